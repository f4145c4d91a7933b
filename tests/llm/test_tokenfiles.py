import zlib

import numpy as np
import pyarrow as pa
import pytest
from common import empty, hard

from flowlens.llm.hashing import pieces, string_parts
from flowlens.llm.tokenfiles import TokenFile, WordEncoder, read_token_files, write_token_files

path = pytest.importorskip("public_tokenizers").path
TOKENIZER = "word_bpe_49k.json"
ODD = [
    "", " ", "Don't stop, it's 3.14!!! we'll 'see' ''quoted'' a'b,'c", "É à Ñandú, ß… «ok»,'x", "x<|endoftext|>y <|startoftext|>", "a\x00b \x01",
    "tab\tnew\nline\x0bvt\x0cff\rcr nbsp sep em", "İstanbul ΣΑΣ ﬁne é ́lone 한국어 emoji😀, 😀a", "a1b22c,3d.e-f_g", "'" * 9 + ",',", "x" * 3000,
]


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    encoder, plain = WordEncoder(path(TOKENIZER)), Tokenizer.from_file(path(TOKENIZER))
    data, offsets = string_parts(pa.array([*ODD, None, *ODD]))
    texts = [*ODD, "", *ODD]
    for first, last in pieces(offsets, 200):
        ids, counts = encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], 2)
        at = 0
        for text, n in zip(texts[first:last], counts.tolist()):
            assert ids[at : at + n].tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text
            at += n


def test_files_hold_all_ids_in_order(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path(TOKENIZER))
    rows = [(i * 7 % 100, ODD[i % len(ODD)] + f" doc {i}") for i in range(100)]
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path(TOKENIZER), 2, length=16)
    got = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    expected, start = [], 0
    for doc, text in sorted(rows):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        row = got[doc]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        expected += ids
    stream = []
    for row in manifest.orderBy("part").collect():
        tokens = TokenFile(row["path"] + ".arrow")
        kept, n = [], 0
        for i in range(-(-row["n_ids"] // 16)):
            ids, mask = tokens.sequence(i)
            assert len(ids) == len(mask) == 16 and ids.dtype == np.uint16
            assert not ids.flags.owndata  # a view of the mapped file
            kept += ids[mask].tolist()
            n += 16
        assert len(kept) == row["n_ids"] and n - len(kept) < 16
        stream += kept
    assert stream == expected


def test_hard_rows(spark):
    manifest = write_token_files(hard(spark), path(TOKENIZER), 2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in read_token_files(manifest).collect())
    assert [g[1] for g in got] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    assert [g[2] for g in got if g[1] in (1, 2, 3)] == [1, 1, 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert read_token_files(write_token_files(empty(spark), path(TOKENIZER), 2)).collect() == []

"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
from common import SMALL, SPACES, ascii_lower
from public_tokenizers import path
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from flowlens.llm.queries import END_ID, ORACLES, QUERIES, WORD_TOKENIZER, clean_labels  # noqa: E402
from flowlens.llm.resampling import importance_resample  # noqa: E402


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SMALL):
        con.execute(f"create view {table[:-8]} as select * from read_parquet('{SMALL}/{table}')")
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(tuple(dict(zip(names, row))[c] for c in sorted(names))) for row in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == expected


@pytest.mark.parametrize("name", ["op4_mix_sources", "op6_positional_decontamination"])
def test_native_plans_have_no_python(spark, name):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def jaccard_sets(rows, size):
    out = {}
    for doc, text in rows:
        words = re.findall(SPACES, ascii_lower(text or ""))
        out[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    return out


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        seen[name], docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_files":
            assert docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    raw, selected = text(seen["quality_classifier"]), text(seen["ngram_jaccard_join"])
    clean = [d for d, (q, t) in labels.items() if q and not t]
    assert sum(d in selected for d in clean) / len(clean) > 0.85
    assert not any(d in selected for d, (q, _) in labels.items() if not q)
    assert all(selected[d] == raw[d] for d in selected)
    drawn = importance_resample(seen["quality_classifier"], clean_labels(spark, SMALL)).where("kept").collect()
    assert selected.keys() == {r["doc_id"] for r in drawn}

    distinct = text(seen["benchmark_decontamination"])
    sets = jaccard_sets(selected.items(), 5)
    for gone in selected.keys() - distinct.keys():
        assert any(5 * len(sets[gone] & s) >= 4 * len(sets[gone] | s) for d, s in sets.items() if d != gone and sets[gone])
    kept = [s for d, s in sets.items() if d in distinct and s]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])

    held = text(seen["source_mixing"])
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = re.findall(word, ascii_lower(r["text"]))
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    for doc, body in distinct.items():
        w = re.findall(word, ascii_lower(body))
        assert (doc in held) == (not any(tuple(w[i : i + 10]) in grams for i in range(len(w))))

    mixed = seen["token_files"].collect()
    total = sum(len(re.findall(SPACES, t)) for t in held.values())
    assert sum(len(re.findall(SPACES, r["text"])) for r in mixed) == pytest.approx(1.5 * total, rel=0.02)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    tokens = sorted(docs.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in tokens] == sorted(r["doc_id"] for r in mixed)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(tokens, tokens[1:]))
    plain = Tokenizer.from_file(path(WORD_TOKENIZER))
    ids = [(r["doc_id"], [*plain.encode(r["text"], add_special_tokens=False).ids, END_ID]) for r in mixed]
    expected = sorted((doc, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for doc, x in ids)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == expected

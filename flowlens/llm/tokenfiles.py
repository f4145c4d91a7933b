"""Token ids of whole texts in Arrow stream files of equal-length sequences and masks.

Documents follow each other in ascending id order, each closed by an end id. A file holds the
stream of one range of ids as record batches of two fixed-size-list columns, ``ids`` and ``mask``;
every batch but the last has the same number of sequences, so sequence i of a file is found by
division and read from a memory map without copying. The mask is false for the padding behind the
last document of a file. Beside it, an index file names each document with its start and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.hashing import WHITESPACE, byte_codes, hashes_at, pieces, string_parts, word_starts
from flowlens.operators.shared import scratch_path, ship_with_tasks, written_table

for _module in (__name__, "flowlens.llm.hashing"):
    ship_with_tasks(_module)

BATCH_SEQUENCES = 64
CACHED_WORDS = 3_000_000
SLOTS = 1 << 22
MANIFEST = "part long, path string, n_documents long, n_ids long"


def _file(path: str):
    """File system and path in it, for plain paths and for URIs that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(use_mmap=True), path


class WordEncoder:
    """Encodes texts word by word, each distinct word once, for tokenizers that never join words.

    That holds where the tokenizer drops white space before anything else looks across it. Where
    trials show that it also parts ASCII letters from punctuation, and takes capitals as small
    letters, words are cut and told apart accordingly, which leaves far fewer of them.
    """

    def __init__(self, path: str):
        import os
        import string

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        marks = [p for p in string.punctuation if p != "'"]
        parts = all(one(f"a{p}b") == one("a") + one(p) + one("b") for p in marks)
        folds = all(one(f"a{c}") == one(f"a{c.lower()}") for c in string.ascii_uppercase)
        self.codes, self.exact_codes = byte_codes(WHITESPACE, lower=folds), byte_codes(WHITESPACE)
        # Texts that spell special tokens are cut at white space alone, capitals and all.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = np.zeros(256, np.uint8)
        if parts:
            self.kinds[list(string.ascii_letters.encode())] = 1
            self.kinds[list("".join(marks).encode())] = 2
        # Ids that end a word, for tokenizers that mark them.
        self.last = np.zeros(size, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # A shortcut to most entries by the low bits of their hash; the last of equal ones has the slot.
        self.slots, self.hashes = np.zeros(SLOTS, np.int32), np.zeros(0, np.uint64)
        self.lengths, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Store the ids of new words, whose hashes ascend."""
        plain = np.array([w.isalpha() for w in words], bool) & self.last.any()
        ids, lengths = self._encode_plain([w for w, p in zip(words, plain) if p])
        rest = [e.ids for e in self.tokenizer.encode_batch([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
        found = np.concatenate([ids, np.array([i for x in rest for i in x], self.kind)])
        sizes = np.concatenate([lengths, np.array([len(x) for x in rest], np.int64)])
        order = np.empty(len(words), np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.known, hashes)
        numbers = np.arange(len(self.starts), len(self.starts) + len(words), dtype=np.int32)
        self.known, self.entry = np.insert(self.known, at, hashes), np.insert(self.entry, at, numbers)
        self.hashes = np.append(self.hashes, hashes)
        self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)] = numbers
        self.starts = np.append(self.starts, starts[order])
        self.lengths = np.append(self.lengths, sizes[order].astype(np.int32))
        self.flat = np.append(self.flat, found)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded many at a time and parted behind the ids that end a word."""
        ids, lengths = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(encoded.ids, self.kind)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(group):  # some word has several parts
                each = [e.ids for e in self.tokenizer.encode_batch(group, add_special_tokens=False)]
                found, ends = np.array([i for x in each for i in x], self.kind), np.cumsum([len(x) for x in each])
            ids.append(found)
            lengths.append(np.diff(np.append(0, ends)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word's entry, and the positions of words that have none yet."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int32), np.arange(len(hashes))
        entry = self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        rest = np.flatnonzero(self.hashes[entry] != hashes)
        at = np.minimum(np.searchsorted(self.known, hashes[rest]), len(self.known) - 1)
        entry[rest] = self.entry[at]
        return entry, rest[self.known[at] != hashes[rest]]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and the number of ids of each text."""
        raw = data.tobytes()
        codes, kinds = self.codes, self.kinds
        if any(token in raw for token in self.special):
            codes, kinds = self.exact_codes, None
        begin = word_starts(data, offsets, codes, kinds)
        hashes, firsts = hashes_at(data, offsets, codes, begin)
        if len(self.known) > CACHED_WORDS:
            self._clear()
        entry, missing = self._entries(hashes)
        if len(missing):
            once, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            size = np.add.reduceat(codes[data] != 0, begin)[at]
            self._learn(once, [raw[a:b].decode() for a, b in zip(begin[at].tolist(), (begin[at] + size).tolist())])
            entry[missing] = self._entries(hashes[missing])[0]
        # The end of a text is an entry like a word: one id behind all others.
        flat = np.append(self.flat, self.kind(end))
        starts = np.insert(self.starts[entry], firsts[1:], len(flat) - 1)
        lengths = np.insert(self.lengths[entry], firsts[1:], 1)
        before = np.cumsum(lengths, dtype=np.int64) - lengths
        out = flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]
        # Entry i of a text comes after one end for each earlier text.
        closing = firsts[1:] + np.arange(len(firsts) - 1)
        return out, np.diff(np.append(-1, before[closing]))


def word_encoder(path: str) -> WordEncoder:
    """One encoder per tokenizer and Python worker; its words serve all tasks that the worker runs.

    It is kept on the tokenizers module, as this module's own globals are new in every task.
    """
    import tokenizers

    encoders = tokenizers.__dict__.setdefault("_word_encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, path: str, kind, length: int):
        system, place = _file(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        ids = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = system.open_output_stream(place)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.kind, self.length, self.rest = kind, length, np.zeros(0, kind)

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        ids, size = np.concatenate([self.rest, ids]), self.length * BATCH_SEQUENCES
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._batch(ids[at : at + size], size)
        self.rest = ids[whole:]

    def close(self) -> None:
        if n := len(self.rest):
            padded = np.zeros(-(-n // self.length) * self.length, self.kind)
            padded[:n] = self.rest
            self._batch(padded, n)
        self.stream.close()
        self.sink.close()


def _write(folder: str, tokenizer: str, end: int, length: int):
    import uuid

    from pyspark import TaskContext

    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # Attempts never share a name; only files that the committed manifest names are read.
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        writer = index = sink = None
        n_ids = n_documents = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = word_encoder(tokenizer)
                writer = _Writer(f"{path}.arrow", encoder.kind, length)
                system, place = _file(f"{path}.index.arrow")
                sink = system.open_output_stream(place)
                index = pa.ipc.new_stream(sink, index_schema)
            data, offsets = string_parts(batch.column(1))
            for first, last in pieces(offsets):
                own = offsets[first : last + 1] - offsets[first]
                ids, counts = encoder.encode(data[offsets[first] : offsets[last]], own, end)
                starts = n_ids + np.cumsum(counts) - counts
                rows = [batch.column(0).slice(first, last - first), pa.array(starts), pa.array(counts)]
                index.write_batch(pa.RecordBatch.from_arrays(rows, schema=index_schema))
                writer.add(ids)
                n_ids, n_documents = n_ids + int(counts.sum()), n_documents + last - first
        if writer is not None:
            writer.close(), index.close(), sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [path], "n_documents": [n_documents], "n_ids": [n_ids]}
            )

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 1024,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and write the files; returns the manifest (part, path, n_documents, n_ids).

    ``tokenizer`` is the path of a tokenizers file whose words never join over white space. Ids are
    stored with 16 bits where the vocabulary allows it. ``folder`` is one that all executors share,
    by default a new one in the cluster's shared folder. Null texts count as empty and give the end
    id alone. Null ids come first; equal ids follow each other in order of their texts. Other columns
    are ignored. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"
    ).sortWithinPartitions("doc_id", "text")
    return written_table(ordered.mapInArrow(_write(folder, tokenizer, end_id, length), MANIFEST), "token-manifest")


class TokenFile:
    """Random access to one file: any sequence with its mask, or any run of ids."""

    def __init__(self, path: str):
        system, place = _file(path)
        self.batches = list(pa.ipc.open_stream(system.open_input_file(place)))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        batch, row = self.batches[i // BATCH_SEQUENCES], i % BATCH_SEQUENCES
        here = slice(row * self.length, (row + 1) * self.length)
        ids = batch.column(0).values.to_numpy()[here]
        return ids, batch.column(1).values.slice(here.start, self.length).to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids start .. start + n - 1, one per batch that holds some of them."""
        size = self.length * BATCH_SEQUENCES
        while n > 0:
            values = self.batches[start // size].column(0).values.to_numpy()
            part = values[start % size : start % size + n]
            yield part
            start, n = start + len(part), n - len(part)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = TokenFile(f"{path}.arrow")
            system, place = _file(f"{path}.index.arrow")
            with system.open_input_file(place) as source:
                for index in pa.ipc.open_stream(source):
                    sums = []
                    for start, n in zip(index.column(1).to_pylist(), index.column(2).to_pylist()):
                        crc = 0
                        for part in tokens.run(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        sums.append(crc)
                    starts = pa.array(index.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays(
                        [index.column(0), starts, index.column(2), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens, crc32 of its ids as 32-bit integers.

    The window without partition sees one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

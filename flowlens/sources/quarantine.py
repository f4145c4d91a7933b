"""Folders of captures landed line by line, with a ledger of files and a quarantine of lines.

One scan of the text writes the ledger: path, header, encoding, lines, longest line and quotes of each file,
as a stored table. Only the distinct headers come to the driver. A second scan joins each line to its file's
entry, parses it, and writes it below its header's folder, or as it stands into the quarantine, with path,
line number and reason. Tables are read from the headers' folders; no list of files is kept anywhere.

Corrected lines are taken back by the ledger: same file, same header, same judgement.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.operators.relational import union_all
from flowlens.operators.schema import normal_name
from flowlens.operators.shared import checked_lookup, collect_lookup, ship_with_tasks, written_table
from flowlens.sources.captures import _LATIN, SOURCE, Captures, _named, _scan, _source_path, _too_long

ship_with_tasks(__name__)

TOO_LONG, ODD_QUOTES = "Line longer than the header", "Quotes that do not pair up"
_NUMBERED = "path string, block long, at long, value binary, utf8 boolean, quotes int, fields int"


@dataclass
class Landing:
    """Rows that were kept, by header; lines that were not; and what is known of each file."""

    captures: Captures
    rejected: DataFrame
    ledger: DataFrame
    headers: dict[int, list[str]]


def _quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).cast("int")


def _fields(line: Column) -> Column:
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("int")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each line within its block of a file. A block is read by one task, from start to end."""
    import numpy as np

    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column(0).dictionary_encode()
        files, names = paths.indices.to_numpy(zero_copy_only=False), paths.dictionary.to_pylist()
        blocks = batch.column(1).to_numpy()
        turns = np.flatnonzero(np.append(True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])))
        at = np.arange(batch.num_rows) - np.repeat(turns, np.diff(np.append(turns, batch.num_rows)))
        if (names[files[0]], int(blocks[0])) == last:
            end = turns[1] if len(turns) > 1 else batch.num_rows
            at[:end] += seen
        last, seen = (names[files[-1]], int(blocks[-1])), int(at[-1]) + 1
        columns = [batch.column(0), batch.column(1), pa.array(at), *batch.columns[2:]]
        yield pa.record_batch(columns, ["path", "block", "at", "value", "utf8", "quotes", "fields"])


def _numbered_lines(spark: SparkSession, folders: Sequence[str], pattern: str) -> DataFrame:
    value = F.col("value")
    lines = (
        spark.read.format("text")
        .option("pathGlobFilter", pattern)
        .load(list(folders))
        .select(
            _source_path().alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            value.cast("binary").alias("value"),
            F.is_valid_utf8(value).alias("utf8"),
            _quotes(value).alias("quotes"),
            _fields(value).alias("fields"),
        )
    )
    return lines.mapInArrow(_number, _NUMBERED)


def _decoded(value: str, latin: str) -> Column:
    # Latin-1 reads any bytes; UTF-8 is decoded only where it was found valid, else as it may be.
    return F.when(F.col(latin), F.decode(value, _LATIN)).otherwise(F.col(value).cast("string"))


def _survey(lines: DataFrame, encoding: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with the number of lines before them, and files with their header, stored."""
    blank = F.trim(F.replace(F.decode("value", _LATIN), F.lit("ï»¿"), F.lit(""))) == ""
    first = F.min(F.when(~blank, F.struct("at", "value")))
    blocks = lines.groupBy("path", "block").agg(
        F.count("*").alias("n"),
        F.count(F.when(~blank, 1)).alias("n_rows"),
        first.alias("first"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_or(F.col("quotes") % 2 == 1).alias("odd"),
        F.sum("quotes").alias("quotes"),
        F.max("fields").alias("fields"),
    )
    blocks = written_table(blocks, "ledger-blocks")
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("path", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    head = F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).alias("head")
    files = blocks.groupBy("path").agg(
        head,
        F.sum("n").alias("lines"),
        F.greatest(F.sum("n_rows") - 1, F.lit(0)).alias("rows"),
        F.max("fields").alias("longest"),
        (~F.bool_and("utf8") & F.lit(encoding == "auto") | F.lit(encoding == _LATIN)).alias("latin"),
        # Quotes that open in one line and close in another: the file is read record by record.
        (F.bool_or("odd") & (F.sum("quotes") % 2 == 0)).alias("broken_lines"),
    )
    files = files.withColumn("raw", F.col("head.first.value"))
    header = F.regexp_replace(_decoded("raw", "latin"), "^﻿", "")
    files = files.select(
        "path",
        header.alias("header"),
        F.col("head.block").alias("head_block"),
        F.col("head.first.at").alias("head_at"),
        "lines",
        "rows",
        "longest",
        "latin",
        "broken_lines",
    )
    return before, written_table(files, "ledger")


def _judged(lines: DataFrame, names: int) -> DataFrame:
    """Lines (text, width) with their fields, and the reason why one is no row."""
    reason = F.when(F.col("fields") > F.col("width"), F.lit(TOO_LONG)).when(F.col("quotes") % 2 == 1, F.lit(ODD_QUOTES))
    schema = ", ".join(f"c{i} string" for i in range(names))
    parsed = F.from_csv(F.col("line"), F.lit(schema), {"escape": '"', "mode": "PERMISSIVE"})
    kept = lines.withColumn("reason", reason).withColumn("parsed", F.when(F.col("reason").isNull(), parsed))
    return kept.select("*", "parsed.*").drop("parsed")


def _tables(rows: DataFrame, headers: dict[int, list[str]], null_tokens: bool) -> tuple[list[DataFrame], list[str]]:
    tables, warnings = [], []
    for number, header in headers.items():
        table, noticed = _named(rows.where(F.col("header_id") == number), header, null_tokens)
        tables.append(table)
        warnings += [w for w in noticed if w not in warnings]
    return tables, warnings


def _present(spark: SparkSession, folders: Iterable[str], pattern: str) -> tuple[list[str], dict[str, str]]:
    found, absent = [], {}
    for folder in folders:
        try:
            empty = spark.read.format("text").option("pathGlobFilter", pattern).load(folder).isEmpty()
        except AnalysisException:
            empty = True
        if empty:
            absent[folder] = "no CSV files"
        else:
            found.append(folder)
    return found, absent


def land_captures(
    spark: SparkSession, folders: Iterable[str], pattern: str = "*.csv", encoding: str = "auto", null_tokens: bool = True
) -> Landing:
    """All lines of the folders' files, as rows by header or in quarantine.

    ``rejected`` has source_file, line_number (from 1, the header's included), reason and raw. A line goes there
    if it has more fields than its file's header, or quotes that do not pair up. Files whose quotes pair up only
    over several lines are read record by record; their records that are too long go there whole, without a
    number. Blank lines are nothing. Short lines are padded with nulls. ``encoding="auto"`` takes Latin-1 for a
    file that is not UTF-8. Missing folders and files without a header are named in ``captures.reasons``.
    """
    found, reasons = _present(spark, folders, pattern)
    if not found:
        raise ValueError("No CSV files were loaded. Check the folder paths and file names.")
    lines = _numbered_lines(spark, found, pattern)
    before, files = _survey(lines, encoding)
    distinct = collect_lookup(files.where("header is not null").select("header").distinct().orderBy("header"))
    if distinct is None:
        raise ValueError("too many different headers")
    headers = {i: next(csv.reader([r["header"]])) for i, r in enumerate(distinct)}
    known = [(r["header"], i, len(headers[i])) for i, r in enumerate(distinct)]
    table = F.broadcast(spark.createDataFrame(known, "header string, header_id int, width int"))
    # A file without a header has only blank lines and is no entry.
    ledger = written_table(files.join(table, "header"), "ledger-files")
    names = max((len(h) for h in headers.values()), default=1)

    entry = checked_lookup(ledger.where("not broken_lines").select("path", "header_id", "width", "latin", "head_block", "head_at"))
    placed = lines.join(entry, "path").join(checked_lookup(before), ["path", "block"])
    placed = placed.withColumn("line", _decoded("value", "latin"))
    placed = placed.where((F.col("block") != F.col("head_block")) | (F.col("at") > F.col("head_at"))).where(F.trim("line") != "")
    judged = _judged(placed, names)
    columns = [f"c{i}" for i in range(names)]
    landed = written_table(
        judged.select(
            F.col("path").alias(SOURCE),
            (F.col("before") + F.col("at") + 1).alias("line_number"),
            "reason",
            F.when(F.col("reason").isNotNull(), F.col("line")).alias("raw"),
            *columns,
            F.col("reason").isNull().alias("kept"),
            "header_id",
        ),
        "landed",
        ["kept", "header_id"],
    )
    tables, warnings = _tables(landed.where("kept"), headers, null_tokens)
    rejected = [landed.where("not kept").select(SOURCE, "line_number", "reason", "raw", "header_id")]
    broken = collect_lookup(ledger.where("broken_lines").select("path", "header_id", "latin"))
    if broken is None:
        raise ValueError("too many files with quoted line breaks")
    for number, latin in sorted({(r["header_id"], r["latin"]) for r in broken}):
        paths = [r["path"] for r in broken if (r["header_id"], r["latin"]) == (number, latin)]
        rows = _scan(spark, paths, headers[number], _LATIN if latin else "UTF-8", True, True)
        bad = F.coalesce(_too_long(len(headers[number])), F.lit(False)).alias("bad")
        rows = written_table(rows.select("*", bad, F.lit(number).alias("header_id")), "records")
        more, noticed = _tables(rows.where("not bad"), {number: headers[number]}, null_tokens)
        tables += more
        warnings += [w for w in noticed if w not in warnings]
        line = [F.lit(None).cast("long").alias("line_number"), F.lit(TOO_LONG).alias("reason"), F.col("__corrupt").alias("raw")]
        rejected.append(rows.where("bad").select(SOURCE, *line, "header_id"))
    has_source = any(SOURCE in map(normal_name, h) for h in headers.values())
    return Landing(Captures(tables, warnings, reasons, has_source), union_all(rejected), ledger, headers)


def take_back(landing: Landing, corrected: DataFrame, null_tokens: bool = True) -> Landing:
    """Corrected lines (source_file, line_number, raw) of a landing, judged again by their files' headers.

    Lines of files that the ledger does not know are left out. Other columns are ignored.
    """
    names = max((len(h) for h in landing.headers.values()), default=1)
    entry = landing.ledger.select(F.col("path").alias(SOURCE), "header_id", "width")
    lines = corrected.select(SOURCE, "line_number", "raw").join(checked_lookup(entry), SOURCE)
    line = F.col("raw")
    lines = lines.withColumns({"line": line, "quotes": _quotes(line), "fields": _fields(line)})
    judged = written_table(_judged(lines, names), "taken-back")
    tables, warnings = _tables(judged.where("reason is null"), landing.headers, null_tokens)
    rejected = judged.where("reason is not null").select(SOURCE, "line_number", "reason", "raw", "header_id")
    return Landing(Captures(tables, warnings, {}, landing.captures.has_source), rejected, landing.ledger, landing.headers)

"""CSV captures to text tables.

Every column lands as text. Types are declared later, so one malformed value costs that value and
not the column. Files are grouped by header, and each group is one distributed scan.
"""

from __future__ import annotations

import csv
import re
import warnings as python_warnings
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import text
from flowlens.operators.relational import union_all
from flowlens.operators.schema import duplicate_warning, first_positions, normal_name, require_columns
from flowlens.operators.shared import ship_with_tasks

ship_with_tasks(__name__)

SOURCE = "source_file"
_CORRUPT = "__corrupt"
_LATIN = "ISO-8859-1"
_HEADER_THREADS = 16


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Paths of the non-empty files below ``path``; a missing path gives none."""
    try:
        return _listing(spark, path, pattern)
    except AnalysisException:
        return []


def _listing(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    # Selecting the path alone lists the files without reading them.
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return sorted(r["path"] for r in reader.load(path).select("path").collect())


def read_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str] | None:
    """Column names of one file as they stand there, or None for an empty file.

    Spark's own header handling renames equal names, so the line is read first.
    """
    reader = spark.read.schema("value string").option("encoding", encoding).option("header", "false")
    # One column and an unused separator make the CSV reader return the decoded line.
    line = reader.option("sep", "\u0001").option("quote", "").csv(path).first()
    if line is None or line["value"] is None:
        return None
    return next(csv.reader([line["value"].lstrip("\ufeff")]))


def read_headers(
    spark: SparkSession, paths: Sequence[str], encodings: dict[str, str] | None = None
) -> dict[str, list[str] | None]:
    """Header per file, read by tasks over the path list; only the first block of each file is fetched.

    Files in a store that the file system library cannot open are asked for through Spark.
    """
    encodings = encodings or {}
    found = _headers_by_tasks(spark, paths, encodings)
    rest = [p for p in paths if p not in found]
    with ThreadPoolExecutor(_HEADER_THREADS) as pool:
        found.update(zip(rest, pool.map(lambda p: read_header(spark, p, encodings.get(p, "UTF-8")), rest)))
    return found


def _headers_by_tasks(spark: SparkSession, paths: Sequence[str], encodings: dict[str, str]) -> dict:
    """First lines read by tasks. Paths the file system library cannot open are left out."""
    rows = [(p, encodings.get(p, "UTF-8")) for p in paths]
    listed = spark.createDataFrame(rows, "path string, encoding string")
    spread = listed.repartition(min(len(paths) // 16 + 1, 2000), "path")
    lines = spread.mapInPandas(_first_lines, "path string, line string").where("line is not null")
    headers = {}
    for row in lines.collect():
        headers[row["path"]] = next(csv.reader([row["line"]])) if row["line"] else None
    return headers


def _first_lines(batches):
    import pandas as pd
    from pyarrow import fs

    for pdf in batches:
        lines = []
        for path, encoding in zip(pdf["path"], pdf["encoding"]):
            try:
                # Spark lists local files as file:/x and S3 files as s3a://; the library differs.
                uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
                system, place = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
                with system.open_input_stream(place) as stream:
                    lines.append(_head_line(stream, encoding))
            except Exception:  # noqa: BLE001 - whatever went wrong, the driver asks Spark instead
                lines.append(None)
        yield pd.DataFrame({"path": pdf["path"], "line": lines})


def _head_line(stream, encoding: str) -> str:
    """First line that is not blank, empty text when there is none."""
    head = b""
    while True:
        block = stream.read(65_536)
        head += block
        # A cut-off last character or line only matters while the file goes on.
        text_lines = head.decode(encoding, "replace").splitlines()
        whole = text_lines if not block else text_lines[:-1]
        for line in whole:
            if line.strip("\ufeff \t"):
                return line.lstrip("\ufeff")
        if not block:
            return ""


@dataclass(frozen=True)
class Survey:
    """What one scan of a file's lines tells before it is parsed."""

    utf8: bool = True
    fields: int = 0  # most fields of a line
    open_quotes: bool = False  # some line has an odd number of quotes, as quoted line breaks do
    balanced: bool = True  # the quotes of the whole file pair up


def survey_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, Survey]:
    """Encoding, line lengths and quotes of each file, in one scan of their text."""
    if not paths:
        return {}
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    # Few lines hold quotes, and only those have quoted parts to take out.
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    facts = (
        spark.read.text(list(paths))
        .select(_source_path().alias("path"), F.is_valid_utf8("value").alias("utf8"), quotes.alias("q"), fields.alias("f"))
        .groupBy("path")
        .agg(
            F.bool_and("utf8").alias("utf8"),
            F.max("f").alias("fields"),
            F.bool_or(F.col("q") % 2 == 1).alias("open_quotes"),
            (F.sum("q") % 2 == 0).alias("balanced"),
        )
    )
    found = {r["path"]: Survey(r["utf8"], r["fields"], r["open_quotes"], r["balanced"]) for r in facts.collect()}
    return {p: found.get(p, Survey()) for p in paths}


def _source_path() -> Column:
    """Path of the row's file as listings spell it; the metadata column escapes it like a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _scan(
    spark: SparkSession,
    paths: Sequence[str],
    header: Sequence[str],
    encoding: str,
    checked: bool = False,
    broken_lines: bool = False,
) -> DataFrame:
    """Files with one common header as text columns named c0, c1, ..., plus path and bad line.

    To notice records of the wrong length the reader's own column pruning has to be off. Files with
    quoted line breaks cannot be split, so only they are read record by record.
    """
    names = [f"c{i}" for i in range(len(header))]
    fields = [T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]]
    rows = (
        spark.read.schema(T.StructType(fields))
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("columnPruning", str(not checked).lower())
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", str(broken_lines).lower())
        .csv(list(paths))
    )
    return rows.select(*names, _CORRUPT, _source_path().alias(SOURCE))


def _named(rows: DataFrame, header: Sequence[str], null_tokens: bool) -> tuple[DataFrame, list[str]]:
    """First column of each normalised name, with missing-value spellings as null."""
    names = [normal_name(c) for c in header]
    keep, repeated = first_positions(names)
    value = text.null_on_read if null_tokens else (lambda c: c)
    columns = [value(F.col(f"c{i}")).alias(names[i]) for i in keep]
    # Written predictions carry the source of their rows already.
    out = rows.select(*columns, *([] if SOURCE in names else [SOURCE]))
    return out, [duplicate_warning(repeated)] if repeated else []


def _too_long(width: int) -> Column:
    """Line with more fields than the header. Short lines are just padded with nulls."""
    bare = F.regexp_replace(F.col(_CORRUPT), '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return F.col(_CORRUPT).isNotNull() & (fields > width)


def _checked(rows: DataFrame, width: int) -> DataFrame:
    """Fail the scan at a line longer than the header, naming file and line start."""
    message = F.concat(
        F.lit("Line longer than the header in "), F.col(SOURCE), F.lit(": "), F.coalesce("c0", F.lit(""))
    )
    fine = F.when(_too_long(width), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.where(fine)


class Captures:
    """Tables read from files, one per header, with what was noticed on the way.

    ``skipped`` names the files left out, ``reasons`` why. ``has_source`` says that files have a
    column of the source's name themselves, which then stands for it.
    """

    def __init__(
        self, tables: list[DataFrame], warnings: list[str], reasons: dict[str, str], has_source: bool = False
    ):
        self.tables, self.warnings, self.reasons, self.has_source = tables, warnings, reasons, has_source

    @property
    def skipped(self) -> list[str]:
        return list(self.reasons)

    def notes(self) -> list[str]:
        return [*self.warnings, *[f"Skipped {path}: {reason}." for path, reason in self.reasons.items()]]

    def table(self, keep_source: bool = False) -> DataFrame:
        """All rows as one table, stacked by column name; what was noticed goes out as Python warnings."""
        for note in self.notes():
            python_warnings.warn(note, stacklevel=2)
        merged = union_all(self.tables)
        return merged if keep_source or self.has_source else merged.drop(SOURCE)


def read_captures(
    spark: SparkSession,
    paths: Sequence[str],
    encoding: str = "UTF-8",
    on_error: str = "raise",
    null_tokens: bool = True,
) -> Captures:
    """Read files of possibly different headers, after one scan of their lines.

    ``encoding="auto"`` takes Latin-1 for a file that is not UTF-8. Quotes inside quoted text are
    doubled, and quoted text may hold line breaks. A file with a line longer than its header, or
    with quotes that do not pair up, is unreadable: ``on_error="skip"`` leaves that whole file out,
    "raise" fails, and "ignore" drops the surplus fields.
    """
    paths = list(paths)
    surveys = survey_files(spark, paths)
    encodings = {p: (encoding if encoding != "auto" else "UTF-8" if surveys[p].utf8 else _LATIN) for p in paths}
    headers = read_headers(spark, paths, encodings)
    groups: dict[tuple, list[str]] = {}
    reasons = {}
    for path in paths:
        header, seen = headers[path], surveys[path]
        if header is None:
            reasons[path] = "no header"
            continue
        problem = None
        if not seen.balanced:
            problem = "Quotes that do not pair up"
        elif seen.fields > len(header) and not seen.open_quotes:
            problem = "Line longer than the header"
        if problem and on_error == "raise":
            raise ValueError(f"{problem} in {path}")
        if problem and on_error == "skip":
            reasons[path] = problem
        else:
            groups.setdefault((tuple(header), encodings[path], seen.open_quotes), []).append(path)
    tables, warnings = [], []
    for (header, charset, broken_lines), files in groups.items():
        # Only where text runs over several lines does the length of a record show in parsing alone.
        rows = _scan(spark, files, header, charset, broken_lines and on_error != "ignore", broken_lines)
        if broken_lines and on_error == "skip":
            bad = rows.where(_too_long(len(header))).groupBy(SOURCE).agg(F.first("c0").alias("at"))
            broken = {r[SOURCE] for r in bad.collect()}
            reasons |= {f: "Line longer than the header" for f in files if f in broken}
            files = [f for f in files if f not in broken]
            if not files:
                continue
            rows = _scan(spark, files, header, charset, broken_lines=True)
        elif broken_lines and on_error == "raise":
            rows = _checked(rows, len(header))
        table, noticed = _named(rows, header, null_tokens)
        warnings += [w for w in noticed if w not in warnings]
        tables.append(table)
    has_source = any(SOURCE in map(normal_name, header) for header, _, _ in groups)
    return Captures(tables, warnings, reasons, has_source)


def open_flows(
    spark: SparkSession, path: str, encoding: str = "UTF-8", null_tokens: bool = True, on_error: str = "raise"
) -> Captures:
    """One file or folder of captures; fails when it is missing or holds no rows."""
    try:
        files = _listing(spark, path)
    except AnalysisException:
        raise FileNotFoundError(f"Input file not found: {path}") from None
    captures = read_captures(spark, files, encoding, on_error, null_tokens)
    if not captures.tables or all(t.isEmpty() for t in captures.tables):
        raise ValueError(f"{path} contains no data rows.")
    return captures


def read_flows(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    null_tokens: bool = True,
    keep_source: bool = False,
    on_error: str = "raise",
) -> DataFrame:
    """The rows of ``open_flows`` as one table."""
    return open_flows(spark, path, encoding, null_tokens, on_error).table(keep_source)


def open_many(
    spark: SparkSession, paths: Iterable[str], missing: str = "skip", encoding: str = "auto", on_error: str = "raise"
) -> Captures:
    """Named files; absent ones are skipped, or raise with ``missing="raise"``."""
    found, absent = [], {}
    for path in paths:
        files = list_files(spark, path)
        if not files:
            if missing == "raise":
                raise FileNotFoundError(f"Input file not found: {path}")
            absent[path] = "not found"
        found += files
    captures = read_captures(spark, found, encoding, on_error)
    if not captures.tables:
        raise ValueError("No files were loaded. Check the input paths.")
    captures.reasons = absent | captures.reasons
    return captures


def read_many(
    spark: SparkSession, paths: Iterable[str], missing: str = "skip", encoding: str = "auto", keep_source: bool = False
) -> DataFrame:
    """The rows of ``open_many`` as one table."""
    return open_many(spark, paths, missing, encoding).table(keep_source)


def open_dirs(spark: SparkSession, folders: Iterable[str], on_error: str = "skip") -> Captures:
    """Every ``*.csv`` of the folders; missing folders and unreadable files are skipped."""
    found, absent = [], {}
    for folder in folders:
        files = list_files(spark, folder, "*.csv")
        if not files:
            absent[folder] = "no CSV files"
        found += files
    captures = read_captures(spark, found, on_error=on_error)
    if not captures.tables:
        raise ValueError("No CSV files were loaded. Check the folder paths and file names.")
    captures.reasons = absent | captures.reasons
    return captures


def read_dirs(
    spark: SparkSession, folders: Iterable[str], on_error: str = "skip", keep_source: bool = False
) -> DataFrame:
    """The rows of ``open_dirs`` as one table."""
    return open_dirs(spark, folders, on_error).table(keep_source)


def read_by_type(spark: SparkSession, folders: Iterable[str]) -> dict[str, DataFrame]:
    """Captures of the folders, stacked per detected schema type."""
    from flowlens.operators.schema import detect_schema

    found = [f for folder in folders for f in list_files(spark, folder, "*.csv")]
    groups: dict[str, list[DataFrame]] = {}
    for table in read_captures(spark, found, on_error="skip").tables:
        groups.setdefault(detect_schema(table.columns).input_type, []).append(table)
    return {kind: union_all(tables) for kind, tables in groups.items()}


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_flows(spark, path), ["predicted_attack"], "predictions")

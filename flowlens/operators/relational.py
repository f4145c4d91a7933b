"""Unions, row dedupe, predicates and dimension joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import domain, threat
from flowlens.operators.schema import normalize_columns


def union_all(dfs: Iterable[DataFrame]) -> DataFrame:
    """Stack tables by normalised column name; a column a table lacks is null there.

    Columns stay text when any two tables disagree on the type, as different files of one
    corpus do; typed projection happens after the union.
    """
    frames = [normalize_columns(df) for df in dfs]
    if not frames:
        raise ValueError("nothing to union")
    types: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}
    aligned = [
        df.select(*[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in df.columns])
        for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row dedupe with null equal to null; copies collapse before the shuffle."""
    return df.dropDuplicates()


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of a row's cells, each spelled as length and text, so that no two different rows spell the same."""
    cells = []
    for name in columns:
        value = F.col(name).cast("string")
        cells.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*cells), 256)


def distinct_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dedupe over whole rows, then project. Only the wanted columns and a digest are shuffled.

    A table without further columns needs no digest.
    """
    if set(df.columns) == set(columns):
        return distinct_rows(df).select(*columns)
    digested = df.select(*columns, row_digest(df.columns).alias("__digest"))
    return digested.dropDuplicates().select(*columns)


def counted_projection(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """Distinct whole rows, projected, with the number of copies of each."""
    digested = df.select(*columns, row_digest(df.columns).alias("__digest"))
    return digested.groupBy(*columns, "__digest").agg(F.count("*").alias(output)).drop("__digest")


def filter_valid_classes(df: DataFrame, column: str = domain.INTRUSION_TARGET) -> DataFrame:
    return df.where(F.col(column).isin(*domain.ATTACK_CLASSES))


def drop_missing_label(df: DataFrame, column: str = domain.INTRUSION_FLAG) -> DataFrame:
    return df.dropna(subset=[column])


def drop_unresolved_class(df: DataFrame, column: str = domain.INTRUSION_TARGET) -> DataFrame:
    return df.dropna(subset=[column])


def malicious_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(threat.is_malicious(F.col(column)))


def intelligence_table(spark: SparkSession) -> DataFrame:
    rows = [
        (cls, *[facts[field] for field in domain.INTELLIGENCE_FIELDS])
        for cls, facts in domain.INTELLIGENCE.items()
    ]
    schema = ", ".join(f"{c} string" for c in ("class", *domain.INTELLIGENCE_FIELDS))
    return spark.createDataFrame(rows, schema)


def enrich_intelligence(df: DataFrame, on: str) -> DataFrame:
    """Add the attack facts of an exact-case class name. The dimension is fixed: ten rows."""
    facts = intelligence_table(df.sparkSession).withColumnRenamed("class", "__class")
    joined = df.join(F.broadcast(facts), F.col(on) == F.col("__class"), "left").drop("__class")
    return joined.withColumns(
        {f: F.coalesce(F.col(f), F.lit(domain.INTELLIGENCE_DEFAULT[f])) for f in domain.INTELLIGENCE_FIELDS}
    )


def align_distributions(p: DataFrame, q: DataFrame, names: Sequence[str] = ("p", "q")) -> DataFrame:
    """Full outer join of two (class, share) tables, an absent class counting 0."""
    left = p.select("class", F.col("share").alias(names[0]))
    right = q.select("class", F.col("share").alias(names[1]))
    return left.join(right, "class", "full_outer").select(
        "class", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]
    )

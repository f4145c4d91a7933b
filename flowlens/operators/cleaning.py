"""The cleaning job over raw intrusion flows, and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, text
from flowlens.operators.relational import counted_projection, distinct_projection, drop_missing_label, drop_unresolved_class, filter_valid_classes
from flowlens.operators.schema import normalize_columns, require_columns
from flowlens.operators.shared import written_table
from flowlens.operators.stats import fit_medians

REQUIRED = (*domain.INTRUSION_COLUMNS, domain.INTRUSION_TARGET, domain.INTRUSION_FLAG)


def typed_flows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Required columns, cleaned and typed but not yet imputed or filtered.

    Stripping is a projection of its own: the rules after it mention the text several times, and
    would otherwise each strip it again.
    """
    types = dict(df.dtypes)
    words = (*domain.INTRUSION_CATEGORICAL, domain.INTRUSION_TARGET)
    numbers = (*domain.INTRUSION_NUMERIC, domain.INTRUSION_FLAG)
    stripped = df.select(
        *keep,
        *[text.strip(text.stringify(F.col(c))).alias(c) for c in words],
        *[numeric.as_number(F.col(c), types[c]).alias(c) for c in numbers],
    )
    return stripped.select(
        *keep,
        *[text.clean_category(F.col(c)).alias(c) for c in domain.INTRUSION_CATEGORICAL],
        *domain.INTRUSION_NUMERIC,
        text.clean_class(F.col(domain.INTRUSION_TARGET)).alias(domain.INTRUSION_TARGET),
        domain.INTRUSION_FLAG,
    )


def clean_flows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dedupe whole rows, type, impute medians, resolve classes, drop what stays unresolved.

    The order decides the result: rows are deduped on all columns before the projection, and
    medians are taken before any row is dropped. ``keep`` names extra columns to carry, such as
    an id or the source file.
    """
    raw = require_columns(normalize_columns(df), (*REQUIRED, *keep), "intrusion flows")
    distinct = distinct_projection(raw, list(dict.fromkeys((*keep, *REQUIRED))))
    # The medians need their own passes, so the one big shuffle is stored and not run again.
    typed = written_table(typed_flows(distinct, keep), "typed")
    medians = fit_medians(typed, domain.INTRUSION_NUMERIC)
    imputed = typed.withColumns(
        {c: numeric.impute(F.col(c), F.lit(medians[c]).cast("double"), guarded=False) for c in medians}
    )
    labelled = drop_missing_label(imputed).withColumns(
        {
            domain.INTRUSION_TARGET: text.resolve_class(
                F.col(domain.INTRUSION_TARGET), numeric.truncate_int(F.col(domain.INTRUSION_FLAG))
            ),
            domain.INTRUSION_FLAG: numeric.truncate_int(F.col(domain.INTRUSION_FLAG)),
        }
    )
    return filter_valid_classes(drop_unresolved_class(labelled))


def typed_by_content(df: DataFrame, declared: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Make text columns numbers: the declared ones always, others when every value parses.

    One aggregate decides for all columns. ``keep`` names columns that stay text.
    """
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in keep]
    open_columns = [c for c in texts if c not in declared]
    numbers = [c for c in texts if c in declared]
    if open_columns:
        unparsed = lambda c: F.col(c).isNotNull() & numeric.coerce_number(F.col(c)).isNull()
        facts = df.agg(*[F.count_if(unparsed(c)).alias(c) for c in open_columns]).first()
        numbers += [c for c in open_columns if facts[c] == 0]
    return df.withColumns({c: numeric.coerce_number(F.col(c)) for c in numbers})


def cleaning_audit(df: DataFrame) -> DataFrame:
    """Row counts after each cleaning step, in one pass with a single shuffle."""
    raw = require_columns(normalize_columns(df), REQUIRED, "intrusion flows")
    distinct = counted_projection(raw, REQUIRED, "__copies")
    typed = typed_flows(distinct, ("__copies",))
    flag = numeric.truncate_int(F.col(domain.INTRUSION_FLAG))
    facts = typed.select(
        "__copies",
        F.col(domain.INTRUSION_FLAG).isNotNull().alias("labelled"),
        text.resolve_class(F.col(domain.INTRUSION_TARGET), flag).alias("cls"),
    )
    labelled, resolved = F.col("labelled"), F.col("cls").isNotNull()
    valid = F.col("cls").isin(*domain.ATTACK_CLASSES)
    return facts.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_in"),
        F.count("*").alias("after_dedupe"),
        F.count_if(~labelled).alias("dropped_missing_label"),
        F.count_if(labelled & ~resolved).alias("dropped_unresolved"),
        F.count_if(labelled & resolved & ~valid).alias("removed_invalid"),
        F.count_if(labelled & resolved & valid).alias("rows_out"),
    )


def corpus_audit(df: DataFrame) -> DataFrame:
    """Rows before and after the full-row dedupe of a merged corpus."""
    copies = counted_projection(df, [], "__copies")
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_in"), F.count("*").alias("after_dedupe")
    )

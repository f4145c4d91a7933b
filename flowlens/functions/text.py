"""String cleaning: strip, lower-case, null tokens, value maps and fills."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions import domain


# ---- fixed values: whitespace --------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace of every kind; plain ``trim`` drops only spaces."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_lower(col: Column) -> Column:
    return F.lower(strip(col))


def stringify(col: Column) -> Column:
    return col.cast("string")


def null_if_in(col: Column, tokens: Iterable[str]) -> Column:
    return F.when(~col.isin(*tokens), col)


def null_on_read(col: Column) -> Column:
    """Null out the spellings a CSV reader takes for missing; a lone dash stays a value."""
    return null_if_in(col, domain.READ_NULL_TOKENS)


def clean_category(col: Column, fill: str = domain.TRAINING_FILL) -> Column:
    """Category from stripped text, its missing-value spellings filled."""
    return F.when(col.isNull() | col.isin(*domain.CATEGORY_NULL_TOKENS), F.lit(fill)).otherwise(col)


def map_values(col: Column, mapping: Mapping[str, str]) -> Column:
    chain = None
    for old, new in mapping.items():
        chain = (F if chain is None else chain).when(col == old, F.lit(new))
    return col if chain is None else chain.otherwise(col)


def clean_class(col: Column) -> Column:
    """Class name from stripped text: missing-value spellings become null, aliases their class."""
    chain = F.when(col.isin(*domain.CLASS_NULL_TOKENS), F.lit(None).cast("string"))
    for old, new in domain.CLASS_ALIASES.items():
        chain = chain.when(col == old, F.lit(new))
    return chain.otherwise(col)


def resolve_class(cls: Column, flag: Column) -> Column:
    """A flow without a class whose flag says "no attack" is benign."""
    return F.when(cls.isNull() & (flag == 0), F.lit(domain.BENIGN_CLASS)).otherwise(cls)


def fill_constant(col: Column, value: str) -> Column:
    return F.coalesce(col, F.lit(value))


def prepare_category(col: Column, fill: str | None, lower: bool = True) -> Column:
    """Category as a model sees it. ``fill=None`` keeps nulls, which one-hot to all zeros."""
    text = stringify(col) if fill is None else fill_constant(stringify(col), fill)
    return strip_lower(text) if lower else text

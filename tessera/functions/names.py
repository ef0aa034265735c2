"""Names and ids: unevenly written names are equal by their letters and digits, ids are equal after trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_key(col: Column | str) -> Column:
    """Lower case, ASCII letters and digits only; null stays null, a name without any such character becomes ''."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def trimmed(col: Column | str) -> Column:
    """Without white space at either end; blank becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    cut = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.when(cut != "", cut)


def missing(col: Column | str) -> Column:
    """True for null and NaN."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | F.isnan(col)


def canonical(df: DataFrame, column: str, names: DataFrame, name: str, out: str) -> DataFrame:
    """Adds ``out``: the spelling in ``names.name`` of the name in ``column``; null where no listed name matches."""
    lookup = names.select(name_key(name).alias("__key"), F.col(name).alias(out)).filter("__key != ''")
    lookup = lookup.groupBy("__key").agg(F.min(out).alias(out))
    return df.withColumn("__key", name_key(column)).join(lookup, "__key", "left").drop("__key")

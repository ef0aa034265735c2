"""Numbers: log-probabilities of letters, vectors, declared option counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6  # probability of a letter that the model does not list


def log_sum_exp(values: Column) -> Column:
    """Stable log of the sum of exponentials of an array; null for an empty array."""
    top = F.array_max(values)
    return F.when(F.size(values) > 0, top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def letter_logprobs(top: Column, k: Column) -> Column:
    """Log-probability of each of the first k letters from array<struct<token, logprob>>; variants of a letter (blank, case,
    bracket) are added up, letters without any get the floor."""
    clean = F.transform(top, lambda t: F.struct(F.upper(F.regexp_replace(t["token"], r"[\s().\[\]:]", "")).alias("l"), t["logprob"].alias("p")))
    one = lambda i: F.transform(F.filter(clean, lambda t: t["l"] == F.char(i + 65)), lambda t: t["p"])
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.coalesce(log_sum_exp(one(i)), F.log(F.lit(FLOOR))))


def margin(lp: Column, gold: Column) -> Column:
    """Log-probability of the gold minus the mean of the others; null without a gold or another option."""
    own = F.try_element_at(lp, gold + 1)
    total = F.aggregate(lp, F.lit(0.0), lambda a, v: a + v)
    return own - (total - own) / F.nullif(F.size(lp) - 1, F.lit(0))


def argmax(lp: Column) -> Column:
    """0-based place of the first largest value; null for an empty array."""
    return F.when(F.size(lp) > 0, (F.array_position(lp, F.array_max(lp)) - 1).cast("int"))


def confidence(lp: Column) -> Column:
    """Probability of the best letter among the listed ones."""
    return F.exp(F.array_max(lp) - log_sum_exp(lp))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; for unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def declared_counts(text: Column) -> Column:
    """Sorted distinct positive whole numbers in a text such as '4 or 5'; empty for none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n > 0)))


def declared_chance(text: Column) -> Column:
    """Mean of 1/n over the whole numbers in a text; null for none. Repeated numbers count repeatedly."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    found = F.filter(found, lambda n: n > 0)
    return F.aggregate(found, F.lit(0.0), lambda a, n: a + 1.0 / n) / F.nullif(F.size(found), F.lit(0))


def width_threshold(chance: Column, n: Column, z: float = 2.326) -> Column:
    """z * sqrt(c (1 - c) / n): the spread that chance alone would give."""
    return F.lit(z) * F.sqrt(F.greatest(chance * (1 - chance), F.lit(0.0)) / F.nullif(n, F.lit(0)))

"""Sources: annotation files in many formats, result logs, nested records, role detection, declarative specs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.options import typed_answer
from tessera.operators.ranks import exact_rank
from tessera.storage import Scratch

# Names under which a column plays a role, in order of preference (compared without case, blanks and dashes).
ROLES = {
    "video": ["video", "video_id", "video_path", "video_name", "vid", "videoid", "clip", "file_name", "filename"],
    "question": ["question", "query", "prompt", "q", "instruction"],
    "answer": ["answer", "gold", "correct_answer", "label", "correct_choice", "gt", "a"],
    "options": ["options", "choices", "candidates", "option", "multiple_choice"],
    "subtask": ["subtask", "task", "task_type", "category", "question_type", "type"],
}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; blank, broken and truncated lines are dropped; a missing path has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return len(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []) > 0


def read_annotations(spark: SparkSession, path: str, kind: str | None = None, records: str | None = None) -> DataFrame:
    """All annotation files below ``path`` of one kind (parquet, jsonl, json, csv, tsv), hidden files skipped, with ``file``.

    Binary columns are dropped. A JSON file holds a list of records, or an object in which ``records`` (a dotted path with
    ``*`` for every entry) or the first list of records is taken.
    """
    kind = kind or os.path.splitext(path)[1].lstrip(".").lower()
    read = spark.read.option("recursiveFileLookup", "true")
    if kind == "parquet":
        df = read.parquet(path)
    elif kind in ("jsonl", "ndjson"):
        df = read.option("mode", "DROPMALFORMED").json(path)
    elif kind == "json":
        df = read.option("multiLine", "true").json(path)
        if records:
            df = unnest(df, records)
        else:
            lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
            if lists and not any(n in ROLES["question"] for n in df.columns):
                df = unnest(df, f"{lists[0]}.*")
    elif kind in ("csv", "tsv"):
        df = read.option("header", "true").option("mode", "DROPMALFORMED").option("multiLine", "true").option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        raise ValueError(f"no reader for {kind!r}")
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    return df.select(*keep, F.col("_metadata.file_path").alias("file")) if kind not in ("json",) else df.select(*keep)


def match_files(df: DataFrame, pattern: str, column: str = "file") -> DataFrame:
    """Rows of files whose path or base name matches a shell pattern, or whose path contains it."""
    shell = "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    base = F.regexp_extract(column, r"([^/]+)$", 1)
    return df.filter(F.col(column).rlike(shell) | base.rlike(shell) | F.contains(F.col(column), F.lit(pattern)))


def unnest(df: DataFrame, path: str) -> DataFrame:
    """Records at a dotted path with ``*`` for every entry of a list or map; scalars of enclosing objects are inherited, the
    record's own fields win; the key of a map entry is ``key``."""
    cur, at = df.withColumn("__ctx", F.struct(F.lit(1).alias("__one"))), None
    inherited: dict[str, Column] = {f.name: F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    cur = cur.select(F.struct(*df.columns).alias("__at"), *[c.alias(f"__in_{n}") for n, c in inherited.items()])
    names = list(inherited)
    for part in path.split("."):
        kind = cur.schema["__at"].dataType
        if part == "*":
            if isinstance(kind, T.MapType):
                cur = cur.select("*", F.explode("__at").alias("__k", "__v")).drop("__at").withColumnRenamed("__v", "__at")
                cur = cur.drop("__in_key").withColumnRenamed("__k", "__in_key")
                names = [*[n for n in names if n != "key"], "key"]
            elif isinstance(kind, T.StructType):  # an inferred object: its fields are the entries
                entries = F.array(*[F.struct(F.lit(f.name).alias("k"), F.col(f"__at.`{f.name}`").alias("v")) for f in kind.fields])
                cur = cur.withColumn("__e", F.explode(entries)).drop("__at", "__in_key").select("*", F.col("__e.k").alias("__in_key"), F.col("__e.v").alias("__at")).drop("__e")
                names = [*[n for n in names if n != "key"], "key"]
            else:
                cur = cur.withColumn("__at", F.explode("__at"))
        else:
            cur = cur.withColumn("__at", F.col(f"__at.`{part}`"))
        kind = cur.schema["__at"].dataType
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
                    cur = cur.withColumn(f"__in_{f.name}", F.col(f"__at.`{f.name}`"))
                    names = [*[n for n in names if n != f.name], f.name]
    kind = cur.schema["__at"].dataType
    own = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
    rest = [F.col(f"__in_{n}").alias(n) for n in names if n not in own]
    return cur.select(*[F.col(f"__at.`{n}`").alias(n) for n in own], *rest) if own else cur.select(F.col("__at").alias("value"), *rest)


def detect(df: DataFrame, role: str) -> str | None:
    """The first name of a role that a column has."""
    plain = {re.sub(r"[\s_-]", "", c).lower(): c for c in reversed(df.columns)}
    return next((plain[k] for n in ROLES[role] if (k := re.sub(r"[\s_-]", "", n)) in plain), None)


def latest_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``: later rows replace earlier ones for readers."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def first_scored(df: DataFrame, key: list[str], order: list[str], correct: str = "correct") -> DataFrame:
    """First row per key among the scored ones."""
    scored = df.filter(F.col(correct).isNotNull())
    return scored.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def overlay_metadata(base: DataFrame, layers: list[DataFrame], key: str = "name") -> DataFrame:
    """Benchmark table with later layers' non-null fields winning; names that only a layer has are added."""
    out = base
    for layer in layers:
        both = [c for c in layer.columns if c != key]
        new = layer.select(key, *[F.col(c).alias(f"__n_{c}") for c in both])
        joined = out.join(new, key, "full_outer")
        names = [*out.columns, *[c for c in both if c not in out.columns]]
        out = joined.select(*[c if c == key or c not in both else (F.coalesce(f"__n_{c}", c) if c in out.columns else F.col(f"__n_{c}")).alias(c) for c in names])
    return out


def result_files(spark: SparkSession, root: str, condition: str) -> DataFrame:
    """A Hive-partitioned result log (condition=/benchmark=/model=), pruned to one condition."""
    return spark.read.parquet(root).filter(F.col("condition") == condition)


# Templates: {field|converter:argument|...}; a plain name returns the column with its type.


def _seconds(c: Column, _: str) -> Column:
    v = c.cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", ""))


CONVERTERS: dict[str, Callable[[Column, str], Column]] = {
    "int": lambda c, _: c.cast("double").cast("long").cast("string"),
    "sec": _seconds,
    "str": lambda c, _: c.cast("string"),
    "basename": lambda c, _: F.regexp_extract(c.cast("string"), r"([^/]*)$", 1),
    "stem": lambda c, _: F.regexp_replace(F.regexp_extract(c.cast("string"), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""),
    "first": lambda c, _: F.try_element_at(c, F.lit(1)),
    "strip": lambda c, a: F.ltrim(c.cast("string"), F.lit(a or " ")),
    "dir0": lambda c, _: F.split(c.cast("string"), "/")[0],
    "lower": lambda c, _: F.lower(c.cast("string")),
    "letter0": lambda c, _: F.char(c.cast("int") + 65),
    "letter1": lambda c, _: F.char(c.cast("int") + 64),
}


def template(spec: str) -> Column:
    """A template as one expression; null as soon as a field that it names is null or NaN."""
    if "{" not in spec:
        return F.col(spec)
    parts, last = [], 0
    for m in re.finditer(r"\{([^{}|]+)((?:\|[^{}|]+)*)\}", spec):
        parts.append(F.lit(spec[last : m.start()]))
        value = F.col(m[1].strip())
        for step in filter(None, m[2].split("|")):
            name, _, argument = step.strip().partition(":")
            value = CONVERTERS[name](value, argument)
        text = value.cast("string")
        parts.append(F.when(text != "NaN", text))
        last = m.end()
    return F.concat(*parts, F.lit(spec[last:]))


def passes(rule: dict) -> Column:
    """A declarative filter: equals, in, not_in (any case), truthy, matches (regular expression)."""
    v, text = F.col(rule["field"]), F.col(rule["field"]).cast("string")
    if "equals" in rule:
        return F.coalesce(text == str(rule["equals"]), F.lit(rule["equals"] is None))
    if "in" in rule:
        return F.coalesce(F.lower(text).isin([str(x).lower() for x in rule["in"]]), F.lit(False))
    if "not_in" in rule:
        return ~F.coalesce(F.lower(text).isin([str(x).lower() for x in rule["not_in"]]), F.lit(False))
    if "truthy" in rule:
        return F.coalesce(~F.lower(text).isin("", "0", "0.0", "false"), F.lit(False)) == F.lit(bool(rule["truthy"]))
    if "matches" in rule:
        return F.coalesce(text, F.lit("")).rlike(rule["matches"])
    raise ValueError(f"{v}: a filter needs equals, in, not_in, truthy or matches")


@dataclass
class IngestSpec:
    """How one benchmark's annotation rows become records; unknown keys raise."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    option_fields: list[str] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    answer_type: str = ""
    keep: str = "all"
    dedupe: bool = False

    @classmethod
    def from_yaml(cls, text: str) -> IngestSpec:
        return cls(**yaml.safe_load(interpolate(text)))


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """Replaces ${NAME:-default} by the environment's value."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


def records(rows: DataFrame, spec: IngestSpec, order: str) -> DataFrame:
    """(n, v, q, a, opts, sub): filtered, projected and numbered in the order of the sequence column ``order``.

    ``order`` must be unique. Rows without a video or question, or with an answer that cannot be typed, are dropped. ``dedupe`` keeps the first row per
    video and first 200 characters of the question. Numbering comes before ``keep: mcq``, so ids do not depend on it.
    """
    for rule in spec.filters:
        rows = rows.filter(passes(rule))
    role = lambda r: template(spec.fields[r]) if r in spec.fields else (F.col(c) if (c := detect(rows, r)) else None)
    v, q, a, sub = role("video"), role("question"), role("answer"), role("subtask")
    if v is None or q is None:
        raise ValueError(f"{spec.name}: no video or question column among {rows.columns}")
    if spec.option_fields:
        texts = F.array(*[F.trim(F.col(c).cast("string")) for c in spec.option_fields])
        opts = F.filter(texts, lambda o: o.isNotNull() & ~o.isin("", "nan"))
        opts = F.when(F.size(opts) > 0, opts)
    else:
        opts = role("options")
    out = rows.select(F.col(order).alias("__o"), v.cast("string").alias("v"), q.cast("string").alias("q"), (a if a is not None else F.lit("")).cast("string").alias("a"), (opts if opts is not None else F.lit(None).cast("array<string>")).alias("opts"), F.coalesce(sub.cast("string") if sub is not None else F.lit(None), F.lit("_none")).alias("sub"))
    out = out.filter(F.col("q").isNotNull() & (F.coalesce(F.trim("v"), F.lit("")) != ""))
    if spec.answer_type:
        out = out.withColumn("a", typed_answer(F.col("a"), spec.answer_type)).filter("a is not null")
    if spec.dedupe:
        out = out.withColumn("__q", F.substring("q", 1, 200))
        out = out.groupBy("v", "__q").agg(F.min_by(F.struct("__o", "q", "a", "opts", "sub"), "__o").alias("__r")).select("v", "__r.*")
    places = exact_rank(out.select("__o"), [], ["__o"], "__n", Scratch(rows.sparkSession))  # file order is global; only the key is ranked
    out = out.join(places, "__o").select((F.col("__n") - 1).cast("int").alias("n"), "v", "q", "a", "opts", "sub")
    if spec.keep == "mcq":
        out = out.filter(F.coalesce(F.size("opts") >= 2, F.lit(False)) & F.trim("a").rlike(r"^\(?[A-Pa-p]\)?\.?$"))
    return out

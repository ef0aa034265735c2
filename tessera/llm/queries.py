"""The pN_ queries over the test tables, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import canonical, missing, name_key, trimmed
from tessera.llm import capping, components, consensus, diverse, mixing, mojibake, neardup, proportions, tokens
from tessera.operators.ranks import latest_rows
from tessera.storage import Scratch

LINK_ABOVE = 0.90
TWO_THIRDS = 2 / 3
CAP_SHARE = 0.05
MIN_JUDGES = 3


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def latest_items(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The latest row of every item; rows without an id are no items."""
    items = _read(spark, folder, "items").withColumn("item_id", trimmed("item_id")).filter("item_id is not null")
    return latest_rows(items, ["item_id"], "row_seq", ["item_id", *columns])


# 1: groups of matched items


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "dedup").select(trimmed("item_id").alias("a"), trimmed("kept").alias("b"), "cos_to_kept")
    return rows.filter(missing("cos_to_kept") | (F.col("cos_to_kept") > LINK_ABOVE)).select("a", "b")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.connected_groups(_links(spark, folder)).withColumnRenamed("id", "item_id")


def p1_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    groups = p1_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("items"))
    return groups.groupBy("items").agg(F.count("*").alias("groups"))


# 2: consensus of judges


def judge_votes(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, model, judge, category): the latest vote of each judge on each instance; ties go to the later row, then to the
    later place in the row. Judges are named by their letters and digits. Unusable replies and unstable rows hold no vote."""
    rows = _read(spark, folder, "attribution_row_labels").select(trimmed("qid").alias("qid"), trimmed("model").alias("model"), "status", "judge_categories", "judged_at", "row_seq")
    rows = rows.filter("qid is not null and model is not null and judge_categories is not null").filter(F.coalesce(name_key("status"), F.lit("")) != "unstable")
    pieces = rows.select("qid", "model", "judged_at", "row_seq", F.posexplode(F.split("judge_categories", r"[|;,{}\n]")).alias("place", "piece"))
    pair = F.split("piece", "[:=]", 2)
    pieces = pieces.filter(F.col("piece").rlike("[:=]")).select("qid", "model", "judged_at", "row_seq", "place", name_key(pair[0]).alias("judge"), pair[1].alias("said"))
    votes = canonical(pieces.filter("judge != ''"), "said", _read(spark, folder, "failure_taxonomy"), "category", "category").filter("category is not null")
    last = F.max_by("category", F.struct("judged_at", "row_seq", "place")).alias("category")
    return votes.groupBy("qid", "model", "judge").agg(last)


def _consensus(spark: SparkSession, folder: str) -> tuple[consensus.Votes, consensus.VoteModel]:
    scratch = Scratch(spark)
    votes = consensus.gather_votes(judge_votes(spark, folder), ["qid", "model"], "judge", "category", scratch)
    return votes, consensus.fit(votes, scratch)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    votes, model = _consensus(spark, folder)
    return consensus.decide(votes, ["qid", "model"], model, MIN_JUDGES).select("qid", "model", "category")


def p2_consensus(spark: SparkSession, folder: str) -> DataFrame:
    votes, model = _consensus(spark, folder)
    return consensus.decide(votes, ["qid", "model"], model)


def p2_judges(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(*_consensus(spark, folder))


# 3: a varied subset


def p3_subset(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the items, varied by video, length, capability group and benchmark."""
    items = latest_items(spark, folder, ["video_id", "duration_s", "capability_group", "benchmark"])
    scratch = Scratch(spark)
    items = scratch.put(items)
    length = F.when(~missing("duration_s") & (F.col("duration_s") > 0) & (F.col("duration_s") < 1e7), F.floor(F.log2("duration_s")))
    name = lambda c: F.when(name_key(c) != "", name_key(c))
    coarse = {"length": length, "group": name("capability_group"), "benchmark": name("benchmark")}
    return diverse.diverse_subset(items, "item_id", {"video": trimmed("video_id")}, coarse, items.count() // 10, scratch)


# 4: lightly changed copies


def _words() -> Column:
    return neardup.word_set(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.concat_ws(" ", "options")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    items = latest_items(spark, folder, ["question", "options"])
    return neardup.near_duplicate_pairs(items, "item_id", _words(), TWO_THIRDS).withColumnsRenamed({"a": "item_id_a", "b": "item_id_b"})


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    items = latest_items(spark, folder, ["question", "options"])
    return neardup.near_duplicate_groups(items, "item_id", _words(), TWO_THIRDS).withColumnRenamed("key", "item_id")


# 5: sample by target proportions

DIMENSIONS = ("benchmark", "capability_group", "fine_category")


def _named_items(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """(dimension, item_id, name) with canonical names, for the three fields of an item."""
    items = scratch.put(latest_items(spark, folder, list(DIMENSIONS)))
    fields = F.array(*[F.struct(F.lit(d).alias("dimension"), name_key(d).alias("__k")) for d in DIMENSIONS])
    long = items.select("item_id", F.explode(fields).alias("x")).select("item_id", "x.*")
    names = _read(spark, folder, "mix_targets").select("dimension", name_key("target_name").alias("__k"), F.col("target_name").alias("name"))
    return long.join(names, ["dimension", "__k"]).select("dimension", "item_id", "name"), items.count()


def _reports(spark: SparkSession, folder: str, scratch: Scratch) -> tuple[dict[str, DataFrame], DataFrame]:
    named, n_items = _named_items(spark, folder, scratch)
    named = scratch.put(named)
    counts = scratch.put(named.groupBy("dimension", "name").agg(F.count("*").alias("n")))
    targets = _read(spark, folder, "mix_targets").withColumnRenamed("target_name", "name")
    parents = {
        "benchmark": _read(spark, folder, "benchmark_meta").select(F.col("benchmark").alias("name"), F.coalesce(name_key("question_format"), F.lit("")).alias("parent")),
        "fine_category": _read(spark, folder, "failure_taxonomy").select(F.col("category").alias("name"), F.col("capability_group").alias("parent")),
        "capability_group": None,
    }
    pick = lambda df, d: df.filter(F.col("dimension") == d).drop("dimension")
    return {d: proportions.allocation_report(pick(counts, d), pick(targets, d), parents[d], n_items // 10) for d in DIMENSIONS}, named


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    reports, _ = _reports(spark, folder, Scratch(spark))
    out = None
    for d, r in reports.items():
        r = r.select(F.lit(d).alias("dimension"), F.col("name").alias("target_name"), "target_pm", "min_items", "wanted", "available", "allocated", "unmet")
        out = r if out is None else out.union(r)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_report(spark, folder).filter("unmet > 0").select("dimension", "target_name")


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn items of each dimension's sample."""
    scratch = Scratch(spark)
    reports, named = _reports(spark, folder, scratch)
    out = None
    for d, r in reports.items():
        part = proportions.draw(named.filter(F.col("dimension") == d), "name", "item_id", r, scratch)
        out = part if out is None else out.union(part)
    return out.select("dimension", F.col("name").alias("target_name"), "item_id")


# 6: no benchmark above its cap


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    items = scratch.put(latest_items(spark, folder, ["benchmark", "attack_pct"]))
    cap = int(items.count() * round(CAP_SHARE * 100) // 100)
    who = F.when(name_key("benchmark") != "", name_key("benchmark"))
    return capping.split_by_cap(items, who, F.col("attack_pct"), "item_id", cap, scratch)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).filter("not within_cap").select("item_id")


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).filter("within_cap").select("item_id", name_key("benchmark").alias("benchmark_key"), "attack_pct")


# 7: ids of a public tokenizer


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, folder, "documents"), "doc_id", "text")


# 8: a mixture by source


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    docs = _read(spark, folder, "documents")
    sizes = tokens.encode_corpus(docs, "doc_id", "text", count=True, carry="source").withColumnRenamed("source", "__raw")
    targets = _read(spark, folder, "source_targets")
    named = canonical(sizes, "__raw", targets, "source", "source")
    sized = scratch.put(named.select("source", F.col("doc_id").alias("key"), F.col("n_tokens").alias("size")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    return mixing.mix(sized, targets, total, scratch)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0].select("source", F.col("key").alias("doc_id"), F.col("size").alias("n_tokens"), "repeats")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).filter("short").select("source")


# 9: garbled text


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.find_garbled(_read(spark, folder, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_restored(spark, folder).select("doc_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_group_sizes, p2_found, p2_consensus, p2_judges, p3_subset, p4_found, p4_groups, p5_found, p5_report, p5_sample, p6_found, p6_kept, p7_ids, p8_found, p8_shares, p8_mixture, p9_found, p9_restored)
}

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_ID = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
_LATEST = f"""latest as (select item_id, max_by(benchmark, row_seq) as benchmark, max_by(struct_pack(v := attack_pct), row_seq).v as attack_pct,
  max_by(struct_pack(v := capability_group), row_seq).v as capability_group, max_by(struct_pack(v := fine_category), row_seq).v as fine_category,
  max_by(struct_pack(v := question), row_seq).v as question, max_by(struct_pack(v := options), row_seq).v as options
  from (select * replace ({_ID.format("item_id")} as item_id) from items) where item_id is not null group by item_id)"""

_GROUPS = f"""links as (select distinct a, b from (select {_ID.format("item_id")} as a, {_ID.format("kept")} as b, cos_to_kept as c from dedup)
  where a is not null and b is not null and a <> b and (c is null or isnan(c) or c > 0.90)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
groups as (select a as item_id, least(a, min(b)) as group_id from reach group by a)"""

ORACLE = {
    "p1_found": f"with recursive {_GROUPS} select item_id, group_id from groups",
    "p1_group_sizes": f"with recursive {_GROUPS} select items, count(*) as groups from (select group_id, count(*) as items from groups group by 1) group by 1",
    "p4_found": rf"""with {_LATEST}, words as (select distinct item_id, w from (select item_id,
  unnest(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(array_to_string(options, ' '), '')), '[\p{{L}}\p{{N}}]+')) as w from latest)
  where not regexp_full_match(w, '\P{{N}}')), n as (select item_id, count(*) as n from words group by 1),
c as (select x.item_id as a, y.item_id as b, count(*) as c from words x join words y on x.w = y.w and x.item_id < y.item_id group by 1, 2)
select a as item_id_a, b as item_id_b from c join n na on na.item_id = a join n nb on nb.item_id = b where c * 3 >= 2 * (na.n + nb.n - c)""",
    "p4_groups": rf"""with recursive {_LATEST}, words as (select distinct item_id, w from (select item_id,
  unnest(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(array_to_string(options, ' '), '')), '[\p{{L}}\p{{N}}]+')) as w from latest)
  where not regexp_full_match(w, '\P{{N}}')), n as (select item_id, count(*) as n, string_agg(w, ' ' order by w) as s from words group by 1),
c as (select x.item_id as a, y.item_id as b, count(*) as c from words x join words y on x.w = y.w and x.item_id <> y.item_id group by 1, 2),
e as (select a, b from c join n na on na.item_id = a join n nb on nb.item_id = b where c * 3 >= 2 * (na.n + nb.n - c)),
reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a), g as (select a, min(b) as m from reach group by 1), l as (select a, count(*) as links from e group by 1)
select item_id, min(item_id) over (partition by s) as class, least(item_id, coalesce(m, item_id)) as group_id, coalesce(links, 0) as links from n left join g on g.a = item_id left join l on l.a = item_id""",
    "p5_found": f"""with {_LATEST}, named as (select 'benchmark' as dimension, {_KEY.format("benchmark")} as k from latest
  union all select 'capability_group', {_KEY.format("capability_group")} from latest union all select 'fine_category', {_KEY.format("fine_category")} from latest),
counts as (select dimension, k, count(*) as n from named group by 1, 2), total as (select count(*) // 10 as n from latest)
select t.dimension, target_name from mix_targets t cross join total left join counts c on c.dimension = t.dimension and c.k = {_KEY.format("target_name")}
where greatest(min_items, target_pm * total.n // 1000) > coalesce(c.n, 0)""",
    "p6_found": f"""with {_LATEST}, total as (select count(*) * 5 // 100 as cap from latest),
ranked as (select item_id, row_number() over (partition by {_KEY.format("benchmark")} order by case when attack_pct >= 0 and attack_pct <= 1 and not isnan(attack_pct) then attack_pct else 2 end, item_id) as r
  from latest where {_KEY.format("benchmark")} <> '') select item_id from ranked, total where r > cap""",
    "p6_kept": f"""with {_LATEST}, total as (select count(*) * 5 // 100 as cap from latest),
ranked as (select item_id, {_KEY.format("benchmark")} as k, attack_pct, row_number() over (partition by {_KEY.format("benchmark")} order by case when attack_pct >= 0 and attack_pct <= 1 and not isnan(attack_pct) then attack_pct else 2 end, item_id) as r from latest)
select item_id, k as benchmark_key, attack_pct from ranked, total where r <= cap or coalesce(k, '') = ''""",
}

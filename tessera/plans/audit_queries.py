"""Registered queries of the audit, pool and attribution operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import frames, text
from tessera.functions.names import name_key, trimmed
from tessera.operators import aggregates, joins, reports, rules, sampling
from tessera.plans import attribution, exports, levels, permutations, pool
from tessera.plans.queries import _ATTACK, _ID, _KEY, CAPABILITIES, ITEMS, LABELS, ORACLE, QUERIES, RESULTS, _attack, items, labels, query, r6, read, results

__all__ = ["ORACLE", "QUERIES"]  # the same tables as those of the core queries

# Audit rows: the attackers of a line stand-in, named by kind and level.

KINDS = ["blind:a", "single_frame:a", "shuffle:a", "window:a", "options_only:a", "captions:a", "fixed_position"]
_NAMES = "(['blind:a', 'single_frame:a', 'shuffle:a', 'window:a', 'options_only:a', 'captions:a', 'fixed_position'])[l_linenumber::int]"
_LEVEL = "case split_part(attacker, ':', 1) when 'blind' then 'text' when 'single_frame' then 'frame' when 'captions' then 'frame' when 'shuffle' then 'order' when 'window' then 'order' else 'option' end"
_BREAK = "coalesce((select arg_min(level, ord) from p where p.benchmark = r.benchmark and case when s - c <= {0} then measured else eps >= s - c - {0} end), 'unbroken')"


def _audit(spark, folder):
    reference, attackers = _attack(spark, folder)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.substring("attacker", 2, 1).cast("int"))
    named = attackers.filter("not (benchmark = 3 and attacker = 'a4')").select(F.col("benchmark").cast("string").alias("benchmark"), name.alias("attacker"), aggregates.level_of(name).alias("level"), "item", "correct")
    return reference.withColumn("benchmark", F.col("benchmark").cast("string")), named


@query(f"""with o as (select o_orderkey as item, (o_custkey % 12)::varchar as benchmark, o_orderkey % 3 <> 0 as ref_ok, 1.0::double / (2 + o_orderkey % 4) as chance from orders),
a as (select benchmark, {_NAMES} as attacker, item, max(l_partkey) % 5 < 2 as correct from lineitem join o on l_orderkey = item where not (benchmark = '3' and l_linenumber = 4) group by all),
m as (select a.benchmark, attacker, {_LEVEL} as level, avg(correct::int) - avg(chance) as margin from a join o using (benchmark, item) group by 1, 2, 3 having count(*) >= 30),
best as (select b.benchmark, lv.level, ord, case when lv.level <> 'order' or (count(*) filter (attacker like 'shuffle%') > 0 and count(*) filter (attacker like 'window%') > 0) then max(margin) end as best
  from (select distinct benchmark from m) b cross join (values ('option', 1), ('text', 2), ('pool', 3), ('frame', 4), ('order', 5)) lv(level, ord) left join m on m.benchmark = b.benchmark and m.level = lv.level group by 1, 2, 3),
p as (select *, best is not null as measured, max(best) over (partition by benchmark order by ord rows unbounded preceding) as eps from best),
r as (select benchmark, avg(ref_ok::int) as s, avg(chance) as c, count(*) as n from o group by 1)
select benchmark, n as n_ref, round(s, 6) as s_star, round(c, 6) as c, (select string_agg(level, ';' order by ord) from p where p.benchmark = r.benchmark and measured) as levels_measured,
round((select eps from p where p.benchmark = r.benchmark and level = 'order' and measured), 6) as eps_order, round((select eps from p where p.benchmark = r.benchmark and level = 'text' and measured), 6) as eps_text,
{_BREAK.format("0.05")} as break_level, {_BREAK.format("0.03")} as break_level_delta3, {_BREAK.format("0.08")} as break_level_delta8 from r""")
def audit_rows(spark, folder):
    out = levels.audit_rows(*_audit(spark, folder))["levels"]
    return out.select("benchmark", "n_ref", r6("s_star").alias("s_star"), r6("c").alias("c"), "levels_measured", r6("eps_order").alias("eps_order"), r6("eps_text").alias("eps_text"), "break_level", "break_level_delta3", "break_level_delta8")


@query("""with r as (select (o_custkey % 12)::varchar as benchmark, l_orderkey as item, l_linenumber - 1 as perm, l_partkey % 3 = 0 as correct, case when l_suppkey % 9 <> 0 then chr(65 + (l_partkey % 4)::int) end as identity, (2 + l_orderkey % 3)::int as k from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <= 3),
f as (select *, case when perm <> 1 or item % 5 <> 0 then correct end as ok from r), plan as (select benchmark, count(distinct item) as n_planned from r group by 1), present as (select benchmark, count(distinct perm) as n_perms_present from f where ok is not null group by 1),
i as (select benchmark, item, count(distinct perm) as have, count(distinct identity) as ids, count(*) filter (identity is null) as bad, max(k) as k from f where ok is not null group by 1, 2), k as (select i.* from i join present using (benchmark) where have = n_perms_present),
acc as (select benchmark, perm, avg(ok::int) as acc from f join k using (benchmark, item) where ok is not null group by 1, 2), w as (select benchmark, max(acc) - min(acc) as width from acc group by 1)
select benchmark, n_planned, n_perms_present, count(*) as n, round(avg(1.0 / k.k), 6) as c, count(*) filter (bad = 0 and ids = 1) as n_items_consistent, count(*) filter (bad > 0) as n_items_unresolved, round(any_value(width), 6) as width from k join plan using (benchmark) join present using (benchmark) join w using (benchmark) group by 1, 2, 3""")
def permutation_summary(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 12).cast("string").alias("benchmark"))
    rows = read(spark, folder, "lineitem").filter("l_linenumber <= 3").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    perm, item = (F.col("l_linenumber") - 1).cast("int"), F.col("l_orderkey")
    identity = F.when(F.col("l_suppkey") % 9 != 0, F.char((F.col("l_partkey") % 4).cast("int") + 65))
    rows = rows.select("benchmark", item.alias("item_id"), perm.alias("perm_id"), F.when((perm != 1) | (item % 5 != 0), F.col("l_partkey") % 3 == 0).alias("correct"), identity.alias("identity"), (2 + item % 3).cast("int").alias("k"))
    out = permutations.permutation_tables(rows, rows)[1].filter("n > 0")
    return out.select("benchmark", "n_planned", "n_perms_present", "n", r6("c").alias("c"), "n_items_consistent", "n_items_unresolved", r6("width").alias("width"))


@query()
def permutation_plan(spark, folder):
    """Every item that takes part, under nine option orders, its own first."""
    calls, _ = permutations.plan(items(spark, folder, ["benchmark", "question", "options", "answer"]))
    return calls.select("item_id", "perm_id", "perm", "gold", "kind", F.array_join("shown", "|").alias("shown"))


@query()
def permutation_exclusions(spark, folder):
    """Items without option orders, by benchmark and reason."""
    return permutations.plan(items(spark, folder, ["benchmark", "question", "options", "answer"]))[1]


# Pool.


@query("select a.vec_id::varchar as a, b.vec_id::varchar as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a join embeddings b on a.label = b.label and a.vec_id::varchar < b.vec_id::varchar and a.vec_id % 3 <> b.vec_id % 3 where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.4")
def cross_benchmark_pairs(spark, folder):
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), (F.col("vec_id") % 3).alias("benchmark"), F.col("label").alias("video_id"), F.col("embedding").alias("vec"))
    return pool.cross_benchmark_pairs(rows, 0.4).withColumn("cos", r6("cos"))


@query("""with t as (select l_orderkey, l_linenumber, [-(l_quantity / 10), -(l_tax * 10), -(l_discount * 20), -1.5::double] as lp, (l_partkey % 4)::int as gold from lineitem), s as (select *, lp[gold + 1] - (list_sum(lp) - lp[gold + 1]) / 3 as m, list_position(lp, list_max(lp)) - 1 = gold as hit from t)
select l_orderkey as item_id, count(*) filter (hit) as hits, count(*) as orders, round(avg(m), 6) + 0.0 as margin, count(*) filter (hit) >= count(*) - 1 and avg(m) > 0.6931471805599453 as remove from s group by 1""")
def text_attack_step(spark, folder):
    lp = F.array(-(F.col("l_quantity") / 10), -(F.col("l_tax") * 10), -(F.col("l_discount") * 20), F.lit(-1.5))
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("item_id"), lp.alias("lp"), (F.col("l_partkey") % 4).cast("int").alias("gold"))
    from tessera.functions import numeric

    return pool.text_step(rows.withColumn("best", numeric.argmax(F.col("lp")))).select("item_id", "hits", "orders", r6("margin").alias("margin"), "remove")


@query(f"with {RESULTS} select user_id as item_id, event_id, k from (select *, row_number() over (partition by user_id order by event_id desc) as r from results where event_type = 'view' and k % 4 <> 0) where r = 1")
def step_rows(spark, folder):
    rows = results(spark, folder).select(F.col("event_type").alias("step"), F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.when(F.col("k") % 4 == 0, "error").when(F.col("k") % 4 == 1, "ok").alias("status"), "event_id", "k")
    return pool.step_rows(rows, "view").select("item_id", "event_id", "k")


@query(f"with {ITEMS} select benchmark, capability_group, count(*) as n from items_now group by 1, 2")
def candidate_counts(spark, folder):
    rows = items(spark, folder, ["benchmark", "capability_group", "video_id", "duration_s", "attack_pct", "chance"])
    return exports.selection_tables(rows, rows.select("item_id"), CAPABILITIES)["candidates"]


@query(f"""with {ITEMS}, c as (select benchmark, coalesce(fine_category, '_none') as v, count(*) as n from items_now group by 1, 2), r as (select *, row_number() over (partition by benchmark order by n desc, v) as r from c)
select benchmark, string_agg(v || ':' || n, ';' order by n desc, v) as subtasks from r where r <= 12 group by 1""")
def top_subtasks(spark, folder):
    rows = items(spark, folder, ["benchmark", "options", "answer_idx", "fine_category"]).withColumns({"form": F.lit("mcq"), "subtask": F.col("fine_category")})
    return rules.format_detail(rows, ["benchmark"]).select("benchmark", "subtasks")


# Items, videos, documents.


@query(rf"""with r as (select * replace ({_ID.format("item_id")} as item_id) from items), f as (select * from (select *, row_number() over (order by row_seq) as n from r) where n <= 1000)
select item_id, max(row_seq) as row_seq from f where item_id is not null group by 1""")
def head_of_file(spark, folder):
    rows = read(spark, folder, "items").select(trimmed("item_id").alias("item_id"), "row_seq")
    return sampling.head(rows, "row_seq", "item_id", 1000).filter("item_id is not null")


@query("select row_seq from (select row_seq, row_number() over (order by row_seq) - 1 as n from items) where n >= 100 and n < 1500 and (n - 100) % 7 = 3")
def item_subset(spark, folder):
    return sampling.subset(read(spark, folder, "items").select("row_seq"), "row_seq", start=100, stop=1500, shard=(3, 7))


@query("""with t as (select video_id, frame_timestamps as ts from video_meta where len(frame_timestamps) > 0), d as (select video_id, list_transform(ts, lambda x: abs(x - (ts[1] + 16 * (ts[-1] - ts[1]) / 31))) as d from t) select video_id, (list_position(d, list_min(d)) - 1)::int as frame from d""")
def attacker_single_frame(spark, folder):
    rows = read(spark, folder, "video_meta").filter("size(frame_timestamps) > 0")
    return rows.select("video_id", F.element_at(frames.attacker_frames("single", F.col("frame_timestamps"), 32), 1).alias("frame"))


@query("""with m as (select video_id, n_frames as n, unnest(range(8)) as i from video_meta where n_frames > 0), p as (select distinct video_id, greatest(0, least(n - 1, cast(round_even((0.016 + i / 7.0) * (n - 1), 0) as int))) as f from m) select video_id, count(*) as places, sum(f)::bigint as total from p group by 1""")
def offset_grid(spark, folder):
    rows = read(spark, folder, "video_meta").filter("n_frames > 0").select("video_id", F.explode(frames.grid(F.col("n_frames"), 8, 0.016, 1.016)).alias("f"))
    return rows.groupBy("video_id").agg(F.count("*").alias("places"), F.sum("f").alias("total"))


@query(r"""select source, round(avg(coalesce(regexp_matches(text, '(?i)\b(hear|heard|hears|sound|sounds|audio|listen|voice|voices|spoken|speech|says?|said|music|song|noise|narrat\w+|dialogue|conversation)\b'), false)::int), 6) as share from documents group by 1""")
def audio_mention_share(spark, folder):
    return read(spark, folder, "documents").groupBy("source").agg(r6(F.avg(text.mentions_sound("text").cast("int"))).alias("share"))


@query(f"""with {ITEMS}, m as (select {_KEY.format("benchmark")} as benchmark, nullif(trim(license), '') as l from benchmark_meta) select item_id, coalesce(nullif(trim(license), ''), m.l, 'unknown') as license from items_now left join m using (benchmark)""")
def license_lookup(spark, folder):
    rows = items(spark, folder, ["benchmark", "license"])
    meta = read(spark, folder, "benchmark_meta").select(name_key("benchmark").alias("benchmark"), "license")
    named = joins.first_match(rows.withColumn("own", F.nullif(F.trim("license"), F.lit(""))).drop("license"), [("meta", meta.withColumn("license", F.nullif(F.trim("license"), F.lit(""))))], ["benchmark"], "license", "listed", "origin")
    return named.select("item_id", F.coalesce("own", "listed", F.lit("unknown")).alias("license"))


@query(f"""with {ITEMS}, v as (select case when duration_s > 0 and duration_s < 1e12 and not isnan(duration_s) then duration_s end as d from items_now) select count(*) as items, round(median(d), 6) as duration_median, count(*) filter (d >= 300) as long_items from v""")
def release_durations(spark, folder):
    out = exports.release_summary(items(spark, folder, ["capability_group", "benchmark", "license", "duration_s"]))
    return out.select("items", r6("duration_median").alias("duration_median"), "long_items")


@query(f"""with {RESULTS}, i as (select event_type, user_id, avg(correct::int) as a from results where correct is not null group by 1, 2) select event_type, round(avg(a), 6) as accuracy, count(*) as items from i group by 1""")
def toolkit_accuracy(spark, folder):
    """Mean over items of the mean over each item's replies."""
    return reports.item_means(results(spark, folder), ["event_type"], "user_id").withColumn("accuracy", r6("accuracy"))


@query("""select c_custkey as item, coalesce(o.gold, c_mktsegment) as gold from customer join (select o_custkey, max(case when o_orderkey % 3 = 0 then o_orderpriority end) as gold from orders group by 1) o on o_custkey = c_custkey""")
def gold_precedence(spark, folder):
    """A result's own gold counts before the sample's."""
    run = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))).alias("answer"))
    sample = read(spark, folder, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("gold"))
    return joins.with_gold(run, sample, ["item"], "answer", "gold")


# Attribution.


@query("""with t as (select category, capability_group as g, row_number() over (order by category) - 1 as n from failure_taxonomy), v as (select l_orderkey as item, l_linenumber as j, category, g from lineitem join t on n = l_partkey % 26 where l_linenumber <= 2),
p as (select item, count(distinct j) as j, count(distinct category) as c, count(distinct g) as gs, min(category) as category, min(g) as g from v group by 1) select item as item_id, case when c = 1 then category end as category, case when gs = 1 then g end as "group", case when c = 1 then 'fine' when gs = 1 then 'group' else 'disputed' end as agreed_level from p where j = 2""")
def judge_agreement(spark, folder):
    taxonomy = read(spark, folder, "failure_taxonomy").select("category", "capability_group")
    names = F.array_sort(F.collect_list("category"))
    listed = taxonomy.agg(names.alias("names"))
    rows = read(spark, folder, "lineitem").filter("l_linenumber <= 2").crossJoin(F.broadcast(listed))  # one row
    votes = rows.select(F.lit("m").alias("model"), F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("judge"), F.element_at("names", (F.col("l_partkey") % 26 + 1).cast("int")).alias("category"))
    return attribution.agreement(votes, taxonomy, ["1", "2"]).select("item_id", "category", "group", "agreed_level")


@query(f"""with {LABELS}, b as (select benchmark, (row_number() over (order by benchmark) - 1) // 20 as w from (select distinct benchmark from labels_now)), l as (select benchmark, model, qid, w from labels_now join b using (benchmark) where fine = 'other' or status = 'disputed')
select w::int as "window", (row_number() over (partition by w order by benchmark, model, qid) - 1)::int as place, qid, model from l""")
def leftover_windows(spark, folder):
    rows = labels(spark, folder).select("benchmark", "model", F.col("qid").alias("item_id"), F.col("fine").alias("category"), F.col("status").alias("agreed_level"))
    return attribution.leftover_windows(rows).select("window", "place", F.col("item_id").alias("qid"), "model")


@query(f"""with {LABELS}, s as (select distinct item_id from (select {_ID.format("item_id")} as item_id from items)) select qid as item_id, model from labels_now where status <> 'unstable' and qid in (select item_id from s where item_id is not null) and not (status = 'ok' and model = 'codecnet')""")
def judge_todo(spark, folder):
    rows = labels(spark, folder).select(F.col("qid").alias("item_id"), "model", "status")
    pre = rows.filter("status != 'unstable'").select("item_id", "model", F.lit(True).alias("to_judge"), F.lit(False).alias("vision_introduced_error"), F.lit("none").alias("preclass"))
    samples = read(spark, folder, "items").select(trimmed("item_id").alias("item_id")).filter("item_id is not null")
    done = rows.filter("status = 'ok' and model = 'codecnet'")
    return attribution.judge_todo(rows.select("item_id", "model"), pre, samples, done)[0].select("item_id", "model")


@query(f"with {_ATTACK} select benchmark, attacker, level, round(acc, 6) as acc, round(margin, 6) as margin, n from m")
def attacker_margins(spark, folder):
    out = aggregates.attacker_margins(*_attack(spark, folder))
    return out.select("benchmark", "attacker", "level", r6("acc").alias("acc"), r6("margin").alias("margin"), "n")

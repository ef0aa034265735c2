"""The engine's registered queries over the driver's tables, each over its whole tables, with SQL where SQL can say it.

Rates and means are rounded to six digits on both sides; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import frames, numeric, options, text
from tessera.functions.names import canonical, missing, name_key, trimmed
from tessera.operators import aggregates, dedup, joins, learner, ranks, reports, rules, sampling, selection
from tessera.sources import readers, sinks
from tessera.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, where there is one, its SQL."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# Views. Results stand in the event log: the item is the user, the condition the event type, correctness the parity of k.


def results(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    log = read(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    return log.withColumn("correct", F.when(F.col("k") % 7 != 0, F.col("k") % 2 == 0))


RESULTS = """results as (select event_id, ts, user_id, event_type, k, case when k % 7 <> 0 then k % 2 = 0 end as correct
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""
LATEST_RESULTS = RESULTS + """, latest as (select * from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from results) where r = 1)"""


def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    return readers.latest_rows(results(spark, folder), ["user_id", "event_type"], ["ts", "event_id"])


def items(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Latest row of each item, names by their letters and digits."""
    rows = read(spark, folder, "items").withColumn("item_id", trimmed("item_id")).filter("item_id is not null")
    out = ranks.latest_rows(rows, ["item_id"], "row_seq", ["item_id", *columns])
    for c in ("benchmark", "capability_group", "fine_category"):
        if c in columns:
            out = out.withColumn(c, name_key(c))
    return out


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_ID = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
ITEMS = f"""items_now as (select * replace ({_KEY.format("benchmark")} as benchmark, {_KEY.format("capability_group")} as capability_group, {_KEY.format("fine_category")} as fine_category)
  from (select *, row_number() over (partition by item_id order by row_seq desc) as r from (select * replace ({_ID.format("item_id")} as item_id) from items) where item_id is not null) where r = 1)"""
SCORE_OK = "attack_pct is not null and not isnan(attack_pct) and attack_pct >= 0 and attack_pct <= 1"


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Latest judging row per (qid, model), names and statuses normalised."""
    rows = read(spark, folder, "attribution_row_labels").select(trimmed("qid").alias("qid"), trimmed("model").alias("model"), name_key("benchmark").alias("benchmark"), name_key("status").alias("status"), "category", "subgroup", "judged_at", "row_seq", "agreed_level", "judge_group", "dense_state")
    rows = canonical(rows, "category", read(spark, folder, "failure_taxonomy").withColumnRenamed("category", "name"), "name", "fine")
    return readers.latest_rows(rows.filter("qid is not null and model is not null"), ["qid", "model"], ["judged_at", "row_seq"])


LABELS = f"""labels_now as (select * from (select {_ID.format("qid")} as qid, {_ID.format("model")} as model, {_KEY.format("l.benchmark")} as benchmark, {_KEY.format("status")} as status, t.category as fine, subgroup,
  row_number() over (partition by {_ID.format("qid")}, {_ID.format("model")} order by judged_at desc, row_seq desc) as r
  from attribution_row_labels l left join failure_taxonomy t on {_KEY.format("t.category")} = {_KEY.format("l.category")} where {_ID.format("qid")} is not null and {_ID.format("model")} is not null) where r = 1)"""


# Results: latest and first rows, accuracies, gain, resume, parity.


@query(f"with {LATEST_RESULTS} select user_id, event_type, event_id, k, correct from latest")
def resume_latest_row(spark, folder):
    return latest_results(spark, folder).select("user_id", "event_type", "event_id", "k", "correct")


@query(f"with {RESULTS} select user_id, event_type, event_id, correct from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from results where correct is not null) where r = 1")
def first_scored_row(spark, folder):
    return readers.first_scored(results(spark, folder), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "correct")


@query(f'with {LATEST_RESULTS} select event_type, round(avg(correct::int), 6) as accuracy, count(correct) as scored, count(*) as "rows" from latest group by 1')
def accuracy_by_group(spark, folder):
    return aggregates.accuracy(latest_results(spark, folder), ["event_type"]).withColumn("accuracy", r6("accuracy"))


@query(f"""with {RESULTS}, m as (select user_id, user_id % 4 as grp, event_type, avg(correct::int) as a from results where correct is not null group by 1, 2, 3)
select v.grp, round(avg(v.a), 6) as video, round(avg(b.a), 6) as blind, round(avg(v.a) - avg(b.a), 6) as gain, count(*) as items from m v join m b on v.user_id = b.user_id where v.event_type = 'view' and b.event_type = 'click' group by 1""")
def gain_common_items(spark, folder):
    rows = results(spark, folder).withColumn("grp", F.col("user_id") % 4)
    pick = lambda t: rows.filter(F.col("event_type") == t)
    out = aggregates.gain(pick("view"), pick("click"), ["user_id"], ["grp"])
    return out.select("grp", r6("video").alias("video"), r6("blind").alias("blind"), r6("gain").alias("gain"), "items")


@query(f"with {RESULTS} select distinct user_id, event_type from results where event_type = 'view' and user_id not in (select user_id from results where event_type = 'purchase' and k >= 90)")
def resume_anti_join(spark, folder):
    rows = results(spark, folder)
    done = rows.filter("event_type = 'purchase' and k >= 90")
    return joins.remaining(rows.filter("event_type = 'view'").select("user_id", "event_type").distinct(), done, ["user_id"])


@query(f"""with {LATEST_RESULTS}, a as (select user_id, correct from latest where event_type = 'view'), b as (select user_id, correct from latest where event_type = 'click' and user_id % 5 <> 0), c as (select user_id, correct from latest where event_type = 'error' and user_id % 7 <> 0)
select user_id, a.correct as one, b.correct as two, c.correct as three, (a.user_id is not null and b.user_id is not null and c.user_id is not null) as complete,
(a.user_id is not null and b.user_id is not null and c.user_id is not null and a.correct is not distinct from b.correct and a.correct is not distinct from c.correct) as same from a full join b using (user_id) full join c using (user_id)""")
def parity_full_outer(spark, folder):
    rows = latest_results(spark, folder)
    pick = lambda t, n: rows.filter((F.col("event_type") == t) & (F.col("user_id") % n != 0)) if n else rows.filter(F.col("event_type") == t)
    return joins.parity({"one": pick("view", 0), "two": pick("click", 5), "three": pick("error", 7)}, ["user_id"], "correct")


@query(f"""with {RESULTS}, t as (select *, row_number() over w as n, count(*) over (partition by user_id) as total, avg(coalesce(correct::int, 0)) over (partition by user_id order by ts, event_id rows 19 preceding) as acc from results window w as (partition by user_id order by ts, event_id))
select user_id, round(avg(case when n > total - ceil(total * 0.2) then acc end) - 0.4, 6) as last_fifth, coalesce(min(case when acc > 0.45 then n end), max(total) + 1) as first_over from t group by 1""")
def moving_average_tail(spark, folder):
    rows = results(spark, folder).withColumn("hit", F.coalesce(F.col("correct").cast("int"), F.lit(0)))
    out = learner.curve_windows(rows, ["user_id"], ["ts", "event_id"], "hit", 0.4)
    return out.select("user_id", r6("last_fifth").alias("last_fifth"), "first_over")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field_extract(spark, folder):
    return read(spark, folder, "events").select("event_id", text.json_field("props", "k").alias("k"))


@query("""select c.event_id, c.user_id, (select arg_min(v.ts, (abs(epoch_us(v.ts) - epoch_us(c.ts)), epoch_us(v.ts))) from events v where v.event_type = 'view' and v.user_id = c.user_id) as nearest_view
from events c where c.event_type = 'click'""")
def nearest_asof(spark, folder):
    log = read(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    pick = lambda t: log.filter(F.col("event_type") == t).select("event_id", "user_id", "t")
    out = joins.nearest_join(pick("click"), pick("view").select("user_id", "t"), ["user_id"], "t", "t", "near")
    return out.select("event_id", "user_id", F.timestamp_micros("near").cast("timestamp_ntz").alias("nearest_view"))


# Items: chance, positions, formats, options.


def _chances(spark, folder):
    rows = items(spark, folder, ["benchmark", "question", "options", "answer", "answer_idx"])
    meta = read(spark, folder, "benchmark_meta").select(name_key("benchmark").alias("benchmark"), "num_options")
    inline = F.regexp_count("question", F.lit(r"\n[A-P]\. "))
    rows = rows.join(meta, "benchmark", "left").withColumn("src", aggregates.chance_source(F.size("options"), inline, F.col("num_options"), F.lit(None).cast("int")))
    return rows.withColumns({"chance": F.col("src.chance"), "source": F.col("src.source")})


_CHANCE = f"""{ITEMS}, declared as (select benchmark, avg(1.0 / n) as d from (select {_KEY.format("benchmark")} as benchmark, cast(unnest(regexp_extract_all(coalesce(num_options, ''), '\\d+')) as int) as n from benchmark_meta) where n > 0 group by 1),
chances as (select i.* exclude (chance), case when len(options) >= 2 then 1.0 / len(options) when inl >= 2 then 1.0 / inl else coalesce(d, 0.0) end as chance, case when len(options) >= 2 then 'list' when inl >= 2 then 'question' when d is not null then 'declared' else 'open' end as source
  from (select *, len(regexp_extract_all(question, '\\n[A-P]\\. ')) as inl from items_now) i left join declared using (benchmark))"""


@query(f"""with {_CHANCE}, per as (select benchmark, source, count(*) as n, sum(chance) as s from chances group by 1, 2)
select benchmark, round(sum(case when source <> 'open' then s end) / sum(case when source <> 'open' then n end), 6) as chance_mcq, round(sum(s) / sum(n), 6) as chance_all, coalesce(sum(case when source <> 'open' then n end), 0)::bigint as n_mcq, sum(n)::bigint as n, string_agg(source || ':' || n, ';' order by source || ':' || n) as sources from per group by 1""")
def chance_by_benchmark(spark, folder):
    out = aggregates.benchmark_chance(_chances(spark, folder), ["benchmark"])
    return out.withColumns({"chance_mcq": r6("chance_mcq"), "chance_all": r6("chance_all")})


_LETTERED = f"{ITEMS}, lettered as (select benchmark, chr(65 + answer_idx) as letter, len(options) as k from items_now where answer_idx between 0 and 15)"


def _lettered(spark, folder):
    rows = items(spark, folder, ["benchmark", "options", "answer_idx"]).filter(F.col("answer_idx").between(0, 15))
    return rows.select("benchmark", text.letter_of(F.col("answer_idx")).alias("letter"), F.when(F.col("options").isNotNull(), F.size("options")).alias("k"))


@query(f"with {_LETTERED}, c as (select benchmark, letter, count(*) as n from lettered group by 1, 2) select benchmark, letter, n, round(n / sum(n) over (partition by benchmark), 6) as share, row_number() over (partition by benchmark order by n desc, letter) = 1 as modal from c")
def modal_position(spark, folder):
    return aggregates.position_shares(_lettered(spark, folder), ["benchmark"], "letter").withColumn("share", r6("share"))


@query(f"""with {_LETTERED}, c as (select benchmark, k, letter, count(*) as n from lettered where k is not null group by 1, 2, 3), nk as (select benchmark, k, sum(n) as nk from c group by 1, 2),
modal as (select benchmark, arg_max(k, (nk, -k)) as k from nk group by 1), p as (select c.*, c.n / sum(c.n) over (partition by benchmark) as p from c join modal using (benchmark, k)) select benchmark, k, round(-sum(p * ln(p)) / ln(k), 6) as entropy from p group by 1, 2""")
def position_entropy(spark, folder):
    return aggregates.position_entropy(_lettered(spark, folder).filter("k is not null"), ["benchmark"], "letter", "k").withColumn("entropy", r6("entropy"))


@query(f"with {_LETTERED} select benchmark, greatest(2, quantile_disc(ascii(letter) - 64, 0.95))::int as k from lettered group by 1")
def inferred_k_p95(spark, folder):
    return aggregates.inferred_k(_lettered(spark, folder), ["benchmark"])


_NORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')), '[‘’“”`]', chr(39), 'g'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200c}}\x{{200d}}\s\x{{85}}\p{{Z}}.\-]', ' ', 'g'), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^\.+|\.+$', '', 'g')"""
_PREFIX = r"^\s*[(\[]?([A-Pa-p])[)\].,:]\s*"
_BARE = rf"""bare as (select *, case when len(options) > 0 and len(list_filter(options, lambda o, i: coalesce(upper(regexp_extract(o, '{_PREFIX}', 1)) = chr(64 + i::int), false))) = len(options) then list_transform(options, lambda o: trim(regexp_replace(o, '{_PREFIX}', ''))) else options end as b from items_now where options is not null)"""
_META = r"(?i)^(?:all|none|both|neither)\b.*\b(?:above|options|these|choices)\b|^(?:cannot|can''t|can not) be determined|^not enough information"


@query(rf"""with {ITEMS}, {_BARE}, n as (select *, list_transform(b, lambda o: trim({_NORM.format("o")})) as t from bare)
select item_id, array_to_string(list_filter([case when coalesce(list_bool_or(list_transform(b, lambda o: regexp_matches(trim(o), '{_META}'))), false) then 'meta_option' end, case when len(list_distinct(t)) + (len(list_filter(t, lambda x: x is null)) > 0)::int < len(t) then 'repeated_option' end,
  case when answer_idx is null or answer_idx < 0 or coalesce(trim(b[answer_idx + 1]), '') = '' then 'empty_gold' end], lambda x: x is not null), ',') as flags from n""")
def option_format_screen(spark, folder):
    rows = items(spark, folder, ["options", "answer_idx"]).filter("options is not null")
    place = F.when(F.col("answer_idx") >= 0, F.col("answer_idx"))
    return rows.select("item_id", F.array_join(options.option_flags(F.col("options"), place), ",").alias("flags"))


@query()
def option_flags(spark, folder):
    rows = items(spark, folder, ["options", "answer", "question"])
    inline = options.inline_options("question")
    rows = rows.withColumn("o", F.coalesce("options", inline["options"]))
    gold = options.resolve_gold(F.col("answer"), F.col("o"))
    rows = rows.withColumn("g", gold)
    return rows.select("item_id", F.col("g.index").alias("gold_index"), F.col("g.format").alias("form"), F.col("g.reason").alias("reason"), F.when(F.col("o").isNotNull(), F.array_join(options.option_flags(F.col("o"), F.col("g.index")), ",")).alias("flags"))


@query(f"""with {ITEMS}, m as (select {_KEY.format("benchmark")} as benchmark, list_distinct(list_transform(regexp_extract_all(num_options, '\\d+'), lambda x: cast(x as int))) as allowed from benchmark_meta where num_options is not null)
select item_id, len(options) as n_options from items_now join m using (benchmark) where len(allowed) > 0 and len(options) > 0 and not list_contains(allowed, len(options))""")
def option_count_repairs(spark, folder):
    meta = read(spark, folder, "benchmark_meta").select(name_key("benchmark").alias("benchmark"), "num_options")
    rows = items(spark, folder, ["benchmark", "options"]).join(meta, "benchmark")
    return aggregates.option_count_repairs(rows, "options", F.col("num_options")).select("item_id", F.size("options").cast("long").alias("n_options"))


@query()
def letter_extract(spark, folder):
    """Letters of all answers: leading and stated ones, option texts, bare indices."""
    rows = read(spark, folder, "items").filter("answer is not null")
    return text.with_letter(rows, "letter", "answer", "options").select("item_id", "row_seq", "letter")


@query(r"""select doc_id, upper(x[len(x)]) as letter from (select doc_id, regexp_extract_all(text, '(?i)(?:answer|option|choice)\s*(?:is|would\s+be)?\s*[:\-]?\s*[(\[]?([A-J])[)\].,:]?(?:\s|$)', 1) as x from documents) where len(x) > 0""")
def stated_answer_last(spark, folder):
    return read(spark, folder, "documents").select("doc_id", text.stated_letter("text").alias("letter")).filter("letter is not null")


@query()
def score_gold_replies(spark, folder):
    """Every item's own gold scored as a reply, as a stated letter, and as the text of the gold option."""
    rows = items(spark, folder, ["options", "answer", "answer_idx"]).filter("options is not null and answer is not null")
    place = F.when(F.col("answer_idx") >= 0, F.col("answer_idx"))
    said = F.concat(F.lit("The answer is "), text.letter_of(place), F.lit("."))
    replies = F.array(*[F.struct(F.lit(n).alias("kind"), r.alias("reply")) for n, r in (("own", F.col("answer")), ("stated", said), ("by_text", F.try_element_at("options", place + 1)))])
    rows = rows.select("item_id", "options", "answer", F.explode(replies).alias("r")).select("item_id", "options", "answer", "r.kind", "r.reply")
    return text.with_score(rows, "correct", "reply", "answer", "options").select("item_id", "kind", "correct")


@query(f"with {ITEMS} select item_id, trim({_NORM.format('question')}) as norm from items_now where question is not null")
def normalize_text(spark, folder):
    return items(spark, folder, ["question"]).filter("question is not null").select("item_id", text.norm_text("question").alias("norm"))


_TEMPLATE = r"""regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(lower(regexp_replace(regexp_replace({0}, '"[^"]*"|“[^”]*”|''[^'']*''(\W|$)', '<ENT>\1', 'g'), '\d+(?:[.:,]\d+)*', '<NUM>', 'g')), '<ent>', '<ENT>'), '<num>', '<NUM>'), '\s+', ' ', 'g')), '<NUM>(?:\s<NUM>)+', '<NUM>', 'g'), '<ENT>(?:\s<ENT>)+', '<ENT>', 'g')"""


@query(f"with {ITEMS} select item_id, {_TEMPLATE.format('question')} as template from items_now where question is not null")
def question_template(spark, folder):
    return items(spark, folder, ["question"]).filter("question is not null").select("item_id", text.question_template("question").alias("template"))


@query(r"""select doc_id, round(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 6) as share, coalesce(round(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 12) >= 0.9, false) as english from documents""")
def english_share(spark, folder):
    return read(spark, folder, "documents").select("doc_id", r6(text.english_share("text")).alias("share"), text.is_english("text").alias("english"))


@query()
def format_report(spark, folder):
    rows = items(spark, folder, ["benchmark", "question", "options", "answer", "answer_idx", "video_id", "fine_category"])
    rows = rows.withColumn("form", options.resolve_gold(F.col("answer"), F.col("options"))["format"]).withColumnRenamed("fine_category", "subtask")
    return rules.format_report(rows, ["benchmark"])


# Margins and levels. Attackers are the ship modes of an order line stand-in: the benchmark is the nation, the item the order.

LEVELS = [("text", 1), ("frame", 2), ("order", 3), ("long", 4)]


def _attack(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 12).alias("benchmark"), (F.col("o_orderkey") % 3 != 0).alias("ref_ok"), (1.0 / (2 + F.col("o_orderkey") % 4)).alias("chance"))
    lines = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg((F.max("l_partkey") % 5 < 2).alias("correct")).join(o.select("o_orderkey", "benchmark"), "o_orderkey")
    level = F.element_at(F.array(*[F.lit(n) for n, _ in LEVELS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    attackers = lines.select("benchmark", F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("attacker"), level.alias("level"), F.col("o_orderkey").alias("item"), "correct")
    return o.select("benchmark", F.col("o_orderkey").alias("item"), F.col("ref_ok").alias("correct"), "chance"), attackers


_ATTACK = """o as (select o_orderkey as item, o_custkey % 12 as benchmark, o_orderkey % 3 <> 0 as ref_ok, 1.0::double / (2 + o_orderkey % 4) as chance from orders),
a as (select benchmark, 'a' || l_linenumber as attacker, (['text', 'frame', 'order', 'long'])[(l_linenumber % 4 + 1)::int] as level, item, max(l_partkey) % 5 < 2 as correct from lineitem join o on l_orderkey = item group by all),
m as (select a.benchmark, attacker, level, avg(correct::int) as acc, avg(correct::int) - avg(chance) as margin, count(*) as n from a join o using (benchmark, item) group by 1, 2, 3 having count(*) >= 30),
lv as (select * from (values ('text', 1), ('frame', 2), ('order', 3), ('long', 4)) t(level, ord)),
best as (select b.benchmark, lv.level, ord, max(margin) as best from (select distinct benchmark from m) b cross join lv left join m on m.benchmark = b.benchmark and m.level = lv.level group by 1, 2, 3),
profile as (select benchmark, level, ord, best is not null as measured, max(best) over (partition by benchmark order by ord rows unbounded preceding) as eps from best)"""


@query(f"with {_ATTACK} select benchmark, level, ord, measured, round(eps, 6) as eps from profile")
def attacker_profile_running_max(spark, folder):
    levels = spark.createDataFrame(LEVELS, "level string, ord int")
    return aggregates.level_profile(aggregates.attacker_margins(*_attack(spark, folder)), levels).withColumn("eps", r6("eps"))


@query(f"""with {_ATTACK}, s as (select benchmark, avg(ref_ok::int) as s, avg(chance) as c from o group by 1), h as (select p.*, s, c, s - c <= 0.3 as near, s - c <= 0.3 and s + 0.02 - c > 0.3 as rescreened from profile p join s using (benchmark)),
u as (select *, case when rescreened then s + 0.02 else s end as s_used from h)
select benchmark, near, rescreened, round(s_used, 6) as s_used, coalesce(arg_min(level, ord) filter (where case when near and not rescreened then measured else eps >= s_used - c - 0.3 end), 'unbroken') as level from u group by 1, 2, 3, 4""")
def breaking_level(spark, folder):
    reference, attackers = _attack(spark, folder)
    levels = spark.createDataFrame(LEVELS, "level string, ord int")
    profile = aggregates.level_profile(aggregates.attacker_margins(reference, attackers), levels)
    s = reference.groupBy("benchmark").agg(aggregates.rate(F.col("correct")).alias("s"), F.avg("chance").alias("c"))
    return aggregates.breaking_level(profile, s.withColumn("s_long", F.col("s") + 0.02), 0.3).withColumn("s_used", r6("s_used"))


@query("""with r as (select o_custkey % 12 as benchmark, l_orderkey as item, l_linenumber as perm, (l_partkey % 4)::int as identity, l_partkey % 3 = 0 as correct, 0.25::double as c from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <= 3),
orders_ as (select benchmark, count(distinct perm) as orders from r group by 1), f as (select benchmark, item, count(distinct perm) as have, count(distinct identity) as answers from r group by 1, 2),
k as (select f.* from f join orders_ using (benchmark) where have = orders), acc as (select r.benchmark, perm, avg(correct::int) as acc, avg(c) as c from r join k using (benchmark, item) group by 1, 2), w as (select benchmark, max(acc) - min(acc) as width, avg(c) as c from acc group by 1),
s as (select benchmark, count(*) as items, avg((answers = 1)::int) as consistency from k group by 1) select benchmark, items, round(width, 6) as width, round(2.326 * sqrt(c * (1 - c) / items), 6) as threshold, round(consistency, 6) as consistency from w join s using (benchmark)""")
def permutation_stats(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 12).alias("benchmark"))
    rows = read(spark, folder, "lineitem").filter("l_linenumber <= 3").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("benchmark", F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("perm"), (F.col("l_partkey") % 4).cast("int").alias("identity"), (F.col("l_partkey") % 3 == 0).alias("correct"), F.lit(0.25).alias("c"))
    out = aggregates.permutation_stats(rows, ["benchmark"], "item", "perm", "identity", "c")
    return out.select("benchmark", "items", r6("width").alias("width"), r6("threshold").alias("threshold"), r6("consistency").alias("consistency"))


# Ranks and selections.


@query(f"""with {ITEMS}, v as (select item_id, case when {SCORE_OK} then attack_pct end as a, case when chance is not null and not isnan(chance) then chance end as b from items_now),
f as (select item_id, coalesce(a, max(a) over ()) as a, coalesce(b, max(b) over ()) as b from v),
r as (select item_id, (rank() over (order by a) + (count(*) over (partition by a) - 1) / 2) / count(*) over () as ra, (rank() over (order by b) + (count(*) over (partition by b) - 1) / 2) / count(*) over () as rb from f)
select item_id, round(ra, 6) as rank_attack, round(rb, 6) as rank_chance, round(greatest(ra, rb), 6) as worst from r""")
def percentile_rank_worst_case(spark, folder):
    rows = items(spark, folder, ["attack_pct", "chance"]).withColumn("attack_pct", F.when(~missing("attack_pct") & F.col("attack_pct").between(0, 1), F.col("attack_pct")))
    both = aggregates.percentile_rank(rows, {"attack_pct": "ra", "chance": "rb"})
    return both.select("item_id", r6("ra").alias("rank_attack"), r6("rb").alias("rank_chance"), r6(F.greatest("ra", "rb")).alias("worst"))


_SOUND_ITEMS = f"{ITEMS}, sound as (select item_id, {_ID.format('video_id')} as video_id, coalesce({_ID.format('video_id')}, 'item:' || item_id) as v, capability_group as capability, case when {SCORE_OK} then attack_pct end as attack_pct from items_now)"


def _sound_items(spark, folder):
    """All items; an impossible score is none, an item without a video stands for a video of its own."""
    rows = items(spark, folder, ["video_id", "capability_group", "attack_pct"])
    return rows.select("item_id", trimmed("video_id").alias("video_id"), F.col("capability_group").alias("capability"), F.when(~missing("attack_pct") & F.col("attack_pct").between(0, 1), F.col("attack_pct")).alias("attack_pct"))


@query(f"with {_SOUND_ITEMS} select video_id, item_id, attack_pct from (select *, row_number() over (partition by v order by attack_pct nulls last, item_id) as r from sound) where r = 1 order by attack_pct nulls last, item_id limit 200")
def hardest_one_per_group_topn(spark, folder):
    rows = _sound_items(spark, folder).withColumn("v", F.coalesce("video_id", F.concat(F.lit("item:"), "item_id")))
    out = selection.hardest_per(rows, ["v"], ["attack_pct", "item_id"])
    return out.orderBy(F.col("attack_pct").asc_nulls_last(), "item_id").limit(200).select("video_id", "item_id", "attack_pct")


CAPABILITIES = ["perception", "temporal", "spatialphysical", "reasoningknowledge"]


def _quota_sql(quota: int) -> str:
    parts, used = [], ""
    for i, g in enumerate(CAPABILITIES):
        parts.append(f"g{i} as (select item_id, video_id, capability, attack_pct, v from (select *, row_number() over (partition by v order by attack_pct nulls last, item_id) as r from sound where capability = '{g}' {used and f'and v not in ({used})'}) where r = 1 order by attack_pct nulls last, item_id limit {quota})")
        used = " union all ".join(f"select v from g{j}" for j in range(i + 1))
    return f"with {_SOUND_ITEMS}, {', '.join(parts)} " + " union all ".join(f"select item_id, video_id, capability, attack_pct from g{i}" for i in range(len(CAPABILITIES)))


@query(_quota_sql(50))
def quota_composition(spark, folder):
    return selection.quota_compose(_sound_items(spark, folder), CAPABILITIES, 50).select("item_id", "video_id", "capability", "attack_pct")


@query("""with c as (select c_mktsegment, c_nationkey, count(*) as w from customer group by 1, 2), r as (select *, 300 * w / sum(w) over (partition by c_mktsegment) as raw from c), b as (select *, floor(raw) as base from r)
select c_mktsegment, c_nationkey, w, (base + (row_number() over (partition by c_mktsegment order by base - raw, c_nationkey) <= 300 - sum(base) over (partition by c_mktsegment))::int)::bigint as share from b""")
def largest_remainder_allocation(spark, folder):
    weights = read(spark, folder, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("w"))
    return sampling.largest_remainder_table(weights, ["c_mktsegment"], "c_nationkey", "w", F.lit(300))


@query("select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def first_rows_per_group(spark, folder):
    return selection.ranked_in(read(spark, folder, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) as place from orders")
def exact_rank_in_hot_groups(spark, folder):
    from tessera.storage import Scratch

    return ranks.exact_rank(read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"], "place", Scratch(spark)).select("o_orderkey", "place")


# Shares, majorities, matrices, funnels.


@query(f"""with {LABELS} select model, count(*) as "rows", count(*) filter (status in ('ok', 'other')) as denominator, {", ".join(f"count(*) filter (status = '{s}') as n_{s}" for s in ("ok", "other", "disputed", "unstable", "unverified"))},
{", ".join(f"round(count(*) filter (status = '{s}' and status in ('ok', 'other')) / nullif(count(*) filter (status in ('ok', 'other')), 0), 6) as s_{s}" for s in ("ok", "other", "disputed", "unstable", "unverified"))} from labels_now group by 1""")
def share_table(spark, folder):
    names = ["ok", "other", "disputed", "unstable", "unverified"]
    out = aggregates.share_table(labels(spark, folder), ["model"], "status", names, F.col("status").isin("ok", "other"))
    return out.withColumns({f"s_{n}": r6(f"s_{n}") for n in names})


@query(f"""with {LABELS}, c as (select qid, status, count(*) as n from labels_now where status is not null group by 1, 2)
select qid, status from (select *, row_number() over (partition by qid order by n desc, coalesce(nullif(list_position(['ok', 'other', 'disputed'], status), 0), 4), status) as r from c) where r = 1""")
def majority_label_tiebreak(spark, folder):
    return aggregates.majority(labels(spark, folder), ["qid"], "status", ["ok", "other", "disputed"])


MODELS = ["blindtext-xl", "clipper-34b", "clipper-7b", "codecnet", "framewise-2", "longview-9b", "refmodel-large", "refmodel-mini", "tinyvid"]


def _matrix_sql() -> str:
    counts = ", ".join(f"count(*) filter (model = '{m}') as \"{m}\"" for m in MODELS)
    shares = ", ".join(f"round(\"{m}\" / nullif(sum(\"{m}\") over (), 0), 6) as \"{m}\"" for m in MODELS)
    totals = ", ".join(f"sum(\"{m}\")::double as \"{m}\"" for m in MODELS)
    return f"with {LABELS}, c as (select fine, {counts} from labels_now where fine is not null group by 1) select fine, {shares} from c union all select 'total', {totals} from c"


@query(_matrix_sql())
def error_matrix_pivot(spark, folder):
    out = aggregates.matrix(labels(spark, folder).filter("fine is not null"), "fine", "model", MODELS)
    return out.select("fine", *[r6(F.col(f"`{m}`")).alias(m) for m in MODELS])


@query(f"""with {ITEMS}, d as (select capability_group, case when duration_s < 15 then 0 when duration_s < 60 then 1 when duration_s < 180 then 2 when duration_s < 600 then 3 when duration_s < 1800 then 4 when duration_s < 3600 then 5 else 6 end as g from items_now where duration_s >= 0 and not isnan(duration_s) and capability_group is not null)
select capability_group, {", ".join(f'count(*) filter (g = {k}) as "{k}"' for k in range(7))}, count(*) as total from d group by 1""")
def composition_crosstab(spark, folder):
    rows = items(spark, folder, ["capability_group", "duration_s"]).withColumn("g", frames.duration_group(F.col("duration_s")).cast("string")).filter("g is not null and capability_group is not null")
    return aggregates.crosstab(rows, "capability_group", "g", [str(k) for k in range(7)])


@query(f"""with {LABELS}, c as (select model, fine, count(*) as n from labels_now where fine is not null group by 1, 2), m as (select distinct model from c), f as (select distinct fine from c),
x as (select a.model as a, b.model as b, f.fine, coalesce(ca.n, 0) as na, coalesce(cb.n, 0) as nb from m a join m b on a.model < b.model cross join f left join c ca on ca.model = a.model and ca.fine = f.fine left join c cb on cb.model = b.model and cb.fine = f.fine)
select a, b, round(sum(least(na, nb)) / sum(greatest(na, nb)), 6) as jaccard from x group by 1, 2""")
def weighted_jaccard(spark, folder):
    cells = labels(spark, folder).filter("fine is not null").groupBy("model", "fine").agg(F.count("*").alias("n"))
    return aggregates.weighted_jaccard(cells, "model", "fine", "n").withColumn("jaccard", r6("jaccard"))


@query(f"""with {LABELS}, x as (select case when model like 'clipper%' then 'own' else 'other' end as side, fine from labels_now where fine is not null), c as (select side, fine, count(*) as o from x group by 1, 2), s as (select side, sum(o) as rs from c group by 1), l as (select fine, sum(o) as cs from c group by 1), n as (select sum(o) as n from c),
f as (select s.side, l.fine, rs * cs / n as e, coalesce(o, 0) as o, n from s cross join l cross join n left join c on c.side = s.side and c.fine = l.fine) select round(sum((o - e) ** 2 / e), 4) as chi2, ((count(distinct side) - 1) * (count(distinct fine) - 1))::bigint as dof, any_value(n)::bigint as n from f""")
def self_attribution_chi2(spark, folder):
    rows = labels(spark, folder).withColumn("side", F.when(F.col("model").startswith("clipper"), "own").otherwise("other"))
    return aggregates.chi_square(rows, "side", "fine").withColumn("chi2", F.round("chi2", 4))


FUNNEL = ["open", "no_video", "easy", "long"]


def _removed(rows: DataFrame) -> DataFrame:
    reason = F.when(F.col("options").isNull(), "open").when(F.col("video_id").isNull(), "no_video").when(F.col("attack_pct") > 0.8, "easy").when(F.col("duration_s") > 1800, "long")
    return rows.withColumn("removed_by", reason)


@query(f"""with {ITEMS}, r as (select case when options is null then 'open' when video_id is null then 'no_video' when attack_pct > 0.8 then 'easy' when duration_s > 1800 then 'long' end as removed_by from items_now),
s as (select * from (values (1, 'open'), (2, 'no_video'), (3, 'easy'), (4, 'long')) t(ord, stage)), c as (select ord, stage, count(removed_by) as removed from s left join r on removed_by = stage group by 1, 2), n as (select count(*) as n from r)
select ord, stage, (n - sum(removed) over (order by ord) + removed)::bigint as entering, removed, (n - sum(removed) over (order by ord))::bigint as remaining from c cross join n""")
def funnel_chain(spark, folder):
    rows = _removed(items(spark, folder, ["options", "video_id", "attack_pct", "duration_s"]))
    stages = spark.createDataFrame([*enumerate(FUNNEL, 1)], "ord int, stage string")
    return aggregates.funnel(rows, "removed_by", stages)


@query()
def removal_reasons(spark, folder):
    rows = items(spark, folder, ["options", "video_id", "attack_pct", "duration_s", "answer"]).withColumn("form", options.resolve_gold(F.col("answer"), F.col("options"))["format"])
    step = lambda c, most: rows.filter(~missing(c)).select("item_id", (F.col(c) > most).alias("remove"))
    out = rules.assign_removal(rows, "form", [("no_video", rows.filter("video_id is null"))], [("text", step("attack_pct", 0.8)), ("long", step("duration_s", 1800))])
    return out.select("item_id", "removed_by", "pending_steps")


@query()
def instance_status(spark, folder):
    rows = labels(spark, folder).withColumn("category", F.col("fine")).select("qid", "model", "agreed_level", "category", name_key("judge_group").alias("judge_group"), "dense_state")
    taxonomy = read(spark, folder, "failure_taxonomy")
    unstable = labels(spark, folder).filter("status = 'unstable'").select("qid", "model")
    return rules.classify(rows, taxonomy, unstable, "not_in_frames").select("qid", "model", "status", "final_group", "subgroup", "basis")


@query(f"""with {ITEMS} select item_id, case when attack_pct < 0.1 then 'reversed_clip' when row_seq % 4 = 0 then 'supported' when row_seq % 4 = 1 and duration_s >= 60 and not isnan(duration_s) then 'not_verifiable_long' when row_seq % 4 = 1 then 'not_verifiable_short' when row_seq % 4 = 2 then 'contradicted' else 'no_verdict' end as reason,
case when attack_pct < 0.1 then true when row_seq % 4 = 0 then true when row_seq % 4 = 1 and duration_s >= 60 and not isnan(duration_s) then true else false end as keep from items_now""")
def keep_rule(spark, folder):
    rows = items(spark, folder, ["row_seq", "duration_s", "attack_pct"])
    verdict = F.element_at(F.array(F.lit("supported"), F.lit("not_verifiable"), F.lit("contradicted"), F.lit(None)), (F.col("row_seq") % 4 + 1).cast("int"))
    rule = rules.keep_rule(verdict, F.col("attack_pct") < 0.1, F.col("duration_s"))
    return rows.select("item_id", rule["reason"].alias("reason"), rule["keep"].alias("keep"))


@query(f"""with {RESULTS}, e as (select 'm' || event_id % 3 as model, event_type = 'click' as blind, user_id as item, user_id % 4 as g0, correct::int as c, k from results where correct is not null), b as (select model, item, avg(c) as b from e where blind group by 1, 2),
v as (select e.model, item, g0::varchar as g, c, k, b from e left join b using (model, item) where not blind)
select model, count(*) as n, round(100.0 * avg(c), 6) as video, round(100.0 * avg(b), 6) as blind, round(100.0 * (avg(case when b is not null then c end) - avg(b)), 6) as gain, count(b) as n_blind, round(100.0 * avg(case when g = '0' then c end), 6) as "0", count(*) filter (g = '0') as "0_n", round(100.0 * avg(case when g = '1' then c end), 6) as "1", count(*) filter (g = '1') as "1_n", round(100.0 * avg(case when g = '2' then c end), 6) as "2", count(*) filter (g = '2') as "2_n", round(100.0 * avg(case when g = '3' then c end), 6) as "3", count(*) filter (g = '3') as "3_n",
avg(16.0)::double as mean_frames, 0::bigint as fallback_items, 0::bigint as unanswered, count(*) < 150 as partial from v group by 1""")
def evaluation_table(spark, folder):
    rows = results(spark, folder).filter("correct is not null").select(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.when(F.col("event_type") == "click", "blind").otherwise("video").alias("protocol"), F.col("user_id").cast("string").alias("item_id"), (F.col("user_id") % 4).cast("string").alias("capability_group"), "correct", F.lit(16).alias("frames"), F.lit(0).alias("fallback"), F.col("k").cast("string").alias("pred"))
    out = rules.evaluation_table(rows, ["0", "1", "2", "3"], 150)
    return out.withColumns({c: r6(c) for c in ("video", "blind", "gain", "0", "1", "2", "3")})


# Duplicates and vectors.


@query("select a.vec_id::varchar as a, b.vec_id::varchar as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a join embeddings b on a.label = b.label and a.vec_id::varchar < b.vec_id::varchar where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.4")
def near_duplicate_pairs(spark, folder):
    return dedup.cosine_pairs(read(spark, folder, "embeddings"), "vec_id", ["label"], "embedding", 0.4).withColumn("cos", r6("cos"))


_COMPONENTS = """p as (select a.vec_id::varchar as a, b.vec_id::varchar as b from embeddings a join embeddings b on a.label = b.label and a.vec_id::varchar < b.vec_id::varchar where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.4),
e as (select a, b from p union select b, a from p), reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)"""


@query(f"with recursive {_COMPONENTS} select a as id, least(a, min(b)) as root from reach group by a")
def duplicate_components(spark, folder):
    return dedup.min_label_groups(dedup.cosine_pairs(read(spark, folder, "embeddings"), "vec_id", ["label"], "embedding", 0.4))


@query("""select a.c_custkey as c_custkey_a, b.c_custkey as c_custkey_b from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey where abs(a.c_acctbal - b.c_acctbal) < 5""")
def block_self_join(spark, folder):
    out = joins.block_self_join(read(spark, folder, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"], ["c_acctbal"], band=("c_acctbal", 5))
    return out.select("c_custkey_a", "c_custkey_b")


@query("""with t as (select l_orderkey, l_linenumber, least(l_quantity, l_tax * 500) as a0, greatest(l_quantity, l_tax * 500) as a1, least(l_discount * 400, 20.0) as b0, greatest(l_discount * 400, 20.0) as b1 from lineitem)
select l_orderkey, l_linenumber, round(case when greatest(a1, b1) - least(a0, b0) > 0 then greatest(0.0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) when abs(a0 - b0) <= 1e-6 then 1.0 else 0.0 end, 6) as iou from t""")
def pair_iou(spark, folder):
    iou = text.interval_iou(F.col("l_quantity"), F.col("l_tax") * 500, F.col("l_discount") * 400, F.lit(20.0))
    return read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", r6(iou).alias("iou"))


@query("""with t as (select l_orderkey, l_linenumber, [-(l_quantity / 10), -(l_tax * 10), -(l_discount * 20), -1.5::double] as lp, (l_partkey % 4)::int as gold from lineitem)
select l_orderkey, l_linenumber, round(lp[gold + 1] - (list_sum(lp) - lp[gold + 1]) / 3, 6) as margin, (list_position(lp, list_max(lp)) - 1)::int as best, round(exp(list_max(lp)) / list_sum(list_transform(lp, lambda x: exp(x))), 6) as confidence from t""")
def logsumexp_margin(spark, folder):
    lp = F.array(-(F.col("l_quantity") / 10), -(F.col("l_tax") * 10), -(F.col("l_discount") * 20), F.lit(-1.5))
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", lp.alias("lp"), (F.col("l_partkey") % 4).cast("int").alias("gold"))
    return rows.select("l_orderkey", "l_linenumber", r6(numeric.margin(F.col("lp"), F.col("gold"))).alias("margin"), numeric.argmax(F.col("lp")).alias("best"), r6(numeric.confidence(F.col("lp"))).alias("confidence"))


# Videos and frames.


@query("""select video_id, case when isnan(d) then null when d < 0 then null when d < 15 then 0 when d < 60 then 1 when d < 180 then 2 when d < 600 then 3 when d < 1800 then 4 when d < 3600 then 5 when d >= 3600 then 6 end as bucket from (select video_id, original_duration as d from video_meta)""")
def duration_bucket(spark, folder):
    return read(spark, folder, "video_meta").select("video_id", frames.duration_group(F.col("original_duration")).alias("bucket"))


@query("""with e as (select * from (values (0, 0.0, 15.0), (1, 15.0, 60.0), (2, 60.0, 600.0), (3, 600.0, null)) t(slot, lo, hi)) select video_id, slot from video_meta left join e on not isnan(original_duration) and original_duration >= lo and (hi is null or original_duration < hi)""")
def interval_join(spark, folder):
    edges = spark.createDataFrame([(0, 0.0, 15.0), (1, 15.0, 60.0), (2, 60.0, 600.0), (3, 600.0, None)], "slot int, lo double, hi double")
    rows = read(spark, folder, "video_meta").select("video_id", F.when(~F.isnan("original_duration"), F.col("original_duration")).alias("d"))
    return joins.interval_join(rows, "d", edges, "lo", "hi").select("video_id", "slot")


_OK = "case when not isnan({0}) and {0} > 0 and {0} < 1e12 then {0} end"


@query(f"""with {ITEMS}, m as (select {_ID.format("video_id")} as v, original_duration as o, case when frame_timestamps is not null then frame_timestamps[-1] + 0.5 end as t from video_meta)
select item_id, round(coalesce({_OK.format("o")}, {_OK.format("t")}, {_OK.format("duration_s")}), 6) as seconds from items_now left join m on v = {_ID.format("video_id")}""")
def video_duration(spark, folder):
    meta = read(spark, folder, "video_meta").select(trimmed("video_id").alias("v"), "original_duration", "frame_timestamps")
    rows = items(spark, folder, ["video_id", "duration_s"])
    joined = rows.join(meta, trimmed("video_id") == F.col("v"), "left")
    seconds = frames.video_duration(F.col("original_duration"), F.lit(None).cast("double"), F.col("frame_timestamps"), F.col("duration_s"))
    return joined.select("item_id", r6(seconds).alias("seconds"))


@query("""with t as (select video_id, frame_timestamps as ts, unnest([0.0, 7.25, 30.0, 61.5]) as target from video_meta where len(frame_timestamps) > 0), d as (select video_id, target, list_transform(ts, lambda x: abs(x - target)) as d from t)
select video_id, target::double as target, (list_position(d, list_min(d)) - 1)::int as frame from d""")
def nearest_frame(spark, folder):
    rows = read(spark, folder, "video_meta").filter(F.size("frame_timestamps") > 0)
    rows = rows.select("video_id", "frame_timestamps", F.explode(F.array(*[F.lit(x) for x in (0.0, 7.25, 30.0, 61.5)])).alias("target"))
    return rows.select("video_id", "target", frames.nearest(F.col("frame_timestamps"), F.col("target")).cast("int").alias("frame"))


@query("""with m as (select video_id, n_frames as n, least(n_frames, 8) as k from video_meta where n_frames > 0), i as (select video_id, n, k, unnest(range(k)) as i from m),
p as (select distinct video_id, cast(round_even(i * (n - 1) / greatest(k - 1, 1), 0) as int) as f from i) select video_id, count(*) as places, min(f) as first_place, max(f) as last_place, sum(f)::bigint as total from p group by 1""")
def frame_grid(spark, folder):
    rows = read(spark, folder, "video_meta").filter("n_frames > 0").select("video_id", F.explode(frames.thin(F.col("n_frames"), 8)).alias("f"))
    return rows.groupBy("video_id").agg(F.count("*").alias("places"), F.min("f").alias("first_place"), F.max("f").alias("last_place"), F.sum("f").alias("total"))


@query()
def frames_per_second(spark, folder):
    fps = F.col("n_frames") / F.nullif(F.col("original_duration"), F.lit(0.0))
    picked = frames.per_second(F.col("n_frames"), F.when(~F.isnan(fps), fps), frames.usable(F.col("original_duration")))
    return read(spark, folder, "video_meta").select("video_id", F.size(picked).alias("n"), frames.certificate(picked).alias("certificate"))


@query()
def resolved_videos(spark, folder):
    files = read(spark, folder, "video_meta").select(F.concat(F.lit("videos/"), trimmed("video_id"), F.lit(".mp4")).alias("path"), F.when(F.col("n_frames") % 2 == 0, F.lit("part.tar")).alias("archive"))
    rows = items(spark, folder, ["video"])
    return joins.resolve_references(rows, "video", joins.file_keys(files, "path", "archive")).select("item_id", "location")


# Registry and tables.


@query("""with b as (select c_custkey as k, c_mktsegment as seg, c_acctbal as bal from customer), n as (select c_custkey as k, case when c_custkey % 2 = 0 then 'NEW' end as seg, c_nationkey as nation from customer where c_custkey % 3 = 0 union all select -s_suppkey, 'SUP', s_nationkey from supplier)
select k, coalesce(n.seg, b.seg) as seg, bal, nation from b full join n using (k)""")
def upsert_registry(spark, folder):
    c, s = read(spark, folder, "customer"), read(spark, folder, "supplier")
    base = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("seg"), F.col("c_nationkey").alias("nation"))
    return sinks.upsert(base, new.union(s.select((-F.col("s_suppkey")).alias("k"), F.lit("SUP").alias("seg"), F.col("s_nationkey").alias("nation"))), "k")


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey not in (1, 3) union all select n_nationkey, upper(n_name) || '!', n_regionkey from nation where n_regionkey in (1, 3) and n_nationkey % 2 = 0")
def partition_merge(spark, folder):
    nation = read(spark, folder, "nation")
    new = nation.filter("n_regionkey in (1, 3) and n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return sinks.merge_rows(nation, new.unionByName(nation.filter("n_regionkey in (1, 3) and false")), "n_regionkey")


@query("select c_custkey, coalesce(case when o.p is not null then o.p end, c_mktsegment) as c_mktsegment from customer left join (select o_custkey, min(o_orderpriority) as p from orders where o_orderstatus = 'F' group by 1) o on o_custkey = c_custkey")
def label_overlay(spark, folder):
    patch = read(spark, folder, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"))
    return joins.overlay(read(spark, folder, "customer").select("c_custkey", "c_mktsegment"), patch, ["c_custkey"], ["c_mktsegment"])


@query("""with o as (select o_custkey, max(o_totalprice) filter (where o_orderstatus = 'F') as f, max(o_totalprice) filter (where o_orderstatus = 'O') as o from orders group by 1) select c_custkey, coalesce(f, o) as value, case when f is not null then 'own' when o is not null then 'other' end as origin from customer left join o on o_custkey = c_custkey""")
def first_source_wins(spark, folder):
    top = lambda s: read(spark, folder, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return joins.first_match(read(spark, folder, "customer").select("c_custkey"), [("own", top("F")), ("other", top("O"))], ["c_custkey"], "v", "value", "origin")


@query()
def ingest_records(spark, folder):
    spec = readers.IngestSpec("items", {"video": "{video|stem}.mp4", "question": "question", "answer": "answer", "options": "options", "subtask": "fine_category"}, filters=[{"field": "license", "not_in": ["unknown"]}], dedupe=True)
    return readers.records(read(spark, folder, "items"), spec, "row_seq").select("n", "v", "q", "a", "sub")


@query()
def report_cards(spark, folder):
    return sinks.markdown_cards(chance_by_benchmark(spark, folder), "benchmark")


# Seeded and iterative operators: no SQL.


@query()
def permutation_fanout_seeded(spark, folder):
    rows = items(spark, folder, ["options", "answer_idx"]).filter("size(options) between 2 and 16 and answer_idx >= 0 and answer_idx < size(options)").withColumn("k", F.size("options"))
    out = sampling.fan_out(rows.select("item_id", "k", "options", "answer_idx"), "item_id", "k")
    return out.select("item_id", "perm_id", "perm", options.permuted_gold(F.col("perm"), F.col("answer_idx")).alias("gold"))


@query()
def stratified_sample_seeded(spark, folder):
    return sampling.stratified_sample(items(spark, folder, ["benchmark", "fine_category"]), "benchmark", "fine_category", "item_id", 60)


@query()
def sample_refill(spark, folder):
    rows = items(spark, folder, ["benchmark", "fine_category", "video_id", "options"]).withColumn("eligible", F.col("options").isNotNull())
    drawn = sampling.stratified_sample(rows, "benchmark", "fine_category", "item_id", 60)
    marks = drawn.select(F.col("grp").alias("benchmark"), F.col("key").alias("item_id"), (F.pmod(F.xxhash64("key"), F.lit(10)) == 0).alias("removed"))
    return sampling.refill(rows, marks, "benchmark", "fine_category", "item_id", 60)


ORDERING = r"(?i)\b(?:order|sequence)\b.*\b(?:events?|actions?|steps?)\b|chronological"  # questions that ask for an order


def _coverage_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Candidates of the coverage selection and the counts of what is left out: whole templates with the number of candidates
    that share them, calibrated leader clusters of the videos, a missing attack_pct as the largest. No table has vectors of
    videos: a hash of the video's name picks one of the embeddings."""
    scratch = Scratch(spark)
    rows = items(spark, folder, ["benchmark", "video_id", "capability_group", "fine_category", "duration_s", "attack_pct", "question", "license"])
    most = rows.agg(F.coalesce(F.max(F.when(~missing("attack_pct"), F.col("attack_pct"))), F.lit(0.0)).alias("most"))
    pct = F.coalesce(F.when(~missing("attack_pct"), F.col("attack_pct")), F.col("most"))
    rows = rows.crossJoin(F.broadcast(most)).select("item_id", "benchmark", trimmed("video_id").alias("video_id"), "duration_s", F.col("capability_group").alias("scene"), F.col("fine_category").alias("task"), pct.alias("attack_pct"), "question", F.lit("none").alias("removed_by"), F.when(F.col("license").isNull(), "license").alias("pending_steps"))
    rows = scratch.put(rows)
    vectors = read(spark, folder, "embeddings")
    last = vectors.agg((F.max("vec_id") + 1).alias("n"))
    timed = rows.withColumn("grp", frames.duration_group(F.col("duration_s"))).filter("video_id is not null and grp is not null")
    videos = timed.groupBy("video_id").agg(F.min("grp").alias("grp")).crossJoin(F.broadcast(last)).withColumn("vec_id", F.pmod(F.xxhash64("video_id"), "n"))
    videos = scratch.put(videos.join(vectors.select("vec_id", "embedding"), "vec_id", "left"))
    clusters = selection.leader_clusters(videos, "video_id", "grp", "embedding", fixed=0.5).select(F.col("key").alias("video_id"), "cluster")
    groups = videos.select("video_id", "grp").join(clusters, "video_id", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("video:"), F.col("video_id"))))
    return selection.eligible(rows, scratch.put(groups), text.question_template("question"), F.col("question").rlike(ORDERING))


@query()
def coverage_select(spark, folder):
    return selection.coverage_select(_coverage_rows(spark, folder)[0], list(range(7)), 400)


@query(rf"""with {ITEMS}, v as (select {_ID.format("video_id")} as v, min(case when duration_s >= 0 and not isnan(duration_s) then duration_s end) as d from items_now where {_ID.format("video_id")} is not null group by 1)
select count(*) filter (license is null) as n_pending, count(*) filter (license is not null and (v.d is null)) as n_no_group, count(*) filter (license is not null and v.d is not null and coalesce(capability_group, '') = '') as n_unlabelled,
count(*) filter (license is not null and v.d is not null and capability_group <> '' and regexp_matches(question, '(?i)\b(?:order|sequence)\b.*\b(?:events?|actions?|steps?)\b|chronological')) as n_unscorable from items_now left join v on v.v = {_ID.format("video_id")}""")
def selection_exclusions(spark, folder):
    return _coverage_rows(spark, folder)[1]


@query()
def leader_clusters(spark, folder):
    return selection.leader_clusters(read(spark, folder, "embeddings"), "vec_id", "label", "embedding", fixed=0.5)


@query()
def prequential_learner(spark, folder):
    rows = read(spark, folder, "embeddings").withColumns({"k": F.lit(4), "gold": F.col("label") % 4})
    return learner.prequential(rows.withColumn("grp", F.lit("all")), "grp", "vec_id", "embedding", "k", "gold", seeds=3)


@query()
def five_fold_attacker(spark, folder):
    return learner.five_fold(read(spark, folder, "embeddings").withColumn("grp", F.lit("all")), "grp", "vec_id", "embedding", "label")


# Summary tables of the pipelines.


@query(f"""with {LABELS}, x as (select model, count(*) as n, count(*) filter (status in ('ok', 'other')) as good, count(*) filter (status = 'disputed') as bad from labels_now group by 1)
select model, n, round(good / n, 6) as settled, round(bad / n, 6) as disputed from x""")
def status_rates(spark, folder):
    out = reports.rates(labels(spark, folder).filter("status is not null"), ["model"], {"settled": F.col("status").isin("ok", "other"), "disputed": F.col("status") == "disputed"})
    return out.withColumns({"settled": r6("settled"), "disputed": r6("disputed")})


@query(f"""with {LABELS}, c as (select model, fine, count(*) as n from labels_now where fine is not null group by 1, 2), m as (select distinct model from labels_now), f as (select category as fine from failure_taxonomy)
select model, fine, coalesce(n, 0) as n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) over (partition by model), 0), 6) as share from m cross join f left join c using (model, fine)""")
def fine_category_table(spark, folder):
    rows = labels(spark, folder)
    out = reports.full_cells(rows, "model", "fine", rows, read(spark, folder, "failure_taxonomy").select(F.col("category").alias("fine")))
    return out.withColumn("share", r6("share"))


@query(f"""with {LABELS}, p as (select model, qid, sum((status = 'disputed')::int) as s, count(status) as n from labels_now group by 1, 2 having count(status) > 0) select model, round(sum(s) / sum(n), 6) as instance_rate, round(avg(s / n), 6) as item_rate from p group by 1""")
def pooled_two_weightings(spark, folder):
    out = reports.two_weightings(labels(spark, folder), ["model"], "qid", F.col("status") == "disputed")
    return out.select("model", r6("instance_rate").alias("instance_rate"), r6("item_rate").alias("item_rate"))


@query(f"""with {RESULTS} select event_type, count(*) as rerun, count(*) filter (correct) as recovered, count(*) filter (correct is null) as unscorable, count(*) filter (k > 95) as refused, round(count(*) filter (correct) / nullif(count(correct), 0), 6) as rate from results group by 1""")
def recovered_table(spark, folder):
    rows = results(spark, folder).withColumns({"still_wrong": ~F.col("correct"), "refused": F.col("k") > 95})
    return reports.recovered(rows, ["event_type"]).withColumn("rate", r6("rate"))


@query(f"""with {LATEST_RESULTS}, s as (select distinct user_id, event_type from latest where event_type <> 'error'), c as (select user_id, event_type, correct as flipped from latest where user_id % 3 = 0)
select event_type, count(*) as requested, count(c.user_id) as checked, count(*) filter (flipped) as flipped, round(count(*) filter (flipped) / nullif(count(flipped), 0), 6) as rate from s left join c using (user_id, event_type) group by 1""")
def unstable_rate(spark, folder):
    rows = latest_results(spark, folder)
    checks = rows.filter("user_id % 3 = 0").withColumn("flipped", F.col("correct"))
    return reports.flipped_rate(checks, rows.filter("event_type <> 'error'"), ["user_id", "event_type"], ["event_type"]).withColumn("rate", r6("rate"))


@query(f"""with {ITEMS}, r as (select benchmark, video_id, case when options is null then 'open' when video_id is null then 'no_video' when attack_pct > 0.8 then 'easy' when duration_s > 1800 then 'long' else 'none' end as removed_by, case when attack_pct is null then 'text' else '' end as pending from items_now)
select benchmark, count(*) as n, {", ".join(f"count(*) filter (removed_by = '{x}') as n_{x}" for x in FUNNEL)}, count(*) filter (removed_by = 'none') as remaining, count(*) filter (removed_by = 'none' and pending <> '') as pending, count(distinct case when removed_by = 'none' then video_id end) as videos from r group by 1""")
def pool_summary(spark, folder):
    rows = _removed(items(spark, folder, ["benchmark", "options", "video_id", "attack_pct", "duration_s"]))
    rows = rows.withColumns({"removed_by": F.coalesce("removed_by", F.lit("none")), "pending_steps": F.when(F.col("attack_pct").isNull(), "text").otherwise("")})
    return reports.pool_summary(rows, ["benchmark"], FUNNEL)


@query(_quota_sql(50).replace("with ", "with picked as (with ", 1) + f""") , {ITEMS} select benchmark, count(*) as total, count(p.item_id) as selected, count(distinct p.video_id) as videos, {", ".join(f"count(*) filter (p.item_id is not null and capability_group = '{g}') as n_{g}" for g in CAPABILITIES)}, round(100.0 * count(p.item_id) / count(*), 6) as percent from items_now i left join picked p on p.item_id = i.item_id group by 1""")
def source_table(spark, folder):
    pool = items(spark, folder, ["benchmark", "video_id", "capability_group"]).withColumn("video_id", trimmed("video_id"))
    out = reports.source_table(pool, quota_composition(spark, folder).select("item_id"), "benchmark", "item_id", "capability_group", CAPABILITIES)
    return out.withColumn("percent", r6("percent"))


@query(f"""with {ITEMS}, v as (select benchmark, {_ID.format("video_id")} as video_id, case when {SCORE_OK} then attack_pct end as attack_pct, case when not isnan(chance) then chance end as chance, case when not isnan(duration_s) then duration_s end as duration_s from items_now)
select count(*) as items, count(distinct benchmark) as benchmarks, count(distinct video_id) as videos, round(median(attack_pct), 6) as attack_median, max(attack_pct) as attack_max, round(avg(chance), 6) as mean_chance, count(*) filter (duration_s >= 300) as long_items from v""")
def selection_summary(spark, folder):
    rows = items(spark, folder, ["benchmark", "video_id", "attack_pct", "chance", "duration_s"]).withColumn("video_id", trimmed("video_id"))
    known = lambda c, ok=True: F.when(~missing(c) & ok, F.col(c))
    out = reports.selection_summary(rows.withColumns({"attack_pct": known("attack_pct", F.col("attack_pct").between(0, 1)), "chance": known("chance"), "duration_s": known("duration_s")}))
    return out.withColumns({"attack_median": r6("attack_median"), "mean_chance": r6("mean_chance")})


@query(f"with {LATEST_RESULTS} select event_type, count(*) as answered, count(correct) as scored, count(*) filter (correct) as correct from latest group by 1")
def run_status(spark, folder):
    rows = results(spark, folder).withColumn("seq", F.struct("ts", "event_id"))
    return reports.run_status(rows, ["event_type"], ["user_id"])


@query(f"with {LABELS}, c as (select fine, count(*) as n from labels_now where fine is not null group by 1), t as (select sum(n) as t from c) select fine, n, round(n / t, 6) as share from c cross join t where n / t > 0.02")
def frequent_failures(spark, folder):
    return reports.frequent(labels(spark, folder), "fine", 0.02).withColumn("share", r6("share"))


@query("select o_custkey % 12 as benchmark, round(avg((o_orderkey % 3 <> 0)::int) - avg(1.0::double / (2 + o_orderkey % 4)), 6) as margin, avg((o_orderkey % 3 <> 0)::int) - avg(1.0::double / (2 + o_orderkey % 4)) <= 0.345 as near from orders group by 1")
def near_chance(spark, folder):
    return reports.near_chance(_attack(spark, folder)[0], ["benchmark"], 0.345).withColumn("margin", r6("margin"))


@query(f"with {ITEMS}, c as (select video_id, benchmark, count(*) as n from items_now where video_id is not null group by 1, 2) select video_id, benchmark from (select *, row_number() over (partition by video_id order by n desc, benchmark) as r from c) where r = 1")
def video_home_benchmark(spark, folder):
    return aggregates.majority(items(spark, folder, ["video_id", "benchmark"]).filter("video_id is not null"), ["video_id"], "benchmark", [])


@query(f"with {ITEMS}, b as (select * from items_now where question is not null) select item_id, question || case when len(options) > 0 then chr(10) || array_to_string(list_transform(options, lambda x, i: chr(64 + i::int) || '. ' || coalesce(x, '')), chr(10)) else '' end as rendered from b")
def rendered_items(spark, folder):
    rows = items(spark, folder, ["question", "options"]).filter("question is not null")
    return rows.select("item_id", options.render_item(F.col("question"), F.col("options")).alias("rendered"))


@query("select source, lang, text_id from (select source, lang, doc_id as text_id, row_number() over (partition by source order by doc_id) as r from documents where source is not null) where r = 1")
def first_document_per_source(spark, folder):
    rows = read(spark, folder, "documents").filter("source is not null").select("source", "lang", F.col("doc_id").alias("text_id"))
    return selection.hardest_per(rows, ["source"], ["text_id"])


@query(f"with {ITEMS}, s as (select item_id, benchmark from items_now where duration_s > 100 and not isnan(duration_s)) select i.item_id, i.benchmark from items_now i where i.item_id not in (select item_id from s)")
def removed_items(spark, folder):
    rows = items(spark, folder, ["benchmark", "duration_s"])
    return joins.remaining(rows, rows.filter((F.col("duration_s") > 100) & ~F.isnan("duration_s")), ["item_id"]).select("item_id", "benchmark")


@query()
def pool_manifest(spark, folder):
    rows = items(spark, folder, ["benchmark", "options", "answer", "video_id"]).withColumn("g", options.resolve_gold(F.col("answer"), F.col("options")))
    return reports.manifest(rows.select("benchmark", "video_id", F.col("g.format").alias("form"), F.col("g.reason").alias("reason")), ["benchmark"])


@query()
def release_summary(spark, folder):
    return reports.release(items(spark, folder, ["capability_group", "benchmark", "license"]), ["capability_group", "benchmark", "license"])


@query()
def seeded_condition_frames(spark, folder):
    kinds = F.explode(F.array(F.lit("uniform"), F.lit("shuffle"), F.lit("window"))).alias("kind")
    rows = read(spark, folder, "video_meta").filter("n_frames > 0").select("video_id", "n_frames", kinds)
    return rows.select("video_id", "kind", frames.seeded_frames("kind", "n_frames", F.lit(8), "video_id").alias("places"))

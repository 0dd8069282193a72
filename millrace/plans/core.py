"""Registered queries over text, joins, aggregates and windows, each with its SQL.

SQL is written for the same tables as views; floats are rounded last, on both sides, to keep the order of
summation out of the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import relational as R
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """negative_pair with each key once: repeated rows have the same content but for the time of arrival."""
    return table(spark, d, "negative_pair").drop("ingested_at").dropDuplicates(["id"])


def prefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preference_row").drop("ingested_at").dropDuplicates(["id"])


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").drop("ingested_at").dropDuplicates(["sample_id"])


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_sample").dropDuplicates(["id", "review_round"])


NP = "(select distinct on (id) * from negative_pair)"
PR = "(select distinct on (id) * from preference_row)"
SM = "(select distinct on (sample_id) * from samples)"
RV = "(select distinct on (id, review_round) * from review_sample)"
TRIM = r"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
NORM = r"regexp_replace(regexp_replace(lower(" + TRIM + r"), '[\s\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def norm_sql(c: str) -> str:
    return NORM.format(c=c)


def tok_sql(c: str) -> str:
    return TOK.format(c=c)


SPLIT_SQL = "case when lower(trim(split)) like 'tr%' then 'train' when split is null or trim(split) = '' then null else 'held' end"


def _side(c: str = "split"):
    s = F.lower(F.trim(F.col(c)))
    return F.when(s.startswith("tr"), "train").when(s.isNull() | (s == ""), F.lit(None)).otherwise("held")


# ---- text


@query(
    f"""with s as (select sample_id, {SPLIT_SQL} side, coalesce(patient_context, '') e, {norm_sql("patient_context")} n from {SM}),
    t as (select * from s where side = 'train')
    select sample_id, case when e in (select e from t) then 'exact' else 'normalized' end as match
    from s where side = 'held' and (e in (select e from t) or n in (select n from t))"""
)
def exact_overlap(spark, d):
    """Evaluation rows whose text, exactly or normalised, is also a training text."""
    s = samples(spark, d).select("sample_id", _side().alias("side"), F.coalesce("patient_context", F.lit("")).alias("e"), X.normalize_answer(F.col("patient_context")).alias("n"))
    return R.exact_or_normal_overlap(s.filter("side = 'held'"), s.filter("side = 'train'"), "sample_id", "e", "n")


@query("""select source, count(*) n_docs, count(distinct title) n_titles, round(avg(length(text)), 4) mean_chars, max(length(text)) most_chars,
    count(distinct specialty) n_specialties from documents group by source""")
def corpus_stats(spark, d):
    """Per source: documents, distinct titles, characters, specialties."""
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_distinct("title").alias("n_titles"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).alias("most_chars"), F.count_distinct("specialty").alias("n_specialties")
    )


@query("""select specialty, count(*) n from documents where specialty is not null and specialty <> '' group by specialty order by n desc, specialty limit 20""")
def top_specialties(spark, d):
    """The 20 commonest specialties, ties by name."""
    return table(spark, d, "documents").filter("specialty <> ''").groupBy("specialty").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "specialty").limit(20)


@query(f"select id, {norm_sql('final_answer')} answer_norm, {norm_sql('negative_final_answer')} negative_norm from {NP}")
def normalize_answers(spark, d):
    """Both answers of each pair, normalised."""
    return pairs(spark, d).select("id", X.normalize_answer(F.col("final_answer")).alias("answer_norm"), X.normalize_answer(F.col("negative_final_answer")).alias("negative_norm"))


_JAC = "case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct(list_concat({a}, {b}))) end"


@query(f"""with t as (select id, {tok_sql("reasoning")} a, {tok_sql("negative_reasoning")} b from {NP})
    select id, round({_JAC.format(a="a", b="b")}, 6) jaccard from t""")
def token_jaccard(spark, d):
    """Token Jaccard of each reasoning and its rewrite."""
    return pairs(spark, d).select("id", F.round(X.jaccard(X.tokens(F.col("reasoning")), X.tokens(F.col("negative_reasoning"))), 6).alias("jaccard"))


@query(f"""with t as (select id, {norm_sql("final_answer")} x, {norm_sql("negative_final_answer")} y, {tok_sql("final_answer")} a, {tok_sql("negative_final_answer")} b from {NP})
    select id, round(case when x = '' or y = '' then 0.0 when x = y then 1.0 when contains(x, y) or contains(y, x) then 0.95 else {_JAC.format(a="a", b="b")} end, 6) score from t""")
def text_match_score(spark, d):
    """How well the rewritten answer matches the right one."""
    return pairs(spark, d).select("id", F.round(X.match_score(F.col("final_answer"), F.col("negative_final_answer")), 6).alias("score"))


@query(f"""with t as (select id, {tok_sql("reasoning")} s, {tok_sql("negative_reasoning")} t from {NP})
    select id, round(case when len(t) = 0 then 1.0 else len(list_filter(t, lambda x: not list_contains(s, x)))::double / len(t) end, 6) novelty,
    round(len(t)::double / greatest(len(s), 1), 6) length_ratio,
    round(len(list_intersect(list_distinct(s), list_distinct(t)))::double / greatest(len(list_distinct(s)), 1), 6) topic_overlap from t""")
def rewrite_ratios(spark, d):
    """Novelty, length ratio and topic overlap of each rewrite."""
    n, s = F.col("negative_reasoning"), F.col("reasoning")
    return pairs(spark, d).select("id", F.round(X.novelty(n, s), 6).alias("novelty"), F.round(X.length_ratio(n, s), 6).alias("length_ratio"), F.round(X.topic_overlap(n, s), 6).alias("topic_overlap"))


@query("""select id, case when length(negative_reasoning) > 200 then rtrim(substr(negative_reasoning, 1, 197)) || '...' else negative_reasoning end preview from """ + NP)
def truncate_preview(spark, d):
    """The first 200 characters of each rewrite, marked where cut."""
    return pairs(spark, d).select("id", X.truncate(F.col("negative_reasoning"), 200).alias("preview"))


@query(f"""select id, coalesce(nullif({TRIM.format(c="rewrite_replacement_span")}, ''), nullif({TRIM.format(c="rewrite_target_span")}, ''), nullif({TRIM.format(c="generation_plan.target_span")}, '')) span from {NP}""")
def first_non_empty(spark, d):
    """The first filled span of several aliases."""
    return pairs(spark, d).select("id", X.first_non_empty(F.col("rewrite_replacement_span"), F.col("rewrite_target_span"), F.col("generation_plan.target_span")).alias("span"))


@query(f"select id, round(('0x' || substr(md5(id), 1, 8))::bigint / 4294967295.0, 9) u from {NP}")
def hash_unit_float(spark, d):
    """A stable number in 0..1 for each key."""
    return pairs(spark, d).select("id", F.round(X.unit_hash(F.col("id")), 9).alias("u"))


_FA = r"(?i)\n\s*final answer\s*:"


@query(rf"""with t as (select id, chosen c, regexp_extract(chosen, '(?i)\n\s*final answer\s*:') m from {PR}), p as (select *, case when m <> '' then instr(c, m) else 0 end i from t)
    select id, length(case when i > 0 then {TRIM.format(c="substr(c, 1, i - 1)")} when c is null then null else {TRIM.format(c="c")} end) reasoning_chars,
    case when i > 0 then {TRIM.format(c="substr(c, i + length(m))")} else '' end final_answer from p""")
def split_response(spark, d):
    """Each chosen response, split at its final answer."""
    p = prefs(spark, d).select("id", X.response_parts(F.col("chosen")).alias("p"))
    return p.select("id", F.length("p.reasoning").alias("reasoning_chars"), F.col("p.final_answer").alias("final_answer"))


@query("""with o as (select id, answer_idx, answer, unnest(map_entries(options)) e from (select distinct on (id) * from mcq_row)),
    f as (select id, any_value(upper(answer_idx)) given, min(case when lower(trim(e.value)) = lower(trim(answer)) then upper(e.key) end) found, count(*) n_options from o group by id)
    select id, coalesce(given, found) as label, n_options from f""")
def mcq_labels(spark, d):
    """The right label of each item: as given, else the option whose text is the answer."""
    m = table(spark, d, "mcq_row").dropDuplicates(["id"]).select("id", "answer_idx", "answer", F.explode("options").alias("k", "v"))
    hit = F.when(F.lower(F.trim("v")) == F.lower(F.trim("answer")), F.upper("k"))
    return m.groupBy("id").agg(F.first(F.upper("answer_idx")).alias("given"), F.min(hit).alias("found"), F.count("*").alias("n_options")).select("id", F.coalesce("given", "found").alias("label"), "n_options")


@query("""select event_type, count(*) n, count(distinct user_id) users, round(sum(value), 2) total, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.9), 6) p90
    from events group by event_type""")
def quantiles(spark, d):
    """Counts and linear-interpolation quantiles per event type."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"),
    )


@query(rf"""select id, review_round, try_cast(regexp_extract(coalesce(reviewer1_clinical_plausibility, ''), '^\s*([1-5])(\.0+)?(/5)?\s*$', 1) as int) score1,
    case when lower(trim(reviewer1_target_type_matched)) in ('true', '1', 'yes', 'y', 't') then true when lower(trim(reviewer1_target_type_matched)) in ('false', '0', 'no', 'n', 'f') then false end matched1 from {RV}""")
def tolerant_casts(spark, d):
    """Scores and booleans in many spellings, null where unreadable."""
    score = F.regexp_extract(F.coalesce("reviewer1_clinical_plausibility", F.lit("")), r"^\s*([1-5])(?:\.0+)?(?:/5)?\s*$", 1).try_cast("int")
    return reviews(spark, d).select("id", "review_round", score.alias("score1"), X.truthy(F.col("reviewer1_target_type_matched")).alias("matched1"))


# ---- joins and sets


@query(f"""select coalesce(case when p.id is null then 'missing_preference' when r.id is null then 'missing_review' end, 'none') skip_reason, count(*) n
    from {NP} n left join (select distinct id from preference_row) p on p.id = n.id left join (select distinct id from review_sample) r on r.id = n.id group by 1""")
def join_skip_reasons(spark, d):
    """Negatives by what keeps them from the three-way join."""
    classified = R.classify_joins(pairs(spark, d), "id", {"preference": table(spark, d, "preference_row"), "review": table(spark, d, "review_sample")})
    return classified.groupBy(F.coalesce("skip_reason", F.lit("none")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query("""select count(*) filter (a is not null and b is not null) n_both, count(*) filter (b is null) n_left_only, count(*) filter (a is null) n_right_only
    from (select distinct id a from preference_row) full outer join (select distinct id b from review_sample) on a = b""")
def common_id_counts(spark, d):
    """Ids in preferences and reviews: common and one-sided."""
    return R.side_counts(table(spark, d, "preference_row"), table(spark, d, "review_sample"), "id")


@query(f"""select n.id, n.error_symbol, coalesce(p.margin, n.m0) margin from (select id, error_symbol, heuristic_qc.similarity m0 from {NP}) n left join {PR} p using (id)""")
def optional_lookup(spark, d):
    """The preference margin of each negative, its similarity where there is none."""
    left = pairs(spark, d).select("id", "error_symbol", F.col("heuristic_qc.similarity").alias("margin"))
    return R.override(left, prefs(spark, d), "id", ["margin"])


@query(f"""with m as (select id, unnest(topo_mask) w, generate_subscripts(topo_mask, 1) - 1 pos from {PR}), s as (select id, unnest(modified_spans) span, generate_subscripts(modified_spans, 1) - 1 pos from {NP})
    select id, pos, w, length(span) span_chars from m join s using (id, pos)""")
def join_by_position(spark, d):
    """Weights and spans of the same key and place in their arrays."""
    m = prefs(spark, d).select("id", F.posexplode("topo_mask").alias("pos", "w"))
    s = pairs(spark, d).select("id", F.posexplode("modified_spans").alias("pos", "span"))
    return m.join(s, ["id", "pos"]).select("id", "pos", "w", F.length("span").alias("span_chars"))


@query(f"""with n as (select sample_id, error_symbol, heuristic_qc.similarity v from {NP} where heuristic_qc is not null), b as (select * from n where error_symbol = 'F1')
    select n.sample_id, n.error_symbol, round(n.v - b.v, 9) delta from n join b using (sample_id) where n.error_symbol <> 'F1'""")
def baseline_self_join(spark, d):
    """Each error type's similarity against that of type F1 of the same sample."""
    n = pairs(spark, d).filter("heuristic_qc is not null").select("sample_id", "error_symbol", F.col("heuristic_qc.similarity").alias("v"))
    b = n.filter("error_symbol = 'F1'").select("sample_id", F.col("v").alias("base"))
    return n.filter("error_symbol <> 'F1'").join(b, "sample_id").select("sample_id", "error_symbol", F.round(F.col("v") - F.col("base"), 9).alias("delta"))


@query("""with x as (select id, margin, ingested_at, 0 side from preference_row union all select id, risk_score::double, returned_at, 1 from review_sample)
    select id, arg_max(margin, (side, ingested_at, margin)) margin from x where id is not null group by id union all select id, margin from x where id is null""")
def ordered_upsert(spark, d):
    """Margins, overridden by the review's risk score: the later side wins, then the later row; rows without an id stay."""
    base = table(spark, d, "preference_row").select("id", "margin", F.struct("ingested_at", "margin").alias("at"))
    score = F.col("risk_score").try_cast("double")
    delta = table(spark, d, "review_sample").select("id", score.alias("margin"), F.struct(F.col("returned_at").alias("ingested_at"), score.alias("margin")).alias("at"))
    return R.upsert(base, delta, ["id"], "at").select("id", "margin")


@query("select id, status from " + NP + " n where not exists (select 1 from review_sample r where r.id = n.id)")
def resume_anti_join(spark, d):
    """Negatives that no review has yet."""
    return pairs(spark, d).select("id", "status").join(table(spark, d, "review_sample").select("id"), "id", "left_anti")


@query(f"""select id from (select id from {PR} except select id from review_sample) union all select id from (select id from {NP} where status = 'infeasible' except select id from {PR})""")
def ledger_recovery(spark, d):
    """Terminal rows that the ledger lacks."""
    p, r = prefs(spark, d).select("id"), table(spark, d, "review_sample").select("id")
    infeasible = pairs(spark, d).filter("status = 'infeasible'").select("id")
    return p.subtract(r).unionAll(infeasible.subtract(p))


@query("""select id, count(*) n_rows, count(distinct margin) n_margins from preference_row group by id having count(*) > 1""")
def key_collisions(spark, d):
    """Keys delivered more than once and whether their content differs."""
    return table(spark, d, "preference_row").groupBy("id").agg(F.count("*").alias("n_rows"), F.count_distinct("margin").alias("n_margins")).filter("n_rows > 1")


# ---- aggregates


@query(f"""select dataset_name, error_symbol, count(*) n, count(*) filter (answer_preserved) n_preserved, round(avg(answer_preserved::int), 6) preserved_rate,
    round(avg((llm_qc.target_type_matched)::int), 6) matched_rate, round(avg(heuristic_qc.similarity), 6) mean_similarity from {NP} group by grouping sets ((), (dataset_name, error_symbol))""")
def group_summary_rates(spark, d):
    """Counts and rates per dataset and error type, and over all; null-aware denominators."""
    flat = pairs(spark, d).select("dataset_name", "error_symbol", "answer_preserved", F.col("llm_qc.target_type_matched").alias("matched"), F.col("heuristic_qc.similarity").alias("similarity"))
    c = F.col("answer_preserved").cast("int")
    return flat.groupingSets([[], ["dataset_name", "error_symbol"]], "dataset_name", "error_symbol").agg(
        F.count("*").alias("n"), F.count_if("answer_preserved").alias("n_preserved"), F.round(F.avg(c), 6).alias("preserved_rate"),
        F.round(F.avg(F.col("matched").cast("int")), 6).alias("matched_rate"), F.round(F.avg("similarity"), 6).alias("mean_similarity"),
    )


@query("""select coalesce(l_returnflag, 'overall') flag, count(*) n, sum(l_extendedprice::decimal(18, 2))::double price, sum(l_discount::decimal(18, 4))::double / count(*) discount from lineitem group by rollup (l_returnflag)""")
def overall_and_key(spark, d):
    """Per flag and overall in one pass."""
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"), (F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("discount")).select(F.coalesce("l_returnflag", F.lit("overall")).alias("flag"), "n", "price", "discount")


@query(f"""select id, len(topo_mask) n_units, round(case when len(topo_mask) = 0 then 0 else list_sum(topo_mask) / len(topo_mask) end, 9) mean_weight, round(coalesce(list_max(topo_mask), 0), 9) peak,
    round(case when len(topo_mask) = 0 then 0 else len(list_filter(topo_mask, lambda x: x > 0.1))::double / len(topo_mask) end, 9) share_over from {PR}""")
def nested_unit_metrics(spark, d):
    """Aggregates over each row's unit weights."""
    m = F.col("topo_mask")
    return prefs(spark, d).select("id", F.size(m).alias("n_units"), F.round(A.mean(m), 9).alias("mean_weight"), F.round(F.coalesce(F.array_max(m), F.lit(0.0)), 9).alias("peak"), F.round(A.share_over(m, 0.1), 9).alias("share_over"))


@query(f"""select metric, error_symbol, count(distinct dataset_name) n_seeds, round(avg(v), 6) mean, round(stddev_pop(v), 6) std from
    (select error_symbol, dataset_name, unnest([('similarity', heuristic_qc.similarity), ('length_ratio', heuristic_qc.length_ratio), ('novelty', heuristic_qc.novelty_ratio)]) m, m[1] metric, m[2]::double v from {NP} where heuristic_qc is not null) group by 1, 2""")
def metric_stats(spark, d):
    """Mean and population deviation of each metric per error type, from wide to long."""
    n = pairs(spark, d).filter("heuristic_qc is not null").select("error_symbol", "dataset_name", F.col("heuristic_qc.similarity").alias("similarity"), F.col("heuristic_qc.length_ratio").alias("length_ratio"), F.col("heuristic_qc.novelty_ratio").alias("novelty"))
    long = n.unpivot(["error_symbol", "dataset_name"], ["similarity", "length_ratio", "novelty"], "metric", "v")
    return long.groupBy("metric", "error_symbol").agg(F.count_distinct("dataset_name").alias("n_seeds"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query(f"select n_rows, count(*) n_groups from (select sample_id, count(*) n_rows from {NP} group by sample_id) group by n_rows")
def group_size_histogram(spark, d):
    """How many samples have how many negatives."""
    return pairs(spark, d).groupBy("sample_id").agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_groups"))


_TYPES = ["F1", "F2", "F3", "F4"]
_CODE = {"evidence_omission": "F1", "evidence_misinterpretation": "F2", "warrant_misuse": "F3", "claim_inconsistency": "F4"}
_CASE = "case llm_qc.realized_error_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _CODE.items()) + " else llm_qc.realized_error_type end"
_DOMAIN = "(select g gold, p predicted from (values ('F1'),('F2'),('F3'),('F4')) a(g), (values ('F1'),('F2'),('F3'),('F4')) b(p))"
_CONF = f"(select c.gold, c.predicted, coalesce(n, 0) n from {_DOMAIN} c left join (select error_symbol gold, {_CASE} predicted, count(*) n from {NP} group by 1, 2) using (gold, predicted))"


def _matrix(spark, d):
    said = F.col("llm_qc.realized_error_type")
    for k, v in _CODE.items():
        said = F.when(F.col("llm_qc.realized_error_type") == k, v).otherwise(said)
    return M.confusion(pairs(spark, d).select("error_symbol", said.alias("said")), "error_symbol", "said", _TYPES)


@query(f"select * from {_CONF}")
def confusion_long(spark, d):
    """Intended against realized error type, zeros included."""
    return _matrix(spark, d)


@query(f"""with m as {_CONF}, g as (select gold as label, sum(n) g, sum(n) filter (gold = predicted) h from m group by 1), p as (select predicted as label, sum(n) p from m group by 1), r as (select label, case when p = 0 then 0 else h / p end pr, case when g = 0 then 0 else h / g end rc from g join p using (label))
    select label, round(pr, 6) as precision, round(rc, 6) recall, round(case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end, 6) f1 from r""")
def precision_recall(spark, d):
    """Precision, recall and F1 of each error type."""
    return M.precision_recall(_matrix(spark, d)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_CAL = f"(select id, generation_plan.confidence c, coalesce(llm_qc.target_type_matched, false) ok from {NP} where generation_plan.confidence is not null)"


@query(f"select least(floor(c * 10), 9)::int bin, count(*) n, round(avg(c), 6) mean_confidence, round(avg(ok::int), 6) accuracy from {_CAL} group by 1")
def reliability_bins(spark, d):
    """Planned confidence against what the judge found, in ten bins."""
    b = M.reliability_bins(_calibration(spark, d), "c", F.col("ok"))
    return b.select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


def _calibration(spark, d):
    return pairs(spark, d).filter("generation_plan.confidence is not null").select("id", F.col("generation_plan.confidence").alias("c"), F.coalesce(F.col("llm_qc.target_type_matched"), F.lit(False)).alias("ok"))


@query(f"""with b as (select least(floor(c * 10), 9) bin, count(*) n, avg(c) mc, avg(ok::int) a, sum((c - ok::int) ^ 2) sq from {_CAL} group by 1)
    select round(sum(n * abs(mc - a)) / sum(n), 6) ece, round(sum(sq) / sum(n), 6) brier from b""")
def brier_ece(spark, d):
    """Calibration error and Brier score in one aggregate."""
    c = _calibration(spark, d)
    b = F.least(F.floor(F.col("c") * 10), F.lit(9))
    ok = F.col("ok").cast("double")
    bins = c.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg(ok).alias("a"), F.sum((F.col("c") - ok) ** 2).alias("sq"))
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mc") - F.col("a"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


_DEC = r"regexp_replace(lower(trim({c})), '[-_\s]+', '_', 'g')"


@query(f"""with r as (select {_DEC.format(c="reviewer1_final_decision")} a, {_DEC.format(c="reviewer2_final_decision")} b from {RV}), k as (select * from r where a in ('accept','minor_revision','reject') and b in ('accept','minor_revision','reject')),
    t as (select count(*) n, avg((a = b)::int) o from k), m as (select k, sum(x) / (select n from t) p, sum(y) / (select n from t) q from (select a k, 1 x, 0 y from k union all select b, 0, 1 from k) group by 1), e as (select sum(p * q) e from m)
    select n, round(o, 6) observed, round(e, 6) expected, round(case when e >= 1 then 1 else (o - e) / (1 - e) end, 6) kappa from t, e""")
def reviewer_kappa(spark, d):
    """Agreement of both reviewers' decisions beyond chance."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[-_\s]+", "_")
    ok = lambda c: F.when(clean(c).isin("accept", "minor_revision", "reject"), clean(c))
    k = M.kappa(reviews(spark, d).select(ok("reviewer1_final_decision").alias("a"), ok("reviewer2_final_decision").alias("b")), "a", "b")
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query(f"select dataset_name, count(*) n, round(corr(heuristic_qc.similarity, heuristic_qc.length_ratio), 6) r from {NP} group by 1")
def pearson(spark, d):
    """Correlation of similarity and length ratio per dataset."""
    return pairs(spark, d).groupBy("dataset_name").agg(F.count("*").alias("n"), F.round(F.corr(F.col("heuristic_qc.similarity"), F.col("heuristic_qc.length_ratio")), 6).alias("r"))


@query("""select count(*) n_groups, sum(n) n_rows, sum((labels > 1)::int) n_conflicting from (select md5(text) h, count(*) n, count(distinct coalesce(lang, '')) labels from documents group by 1 having count(*) > 1)""")
def cross_label_reuse(spark, d):
    """Repeated texts and how many of them stand under several labels."""
    g = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("lang", F.lit(""))).alias("labels")).filter("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.sum((F.col("labels") > 1).cast("int")).alias("n_conflicting"))


@query(f"""select sample_id, coalesce(arg_min(status, id) filter (error_symbol = 'F1'), '') F1, coalesce(arg_min(status, id) filter (error_symbol = 'F2'), '') F2,
    coalesce(arg_min(status, id) filter (error_symbol = 'F3'), '') F3, coalesce(arg_min(status, id) filter (error_symbol = 'F4'), '') F4 from {NP} group by 1""")
def pivot_first(spark, d):
    """Status by sample and error type, the first one by key."""
    return R.pivot_first(pairs(spark, d), "sample_id", "error_symbol", "status", "id", _TYPES)


@query(f"""select error_symbol, expected_answer_preserved expected, answer_preserved actual, count(*) n from {NP} group by 1, 2, 3""")
def answer_policy(spark, d):
    """Expected against actual preservation of the answer."""
    return pairs(spark, d).groupBy("error_symbol", F.col("expected_answer_preserved").alias("expected"), F.col("answer_preserved").alias("actual")).agg(F.count("*").alias("n"))


# ---- windows


@query(f"""select id, coalesce(string_agg(error_symbol, ' ') over (partition by sample_id order by error_symbol, id rows between unbounded preceding and 1 preceding), '') history from {NP}""")
def history_concat(spark, d):
    """The earlier error types of each sample."""
    return R.history(pairs(spark, d).select("id", "sample_id", "error_symbol"), ["sample_id"], ["error_symbol", "id"], "error_symbol").select("id", "history")


@query("""select vec_id, label, rank() over (partition by label order by embedding[1]) + (count(*) over (partition by label, embedding[1]) - 1) / 2.0 mid_rank from embeddings""")
def mid_ranks(spark, d):
    """Average ranks with ties of the first coordinate within each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"))
    return R.mid_ranks(e, ["label"], "x").select("vec_id", "label", "mid_rank")


@query(f"""with x as (select error_symbol, id, heuristic_qc.similarity p from {NP} where heuristic_qc.similarity is not null), r as (select *, (count(*) over (partition by error_symbol) - row_number() over (partition by error_symbol order by p, id) + 1) * p x from x)
    select error_symbol, id, round(least(1.0, max(x) over (partition by error_symbol order by p, id rows unbounded preceding)), 9) p_holm from r""")
def holm_adjusted(spark, d):
    """Step-down adjustment within each error type (similarities stand in for p values)."""
    x = pairs(spark, d).select("error_symbol", "id", F.col("heuristic_qc.similarity").alias("p")).filter("p is not null")
    return R.holm(x, ["error_symbol"], "p", "id").select("error_symbol", "id", F.round("p_holm", 9).alias("p_holm"))


@query(f"""select id, case when r <= 50 then 'double' when r <= 150 then 'single' end as label from (select id, row_number() over (partition by error_symbol order by margin desc, id) r from {PR})""")
def ranked_quota(spark, d):
    """The 50 largest margins of each type for two annotators, the next 100 for one."""
    return R.quota_labels(prefs(spark, d), [F.desc("margin"), F.col("id")], [("double", 50), ("single", 100)], ["error_symbol"]).select("id", "label")


@query("""select user_id, event_type, min(ts) first_ts, row_number() over (partition by user_id order by min(ts), event_type) ordinal from events group by user_id, event_type""")
def first_seen(spark, d):
    """The order in which each user showed each kind of event."""
    f = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return f.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts", "event_type")))


@query(f"""select id, list_position(topo_mask, list_max(topo_mask)) - 1 best from {PR} where len(topo_mask) > 0""")
def argmax_first(spark, d):
    """The place of the largest weight, the first of equal ones."""
    return prefs(spark, d).filter(F.size("topo_mask") > 0).select("id", A.first_argmax(F.col("topo_mask")).alias("best"))


@query(f"select id, margin from {PR} order by margin desc, id limit 100")
def top_k_margins(spark, d):
    """The 100 largest margins, ties by key."""
    return prefs(spark, d).select("id", "margin").orderBy(F.desc("margin"), "id").limit(100)


@query(f"""select source_id, id, margin from (select *, max(margin) over (partition by source_id) mx, row_number() over (partition by source_id order by margin desc nulls last, id) rn from {PR}) where margin >= 1.5 or (coalesce(mx, -1) < 1.5 and rn = 1)""")
def keep_or_best(spark, d):
    """Rows with a margin of 1.5 or more, else each source's best."""
    return R.keep_or_best(prefs(spark, d).select("source_id", "id", "margin"), ["source_id"], "margin", 1.5, ["id"])


@query(f"""select sample_id, id, sim from (select sample_id, id, heuristic_qc.similarity sim, row_number() over (partition by sample_id order by heuristic_qc.similarity nulls last, id) rn from {NP}) where rn = 1""")
def best_of_k(spark, d):
    """The rewrite of each sample that is least like its origin."""
    n = pairs(spark, d).select("sample_id", "id", F.col("heuristic_qc.similarity").alias("sim"))
    return R.top_per_group(n, ["sample_id"], [F.col("sim").asc_nulls_last(), F.col("id")], 1).drop("rank")

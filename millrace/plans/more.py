"""Registered queries of rules, loose fields, span repair and plug-in scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import rules as U
from millrace.plans.core import NP, PR, SM, TRIM, norm_sql, pairs, prefs, query, reviews, samples, tok_sql
from millrace.session import table


def _case(c: str, rules, other: str, fold: str = "") -> str:
    return "case " + " ".join(f"when regexp_matches({c}, '{fold}{p}') then '{n}'" for n, p in rules) + f" else '{other}' end"


_QUERIES = f"""(select id, {TRIM.format(c="rewrite_target_span")} q from {NP} union all select id, {TRIM.format(c="generation_plan.rationale")} from {NP} union all select id, {TRIM.format(c="final_answer")} || ' differential diagnosis' from {NP})"""


@query(rf"""select bucket, count(*) n from (select case when q = '' then null when contains(lower(q), 'differential diagnosis') then 'differential diagnosis' when contains(lower(q), 'clinical features') then 'clinical features'
    when regexp_matches(lower(q), '\b(mri|pet|ct|mrcp|ultrasound|biopsy|histology|histopath|immunohist|endoscopy|radiograph|x-ray|xray|fna)\b') then 'modality/procedure-heavy' when regexp_matches(lower(q), '\b(was|were|is|are)\b') then 'claimish'
    when len(regexp_split_to_array(q, '[\s\p{{Z}}]+')) <= 3 then 'short<=3' end bucket from {_QUERIES}) group by bucket""")
def query_buckets(spark, d):
    """How many retrieval queries of each kind the target spans, plans and answers would make."""
    n = pairs(spark, d).select("id", F.explode(F.array(F.col("rewrite_target_span"), F.col("generation_plan.rationale"), F.concat(F.coalesce("final_answer", F.lit("")), F.lit(" differential diagnosis")))).alias("q"))
    return n.groupBy(U.query_bucket(F.col("q")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""with t as (select id, reasoning r, negative_reasoning n, {tok_sql("reasoning")} s, {tok_sql("negative_reasoning")} t, {norm_sql("reasoning")} rn, {norm_sql("negative_reasoning")} nn, heuristic_qc.similarity sim, answer_preserved a, expected_answer_preserved e from {NP}),
    m as (select *, len(t)::double / greatest(len(s), 1) ratio, case when len(t) = 0 then 1.0 else len(list_filter(t, lambda x: not list_contains(s, x)))::double / len(t) end nov, len(list_intersect(list_distinct(s), list_distinct(t)))::double / greatest(len(list_distinct(s)), 1) topic from t)
    select id, array_to_string(list_filter([case when trim(coalesce(n, '')) = '' then 'non_empty' end, case when nn = rn then 'not_identical' end, case when not (sim between 0.55 and 0.98) then 'similarity' end, case when not (ratio between 0.6 and 1.5) then 'length_ratio' end,
    case when nov > 0.4 then 'novelty' end, case when topic < 0.03 then 'topic_overlap' end, case when regexp_matches(coalesce(n, ''), '{U.META}') then 'no_meta_language' end, case when a <> e then 'answer_policy' end], lambda x: x is not null), ',') failed from m""")
def heuristic_checks(spark, d):
    """The checks that each rewrite fails."""
    failed = U.heuristic_checks(F.col("negative_reasoning"), F.col("reasoning"), F.col("heuristic_qc.similarity"), F.col("answer_preserved"), F.col("expected_answer_preserved"))
    return pairs(spark, d).select("id", F.array_join(failed, ",").alias("failed"))


@query(r"""with s as (select id, review_round, regexp_replace(lower(trim(reviewer1_final_decision)), '[-_\s]+', '_', 'g') a, regexp_replace(lower(trim(reviewer2_final_decision)), '[-_\s]+', '_', 'g') b,
    try_cast(regexp_extract(coalesce(reviewer1_clinical_plausibility, ''), '^\s*([1-5])', 1) as int) x, try_cast(regexp_extract(coalesce(reviewer2_clinical_plausibility, ''), '^\s*([1-5])', 1) as int) y from (select distinct on (id, review_round) * from review_sample) where reviewer2_id is not null)
    select kind, count(*) n from (select case when a <> b then 'decision' when abs(x - y) > 1 then 'score' else 'none' end kind from s) group by kind""")
def reviewer_disagreement(spark, d):
    """Double reviews by what their reviewers disagree on."""
    dec = lambda k: F.regexp_replace(F.lower(F.trim(f"reviewer{k}_final_decision")), r"[-_\s]+", "_")
    sc = lambda k: F.regexp_extract(F.coalesce(f"reviewer{k}_clinical_plausibility", F.lit("")), r"^\s*([1-5])", 1).try_cast("int")
    r = reviews(spark, d).filter("reviewer2_id is not null").select(F.coalesce(U.disagreement(dec(1), dec(2), sc(1), sc(2)), F.lit("none")).alias("kind"))
    return r.groupBy("kind").agg(F.count("*").alias("n"))


@query("""select tag, count(*) n from (select unnest(from_json(risk_tags, '["VARCHAR"]')) tag from (select distinct on (id, review_round) * from review_sample) where risk_tags like '[%') where trim(tag) <> '' group by tag""")
def review_tags(spark, d):
    """How often each tag stands in the JSON lists of the review sheet."""
    tags = reviews(spark, d).filter(F.col("risk_tags").startswith("[")).select(F.explode(U.list_field(F.col("risk_tags"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query()
def event_objects(spark, d):
    """The JSON object in each event's properties, brought to one form."""
    return table(spark, d, "events").select("event_id", U.json_object(F.col("props")).alias("props"))


@query(rf"""with m as (select id, prompt p from (select distinct on (id) * from mcq_row)), x as (select id, regexp_extract_all(p, '(?m)^([A-E])[.] ', 1) l from m) select id, len(l) n_options, l[-1] last_label from x""")
def option_lines(spark, d):
    """The option lines of each item's prompt."""
    m = table(spark, d, "mcq_row").dropDuplicates(["id"]).select("id", F.regexp_extract_all("prompt", F.lit(r"(?m)^([A-E])[.] "), 1).alias("l"))
    return m.select("id", F.size("l").alias("n_options"), F.try_element_at("l", F.lit(-1)).alias("last_label"))


@query()
def reasoning_units(spark, d):
    """The units of each reasoning with offsets and role."""
    return pairs(spark, d).select("id", F.inline(U.units_of(F.col("reasoning")))).select("id", "start", "end", "role")


@query()
def span_patch(spark, d):
    """Each reasoning with its target span, exact or fuzzy, replaced."""
    return pairs(spark, d).select("id", U.patch_spans("reasoning", "rewrite_target_span", "rewrite_replacement_span").alias("patched")).filter("patched is not null")


@query()
def query_variants(spark, d):
    """Retrieval queries from each target span."""
    return pairs(spark, d).select("id", F.posexplode(U.query_variants(F.col("rewrite_target_span"))).alias("place", "variant"))


@query()
def best_sentences(spark, d):
    """The two sentences of the evidence that share most with the final answer and context."""
    return samples(spark, d).select("sample_id", U.best_sentences(F.col("retrieved_evidence"), F.col("patient_context")).alias("premise"))


@query(f"""with n as (select id, sampling_bucket b, risk_score::double s from (select distinct on (id, review_round) * from review_sample) where review_round = 'round1'),
    r as (select *, row_number() over (partition by b order by s desc, id) rn, list_position(['very_high_similarity', 'low_topic_overlap', 'clean_random'], b) place from n where b in ('very_high_similarity', 'low_topic_overlap', 'clean_random')),
    f as (select *, case when rn > 20 then 1 else 0 end late from r where rn <= 100), g as (select *, row_number() over (order by late, place, rn) fill_rank from f) select id, b as sampling_bucket, fill_rank from g where fill_rank <= 100""")
def priority_fill(spark, d):
    """A review batch of 100: 20 of each bucket, then by the buckets' order."""
    n = reviews(spark, d).filter("review_round = 'round1'").select("id", "sampling_bucket", F.col("risk_score").cast("double").alias("s"))
    order = ["very_high_similarity", "low_topic_overlap", "clean_random"]
    return U.priority_fill(n, "sampling_bucket", order, dict.fromkeys(order, 20), 100, [F.desc("s"), F.col("id")]).drop("s")


@query()
def scored_pairs(spark, d):
    """Each final answer against its context by the stand-in model."""
    s = pairs(spark, d).select("id", "sample_id", "final_answer").join(samples(spark, d).select("sample_id", "patient_context"), "sample_id")
    return U.score_pairs(s, ["id"], "patient_context", "final_answer", U.overlap_stub)


@query(f"""with a as (select source_id, id, margin from {PR} where error_symbol = 'F1'), b as (select source_id, id, margin from {PR} where error_symbol = 'F2') select a.id id_a, b.id id_b, least(a.margin, b.margin) shared from a join b on split_part(a.id, '::', 1) = split_part(b.id, '::', 1)""")
def same_sample_pairs(spark, d):
    """The F1 and F2 rows of the same sample side by side."""
    p = prefs(spark, d).select("id", F.split_part("id", F.lit("::"), F.lit(1)).alias("k"), "error_symbol", "margin")
    a, b = p.filter("error_symbol = 'F1'").select("k", F.col("id").alias("id_a"), F.col("margin").alias("x")), p.filter("error_symbol = 'F2'").select("k", F.col("id").alias("id_b"), F.col("margin").alias("y"))
    return a.join(b, "k").select("id_a", "id_b", F.least("x", "y").alias("shared"))


@query("""with s as (select distinct reviewer_id, specialty, site, row_number() over (order by reviewer_id) ord from reviewers) select s.ord, s.reviewer_id, s.specialty, count(r.id) n from s left join (select distinct on (id, review_round) * from review_sample) r on r.reviewer1_id = s.reviewer_id group by all""")
def ordered_extract(spark, d):
    """The rows of a list of reviewers in the list's order, those without reviews too."""
    from pyspark.sql.window import Window

    s = table(spark, d, "reviewers").distinct().select("reviewer_id", "specialty", F.row_number().over(Window.orderBy("reviewer_id")).alias("ord"))
    n = reviews(spark, d).groupBy(F.col("reviewer1_id").alias("reviewer_id")).agg(F.count("*").alias("n"))
    return s.join(n, "reviewer_id", "left").select("ord", "reviewer_id", "specialty", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""select dataset_name, month, n, round(sum(n) over (partition by dataset_name order by month), 0)::bigint running from (select dataset_name, strftime(created_at, '%Y-%m') as month, count(*) n from {SM} group by 1, 2)""")
def running_counts(spark, d):
    """Samples a month and dataset with a running total."""
    from pyspark.sql.window import Window

    m = samples(spark, d).groupBy("dataset_name", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.withColumn("running", F.sum("n").over(Window.partitionBy("dataset_name").orderBy("month")))


@query("""select c_mktsegment, o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by 1, 2""")
def segment_status(spark, d):
    """Orders of a region by segment and status."""
    n = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select label, round(avg(embedding[1]::double), 6) mean_x, count(*) n from embeddings group by label""")
def label_means(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("mean_x"), F.count("*").alias("n"))


"""Registered queries of canonical rows, paired and stratified evaluation, quotas and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import records as C
from millrace.operators import relational as R
from millrace.operators import sampling as S
from millrace.plans.core import NP, PR, RV, SM, TRIM, norm_sql, pairs, prefs, query, reviews, samples, tok_sql
from millrace.session import table


def _trim(c: str) -> str:
    return TRIM.format(c=c)


_MARK = r"(?i)\n\s*final answer\s*:"


# ---- rows in one form


@query(rf"""with r as (select id, prompt, chosen c, regexp_extract(chosen, '{_MARK}') m from {PR})
    select id, 'given' model_id, {_trim("prompt")} prompt, case when coalesce(m, '') = '' then {_trim("c")} else {_trim("c[:instr(c, m) - 1]")} end reasoning, case when coalesce(m, '') = '' then '' else {_trim("c[instr(c, m) + length(m):]")} end final_answer, '' gold_answer from r""")
def canonical_rows(spark, d):
    """Preference rows as (id, model, prompt, reasoning, answer), the chosen response split at its answer line."""
    return C.canonical_rows(prefs(spark, d).select("id", "prompt", "chosen"), "given", response="chosen").drop("raw")


@query(rf"""select sample_id, {_trim("reasoning")} || case when {_trim("reasoning")} <> '' and {_trim("final_answer")} <> '' then chr(10) || chr(10) else '' end || case when {_trim("final_answer")} <> '' then 'Final Answer: ' || {_trim("final_answer")} else '' end response from {SM}""")
def built_responses(spark, d):
    """Reasoning and answer of each sample as one response."""
    return samples(spark, d).select("sample_id", C.build_response(F.col("reasoning"), F.col("final_answer")).alias("response"))


@query(rf"""select id, case when {_trim("final_answer")} <> '' and {_trim("negative_final_answer")} <> '' then 'normalized_text' else 'none' end as method,
    case when {_trim("final_answer")} <> '' and {_trim("negative_final_answer")} <> '' then {norm_sql("final_answer")} = {norm_sql("negative_final_answer")} end exact_match from {NP}""")
def answer_matches(spark, d):
    """Whether each rewrite kept the answer; null where one of them is missing."""
    return pairs(spark, d).select("id", C.answer_match(F.lit(None), F.lit(None), F.col("final_answer"), F.col("negative_final_answer")).alias("m")).select("id", "m.method", "m.exact_match")


@query(r"""with m as (select distinct on (id) id, upper(trim(coalesce(answer_idx, ''))) g, answer a, options o from mcq_row), p as (select id, g, a, upper(coalesce(list_filter(map_keys(o), lambda k: o[k] = a)[1], '')) p, o[map_keys(o)[1]] x from m)
    select id, case when g <> '' and p <> '' then 'choice_label' when coalesce(a, '') <> '' then 'normalized_text' else 'none' end as method, case when g <> '' and p <> '' then g = p when coalesce(a, '') <> '' then true end exact_match from p""")
def label_matches(spark, d):
    """The label under which each item's answer text stands, against the label given for it."""
    m = table(spark, d, "mcq_row").dropDuplicates(["id"])
    label = F.try_element_at(F.map_keys(F.map_filter("options", lambda k, v: v == F.col("answer"))), F.lit(1))
    return m.select("id", C.answer_match(F.col("answer_idx"), label, F.col("answer"), F.col("answer")).alias("m")).select("id", "m.method", "m.exact_match")


@query(rf"""select id, array_to_string(list_filter(list_transform(p, lambda x: {_trim("x")}), lambda x, i: x <> '' and list_position(list_transform(p, lambda y: {_trim("y")}), x) = i), chr(10)) spans from (select id, list_concat(coalesce(modified_spans, []), coalesce(edit_summary, [])) p from {NP})""")
def distinct_spans(spark, d):
    """Changed spans and edit notes of each rewrite, each text once, in order."""
    both = F.concat(F.coalesce("modified_spans", F.array().cast("array<string>")), F.coalesce("edit_summary", F.array().cast("array<string>")))
    return pairs(spark, d).select("id", C.ordered_concat(both).alias("spans"))


@query(rf"select sample_id, case when {_trim('retrieved_evidence')} = '' then 0 else 1 end n, {_trim('retrieved_evidence')} as first from {SM}")
def evidence_lists(spark, d):
    """The evidence of each sample as a list of texts."""
    s = samples(spark, d)
    return s.select("sample_id", C.evidence_texts(s, "retrieved_evidence").alias("e")).select("sample_id", F.size("e").alias("n"), F.coalesce(F.try_element_at("e", F.lit(1)), F.lit("")).alias("first"))


@query(r"""select id, regexp_replace(regexp_replace(lower(trim(coalesce(dataset_name, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || regexp_replace(regexp_replace(lower(trim(coalesce(subset, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || row_number() over (partition by dataset_name, subset order by id) row_id
    from (select distinct id, dataset_name, subset from mcq_row)""")
def row_ids(spark, d):
    """dataset__subset__ordinal of each item."""
    from pyspark.sql.window import Window

    m = table(spark, d, "mcq_row").select("id", "dataset_name", "subset").distinct()
    place = F.row_number().over(Window.partitionBy("dataset_name", "subset").orderBy("id"))
    return m.select("id", F.concat_ws("__", C.slug(F.col("dataset_name")), C.slug(F.col("subset")), place.cast("string")).alias("row_id"))


@query(f"""with c as (select dataset_name, count(*) filter (status like 'accepted%') k, count(*) n from {NP} group by 1)
    select dataset_name, k || '/' || n || ' (' || ((2000 * k + n) // (2 * n)) // 10 || '.' || ((2000 * k + n) // (2 * n)) % 10 || '%)' as fraction from c""")
def fractions(spark, d):
    """Accepted rewrites per dataset as a fraction with an exact percentage."""
    c = pairs(spark, d).groupBy("dataset_name").agg(F.count_if(F.col("status").startswith("accepted")).alias("k"), F.count("*").alias("n"))
    return c.select("dataset_name", C.format_fraction(F.col("k"), F.col("n")).alias("fraction"))


@query(f"""select sample_id, case when length(patient_context) > 600 then rtrim(patient_context[:300], ' ') || '{C.TRUNCATED}' || ltrim(patient_context[-300:], ' ') else patient_context end shown from {SM}""")
def shown_contexts(spark, d):
    """Contexts cut to 600 characters, half from each end."""
    return samples(spark, d).select("sample_id", C.head_and_tail(F.col("patient_context"), 600).alias("shown"))


@query(f"""with s as (select id, modified_spans m, rewrite_replacement_span r, {norm_sql("rewrite_replacement_span")} y, {tok_sql("rewrite_replacement_span")} t from {NP}),
    u as (select id, {norm_sql("c")} x, y, {tok_sql("c")} k, t from (select id, unnest(m) c, y, t from s)),
    v as (select id, case when x = '' or y = '' then 0 when x = y then 1 when contains(x, y) or contains(y, x) then 0.95 when len(k) = 0 or len(t) = 0 then 0 else len(list_intersect(k, t))::double / len(list_distinct(list_concat(k, t))) end >= 0.8 ok from u)
    select s.id, coalesce(bool_or(ok), false) matched from s left join v on v.id = s.id group by s.id""")
def span_matches(spark, d):
    """Whether any changed span matches the replacement that was planned."""
    any_of = C.any_match(F.coalesce("modified_spans", F.array().cast("array<string>")), F.array("rewrite_replacement_span"))
    return pairs(spark, d).select("id", F.coalesce(any_of, F.lit(False)).alias("matched"))


@query(f"""select id, list_sort(list_transform(generate_series(1, len(topo_mask)), lambda i: {{'s': -topo_mask[i], 'i': i - 1}}))[1].i as place from {PR} where len(topo_mask) > 0 and list_max(topo_mask) >= 0.1
    union all select id, null from {PR} where coalesce(len(topo_mask), 0) = 0 or list_max(topo_mask) < 0.1""")
def winning_units(spark, d):
    """The unit of each row with the greatest weight of 0.1 or more, the first of equal ones."""
    return prefs(spark, d).select("id", C.winner(F.col("topo_mask"), lambda x: x, lambda x: F.lit(0), 0.1).alias("place"))


@query(f"select id, unnest(generate_series(0, len(modified_spans) - 1)) place, unnest(modified_spans) span, unnest(generate_series(0, len(modified_spans) - 1)) = len(modified_spans) - 1 terminal from {NP} where len(modified_spans) > 0")
def terminal_spans(spark, d):
    """Every changed span with its place and whether it is the last."""
    return C.with_terminal(pairs(spark, d).select("id", "modified_spans"), "modified_spans").withColumnRenamed("item", "span")


@query(f"select id, length(reasoning) as length from {NP} where length(reasoning) > 600 and error_symbol <> 'F1'")
def long_rows(spark, d):
    """Rows over 600 characters that no record of skipped ones (here those of F1) has."""
    n = pairs(spark, d).select("id", "error_symbol", "reasoning")
    return C.split_by_length(n, "reasoning", 600, n.filter("error_symbol = 'F1'"))[1].select("id", "length")


# ---- joins


@query(f"""
    with p as (select id, max({{'m': margin, 's': source_id}}) b from preference_row where id is not null group by 1), r as (select id, max({{'w': review_round, 's': risk_score}}) b from {RV} where id is not null group by 1)
    select n.id, p.b.m prefs_margin, r.b.w reviews_review_round from {NP} n join p on p.id = n.id join r on r.id = n.id""")
def joined_rows(spark, d):
    """Negatives that also have a preference row and a review, with both."""
    p, r = table(spark, d, "preference_row").select("id", "margin", "source_id"), reviews(spark, d).select("id", "review_round", "risk_score")
    return R.join_all(pairs(spark, d).select("id"), "id", {"prefs": p, "reviews": r})[0].select("id", "prefs_margin", "reviews_review_round")


@query(f"""with a as (select id, margin from {PR}), b as (select distinct id, sampling_bucket from {RV} where review_round = 'round1')
    select coalesce(a.id, b.id) id, case when a.id is null then 'after' when b.id is null then 'before' else 'both' end side from a full join b on a.id = b.id""")
def paired_sides(spark, d):
    """Preference rows against reviewed ones: in both, or which side lacks the id."""
    b = reviews(spark, d).filter("review_round = 'round1'").select("id", "sampling_bucket").distinct()
    return R.paired(prefs(spark, d).select("id", "margin"), b, "id").select("id", "side")


@query("select id, count(*) filter (side = 0) n_base, count(*) filter (side = 1) n_delta from (select id, 0 side from preference_row union all select id, 1 from review_sample) group by id having count(*) > 1")
def id_collisions(spark, d):
    """Ids that are in both tables or repeated in one."""
    return R.collisions(table(spark, d, "preference_row"), table(spark, d, "review_sample"), "id")


@query(f"""with b as (select id, heuristic_qc.similarity s from {NP} where heuristic_qc.similarity is not null),
    r as (select id, row_number() over (order by s desc, id) h, row_number() over (order by s, id) l, row_number() over (order by abs(s - 0.8), id) m from b)
    select id, 'high' band, h place from r where h <= 20 union all select id, 'low', l from r where l <= 20 union all select id, 'middle', m from r where m <= 20""")
def score_bands(spark, d):
    """The 20 most, least and middling similar rewrites."""
    return R.bands(pairs(spark, d).select("id", F.col("heuristic_qc.similarity").alias("s")), "s", "id", 20, 0.8).select("id", "band", "place")


@query(f"""with w as (select sample_id, error_symbol, reasoning from {NP} where {norm_sql("final_answer")} = {norm_sql("negative_final_answer")} and length(negative_reasoning) >= 200)
    select a.sample_id from w a join w b using (sample_id) where a.error_symbol = 'F1' and b.error_symbol = 'F2'""")
def same_answer_subset(spark, d):
    """Samples whose F1 and F2 rewrites both keep the answer and reason at some length."""
    n = pairs(spark, d).filter((X.normalize_answer(F.col("final_answer")) == X.normalize_answer(F.col("negative_final_answer"))) & (F.length("negative_reasoning") >= 200))
    return n.filter("error_symbol = 'F1'").select("sample_id").join(n.filter("error_symbol = 'F2'").select("sample_id"), "sample_id")


# ---- rates and scores

_DEC = r"regexp_replace(lower(trim(reviewer{k}_final_decision)), '[-_\s]+', '_', 'g')"
_DOMAIN = ["accept", "minor_revision", "reject"]


def _decisions(spark, d):
    of = lambda k: F.regexp_replace(F.lower(F.trim(f"reviewer{k}_final_decision")), r"[-_\s]+", "_").alias("gold" if k == 1 else "predicted")
    return M.confusion(reviews(spark, d).select(of(1), of(2)), "gold", "predicted", _DOMAIN)


_CELLS = f"""d as (select unnest(['accept', 'minor_revision', 'reject']) l), c as (select {_DEC.format(k=1)} g, {_DEC.format(k=2)} p, count(*) n from {RV} group by 1, 2),
    m as (select a.l g, b.l p, coalesce(c.n, 0) n from d a join d b on true left join c on c.g = a.l and c.p = b.l)"""


@query(f"with {_CELLS} select g gold, sum(n) filter (p = 'accept') accept, sum(n) filter (p = 'minor_revision') minor_revision, sum(n) filter (p = 'reject') reject from m group by g")
def confusion_wide(spark, d):
    """Decisions of both reviewers against each other, one column a decision."""
    return M.confusion_wide(_decisions(spark, d), _DOMAIN)


@query(f"""with {_CELLS}, f as (select l, (select sum(n) from m where g = l and p = l) h, (select sum(n) from m where p = l) np, (select sum(n) from m where g = l) ng from d)
    select (select sum(n) from m) n, round((select sum(n) filter (g = p) from m) / (select sum(n) from m), 9) accuracy, round(avg(case when np = 0 or ng = 0 or h = 0 then 0 else 2 * (h / np) * (h / ng) / (h / np + h / ng) end), 9) macro_f1 from f""")
def decision_scores(spark, d):
    """Accuracy and macro F1 of the second reviewer against the first."""
    return M.overall_scores(_decisions(spark, d)).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""with x as (select error_symbol, heuristic_qc.similarity v, row_number() over (partition by error_symbol order by heuristic_qc.similarity) - 1 i, count(*) over (partition by error_symbol) n from {NP} where heuristic_qc.similarity is not null)
    select error_symbol, min(v) filter (i = round_even(0.5 * (n - 1), 0)) p50, min(v) filter (i = round_even(0.95 * (n - 1), 0)) p95 from x group by 1""")
def nearest_ranks(spark, d):
    """Median and 95th percentile of the similarity by nearest rank."""
    n = pairs(spark, d).select("error_symbol", F.col("heuristic_qc.similarity").alias("v"))
    return M.nearest_rank(n, ["error_symbol"], "v", {"p50": 0.5, "p95": 0.95})


@query(f"""select error_symbol, sum(len(list_filter(topo_mask, lambda x: x > 0.1))) hits, sum(len(topo_mask)) units, sum(len(list_filter(topo_mask, lambda x: x > 0.1)))::double / sum(len(topo_mask)) share from {PR} group by 1""")
def process_ratios(spark, d):
    """Units over the threshold as a ratio of sums, not a mean of ratios."""
    hits, units = F.sum(F.size(F.filter(F.coalesce("topo_mask", F.array().cast("array<double>")), lambda x: x > 0.1))), F.sum(F.size(F.coalesce("topo_mask", F.array().cast("array<double>"))))
    return prefs(spark, d).groupBy("error_symbol").agg(hits.alias("hits"), units.alias("units"), F.try_divide(hits.cast("double"), units.cast("double")).alias("share"))


@query(f"""with c as (select error_symbol, coalesce(answer_preserved, false) a, coalesce(llm_qc.target_type_matched, false) b from {NP})
    select error_symbol, count(*) filter (a and b) both_right, count(*) filter (a and not b) only_a, count(*) filter (not a and b) only_b, count(*) filter (not a and not b) both_wrong from c group by 1""")
def correctness_strata(spark, d):
    """The two by two table of two verdicts per error type."""
    no = F.lit(False)
    return M.strata(pairs(spark, d), ["error_symbol"], F.coalesce("answer_preserved", no), F.coalesce("llm_qc.target_type_matched", no))


@query(f"""select dataset_name, count(*) n, count(*) filter (status like 'accepted%') n_accepted, avg(answer_preserved::int) filter (status like 'accepted%') kept_accepted, avg(answer_preserved::int) filter (status not like 'accepted%') kept_rest from {NP} group by 1""")
def slice_rates(spark, d):
    """How often the answer is kept among accepted rewrites and among the rest."""
    ok, kept = F.col("status").startswith("accepted"), F.col("answer_preserved").cast("int")
    return pairs(spark, d).groupBy("dataset_name").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"), F.avg(F.when(ok, kept)).alias("kept_accepted"), F.avg(F.when(~ok, kept)).alias("kept_rest"))


# ---- samples


def _md5(seed: str) -> str:
    return f"md5('{seed}:' || id)"


@query(f"select id from (select id, dataset_name, row_number() over (partition by dataset_name order by {_md5('q1')}, id) r from {NP}) order by r, dataset_name nulls first, id limit 500")
def equal_quotas(spark, d):
    """500 rewrites, as many of each dataset as there are."""
    return S.equal_quota(pairs(spark, d).select("id", "dataset_name"), ["dataset_name"], "id", 500, "q1").select("id")


@query(f"""with a as (select id, error_symbol e, status s, dataset_name n, row_number() over (partition by error_symbol, status, dataset_name order by {_md5('t1')}, id) r from {NP}),
    b as (select *, row_number() over (partition by e, s order by r, n nulls first, id) r2 from a), c as (select *, row_number() over (partition by e order by r2, s nulls first, id) r3 from b)
    select id from c order by r3, e nulls first, id limit 300""")
def nested_quotas(spark, d):
    """300 rewrites shared out by error type, within it by status, within that by dataset."""
    return S.equal_quota(pairs(spark, d).select("id", "error_symbol", "status", "dataset_name"), ["error_symbol", "status", "dataset_name"], "id", 300, "t1").select("id")


@query(f"select id from {NP} order by {_md5('x1')}, id limit 150")
def exact_sample(spark, d):
    """150 rewrites, or an error where there are fewer."""
    return S.exact_sample(pairs(spark, d).select("id"), "id", 150, "x1")


@query(f"""with x as (select id, {_md5('v1')} h, count(*) over (partition by error_symbol, status) n, row_number() over (partition by error_symbol, status order by {_md5('v1')}, id) r, count(*) over () total from {NP}),
    y as (select *, r <= case when n < 2 then 0 else least(greatest(round(n * 0.3), 1), n - 1) end first from x), z as (select *, row_number() over (order by (not first)::int, h, id) k from y)
    select id, case when k <= greatest(1, least(total - 1, round_even(total * 0.3, 0))) then 'calibration' else 'evaluation' end part from z""")
def balanced_calibration(spark, d):
    """30 % of each error type and status for calibration, and of all together."""
    return S.balanced_calibration(pairs(spark, d).select("id", "error_symbol", "status"), ["error_symbol", "status"], "id", 0.3, "v1").select("id", "part")


# ---- intervals: resamples come from hashes that SQL hasn't; the tests hold them against known distributions


@query()
def floor_bootstrap(spark, d):
    """Interval of the mean novelty of each error type, its ends at whole ranks."""
    return M.bootstrap_mean(pairs(spark, d).select("error_symbol", "id", F.col("heuristic_qc.novelty_ratio").alias("v")), ["error_symbol"], "v", "id", floor_index=True)


@query()
def macro_bootstrap(spark, d):
    """Interval of the mean over datasets of the share of kept answers."""
    return M.macro_bootstrap(pairs(spark, d).select("dataset_name", "id", F.col("answer_preserved").cast("double").alias("v")), ["dataset_name"], "v", "id")


@query()
def label_bootstrap(spark, d):
    """Interval of the share of each judge's decision per error type."""
    n = pairs(spark, d).select("error_symbol", "id", F.col("llm_qc.decision").alias("decision"))
    return M.label_bootstrap(n, ["error_symbol"], "decision", ["accept", "reject", "needs_review"], "id")

"""Registered queries of retrieval, scoring, sampling, statistics, spans and incremental work, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import retrieval as V
from millrace.operators import sampling as S
from millrace.operators import scoring as C
from millrace.operators import spans as P
from millrace.plans.core import NP, PR, SM, _side, pairs, prefs, query, reviews, samples
from millrace.session import table

# ---- retrieval

_TOP = """(with q as (select vec_id q, embedding e from embeddings where vec_id % 50 = 0), s as (select q as query, vec_id as doc, list_sum(list_transform(generate_series(1, len(e)), lambda i: e[i]::double * embedding[i]::double)) score
    from q, embeddings where vec_id <> q) select * from (select *, row_number() over (partition by query order by score desc, doc) rank from s) where rank <= {k})"""


def _hits(spark, d, k):
    e = table(spark, d, "embeddings")
    return V.dense_top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", k)


@query(f"select query, rank, round(score, 6) score from {_TOP.format(k=10)}")
def dense_topk(spark, d):
    """The ten nearest vectors of each query vector, by inner product, against all rows."""
    return _hits(spark, d, 10).select("query", "rank", F.round("score", 6).alias("score"))


@query(f"""with h as (select h.*, l.label from {_TOP.format(k=50)} h join embeddings l on l.vec_id = h.doc), m as (select query, label, max(score) best_score, min(rank) best_rank, count(*) n_hits from h group by 1, 2)
    select * from (select query, label, round(best_score, 6) best_score, best_rank, n_hits, row_number() over (partition by query order by best_score desc, best_rank, n_hits desc, label) merged_rank from m) where merged_rank <= 3""")
def merge_candidates(spark, d):
    """The hits of each query merged by label, the best three."""
    h = _hits(spark, d, 50).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc")
    return V.merge_candidates(h, "query", "label", "score", "rank", 3).withColumn("best_score", F.round("best_score", 6))


@query(f"""with h as (select h.rank, (a.label = b.label)::int ok, h.query from {_TOP.format(k=10)} h join embeddings a on a.vec_id = h.query join embeddings b on b.vec_id = h.doc)
    select k, round(avg(ok), 6) hit_rate from (select k, query, max(case when rank <= k then ok else 0 end) ok from h, (values (1), (5), (10)) t(k) group by 1, 2) group by k""")
def hit_at_k(spark, d):
    """How many queries have a result of their own label among the first 1, 5 and 10."""
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    h = _hits(spark, d, 10).join(lab.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc").join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query")
    ks = h.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10)))))
    per = ks.groupBy("k", "query").agg(F.max(F.when((F.col("rank") <= F.col("k")) & (F.col("a") == F.col("b")), 1).otherwise(0)).alias("ok"))
    return per.groupBy("k").agg(F.round(F.avg("ok"), 6).alias("hit_rate"))


@query()
def neardup_tfidf(spark, d):
    """For each evaluation sample the five training samples with the nearest contexts, by n-gram cosine of 0.75 or more."""
    s = table(spark, d, "samples").select("sample_id", "patient_context", _side().alias("side"))
    held, train = (s.filter(F.col("side") == x) for x in ("held", "train"))
    return V.tfidf_join(held, train, "sample_id", "patient_context").select("held", "train", "rank", F.round("cosine", 6).alias("cosine"))


# ---- scoring

_U = "('0x' || substr(md5(id || ':' || {s}), 1, 8))::bigint / 4294967295.0"


def _u(s: str):
    return X.unit_hash(F.concat(F.col("id"), F.lit(":" + s)))


_PROB = f"""(select id, case error_symbol when 'F1' then 'O' when 'F2' then 'D' when 'F3' then 'W' else 'C' end kind, {_U.format(s="'e'")} e, {_U.format(s="'n'")} n, {_U.format(s="'c'")} c, len(modified_spans) > 0 ev from {NP})"""


def _probabilities(spark, d):
    """Stand-in for a model's output: three numbers from hashes of the key."""
    kind = F.when(F.col("error_symbol") == "F1", "O").when(F.col("error_symbol") == "F2", "D").when(F.col("error_symbol") == "F3", "W").otherwise("C")
    return pairs(spark, d).select("id", kind.alias("kind"), _u("e").alias("e"), _u("n").alias("n"), _u("c").alias("c"), (F.size("modified_spans") > 0).alias("ev"))


@query(f"""select id, round(case kind when 'O' then greatest(c, 0.2 * n) when 'W' then case when ev then greatest(c, 0.8 * n) else 0.8 end when 'D' then greatest(c, 0.8 * n * case when ev then 1 else 0.5 end)
    else greatest(c, 0.5 * 0.2 * greatest(n - e, 0)) end, 6) score from {_PROB}""")
def route_scores(spark, d):
    """The defect score of each unit by its kind."""
    return _probabilities(spark, d).select("id", F.round(C.unit_score(F.col("kind"), F.col("e"), F.col("n"), F.col("c"), F.col("ev")), 6).alias("score"))


@query(f"""with r as (select id, 0.6 * coalesce(list_max(topo_mask), 0) + 0.4 * case when len(topo_mask) = 0 then 0 else len(list_filter(topo_mask, lambda x: x > 0.1))::double / len(topo_mask) end
    + 0.1 * case when len(topo_mask) = 0 then 0 else list_sum(topo_mask) / len(topo_mask) end raw from {PR})
    select id, least(raw, 1.0) risk, least(3 * least(raw, 1.0), 2.5) margin from r""")
def row_risk(spark, d):
    """Risk and margin of each row's units."""
    risk = C.row_risk(F.col("topo_mask"))
    return prefs(spark, d).select("id", risk.alias("risk"), C.margin(risk).alias("margin"))


@query(f"""with r as (select id, 0.6 * coalesce(list_max(topo_mask), 0) + 0.4 * case when len(topo_mask) = 0 then 0 else len(list_filter(topo_mask, lambda x: x > 0.1))::double / len(topo_mask) end
    + 0.1 * case when len(topo_mask) = 0 then 0 else list_sum(topo_mask) / len(topo_mask) end raw from {PR}) select id, raw / (0.6 + 0.4 + 0.1) severity from r""")
def row_severity(spark, d):
    """The normalised severity of each row's units."""
    return prefs(spark, d).select("id", C.row_risk(F.col("topo_mask"), "paper").alias("severity"))


@query(f"""with r as (select id, list_max(topo_mask) peak, len(list_filter(topo_mask, lambda x: x > 0.1))::double / len(topo_mask) share, list_sum(topo_mask) / len(topo_mask) mean from {PR} where len(topo_mask) > 0)
    select id, least(0.6 * peak + 0.4 * greatest(0.5 - share, 0) + 0.1 * mean, 1.0) risk from r""")
def coverage_risk(spark, d):
    """Risk with a penalty for covering less than half of the row's units."""
    m = F.col("topo_mask")
    return prefs(spark, d).filter("size(topo_mask) > 0").select("id", C.coverage_risk(m, A.share_over(m, C.TAU), F.lit(0.5), F.lit(False)).alias("risk"))


@query(f"""with t as (select id, list_filter([case when expected_answer_preserved and not answer_preserved then 'answer_changed' end, case when not llm_qc.target_type_matched then 'label_mismatch' end,
    case when heuristic_qc.similarity > 0.97 then 'very_high_similarity' end, case when heuristic_qc.topic_overlap < 0.1 then 'low_topic_overlap' end, case when heuristic_qc.length_ratio < 0.6 or heuristic_qc.length_ratio > 1.5 then 'length_outlier' end], lambda x: x is not null) tags from {NP})
    select id, array_to_string(tags, ',') tags, coalesce(list_sum(list_transform(tags, lambda x: case x when 'answer_changed' then 5 when 'label_mismatch' then 5 when 'very_high_similarity' then 3 when 'low_topic_overlap' then 2 else 1 end)), 0)::int risk_score from t""")
def risk_tags(spark, d):
    """The tags that a negative earns and their weight."""
    h = lambda f: F.col(f"heuristic_qc.{f}")
    t = pairs(spark, d).withColumn("tags", C.risk_tags(h("similarity"), h("length_ratio"), h("topic_overlap"), F.col("expected_answer_preserved"), F.col("answer_preserved"), F.col("llm_qc.target_type_matched")))
    return t.select("id", F.array_join("tags", ",").alias("tags"), C.tag_score(F.col("tags")).alias("risk_score"))


@query(f"""with w as (select id, topo_mask m, list_sum(topo_mask) s, len(topo_mask) n from {PR} where len(topo_mask) > 0)
    select id, round(list_sum(list_transform(m, lambda x: case when s = 0 then 1.0 else x * n / s end)), 6) total, round(list_max(list_transform(m, lambda x: case when s = 0 then 1.0 else x * n / s end)), 6) peak from w""")
def normalized_weights(spark, d):
    """Unit weights brought to a mean of one."""
    w = prefs(spark, d).filter("size(topo_mask) > 0").select("id", A.normalized_weights(F.col("topo_mask")).alias("w"))
    return w.select("id", F.round(A.total(F.col("w")), 6).alias("total"), F.round(F.array_max("w"), 6).alias("peak"))


@query()
def claim_history(spark, d):
    """The premises that each claim's earlier units give it."""
    u = _probabilities(spark, d).join(pairs(spark, d).select("id", "sample_id", "error_symbol", "rewrite_target_span"), "id")
    u = u.withColumn("score", C.unit_score(F.col("kind"), F.col("e"), F.col("n"), F.col("c"), F.col("ev"))).withColumn("pos", F.substring("error_symbol", 2, 1).cast("int"))
    return C.claim_history(u, "sample_id", "pos", "kind", "score", "rewrite_target_span")


@query(f"""select id, len(w) n_tokens, list_sum(list_transform(generate_series(1, len(w)), lambda i: case when list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 - length(w[i]) / 2.0 >= s and list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 - length(w[i]) / 2.0 < e then 1 else 0 end))::int n_in_span
    from (select id, string_split(reasoning, ' ') w, instr(reasoning, rewrite_target_span) - 1 s, instr(reasoning, rewrite_target_span) - 1 + length(rewrite_target_span) e from {NP} where rewrite_target_span <> '' and instr(reasoning, rewrite_target_span) > 0)""")
def token_mask(spark, d):
    """How many tokens of a reasoning lie in the span to rewrite."""
    n = pairs(spark, d).select("id", "reasoning", P.locate(F.col("reasoning"), F.col("rewrite_target_span")).alias("s")).filter("s is not null")
    spans = F.array(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(0.5).alias("score")))
    m = n.select("id", P.token_mask(F.col("reasoning"), spans).alias("m"))
    return m.select("id", F.size("m").alias("n_tokens"), F.size(F.filter("m", lambda x: x > 1)).alias("n_in_span"))


# ---- sampling


def _md5(seed: str, key: str = "id") -> str:
    return f"md5('{seed}:' || {key})"


@query(f"""with c as (select dataset_name, count(*) n from {NP} where dataset_name is not null group by 1), e as (select dataset_name, n - 1 room, (400 - count(*) over ()) * (n - 1)::double / (sum(n) over () - count(*) over ()) exact, 400 - count(*) over () free from c),
    q as (select dataset_name, 1 + floor(exact) + (row_number() over (order by floor(exact) - exact, -room, dataset_name) <= free - sum(floor(exact)) over ())::int quota from e),
    r as (select id, dataset_name, row_number() over (partition by dataset_name order by {_md5('s1')}, id) r from {NP}) select id, dataset_name from r join q using (dataset_name) where r <= quota""")
def stratified_quota(spark, d):
    """400 negatives in proportion to their datasets."""
    return S.stratified(pairs(spark, d).select("id", "dataset_name"), "dataset_name", "id", 400, "s1")


@query(f"select error_symbol, id from (select error_symbol, id, row_number() over (partition by error_symbol order by {_md5('b1')}, id) r from {NP}) where r <= 25")
def bucket_sample(spark, d):
    """25 negatives of each error type."""
    return S.bucket_sample(pairs(spark, d).select("error_symbol", "id"), "error_symbol", "id", 25, "b1")


@query(f"select id, case when r <= 3 then 'smoke' when r <= 20 then 'pilot' else 'final' end stage from (select id, row_number() over (partition by dataset_name order by {_md5('n1')}, id) r from {NP}) where r <= 100")
def nested_stages(spark, d):
    """Stages of 3, 20 and 100 rows a dataset, each inside the next."""
    return S.nested_stages(pairs(spark, d).select("id", "dataset_name"), "dataset_name", "id", {"smoke": 3, "pilot": 20, "final": 100}, "n1").select("id", "stage")


@query(f"select id, case when ('0x' || substr({_md5('h1')}, 1, 8))::bigint / 4294967296.0 < 0.8 then 'train' else 'eval' end part from {NP}")
def hash_split(spark, d):
    """80/20 by hash."""
    return S.hash_split(pairs(spark, d).select("id"), "id", [("train", 0.8), ("eval", 0.2)], "h1")


@query(f"""with x as (select id, error_symbol, count(*) over (partition by error_symbol) n, row_number() over (partition by error_symbol order by {_md5('c1')}, id) r from {NP})
    select id, case when r <= (case when n < 2 then 0 else least(greatest(round(n * 0.3), 1), n - 1) end) then 'calibration' else 'evaluation' end part from x""")
def calibration_split(spark, d):
    """30 % of each error type for calibration."""
    return S.calibration_split(pairs(spark, d).select("id", "error_symbol"), "error_symbol", "id", 0.3, "c1").select("id", "part")


# ---- statistics


_SHIFT = f"(select dataset_name, id, heuristic_qc.novelty_ratio b, heuristic_qc.topic_overlap a from {NP} where heuristic_qc.novelty_ratio is not null and heuristic_qc.topic_overlap is not null)"


def _before_after(spark, d):
    return pairs(spark, d).select("dataset_name", "id", F.col("heuristic_qc.novelty_ratio").alias("b"), F.col("heuristic_qc.topic_overlap").alias("a"))


@query(f"""select dataset_name, count(*) n, round(avg(a - b), 6) mean_delta, round(median(a - b), 6) median_delta, count(*) filter (a - b < 0) improved, count(*) filter (a - b > 0) worsened, count(*) filter (a - b = 0) tied from {_SHIFT} group by 1""")
def paired_shift(spark, d):
    """Change from one measure to another per dataset."""
    s = M.paired_shift(_before_after(spark, d), ["dataset_name"], "b", "a")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_delta", "median_delta")})


@query(f"select dataset_name, count(*) n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) t from {_SHIFT} group by 1")
def paired_t(spark, d):
    """Paired t statistic per dataset."""
    return M.paired_t(_before_after(spark, d), ["dataset_name"], "b", "a").withColumn("t", F.round("t", 4))


@query(f"""with c as (select error_symbol, count(*) filter (answer_preserved and not expected_answer_preserved) only_a, count(*) filter (expected_answer_preserved and not answer_preserved) only_b from {NP} group by 1)
    select error_symbol, only_a, only_b from c""")
def mcnemar_counts(spark, d):
    """Discordant counts of two flags (with their exact p in `mcnemar_p`)."""
    return M.mcnemar(pairs(spark, d), "error_symbol", F.col("answer_preserved"), F.col("expected_answer_preserved")).drop("p")


@query(f"""with c as (select error_symbol, count(*) filter (answer_preserved and not expected_answer_preserved) only_a, count(*) filter (expected_answer_preserved and not answer_preserved) only_b from {NP} group by 1), k as (select *, only_a + only_b n, least(only_a, only_b) k from c)
    select error_symbol, only_a, only_b, round(case when n = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) end, 6) p from k""")
def mcnemar_p(spark, d):
    """Discordant counts of two flags with their exact p."""
    return M.mcnemar(pairs(spark, d), "error_symbol", F.col("answer_preserved"), F.col("expected_answer_preserved")).withColumn("p", F.round("p", 6))


@query()
def paired_bootstrap(spark, d):
    """Interval of the mean similarity of each error type."""
    n = pairs(spark, d).select("error_symbol", "id", F.col("heuristic_qc.similarity").alias("v"))
    return M.bootstrap_mean(n, ["error_symbol"], "v", "id")


@query()
def wilcoxon(spark, d):
    """Exact signed-rank test of each sample's changes."""
    n = pairs(spark, d).select("sample_id", (F.col("heuristic_qc.novelty_ratio") - F.col("heuristic_qc.topic_overlap")).alias("d"))
    return M.wilcoxon_exact(n, ["sample_id"], "d")


_W = "(p + 3.841459287681 / (2 * n) {s} 1.959964 * sqrt(p * (1 - p) / n + 3.841459 / (4.0 * n * n))) / (1 + 3.841459 / n)"


@query(f"""with c as (select dataset_name, count(*) n, avg((status = 'accepted_without_judge')::int) p from {NP} group by 1) select dataset_name, n, round({_W.format(s="-")}, 4) low, round({_W.format(s="+")}, 4) high from c""")
def wilson_interval(spark, d):
    """The share accepted without a judge per dataset, with its interval."""
    c = pairs(spark, d).groupBy("dataset_name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "accepted_without_judge").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return c.select("dataset_name", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


# ---- spans


@query(f"""with s as (select id, instr(reasoning, rewrite_target_span) - 1 a, instr(reasoning, rewrite_target_span) - 1 + length(rewrite_target_span) b, instr(negative_reasoning, modified_spans[1]) - 1 c, instr(negative_reasoning, modified_spans[1]) - 1 + length(modified_spans[1]) d
    from {NP} where rewrite_target_span <> '' and instr(reasoning, rewrite_target_span) > 0 and modified_spans[1] <> '' and instr(negative_reasoning, modified_spans[1]) > 0)
    select id, round(greatest(least(b, d) - greatest(a, c), 0)::double / (greatest(b, d) - least(a, c)), 6) iou from s""")
def span_iou(spark, d):
    """How far the rewritten span covers the place of the target span."""
    n = pairs(spark, d).select("id", P.locate(F.col("reasoning"), F.col("rewrite_target_span")).alias("x"), P.locate(F.col("negative_reasoning"), F.try_element_at("modified_spans", F.lit(1))).alias("y")).filter("x is not null and y is not null")
    return n.select("id", F.round(P.iou(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end")), 6).alias("iou"))


@query(f"""with s as (select distinct sample_id, instr(reasoning, rewrite_target_span) - 1 s, instr(reasoning, rewrite_target_span) - 1 + length(rewrite_target_span) e from {NP} where rewrite_target_span <> '' and instr(reasoning, rewrite_target_span) > 0)
    select sample_id, s, e from s x where not exists (select 1 from s y where y.sample_id = x.sample_id and y.s <= x.s and y.e >= x.e and (y.s < x.s or y.e > x.e))""")
def outer_spans(spark, d):
    """The target spans of each sample that no other one contains."""
    n = pairs(spark, d).select("sample_id", P.locate(F.col("reasoning"), F.col("rewrite_target_span")).alias("x")).filter("x is not null").select("sample_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    return P.drop_contained(n, "sample_id", "s", "e")


@query()
def bipartite_match(spark, d):
    """Maximum matching of both reviewers' rounds with equal scores, per item."""
    r = reviews(spark, d)
    a = r.select("id", F.col("review_round").alias("g"), F.col("reviewer1_clinical_plausibility").alias("s"))
    b = r.select("id", F.col("review_round").alias("p"), F.col("reviewer2_clinical_plausibility").alias("s"))
    return P.bipartite_match(a.join(b, ["id", "s"]), "id", "g", "p")


@query()
def sequence_similarity(spark, d):
    """Matching-block similarity of each pair's whole reasoning and its rewritten one, in canonical form; 0 where either is null."""
    return pairs(spark, d).select("id", P.sequence_similarity(X.similarity_text(F.col("reasoning")), X.similarity_text(F.col("negative_reasoning"))).alias("ratio"))


@query(f"""select dataset_name, count(*) n, count(*) filter (patient_context is null or trim(patient_context) = '') no_context, count(*) filter (retrieved_evidence is null or trim(retrieved_evidence) = '') no_evidence,
    count(*) filter (length(patient_context) > 1500) long_context from {SM} group by 1""")
def preflight(spark, d):
    """Missing and long fields per dataset before scoring."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return samples(spark, d).groupBy("dataset_name").agg(F.count("*").alias("n"), F.count_if(blank("patient_context")).alias("no_context"), F.count_if(blank("retrieved_evidence")).alias("no_evidence"), F.count_if(F.length("patient_context") > 1500).alias("long_context"))

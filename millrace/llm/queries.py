"""The queries of the training-data problems, pN_..., over the tables below a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from millrace.llm import components, consensus, crosssplit, defects, endings, langid, leaks, packing, split
from millrace.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_TEXTS = ["patient_context", "retrieved_evidence"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of samples over 1,500 characters with the boundary that its cuts need."""
    cut = split.split_oversized(table(spark, sf_dir, "samples"), ["sample_id"], SAMPLE_TEXTS, with_text=False)
    return cut.select("sample_id", "field", "boundary").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of those values."""
    cut = split.split_oversized(table(spark, sf_dir, "samples"), ["sample_id"], SAMPLE_TEXTS)
    return split.explode_pieces(cut, ["sample_id"]).dropDuplicates(["sample_id", "field", "piece"])


def _sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(components.grouped_records(table(spark, sf_dir, "samples")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with a split whose source, over all records, is torn between splits."""
    return components.torn_records(_sample_groups(spark, sf_dir)).select(F.col("record").alias("sample_id"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record, the same for all records of a source."""
    groups = _sample_groups(spark, sf_dir)
    splits = components.assign_splits(groups).select("component", F.col("split").alias("assigned"))
    return groups.join(splits, "component").select(F.col("record").alias("sample_id"), "component", "given", "assigned")


def p2_torn_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources which the given splits tear apart, with their records per split."""
    return components.torn_components(_sample_groups(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training record and one of val or test with the same or nearly the same context."""
    pairs = crosssplit.cross_split_overlaps(table(spark, sf_dir, "samples"))
    return pairs.select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b")).distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs by the evaluation record's split and dataset_name, and how many of its records are in one.

    Pairs are counted from the sizes of the linked classes, without listing them.
    """
    samples = table(spark, sf_dir, "samples")
    names = samples.groupBy(F.col("sample_id").alias("id")).agg(F.min("dataset_name").alias("dataset_name"))
    members, links = crosssplit.class_links(samples)
    partners = members.filter("part = 'train'").groupBy(F.col("class").alias("train")).agg(F.count("*").alias("n"))
    linked = links.join(partners, "train").groupBy(F.col("held").alias("class")).agg(F.sum("n").alias("n"))
    held = members.filter("part <> 'train'").join(names, "id").groupBy("class", F.col("part").alias("split"), "dataset_name").agg(F.count_distinct("id").alias("records"), F.count("*").alias("rows"))
    return held.join(linked, "class").groupBy("split", "dataset_name").agg(F.sum(F.col("n") * F.col("rows")).alias("n_pairs"), F.sum("records").alias("n_records"))


def _p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    neg, sam = table(spark, sf_dir, "negative_pair"), table(spark, sf_dir, "samples")
    return neg.select(F.lit("negative_reasoning").alias("field"), F.col("id").alias("record_key"), "dataset_name", F.col("negative_reasoning").alias("text")).unionByName(
        sam.select(F.lit("retrieved_evidence").alias("field"), F.col("sample_id").cast("string").alias("record_key"), "dataset_name", F.col("retrieved_evidence").alias("text"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of negative_reasoning and retrieved_evidence that break off inside a sentence or word."""
    judged = endings.judge_endings(_p4_values(spark, sf_dir), ["record_key"], "field", "text")
    return judged.filter("truncated").select("field", "record_key")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of truncated values by field and dataset_name, each key counted once."""
    judged = endings.judge_endings(_p4_values(spark, sf_dir), ["record_key", "dataset_name"], "field", "text")
    return judged.groupBy("field", "dataset_name").agg(
        F.count("*").alias("n_values"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("int")).alias("share")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chosen and rejected side that is no proper answer to its prompt, with its defect."""
    return defects.pair_defects(table(spark, sf_dir, "preference_row"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.detect(docs, ["doc_id", "lang"], "text", langid.fit_from(docs, "doc_id", "text", "lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each document whose label is missing or wrong, or that has several."""
    langs = langid.document_languages(_detected(spark, sf_dir), ["doc_id", "lang"]).withColumn("label", langid.label_language(F.col("lang")))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains(F.col("langs.lang"), F.col("label"))
    return langs.filter(wrong).select("doc_id", F.explode("langs.lang").alias("lang")).distinct()


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's languages with a confidence, whatever its label."""
    langs = langid.document_languages(_detected(spark, sf_dir), ["doc_id"])
    return langs.select("doc_id", F.inline_outer("langs")).dropDuplicates(["doc_id", "lang"])


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document in one language."""
    return _detected(spark, sf_dir).select("doc_id", F.inline("segments")).dropDuplicates(["doc_id", "start"])


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "mcq_row"), "id", "question")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each test item of which it holds a passage."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items with the number of documents that hold them."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("n_words").alias("most_words"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return packing.oversized(_packed(spark, sf_dir), "doc_id")


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and position of every document or piece."""
    return _packed(spark, sf_dir)


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences are: their number, tokens, and unused share."""
    filled = _packed(spark, sf_dir).filter("sequence is not null").groupBy("sequence").agg(F.sum("n_tokens").alias("tokens"))
    return filled.agg(F.count("*").alias("n_sequences"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"), (1 - F.avg("tokens") / packing.CAPACITY).alias("unused"))


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.fit(consensus.ratings(table(spark, sf_dir, "review_sample")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus decision of each item that at least three reviewers decided on."""
    return _consensus(spark, sf_dir).items().filter("n_reviewers >= 3").select(F.col("item").alias("id"), "decision")


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, confidence and score of every item with a readable decision."""
    return _consensus(spark, sf_dir).items().withColumnRenamed("item", "id")


def p6_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer's reliability with its interval."""
    return _consensus(spark, sf_dir).reviewers()


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of the decisions."""
    return consensus.krippendorff(consensus.ratings(table(spark, sf_dir, "review_sample")))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_split": p2_split, "p2_torn_sources": p2_torn_sources, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p6_found": p6_found, "p6_consensus": p6_consensus, "p6_reviewers": p6_reviewers, "p6_agreement": p6_agreement, "p7_found": p7_found, "p7_places": p7_places, "p7_use": p7_use, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_languages": p9_languages, "p9_segments": p9_segments}

_SEP = r"[\s:_\x{00AD}\x{2010}-\x{2015}\x{2212}\x{FF0D}-]*"
_REFS = rf"""
named as (
    select distinct on (sample_id) sample_id, lower(trim(coalesce(split, ''))) s, upper(trim(coalesce(source_id, ''))) bare,
        list_distinct(list_transform(list_filter(regexp_extract_all(upper(coalesce(source_id, '')), '[A-Z]+{_SEP}[0-9]+'), lambda m: regexp_extract(m, '^[A-Z]+') not in ('V', 'VER', 'VERSION', 'REV', 'PART')),
            lambda m: regexp_extract(m, '^[A-Z]+') || '-' || regexp_replace(regexp_extract(m, '[0-9]+$'), '^0+([0-9])', '\1'))) found
    from samples where sample_id is not null),
refs as (select sample_id, s, case when len(found) > 0 then found when bare <> '' then [bare] else ['record ' || sample_id] end r from named),
sides as (select sample_id, r, case when s like 'tr%' then 'train' when s like '%test%' then 'test' when s <> '' then 'val' end given from refs),
links as (select r[1] a, unnest(r) b from sides union select unnest(r), r[1] from sides),
walk as (select a node, a reached from links union select w.node, l.b from walk w join links l on l.a = w.reached),
component as (select node, min(reached) c from walk group by node),
records as (select sample_id, c, given from sides join component on node = r[1]),
torn as (select c, count(*) n_records, count(*) filter (given = 'train') n_train, count(*) filter (given = 'val') n_val, count(*) filter (given = 'test') n_test from records group by c having count(distinct given) > 1)
"""

_SPLITS = """
sizes as (select c, count(*) n, md5('split:' || c) h, sum(count(*)) over () total from records group by c),
big as (select *, row_number() over (order by h) i from sizes where n > total * 0.02),
walk_big as (select 0::bigint i, ''::varchar c, ''::varchar s, 0.0::double tr, 0.0::double va, 0.0::double te
    union all select i, c, s, tr + case s when 'train' then n else 0 end, va + case s when 'val' then n else 0 end, te + case s when 'test' then n else 0 end from (
        select *, case when a >= b and a >= d and a > -9 then 'train' when b >= d and b > -9 then 'val' when d > -9 then 'test' else 'train' end s from (
            select b.i, b.c, b.n, g.tr, g.va, g.te, case when total * (1 - 0.1 - 0.1) - tr >= n / 2 then 1 - tr / (total * (1 - 0.1 - 0.1)) else -10 end a,
                case when total * 0.1 - va >= n / 2 then 1 - va / (total * 0.1) else -10 end b, case when total * 0.1 - te >= n / 2 then 1 - te / (total * 0.1) else -10 end d
            from walk_big g join big b on b.i = g.i + 1))),
rooms as (select greatest(0, (select max(total) from sizes) * 0.1 - te) te, greatest(0, (select max(total) from sizes) * 0.1 - va) va from walk_big order by i desc limit 1),
small as (select c, sum(n) over (order by h rows unbounded preceding) - n / 2 middle from sizes where n <= total * 0.02),
assigned as (select c, case when middle < te then 'test' when middle < te + va then 'val' else 'train' end s from small, rooms union all select c, s from walk_big where i > 0)
"""

ORACLES: dict[str, str] = {
    "p2_split": f"with recursive {_REFS}, {_SPLITS} select sample_id, c component, given, s assigned from records join assigned using (c)",
    "p2_torn_sources": f"with recursive {_REFS} select c component, n_records, n_train, n_val, n_test from torn",
    "p2_found": f"with recursive {_REFS} select sample_id from records where given is not null and c in (select c from torn)",
    "p6_agreement": r"""
        with sides as (select id, review_round, trim(reviewer1_id) reviewer, reviewer1_final_decision d, reviewer1_clinical_plausibility s from review_sample
            union all select id, review_round, trim(reviewer2_id), reviewer2_final_decision, reviewer2_clinical_plausibility from review_sample),
        clean as (select distinct id, review_round, reviewer, regexp_replace(lower(trim(d)), '[-_\s]+', '_', 'g') d from sides where reviewer <> ''),
        item as (select id, count(*) filter (d = 'accept') a, count(*) filter (d = 'minor_revision') b, count(*) filter (d = 'reject') c, count(*) m from clean
            where d in ('accept', 'minor_revision', 'reject') group by id having count(*) > 1),
        t as (select count(*) n_items, sum(m) n, sum((a * (a - 1) + b * (b - 1) + c * (c - 1)) / (m - 1)) same, sum(a) a, sum(b) b, sum(c) c from item)
        select n_items, n n_ratings, 1 - (1 - same / n) / (1 - (a * (a - 1) + b * (b - 1) + c * (c - 1)) / (n * (n - 1))) alpha from t""",
}

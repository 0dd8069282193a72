"""Readers and writers of the file forms that the data model uses."""

from __future__ import annotations

import json
import math
import os
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """One row a line. Strict mode fails at a bad line; tolerant mode keeps it in `_corrupt_record`.

    Blank lines are no rows. The schema is given, so that no pass infers it.
    """
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def split_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their line in `_corrupt_record`) of a tolerant read."""
    return df.filter(F.col(BAD).isNull()).drop(BAD), df.filter(F.col(BAD).isNotNull())


def bad_row_report(bad: DataFrame, preview: int = 5, width: int = 160) -> DataFrame:
    """One row (n_bad, preview): how many lines a tolerant read couldn't parse, and the beginnings of the first few in text order."""
    shown = bad.select(F.substring(BAD, 1, width).alias("line")).orderBy("line").limit(preview).agg(F.sort_array(F.collect_list("line")).alias("preview"))
    return bad.agg(F.count("*").alias("n_bad")).withColumn("_", F.lit(1)).join(shown.withColumn("_", F.lit(1)), "_").drop("_")


def read_window(spark: SparkSession, path: str, start: int, end: int = -1) -> DataFrame:
    """(ordinal, value): the lines start..end-1 of a text file or folder in file order, counted from 0; no bound for a negative end.

    Ordinals follow the files' names and the lines in them; a first pass counts the lines of each partition.
    """
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = lines.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.min(F.struct("_file", F.col("_id"))).alias("first")).orderBy("first").collect()  # one row a partition
    before, total = {}, 0
    for r in sizes:
        before[r["_part"]] = total
        total += r.n
    offset = F.create_map(*(x for k, n in before.items() for x in (F.lit(k), F.lit(n)))) if before else F.create_map().cast("map<bigint,bigint>")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lines.select((F.try_element_at(offset, part) + inside).cast("long").alias("ordinal"), "value")
    return numbered.filter((F.col("ordinal") >= start) & (F.lit(end < 0) | (F.col("ordinal") < end)))


def read_ids(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """(id, ord): the distinct non-blank ids of a list in any readable form, in the order of their first place."""
    rows = read_records(spark, path).select(F.trim(F.col(column).cast("string")).alias("id"), F.monotonically_increasing_id().alias("at")).filter("id <> ''")
    return rows.groupBy("id").agg(F.min("at").alias("ord"))


def read_config(path: str, defaults: dict | None = None) -> dict:
    """A JSON or, where a parser is there, YAML document over its defaults, nested ones key by key."""
    text = Path(path).read_text()
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        own = yaml.safe_load(text) or {}
    else:
        own = json.loads(text)

    def over(a: dict, b: dict) -> dict:
        return {k: over(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    return over(defaults or {}, own)


def read_csv(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """Quoted fields may hold line breaks. All columns as strings, an empty field an empty string; or `typed`: types inferred, empty fields null."""
    if typed:
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=True)
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return rows.fillna("")


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: .jsonl, .json (a list, a list under records, rows, data or items, or one row), .csv, .parquet, .orc."""
    kind = Path(path.rstrip("/")).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == ".jsonl":
        return reader.json(path)
    if kind == ".csv":
        return read_csv(spark, path)
    if kind in (".parquet", ".orc"):
        return reader.format(kind[1:]).load(path)
    if kind != ".json":
        raise ValueError(f"no reader for {kind or path}")
    whole = spark.read.json(path, multiLine=True)
    for name in ("records", "rows", "data", "items"):
        if name in whole.columns and isinstance(whole.schema[name].dataType, T.ArrayType):
            return whole.select(F.inline(name))
    return whole


def flatten_map_of_lists(df: DataFrame, payload: str, element: T.StructType, source: str = "source") -> DataFrame:
    """Rows of a JSON object of lists; `source` is the list's name where the row has none itself."""
    lists = df.select(F.explode(F.from_json(F.col(payload), T.MapType(T.StringType(), T.ArrayType(element)))).alias("_key", "_rows"))
    rows = lists.select("_key", F.explode("_rows").alias("_row")).select("_key", "_row.*")
    named = F.coalesce(F.col(source), F.col("_key")) if source in rows.columns else F.col("_key")
    return rows.withColumn(source, named).drop("_key")


def read_many(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """JSON documents of several paths or globs, each file once, with the file that each row came from."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = set()
    for p in patterns:
        target = hadoop.Path(p)
        found |= {str(s.getPath()) for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []}
    return spark.read.json(sorted(found), multiLine=True).withColumn("source_file", F.col("_metadata.file_path"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The table at `path`, an empty one where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, order: str = "first_seen") -> None:
    """Nested cells as JSON, null as an empty cell; columns as they are or sorted by name."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
    if order == "sorted":
        flat = [flat[df.columns.index(c)] for c in sorted(df.columns)]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, nullValue="", quote='"', escape='"')


def write_union(frames: list[DataFrame], path: str, order: str = "first_seen") -> None:
    """One CSV of tables with different columns: the union of all columns, by first appearance or by name; missing cells are empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    write_csv(out, path, order)


def finite(value):
    """The value with NaN and infinities as null, inside lists and objects too."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_document(payload: dict | list, path: str) -> None:
    """A JSON document, indented, with a line break at its end; written beside and renamed, so that readers see the old or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(f".{target.name}.{os.getpid()}")
    beside.write_text(json.dumps(finite(payload), indent=2, ensure_ascii=False) + "\n")
    os.replace(beside, target)


def annotation_sheet(df: DataFrame, shown: list[str], asked: list[str]) -> DataFrame:
    """The shown columns and a blank one for each thing asked of the annotator; nested cells as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in shown]
    return df.select(*flat, *(F.lit("").alias(a) for a in asked))


def open_jobs(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The jobs to hand out: those whose key no result has, each key once."""
    return jobs.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def write_routed(df: DataFrame, path: str, by: str = "status") -> None:
    """One folder for each terminal status, in one pass."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def run_metadata(spark: SparkSession, stage: str, started: str, finished: str, args: dict, stats: dict) -> DataFrame:
    """One row that describes a run, for appending to a metadata table."""
    seconds = F.round((F.unix_micros(F.to_timestamp(F.lit(finished))) - F.unix_micros(F.to_timestamp(F.lit(started)))) / 1e6, 4)
    text = lambda x: {k: json.dumps(v) for k, v in x.items()}
    row = spark.createDataFrame([(stage, started, finished, text(args), text(stats), {"cpus": str(os.cpu_count()), "system": platform.platform()})], "stage_name string, started_at string, finished_at string, args map<string,string>, stats map<string,string>, hardware map<string,string>")
    return row.withColumn("elapsed_seconds", seconds)

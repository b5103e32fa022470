"""CSV, JSON, GeoJSON, FASTQ and transit files, and keyed stores."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A CSV with a given schema (never inferred); a UTF-8 mark is skipped."""
    return spark.read.schema(schema).option("sep", delimiter).option("header", header).option("enforceSchema", not header).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """JSON lines, or the records of an array field."""
    if field is None:
        return spark.read.schema(schema).json(path)
    whole = spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.inline(field))


FEATURE = "struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as properties (map) and geometry (type, coordinates as JSON
    text). A file is one JSON value, so it is read as a whole by one task;
    convert large collections to one feature per line first."""
    raw = spark.read.schema(f"features array<{FEATURE}>").option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line: splits like any text."""
    kind = FEATURE.removeprefix("struct<").removesuffix(">")
    return spark.read.schema(", ".join(p.replace(":", " ", 1) for p in _top_level(kind))).json(path).select("properties", "geometry")


def _top_level(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def point_of(geometry: Column) -> Column:
    """Struct lon, lat of a point geometry."""
    xy = F.from_json(geometry["coordinates"], "array<double>")
    return F.struct(F.try_element_at(xy, F.lit(1)).alias("lon"), F.try_element_at(xy, F.lit(2)).alias("lat"))


def line_of(geometry: Column) -> Column:
    """Points of a line geometry."""
    xy = F.from_json(geometry["coordinates"], "array<array<double>>")
    return F.transform(xy, lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("lon"), F.try_element_at(p, F.lit(2)).alias("lat")))


def read_acs(spark: SparkSession, path: str, schema: str, state: str, targets: list[str], key: str = "GEOID") -> DataFrame:
    """Census rows of a state that have at least one of the target values."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    code = F.regexp_replace(F.col(key), "^[0-9]*US", "")
    some = F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in targets]).isNotNull()
    return rows.filter(code.startswith(state) & some).select(key, "NAME", *targets)


def _code_sum(lines: pd.Series) -> pd.Series:
    """Sum of the code points of each text."""
    sums = np.cumsum(np.frombuffer("".join(lines).encode("utf-32-le"), "<u4"), dtype=np.int64)
    ends = np.cumsum(lines.str.len().to_numpy(np.int64))
    return pd.Series(np.diff(np.concatenate(([0], sums))[ends], prepend=0))


def fastq_quality(spark: SparkSession, path: str) -> DataFrame:
    """Per file: reads, bases and mean Phred score. Quality lines are every
    fourth line. Files are read in splits: each split is summed for the four
    remainders that its lines' numbers can have, and the numbers of lines in the
    splits before it tell which remainder is the quality lines'."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    lines = lines.select("file", "_at", "_id", F.length("value").alias("_bases"), F.pandas_udf(_code_sum, "long")("value").alias("_sum"))
    some = F.col("_bases") > 0
    kinds = lines.groupBy("file", "_at", (F.col("_id") % 4).alias("_kind")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.count_if(some).alias("reads"), F.sum("_bases").alias("bases"), F.sum(F.col("_sum") - 33 * F.col("_bases")).alias("score")
    )
    kind = F.struct("_kind", "reads", "bases", "score")
    splits = kinds.groupBy("file", "_at").agg(F.min("_first").alias("_first"), F.sum("_lines").alias("_lines"), F.collect_list(kind).alias("_kinds"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quality = splits.withColumn("_before", before).select("file", "_first", "_before", F.inline("_kinds")).filter("(_kind - _first + _before) % 4 = 3 or (_kind - _first + _before) % 4 = -1")
    return quality.groupBy("file").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), (F.sum("score") / F.sum("bases")).alias("mean_phred")).filter("reads > 0")


def read_gtfs(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """A table of a transit feed; a missing file or column gives no rows or nulls."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    clean = raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns})
    return clean.select(*[(F.col(c) if c in clean.columns else F.lit(None).cast("string")).alias(c) for c in columns])


# ---- stores ---------------------------------------------------------------


def upsert(store: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The store after the changes: per key the change last in ``order`` wins
    over the stored row. One aggregate over both, no join."""
    fields = [c for c in store.columns if c not in keys]
    old = store.select(*keys, F.struct(*fields).alias("_row"), F.lit(0).alias("_new"), F.lit(None).cast(dict(changes.dtypes)[order]).alias("_at"))
    new = changes.select(*keys, F.struct(*fields).alias("_row"), F.lit(1).alias("_new"), F.col(order).alias("_at"))
    merged = old.unionByName(new).groupBy(*keys).agg(F.max_by("_row", F.struct("_new", "_at")).alias("_row"))
    return merged.select(*keys, "_row.*").select(*store.columns)


def ingest(store: DataFrame | None, rows: DataFrame, dataset: str, key: Column, facet: str, kind: str, at_ms: int) -> DataFrame:
    """A keyed store of records after rows with ``properties`` (map) and, if
    they have one, ``geometry`` came in: one record per dataset and feature
    key, of which the newest load wins. A null key counts as empty; of rows of
    one load that share a key, one with the greatest properties text stays."""
    shape = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("coordinates"))
    geometry = F.col("geometry") if "geometry" in rows.columns else F.when(F.lit(False), shape)
    fresh = rows.select(
        F.lit(dataset).alias("dataset_key"), F.coalesce(key.cast("string"), F.lit("")).alias("feature_key"), F.lit(facet).alias("facet_name"), F.lit(kind).alias("data_type"),
        F.col("properties").alias("properties"), geometry.alias("geometry"), F.lit(at_ms).cast("long").alias("imported_at"),
    )
    both = fresh if store is None else store.select(*fresh.columns).unionByName(fresh)
    fields = [c for c in fresh.columns if c not in ("dataset_key", "feature_key")]
    newest = F.max_by(F.struct(*fields), F.struct("imported_at", F.to_json("properties")))
    return both.groupBy("dataset_key", "feature_key").agg(newest.alias("_row")).select("dataset_key", "feature_key", "_row.*")


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV as ``properties`` maps of texts."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)
    return raw.select(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("properties"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON objects as ``properties`` maps of texts."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("properties")).filter("properties is not null")


def write_features(features: DataFrame, path: str, keep: Column) -> DataFrame:
    """Features (properties, geometry) that a condition keeps, written one per
    line, and read back."""
    geometry = F.struct(F.col("geometry.type").alias("type"), F.try_parse_json("geometry.coordinates").alias("coordinates"))
    features.filter(keep).select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", geometry.alias("geometry")))).write.text(path)
    return read_feature_lines(features.sparkSession, path)


def load(df: DataFrame, target: str, mode: str = "append") -> dict:
    """Write and report: rows written are counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(target)
    rows = seen.get["rows"]
    return {"target": target, "rows_written": rows, "status": "ok" if rows else "empty"}


def export_csv(df: DataFrame, first: list[str], preferred: list[str]) -> DataFrame:
    """Columns in export order: the first ones, preferred ones, the rest by name."""
    named = [c for c in [*first, *preferred] if c in df.columns]
    return df.select(*named, *sorted(c for c in df.columns if c not in named))


def guarded_sql(spark: SparkSession, statement: str, most: int = 5000) -> DataFrame:
    """A read-only statement with a row limit: it must begin with select or
    with and may not hold words that change data."""
    low = statement.strip().lower()
    # Words that are refused.
    refused = {"insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "set", "cache", "refresh"}
    if not low.startswith(("select", "with")) or ";" in low.rstrip("; \n") or refused & set("".join(c if c.isalnum() or c == "_" else " " for c in low).split()):
        raise ValueError("only a single read-only statement is allowed")
    return spark.sql(statement.rstrip("; \n")).limit(most)


def cache_key(inputs: dict[str, int], parameters: dict, version: str) -> str:
    """Name of a materialised result: input sizes, parameters and version decide."""
    return hashlib.sha256(json.dumps([sorted(inputs.items()), sorted(parameters.items()), version], default=str).encode()).hexdigest()[:24]


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """The result under ``folder/key``, computed once. Paths go through Spark's
    file systems, so the folder may be in any store."""
    spark, path = df.sparkSession, f"{folder}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

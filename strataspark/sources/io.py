"""Readers and writers of the supported file shapes, and checks on what was read."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("unit_id", T.LongType()), T.StructField("time", T.IntegerType()),
    T.StructField("feature", T.StringType()), T.StructField("action", T.StringType()), T.StructField("modality", T.StringType()),
    T.StructField("polarity", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("raw", T.DoubleType()),
    T.StructField("norm", T.DoubleType()), T.StructField("is_key_marker", T.BooleanType()), T.StructField("provenance", T.StringType()),
])
TRIPLES = "row LONG, col LONG, value DOUBLE"


# ---- Matrix Market
def mtx_header(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(rows, cols, entries): the first line that is not a comment, of the first file."""
    files = sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    for f in files:
        first = spark.read.text(f).where(~F.col("value").startswith("%")).head()
        if first is not None:
            return tuple(int(x) for x in first[0].split()[:3])
    raise ValueError(f"no size line in {path}")


def read_mtx_long(spark: SparkSession, path: str) -> DataFrame:
    """0-based (row, col, value) of a Matrix Market file or folder of parts, without its size line.

    A malformed line, or another number of entries than the size line says, is an error. An entry that equals the size
    line is kept: of the lines like it, one is taken away. Plain text splits by block; a gzip file is one split, so it
    is spread before anything else runs."""
    n_row, n_col, nnz = mtx_header(spark, path)
    raw = (spark.read.option("sep", " ").option("comment", "%").option("recursiveFileLookup", True).option("mode", "FAILFAST")
           .schema(TRIPLES).csv(path))
    if path.endswith(".gz"):
        raw = raw.repartition(spark.sparkContext.defaultParallelism, "col")
    found = raw.agg(F.count(F.struct("row", "col", "value"))).first()[0] - 1
    if found != nnz:
        raise ValueError(f"{found} entries in {path}; its size line says {nnz}")
    like = (F.col("row") == n_row) & (F.col("col") == n_col) & (F.col("value") == float(nnz))
    again = raw.where(like).groupBy("row", "col", "value").count().where("count > 1").withColumn("k", F.explode(F.expr("sequence(2, count)"))).select("row", "col", "value")
    return raw.where(~like).unionByName(again).select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value")


def write_mtx(df: DataFrame, path: str, n_row: int, n_col: int) -> None:
    """Writes 0-based (row, col, value) triples as a folder: header part, then body parts. Values with fractions make a
    real matrix, whole ones an integer matrix."""
    n = df.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.bool_and(F.col("value") == F.rint("value")), F.lit(True)).alias("whole")).first()
    value = F.col("value").cast("long" if n.whole else "double").cast("string")
    body = df.select(F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), value).alias("value"))
    kind = "integer" if n.whole else "real"
    head = df.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general\n{n_row} {n_col} {n.nnz}",)], "value string")
    head.write.mode("overwrite").text(f"{path}/0_header")
    body.write.mode("overwrite").text(f"{path}/1_body")


# ---- feature tables, events
def read_feature_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; a malformed one is an error."""
    return spark.read.option("sep", "\t").option("mode", "FAILFAST").schema(schema).csv(path)


def write_feature_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def read_events_jsonl(spark: SparkSession, path: str, wanted: DataFrame | None = None, where: Column | None = None,
                      schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Event rows; optionally only the units of ``wanted`` and the rows that pass ``where``. A malformed line is an error."""
    df = spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    if where is not None:
        df = df.where(where)
    return df if wanted is None else df.join(wanted.select("unit_id").distinct(), "unit_id", "left_semi")


def write_events_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# ---- counts
def counts_long_filtered(counts: DataFrame, feature_map: DataFrame) -> DataFrame:
    """Rows of mapped features (``feature -> mapped``) with totals over ALL features of the unit."""
    totals = counts.groupBy("unit_id").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("detected"))
    kept = counts.join(feature_map.select("feature", "mapped"), "feature").where(F.col("mapped").isNotNull())
    return kept.groupBy("unit_id", "mapped").agg(F.sum("count").alias("count")).join(totals, "unit_id")


def counts_integrity(counts: DataFrame, totals: DataFrame, declared_entries: DataFrame) -> DataFrame:
    """One row per rule with its number of violations.

    ``totals``: published (unit_id, total); ``declared_entries``: one row (n)."""
    v = lambda c: F.sum(c.cast("int"))
    one = counts.agg(F.coalesce(v(F.col("count") <= 0), F.lit(0)).alias("not_positive"),
                     F.coalesce(v(F.col("count") != F.rint("count")), F.lit(0)).alias("not_integer"),
                     F.count(F.lit(1)).alias("n"))
    one = one.withColumn("entries", F.abs(F.col("n") - declared_entries.select("n").scalar()))
    pair = counts.groupBy("unit_id", "feature").count().agg(F.coalesce(v(F.col("count") > 1), F.lit(0)).alias("k"))
    tot = (counts.groupBy("unit_id").agg(F.sum("count").alias("t")).join(totals, "unit_id", "full")
                 .agg(F.coalesce(v(~F.col("t").eqNullSafe(F.col("total"))), F.lit(0)).alias("k")))
    dup = totals.groupBy("unit_id").count().agg(F.coalesce(v(F.col("count") > 1), F.lit(0)).alias("k"))
    rows = one.select(F.expr("stack(3, 'counts are positive', cast(not_positive as bigint), 'counts are whole', cast(not_integer as bigint), "
                             "'entries equal the header', cast(entries as bigint)) as (rule, violations)"))
    for name, d in (("one entry per unit and feature", pair), ("totals equal the published ones", tot), ("unit ids are unique", dup)):
        rows = rows.unionByName(d.select(F.lit(name).alias("rule"), F.col("k").cast("long").alias("violations")))
    return rows


# ---- profile, fingerprints, manifests
def table_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Per column: distinct values, missing values. Values are first reduced per (column, value), so the
    exact distinct count is two hash aggregates and no column is shuffled whole."""
    if approximate:
        aggs = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("n_distinct"),
                         F.sum(F.col(c).isNull().cast("long")).alias("n_missing")) for c in columns]
        return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s"))
    per = long.groupBy("s.column", "s.v").count()
    return per.groupBy("column").agg(F.count("v").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("count"))), F.lit(0)).alias("n_missing"))


def value_counts(df: DataFrame, column: str, top: int = 60) -> DataFrame:
    """The most frequent values of a column (a top-k report)."""
    return df.groupBy(F.col(column).cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(top)


def regex_share(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Share of the values of a column that match an id pattern."""
    d = df.select(F.col(column).cast("string").alias("v"))
    return d.agg(F.avg(F.col("v").rlike(pattern).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def id_set_fingerprint(df: DataFrame, id_col: str, by: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of the set of ids (an id that is listed twice counts once): count and xor of two 60-bit
    slices of md5(id)."""
    df = df.select(*(by or []), id_col).distinct()
    h = F.md5(F.col(id_col).cast("string"))
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("long")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part(1)).alias("fp1"), F.bit_xor(part(17)).alias("fp2"))


def id_set_sha256(df: DataFrame, id_col: str, by: list[str] | None = None, width: int = 4096) -> DataFrame:
    """Order-free SHA-256 of an integer id set as a two-level tree: ids are hashed in runs of ``width``
    consecutive values, then the run digests in order, so no task holds the whole set."""
    by = by or []
    d = df.select(*by, F.col(id_col).cast("long").alias("id")).distinct().withColumn("run", F.floor(F.col("id") / width))
    leaf = d.groupBy(*by, "run").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), ","), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return leaf.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("run", "h"))), lambda s: s["h"]), ","), 256).alias("sha256"))


def pair_set_fingerprint(df: DataFrame, a: str, b: str) -> DataFrame:
    """Fingerprint of the set of unordered pairs, written lo|hi."""
    code = F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")).alias("code")
    return id_set_fingerprint(df.select(code), "code")


def checksum_manifest_check(present: DataFrame, manifest: DataFrame, key: str = "name", digest: str = "digest") -> DataFrame:
    """OK / MISMATCH / MISSING per declared name (and UNDECLARED for extra ones)."""
    j = manifest.select(key, F.col(digest).alias("want")).join(present.select(key, F.col(digest).alias("have")), key, "full")
    return j.select(key, F.when(F.col("want").isNull(), "UNDECLARED").when(F.col("have").isNull(), "MISSING")
                    .when(F.col("want") == F.col("have"), "OK").otherwise("MISMATCH").alias("status"))


# ---- evidence events
def export_evidence_events(panel: DataFrame, q: DataFrame, panel_of: dict[str, list[str]], key_marker: dict[str, str],
                           value: str = "predicted", timing: str = "zero", provenance: str = "prediction") -> DataFrame:
    """One typed event per (unit, panel feature): value = clip(pred / p95, 0, 1), class, key-marker flag."""
    flat = [(f, c) for c, fs in panel_of.items() for f in fs]
    meta = panel.sparkSession.createDataFrame(
        [(f, c, key_marker[c] == f, i if timing == "order" else 0) for i, (f, c) in enumerate(flat)],
        "feature string, action string, is_key_marker boolean, time int")
    d = panel.join(F.broadcast(meta), "feature").join(q, "feature")       # meta: one row per declared panel feature
    v = F.least(F.greatest(F.col(value) / F.greatest(F.col("q"), F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    return d.select(F.concat(F.lit("u"), F.col("unit_id").cast("string"), F.lit(":"), F.col("feature")).alias("event_id"), "unit_id", "time",
                    "feature", "action", F.lit("predicted").alias("modality"), F.lit("support").alias("polarity"), v.alias("value"),
                    F.col(value).alias("raw"), F.col("q").alias("norm"), "is_key_marker", F.lit(provenance).alias("provenance"))


def panel_warnings(pearson: DataFrame, min_r: float) -> DataFrame:
    """Panel features whose correlation with the measurement is below ``min_r``."""
    return pearson.where(F.col("r") < min_r)


def group_events_to_instances(events: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """One row per unit with its events nested in (time, event_id) order; a unit has one event per panel feature."""
    g = events.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("time", "event_id", "feature", "action", "value", "is_key_marker"))).alias("events"))
    return g if units is None else g.join(units, "unit_id")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)

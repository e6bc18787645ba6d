"""Helpers of the corpus operators: Arrow passes over documents, bounded blocks of text and exact per-group numbering."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_code

BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only: whatever else the table has, under whatever name, plays no part."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def schema_of(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


def blocks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into pieces of about ``limit`` bytes of text; a single longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(text_at)
        lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_documents(df: DataFrame, text: str, out: str, fn: Callable[[pa.RecordBatch], dict], limit: int = BLOCK_BYTES) -> DataFrame:
    """Runs ``fn`` on blocks of at most ``limit`` text bytes; ``fn`` returns the columns of ``out`` by name."""
    schema = schema_of(out)
    arrow = to_arrow_schema(schema)
    at = df.columns.index(text)

    def run(batches):
        for block in blocks(batches, at, limit):
            got = fn(block)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in arrow], schema=arrow)
    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_documents(df: DataFrame, text: str, keep: Callable[[list], list], limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``df`` (all columns as they are) whose text passes ``keep`` (list of texts -> list of booleans)."""
    at = df.columns.index(text)

    def run(batches):
        for block in blocks(batches, at, limit):
            yield block.filter(pa.array(keep(block.column(at).to_pylist()), type=pa.bool_()))
    ship_code(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def replace_texts(df: DataFrame, text: str, change: Callable[[list], list], n_chars: str | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with its texts changed; a column of text lengths follows where there is one."""
    at = df.columns.index(text)

    def run(batches):
        for block in blocks(batches, at, limit):
            out = pa.array(change(block.column(at).to_pylist()), type=block.schema.field(at).type)
            yield block.set_column(at, block.schema.field(at), out)
    ship_code(df.sparkSession)
    out = df.mapInArrow(run, df.schema)
    if n_chars and n_chars in df.columns:
        out = out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(df.schema[n_chars].dataType))
    return out


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, key: Column, rows_per_task: int = 200_000) -> DataFrame:
    """A gapless number from 0 within each group, in buckets of the row key: no group lies in one task.

    Bucket sizes are counted first (one row per group and bucket) and give each bucket its offset; the number of
    buckets follows the row count. ``key`` must be a column expression that spreads the rows of a group."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_task)) * 4
    spread = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(*by, "__bucket").agg(F.count("*").alias("__size"))
    from pyspark.sql import Window as W
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    inside = spread.withColumn("__inside", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(*order)) - 1)
    return inside.join(before, [*by, "__bucket"]).withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__before", "__inside", "__bucket")


EDGES_PER_TASK = 250_000


def components(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label) with the smallest node as the label.

    Alternates large stars (each neighbour above a node joins its smallest neighbour) and small stars until nothing
    changes. Each star is one exchange: a node's edges come sorted, the smallest neighbour is the first of them, repeated
    edges are dropped as they pass, and no group is held. Nothing is collected but two totals per round."""
    from pyspark.sql import Window as W
    by = W.partitionBy("u").orderBy("v")
    new = F.col("v") != F.coalesce(F.lag("v").over(by), F.col("v") - 1)
    state = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen, tasks = None, None
    while True:
        if tasks:
            state = state.coalesce(tasks)
        both = state.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = both.select("u", "v", F.least("u", F.first("v").over(by)).alias("m"), new.alias("new")).where("new AND v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = large.select("u", "v", F.first("v").over(by).alias("m"), new.alias("new")).where("new")
        # the smallest neighbour keeps the node, the others join the smallest
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        state = checkpoint(small)
        total = (state.coalesce(tasks) if tasks else state).agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (total.n, total.h) == seen:
            break
        seen, tasks = (total.n, total.h), max(1, total.n // EDGES_PER_TASK)
    state = state.distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

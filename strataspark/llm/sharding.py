"""Sharding by a k-d tree with weighted medians.

The tree starts with all documents and the wanted number of shards. At each level every node with more than one shard
is cut along its widest dimension, at the weighted median (the quantile, where its shards are odd in number), which
is found for all nodes at once by counting bytes in ever finer bins of the coordinate: what reaches the driver is a row
for each node and bin, whatever the number of documents. A coordinate is the dimension's value with a hash of the row
below it, so rows of equal value can be cut apart and a shard's bytes come near to the target.

Null texts count as no bytes. Repeated rows fall where their coordinates put them. An empty table gives no rows. Only the
id, text and dimension columns are read."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import documents, numbered

OVERHEAD = 16
BINS = 1024
LOW_BITS = 24
VALUE_BITS = 30


@dataclass
class Node:
    first: int
    shards: int
    dim: int = -1
    low: int = 0
    high: int = 0
    want: float = 0.0
    below: int = 0
    cut: int | None = None


def ordered_code(name: Column) -> Column:
    """A number for a string, in the order of the strings' first six bytes; null for null."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _coordinates(sized: DataFrame, dims: Sequence[str]) -> DataFrame:
    """A row's coordinates as integers: the value on a scale of 30 bits from the least to the largest, then 24 hash bits."""
    ends = sized.agg(*(f(F.col(d).cast("double")).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cols = []
    for i, d in enumerate(dims):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        scaled = F.floor((F.coalesce(F.col(d).cast("double"), F.lit(lo)) - F.lit(lo)) * F.lit(((1 << VALUE_BITS) - 1) / ((hi - lo) or 1.0)))
        cols.append((F.shiftleft(scaled.cast("long"), LOW_BITS) + F.pmod(F.xxhash64("id", "text_crc32", F.lit(i)), F.lit(1 << LOW_BITS))).alias(f"c{i}"))
    return sized.select("*", *cols)


def kd_shards(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", dims: Sequence[str] = ("n_bytes", "text_crc32", "row")) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot). Dimensions may be columns of ``docs`` or n_bytes, text_crc32 and row
    (a number made from the id)."""
    own = [d for d in dims if d not in ("n_bytes", "text_crc32", "row")]
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = (documents(docs, doc_id, text, *own).withColumnsRenamed({doc_id: "id", text: "text"})
             .select("id", *own, (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.octet_length(raw).cast("long").alias("n_bytes"), F.crc32(raw).alias("text_crc32"), F.xxhash64("id").alias("row")))
    rows = checkpointed(_coordinates(checkpointed(sized), dims).select("id", "size", "text_crc32", *(f"c{i}" for i in range(len(dims)))))
    state = rows.withColumn("node", F.lit(0))
    live = [Node(0, shards)] if shards > 1 else []
    while live:
        _level(state, live, len(dims))
        cut = [n for n in live if n.cut is not None]
        if cut:
            table = F.create_map(*(x for n in cut for x in (F.lit(n.first), F.struct(F.lit(n.dim).alias("dim"), F.lit(n.cut).alias("cut"), F.lit(n.shards // 2).alias("jump")))))
            up = F.expr(f"if(array({', '.join(f'c{i}' for i in range(len(dims)))})[t.dim] >= t.cut, t.jump, 0)")
            state = checkpointed(state.withColumn("t", table[F.col("node")]).withColumn("node", F.col("node") + F.coalesce(up, F.lit(0))).drop("t"))
        live = [x for n in live for x in (Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)) if x.shards > 1]
    placed = state.select(F.col("id").alias(doc_id), "size", "text_crc32", F.col("node").alias("shard"))
    return numbered(placed, ["shard"], [F.col(doc_id), F.col("text_crc32")], "slot", F.struct(doc_id, "text_crc32"))


def _level(state: DataFrame, live: list[Node], n_dims: int) -> None:
    """Finds the dimension and the cut of every live node."""
    numbers = [n.first for n in live]
    own = state.where(F.col("node").isin(numbers))
    ends = {r.node: r for r in own.groupBy("node").agg(F.sum("size").alias("size"), *(f(f"c{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
    open_ = []
    for n in live:
        r = ends.get(n.first)
        if r is None:
            continue
        n.dim = max(range(n_dims), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
        n.low, n.high = r[f"lo{n.dim}"], r[f"hi{n.dim}"] + 1
        n.want = r["size"] * (n.shards // 2) / n.shards
        open_.append(n)
    while open_:
        # bins of equal width between a node's ends; the node's cut lies in the bin in which its bytes reach what is wanted
        table = F.create_map(*(x for n in open_ for x in (F.lit(n.first), F.struct(F.lit(n.dim).alias("dim"), F.lit(n.low).alias("low"), F.lit(n.high).alias("high"), F.lit(_step(n)).alias("step")))))
        at = F.array(*(F.col(f"c{i}") for i in range(n_dims)))
        bins = (state.where(F.col("node").isin([n.first for n in open_])).withColumn("t", table[F.col("node")]).withColumn("c", at[F.col("t.dim")])
                .where((F.col("c") >= F.col("t.low")) & (F.col("c") < F.col("t.high"))).groupBy("node", F.expr("cast((c - t.low) div t.step as int)").alias("bin")).agg(F.sum("size").alias("size")).collect())
        sizes: dict[int, np.ndarray] = {n.first: np.zeros(BINS + 1, np.int64) for n in open_}
        for r in bins:
            sizes[r.node][r.bin] = r["size"]
        rest = []
        for n in open_:
            total = n.below + np.cumsum(sizes[n.first])
            k = int(np.searchsorted(total, n.want))
            step = _step(n)
            before = int(total[k - 1]) if k else n.below
            if step == 1 or sizes[n.first][min(k, BINS)] <= 1e-4 * n.want:
                # the edge of the bin that leaves the lower side nearer to what it should have
                n.cut = n.low + (k + (abs(int(total[min(k, BINS)]) - n.want) < abs(before - n.want))) * step
            else:
                n.low, n.high, n.below = n.low + k * step, min(n.high, n.low + (k + 1) * step), before
                rest.append(n)
        open_ = rest


def _step(n: Node) -> int:
    return max(1, -(-(n.high - n.low) // BINS))

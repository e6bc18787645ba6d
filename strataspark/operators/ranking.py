"""Exact order statistics that never put one whole group into one task.

* ``hash_rank``    dense 1..n numbers inside a group in seeded (md5) order
* ``value_rank``   dense 1..n numbers in value order, ties by a seeded order
* ``running_sum``  exact cumulative sums along such a rank
* ``group_percentile`` exact linear-interpolation percentiles

All four split a group into ordered buckets, work inside the buckets and add per-bucket
offsets, so a group that holds a third of all rows still spreads over many tasks.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw_key
from ..session import checkpointed


ROWS_PER_BUCKET = 1_000_000


def _conf(df: DataFrame, name: str, default: int) -> int:
    """Bucket counts of a session: raise them with the data (``spark.strataspark.rankDigits``, ``.rankEdges``)."""
    return int(df.sparkSession.conf.get(f"spark.strataspark.{name}", str(default)))


def _offsets(df: DataFrame, by: list[str], bucket: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): totals of all earlier buckets of the group (one small row per bucket)."""
    per = df.groupBy(*by, *bucket).agg(*[e.alias(f"__s_{n}") for n, e in sums.items()])
    w = Window.partitionBy(*by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, *bucket, *[F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)).alias(f"__o_{n}") for n in sums])


def _rank_in_buckets(df: DataFrame, by: list[str], bucket: list[str], order: list, out: str, sums: dict[str, str]) -> DataFrame:
    off = _offsets(df, by, bucket, {"n": F.count(F.lit(1)), **{n: F.sum(c) for n, c in sums.items()}})
    w = Window.partitionBy(*by, *bucket).orderBy(*order)
    d = df.withColumn("__rn", F.row_number().over(w))
    for n, c in sums.items():
        d = d.withColumn(n, F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(off, [*by, *bucket]).withColumn(out, (F.col("__rn") + F.col("__o_n")).cast("long"))
    for n in sums:
        d = d.withColumn(n, F.col(n) + F.col(f"__o_{n}"))
    return d.drop("__rn", "__o_n", *[f"__o_{n}" for n in sums], *bucket)


def hash_rank(df: DataFrame, by: list[str], seed, keys: list[str], out: str = "rank", digits: int | None = None) -> DataFrame:
    """1..n inside each group of ``by`` in the order of md5(seed|keys); buckets are hash prefixes of ``digits`` hex digits."""
    digits = digits or _conf(df, "rankDigits", 2)
    d = df.withColumn("__h", draw_key(seed, *keys)).withColumn("__b", F.substring("__h", 1, digits))
    return _rank_in_buckets(d, by, ["__b"], ["__h", *keys], out, {}).drop("__h")


def top_n_by_hash(df: DataFrame, by: list[str], seed, keys: list[str], n: int, digits: int | None = None) -> DataFrame:
    """First ``n`` rows per group in seeded order, without numbering the rest: first per hash
    bucket, then per group (exact: a row of the answer is among the first n of its bucket)."""
    digits = digits or _conf(df, "rankDigits", 2)
    d = df.withColumn("__h", draw_key(seed, *keys)).withColumn("__b", F.substring("__h", 1, digits))
    inner = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *keys))
    d = d.withColumn("__rn", inner).where(F.col("__rn") <= n)
    outer = F.row_number().over(Window.partitionBy(*by).orderBy("__h", *keys))
    return d.withColumn("__rn", outer).where(F.col("__rn") <= n).drop("__h", "__b", "__rn")


def sort_key(value: Column, descending: bool = True, missing_last: bool = True) -> Column:
    """Ascending sort key of a score: negated when the largest comes first, NULL and NaN last."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    return F.when(ok, (-v if descending else v) + F.lit(0.0)).otherwise(F.lit(float("inf" if missing_last else "-inf")))


def value_rank(df: DataFrame, by: list[str], value, seed, keys: list[str], out: str = "rank",
               descending: bool = True, sums: dict[str, str] | None = None, n_edges: int | None = None) -> DataFrame:
    """1..n inside each group of ``by`` in the order of ``value`` (ties in seeded order of ``keys``);
    ``sums`` adds, per ``new: col``, the sum of ``col`` over all rows up to and including this one.

    The input is read three times (edges, bucket totals, ordering), so it is stored once first.
    Buckets are value ranges whose edges are approximate quantiles of all rows: any edges give exact ranks, and these
    are partial aggregates. They are read once (at most 4095 numbers), so later tasks all see the same ones. The number of
    ranges follows the row count, unless the session or the caller sets it. A value that is itself an edge is a bucket
    of its own, split further by hash prefix, so a score shared by very many rows spreads as well."""
    d = (df.withColumn("__k", sort_key(F.col(value) if isinstance(value, str) else value, descending))
           .withColumn("__h", draw_key(seed, *keys)))
    d = checkpointed(d)
    n = d.count()
    n_edges = n_edges or _conf(df, "rankEdges", min(4095, max(255, n // ROWS_PER_BUCKET)))
    digits = max(_conf(df, "rankDigits", 2), math.ceil(math.log(max(n / ROWS_PER_BUCKET, 1), 16)))
    probs = [(i + 1) / (n_edges + 1) for i in range(n_edges)]
    found = d.where(~F.col("__k").isin(float("inf"), float("-inf"))).agg(F.percentile_approx("__k", probs, 10 * (n_edges + 1)).alias("e")).first().e
    found = sorted(set(found or []))
    edges = F.array(*[F.lit(float(e)) for e in found]).cast("array<double>")
    # edges below the key, by bisection
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(max(len(found), 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, j: F.when((at + j <= len(found)) & (F.get(edges, at + j - 1) < F.col("__k")), at + j).otherwise(at))
    d = (d.withColumn("__p", below)
          .withColumn("__q", F.coalesce(F.get(edges, F.col("__p")) == F.col("__k"), F.lit(False)) | F.col("__k").isin(float("inf"), float("-inf")))
          .withColumn("__s", F.when(F.col("__q"), F.substring("__h", 1, digits)).otherwise(F.lit(""))))
    return _rank_in_buckets(d, by, ["__p", "__q", "__s"], ["__k", "__h", *keys], out, sums or {}).drop("__k", "__h")


def running_sum(df: DataFrame, by: list[str], rank: str, sums: dict[str, str], block: int = 1 << 20) -> DataFrame:
    """Adds, per ``new: col``, the sum of ``col`` over all rows of the group up to and including ``rank``."""
    d = df.withColumn("__blk", F.floor(F.col(rank) / F.lit(block)).cast("long"))
    off = _offsets(d, by, ["__blk"], {n: F.sum(c) for n, c in sums.items()})
    w = Window.partitionBy(*by, "__blk").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        d = d.withColumn(n, F.sum(c).over(w))
    d = d.join(off, [*by, "__blk"])
    for n in sums:
        d = d.withColumn(n, F.col(n) + F.col(f"__o_{n}"))
    return d.drop("__blk", *[f"__o_{n}" for n in sums])


CELLS = 4096            # different values of a bracket that are put in order at once
BINS = 1024
SHORT = 200             # rows of a group that needs no bracket
SIDE = 0.02
BROADCAST_ROWS = 100_000


def _below(pairs: Column, k: Column) -> Column:
    """Of an ordered array of (v, c): the index of the entry that holds position ``k``, and the count before it."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["done"] | (acc["before"] + x["c"] > k)
        return F.struct(F.when(done, acc["before"]).otherwise(acc["before"] + x["c"]).alias("before"), F.when(done, acc["at"]).otherwise(acc["at"] + 1).alias("at"), done.alias("done"))
    return F.aggregate(pairs, start, step)


def _refined(cells: DataFrame, state: DataFrame, keys: list[str], log: bool) -> tuple[DataFrame, DataFrame]:
    """One round: a histogram of every bracket, and the cells and state of the bin in which its position lies."""
    scale = (lambda v: F.signum(v) * F.log1p(F.abs(v))) if log else (lambda v: v)
    ends = cells.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    width = scale(F.col("__hi")) - scale(F.col("__lo"))
    # the ends always fall in different bins: infinite or vanishing widths leave only the largest value for the last one
    spread = F.floor((scale(F.col("v")) - scale(F.col("__lo"))) / width * (BINS - 1))
    ok = (width > 0) & (width < float("inf"))
    at = F.when(F.col("v") == F.col("__hi"), BINS - 1).when(F.col("v") == F.col("__lo"), 0).when(ok, F.least(F.greatest(spread, F.lit(0)), F.lit(BINS - 2))).otherwise(1)
    binned = checkpointed(cells.join(ends, keys).withColumn("bin", at.cast("int")).drop("__lo", "__hi"))
    counts = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("c"), F.min("v").alias("low"))
    hist = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "low"))).alias("hist"))          # at most BINS entries
    found = state.join(hist, keys).withColumn("f", _below(F.col("hist"), F.col("k"))).withColumn("__n", F.col("f.at") + 1)
    nxt = F.when(F.col("__n") < F.size("hist"), F.get(F.col("hist"), F.col("__n"))["low"]).otherwise(F.col("above"))
    found = checkpointed(found.select(*keys, (F.col("k") - F.col("f.before")).alias("k"), "t", nxt.alias("above"), F.get(F.col("hist"), F.col("f.at"))["bin"].alias("bin")))
    kept = binned.join(found.select(*keys, "bin"), [*keys, "bin"]).drop("bin")
    return checkpointed(kept), found.drop("bin")


def group_percentile(df: DataFrame, by: list[str], value, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Exact percentiles (linear interpolation) per group: one column per entry of ``probs``.

    Pass 1 brackets every wanted position with ``percentile_approx`` (rank error <= n/accuracy); pass 2 counts what lies
    below each bracket and keeps the different values inside it with their counts. Brackets of more than ``CELLS``
    values are refined, all at once, by histograms in which only the bin of the position is kept: no group is ordered in
    a task, whatever its size. A position outside its bracket fails the job."""
    v = F.col(value) if isinstance(value, str) else value
    names = list(probs)
    m = len(names)
    by_ = by or ["__all"]
    keys = [*by_, "__p"]
    x = (df if by else df.withColumn("__all", F.lit(1))).select(*by_, (v.cast("double") + F.lit(0.0)).alias("v"))
    x = x.where(F.col("v").isNotNull() & ~F.isnan("v"))
    # the bracket is narrow in long groups, wider in shorter ones, and the whole of a short one
    edges = [f(p, s) for s in (3.0 / accuracy, SIDE) for f in (lambda p, s: max(p - s, 0.0), lambda p, s: min(p + s, 1.0)) for p in probs.values()]
    br = checkpointed(x.groupBy(*by_).agg(F.percentile_approx("v", edges, accuracy).alias("__q"), F.count(F.lit(1)).alias("__n")))
    at = F.when(F.col("__n") > 10 * accuracy, 0).otherwise(2 * m)
    whole = F.col("__n") <= SHORT
    few = br.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    d = x.join(F.broadcast(br) if few else br, by_)
    side = lambda i: F.when(whole, 1).when(F.col("v") < F.get(F.col("__q"), at + i), 0).when(F.col("v") <= F.get(F.col("__q"), at + m + i), 1).otherwise(2)
    # one row per value inside a bracket, and one per bracket for what lies below and above
    d = d.select(*by_, "v", F.posexplode(F.array(*[side(i) for i in range(m)])).alias("__p", "__side"))
    cells = d.groupBy(*keys, "__side", F.when(F.col("__side") == 1, F.col("v")).alias("__in")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
    cells = checkpointed(cells.drop("__in"))
    outside = cells.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__side") == 0, F.col("c"))), F.lit(0)).alias("below"), F.min(F.when(F.col("__side") == 2, F.col("v"))).alias("above"))
    h = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("__p") + 1)
    state = br.select(*by_, "__n").join(outside, by_).select(*keys, (F.floor(h) - F.col("below")).alias("k"), (h - F.floor(h)).alias("t"), "above")
    cells = cells.where("__side = 1").drop("__side")
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    log = False
    while (sizes.agg(F.max("n")).first()[0] or 0) > CELLS:
        cells, state = _refined(cells, state, keys, log)
        sizes, log = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), not log
    lists = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("cells"))                  # at most CELLS entries
    got = state.join(lists, keys).withColumn("f", _below(F.col("cells"), F.col("k")))
    here = F.get(F.col("cells"), F.col("f.at"))
    last = F.col("k") + 1 >= F.col("f.before") + here["c"]          # the next position holds the next value
    nxt = F.when(~last, here["v"]).when(F.col("f.at") + 1 < F.size("cells"), F.get(F.col("cells"), F.col("f.at") + 1)["v"]).otherwise(F.col("above"))
    a = F.when((F.col("k") >= 0) & here.isNotNull(), here["v"]).otherwise(F.raise_error(F.lit("percentile position outside its bracket")).cast("double"))
    val = F.when(F.col("t") == 0, a).otherwise(a + (nxt - a) * F.col("t"))
    out = got.select(*by_, "__p", val.alias("val")).groupBy(*by_).agg(*[F.max(F.when(F.col("__p") == i, F.col("val"))).alias(n) for i, n in enumerate(names)])
    return out.select(*by, *names)


def top_k_by_count(df: DataFrame, value: str, position: str, k: int) -> DataFrame:
    """Most frequent values; the first seen (smallest position) wins ties. Feature: a top-k report."""
    return (df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos"))
              .orderBy(F.desc("n"), "first_pos").limit(k))


def weighted_quantile(df: DataFrame, by: list[str], rank: str, value: str, weight: str, prob: float = 0.5,
                      out: str = "q", block: int = 1 << 20) -> DataFrame:
    """Percentile of ``value`` when every row counts ``weight`` times (bootstrap multiplicities).

    ``rank`` numbers the rows in ascending value order once; only the weights differ between draws,
    so each draw needs a cumulative sum along the fixed order and no sort of its own."""
    d = running_sum(df.where(F.col(weight) > 0), by, rank, {"__hi": weight}, block)
    tot = df.groupBy(*by).agg(F.sum(weight).alias("__n"))
    d = d.join(tot, by)
    h = (F.col("__n") - 1) * F.lit(float(prob))
    at = lambda k: (F.col("__hi") - F.col(weight) <= k) & (k < F.col("__hi"))
    g = d.groupBy(*by).agg(F.max(F.when(at(F.floor(h)), F.col(value))).alias("__a"),
                           F.max(F.when(at(F.ceil(h)), F.col(value))).alias("__b"), F.max(h - F.floor(h)).alias("__t"))
    return g.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__t")).alias(out))

"""Bootstrap multiplicities, permutation nulls, intervals and decision rules.

A draw is never materialised as rows: it is a table (draw, unit, w). Draw 0, where present, is the data."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import _head, draw_key, place_counts, places, poisson1, slot, uniform, uniforms
from ..session import checkpointed, ship_code
from .ranking import hash_rank, value_rank, weighted_quantile
from .selection import weighted_selective_accuracy


def _explode(df: DataFrame, name: str, n: int, first: int = 1) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(n))))


# ---- multiplicities
def group_draws(rows: DataFrame, group: str, n_boot: int, seed) -> DataFrame:
    """(draw, gslot, group): as many groups as there are, drawn with replacement. Groups are donors: a short table."""
    g = hash_rank(rows.select(group).distinct(), [], f"{seed}g", [group], out="g_no")
    n = rows.agg(F.count_distinct(group).alias("n")).scalar()
    s = _explode(g.select(F.col("g_no").alias("gslot")), "draw", n_boot).withColumn("g_no", slot(n, seed, F.lit("g"), "draw", "gslot"))
    return s.join(g, "g_no").select("draw", "gslot", group)


CHUNK = 1 << 17        # groups of more rows are numbered in hash buckets
BUCKET = 32            # rows that share the last split
BALLS = 100_000        # draws that a task makes at a time
STRETCH = 1 << 23      # balls of a draw that are counted together before they are sent to the blocks of rows
TASK = 1 << 22         # balls that a task throws, about
TASKS = 960            # tasks that throw them, at most
BLOCK = 512            # buckets of a block of rows


def _numbered(rows: DataFrame, g: list[str], most: int, seed) -> DataFrame:
    """``rows`` with their number in their group (r_no), whose largest has ``most`` rows."""
    if most > CHUNK:
        return hash_rank(rows, g, f"{seed}r", ["unit_id"], out="r_no")
    return rows.withColumn("r_no", F.row_number().over(Window.partitionBy(*g).orderBy(draw_key(f"{seed}r", "unit_id"), "unit_id")).cast("long"))


def _thrown(rows: DataFrame, inner: list[str], totals: DataFrame, seed) -> tuple[DataFrame, DataFrame, list[str]]:
    """Counts (draw, group, bucket, w: one count for each row of the bucket), the rows of every bucket (group, bucket, held)
    and the columns of a group: see ``multiplicities``."""
    g = inner or ["__g"]
    base = rows.select("unit_id", *inner)
    if not inner:
        base, totals = base.withColumn("__g", F.lit(0)), totals.withColumn("__g", F.lit(0))
    base = checkpointed(base)
    t = totals.join(base.groupBy(*g).agg(F.count(F.lit(1)).alias("n_in")), g).select("draw", *g, "n_in", (F.col("copies") * F.col("n_in")).alias("balls"))
    whole = t.agg(F.sum("balls"), F.max("n_in")).first()
    parts = max(1, -(-(whole[0] or 0) // BALLS))
    numbered = _numbered(base, g, whole[1] or 0, seed)
    numbered = checkpointed(numbered) if (whole[1] or 0) > CHUNK else numbered
    ship_code(rows.sparkSession)
    stretch = t.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("balls"), F.lit(BALLS).cast("long")))).repartition(parts)
    at = places(_head(seed, F.lit("b"), "draw", *inner, F.lit(0)), F.col("from"), F.least(F.col("from") + (BALLS - 1), F.col("balls")), F.col("n_in"))
    thrown = stretch.select("draw", *g, "n_in", F.explode(at).alias("at"))
    second = thrown.groupBy("draw", *g, "n_in", F.floor(F.col("at") / BUCKET).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("balls"))
    size = F.least(F.lit(BUCKET), F.col("n_in") - F.col("bucket") * BUCKET)
    counts = second.select("draw", *g, "bucket", place_counts(_head(seed, F.lit("r"), "draw", *inner, "bucket"), F.col("balls"), size).alias("w"))
    held = numbered.groupBy(*g, F.floor((F.col("r_no") - 1) / BUCKET).cast("long").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("r_no", "unit_id"))).alias("held"))     # at most BUCKET rows
    return counts, held, g


def multiplicities(rows: DataFrame, inner: list[str], totals: DataFrame, seed) -> DataFrame:
    """(draw, inner, unit_id, w): for each (draw, inner, copies) of ``totals``, copies times as many balls as the group has
    rows, thrown into its rows.

    A seeded multinomial tree: the balls of a draw are split over buckets of ``BUCKET`` rows, then inside a bucket. They are
    thrown a stretch at a time, so that one group's balls spread over many tasks, and counted before the shuffle; a bucket's
    rows are one short array: what is shuffled and joined are counts of buckets. The size of a group decides how its rows
    are numbered, never what is drawn."""
    counts, held, g = _thrown(rows, inner, totals, seed)
    d = counts.join(held, [*g, "bucket"]).withColumn("ids", F.col("held")["unit_id"])
    return d.select("draw", *inner, F.inline(F.arrays_zip("ids", "w"))).where("w > 0").withColumnRenamed("ids", "unit_id").select("draw", *inner, "unit_id", "w")


def row_weights(rows: DataFrame, n_boot: int, seed, group: dict[str, Column]) -> DataFrame:
    """(unit_id, ws): the counts of a row in draws 1 to ``n_boot``, the same as in ``bootstrap_rows``, as one array: a row for
    each unit, not for each unit and draw. All rows are one group, named by the columns of ``group``."""
    named = rows.select("unit_id", *[c.alias(k) for k, c in group.items()])
    totals = rows.sparkSession.range(1).select(*[c.alias(k) for k, c in group.items()], F.lit(1).cast("long").alias("copies"))
    counts, held, g = _thrown(named, list(group), _explode(totals, "draw", n_boot), seed)
    of = counts.groupBy(*g, "bucket").agg(F.map_from_entries(F.collect_list(F.struct("draw", "w"))).alias("of"))             # at most n_boot entries
    in_draws = lambda i: F.transform(F.sequence(F.lit(1), F.lit(n_boot)), lambda k: F.coalesce(F.get(F.try_element_at("of", k), i), F.lit(0).cast("long")))
    return held.join(of, [*g, "bucket"]).select(F.inline(F.transform("held", lambda x, i: F.struct(x["unit_id"].alias("unit_id"), in_draws(i).alias("ws")))))


class RowDraws:
    """The draws of ``multiplicities`` for statistics that go over all rows once for all draws, and draw 0, the data: a row
    stays one row with what it carries, in a block of ``block`` buckets of its group.

    The first split of a draw is sent to the blocks, one small number for each bucket; the second one is thrown where the
    rows lie and goes no further. So nothing of the length of rows x draws is shuffled or stored. rows: unit_id (one row
    for each unit), ``inner`` and more, read twice; totals: draw, inner, copies."""

    def __init__(self, rows: DataFrame, inner: list[str], totals: DataFrame, seed, block: int | None = None):
        self.g, self.block = inner, block or BLOCK
        size = BUCKET * self.block
        sizes = checkpointed(rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("n_in")))
        t = checkpointed(totals.join(sizes, inner).select("draw", *inner, "n_in", (F.col("copies") * F.col("n_in")).alias("balls")))
        whole = t.agg(F.sum("balls"), F.max("n_in")).first()
        most = sizes.agg(F.max("n_in")).first()[0] or 0
        ship_code(rows.sparkSession)
        at = F.floor((F.col("r_no") - 1) / size).cast("long")
        self.rows = _numbered(rows, inner, most, seed).withColumn("block", at)
        parts = min(TASKS, max(1, -(-(whole[0] or 0) // TASK)))
        stretch = t.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("balls"), F.lit(STRETCH).cast("long")))).withColumn("tail", _tail(*inner, F.lit(0)))
        types = {f.name: f.dataType.simpleString() for f in t.schema}
        ddl = ", ".join(f"`{c}` {types[c]}" for c in ("draw", *inner)) + ", block bigint, thrown binary"
        sent = stretch.repartition(parts).mapInArrow(_first_split(f"{seed}|b|", inner, self.block, STRETCH), ddl)
        data = sizes.select(F.lit(0).cast(types["draw"]).alias("draw"), *inner, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_in") - 1) / size).cast("long"))).alias("block"), F.lit(None).cast("binary").alias("thrown"))
        self.sent = sent.unionByName(data).withColumn("tail", _tail(*inner))
        self.head = f"{seed}|r|"

    def over(self, run: Callable, schema: str, rows: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
        """run(rows of a block in the order of their numbers, draws, what was sent to it) -> table, for every block;
        ``draws(only)`` gives the counts of its rows in each draw, see ``drawn``."""
        key, block, head = [*self.g, "block"], self.block, self.head
        sent = self.sent if sent is None else sent
        fresh = sent.select(*[F.col(c).alias(c) for c in sent.columns])
        ordered = lambda v, c: run(v.sort_by("r_no"), lambda only=None: drawn(c, head, len(v), block, v["block"][0].as_py() if len(v) else 0, only), c)
        return (self.rows if rows is None else rows).groupBy(*key).cogroup(fresh.groupBy(*key)).applyInArrow(ordered, schema)


def _tail(*parts) -> Column:
    """The text of a draw's key between the draw and its last part: see ``_head``."""
    return F.concat(F.lit("|"), F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit("")))


def _groups(sizes: list[int], most: int) -> Iterator[range]:
    """Neighbours whose sizes add up to about ``most``."""
    a, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield range(a, k + 1)
            a, total = k + 1, 0
    if a < len(sizes):
        yield range(a, len(sizes))


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _first_split(head: str, g: list[str], block: int, stretch: int) -> Callable:
    """How many balls of a stretch fall into each bucket: for each block of buckets one text of numbers. Short stretches are
    thrown together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draw, first, balls, size = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("draw", "first", "balls", "n_in"))
            last, tails = np.minimum(first + stretch - 1, balls), b.column("tail").to_pylist()
            alikes = {}
            for k, key in enumerate(zip(tails, size.tolist())):
                alikes.setdefault(key, []).append(k)
            for (tail, n), alike in alikes.items():
                alike = np.array(alike)
                width = -(-n // (BUCKET * block)) * block
                for part in _groups((last - first + 1)[alike].tolist(), 1 << 18):
                    ks = alike[part]
                    count = np.zeros(len(ks) * width, np.int32)
                    for at in range(0, int((last - first)[ks].max()) + 1, 1 << 18):
                        here = np.clip(last[ks] - first[ks] + 1 - at, 0, 1 << 18)
                        own = np.repeat(np.arange(len(ks)), here)
                        u = uniforms(head, draw[ks][own], tail, first[ks][own] + at + _counted(here))
                        count += np.bincount(own * width + np.floor(u * n).astype(np.int64) // BUCKET, minlength=len(count)).astype(np.int32)
                    count = count.reshape(-1, block)
                    hit = np.flatnonzero(count.any(1))
                    short = count.max(initial=0) < 256
                    own = pa.array(ks[hit // (width // block)])
                    texts = [x.astype(np.uint8 if short else np.uint32).tobytes() for x in count[hit]]
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(own) for c in ("draw", *g)], pa.array((hit % (width // block)).astype(np.int64)), pa.array(texts, pa.binary())], names=["draw", *g, "block", "thrown"])
    return run


def drawn(sent: pa.Table, head: str, rows: int, block: int, number: int, only: Callable | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(draw, counts of the ``rows`` rows of a block) for each draw that was sent to block ``number``; with ``only(draw)``,
    rows by their place in the block, the counts of the rows that share a bucket with these."""
    if not len(sent) or not rows:
        return
    sent = sent.select(["draw", "tail", "thrown"]).sort_by("draw")
    draws, tail, texts = sent["draw"].to_numpy().astype(np.int64), sent["tail"][0].as_py(), sent["thrown"].to_pylist()
    buckets = np.arange(block)
    size = np.minimum(BUCKET, rows - BUCKET * buckets)
    starts = np.flatnonzero(np.append(True, draws[1:] != draws[:-1]))
    spans = list(zip(starts.tolist(), np.append(starts[1:], len(draws)).tolist()))
    if texts[0] is None:                                    # the data
        yield int(draws[0]), np.ones(rows, np.int64)
        spans = spans[1:]
    together = max(1, (1 << 16) // rows)                    # short blocks throw several draws at once
    for a in range(0, len(spans), together):
        some = spans[a:a + together]
        count = np.array([sum(np.frombuffer(x, np.uint8 if len(x) == block else np.uint32).astype(np.int64) for x in texts[f:z]) for f, z in some])
        if only is not None:
            for k, (f, _) in enumerate(some):
                asked = np.zeros(block, bool)
                asked[only(int(draws[f])) // BUCKET] = True
                count[k, ~asked] = 0
        balls = count.ravel()
        own = np.repeat(np.arange(len(balls)), balls)
        bucket = own % block
        w = np.zeros(len(some) * block * BUCKET, np.int64)
        if len(own):
            u = uniforms(head, draws[[f for f, _ in some]][own // block], tail, bucket + number * block, "|", _counted(balls) + 1)
            w = np.bincount(own * BUCKET + np.floor(u * size[bucket]).astype(np.int64), minlength=len(w))
        for (f, _), x in zip(some, w.reshape(len(some), -1)):
            yield int(draws[f]), x[:rows]


def bootstrap_two_stage(rows: DataFrame, group: str, n_boot: int, seed, strata: list[str] | None = None, scheme: str = "multinomial") -> DataFrame:
    """(draw, unit_id, w): groups with replacement, then rows with replacement inside every drawn group (and stratum).

    scheme 'multinomial' draws exactly as many rows as a group has, for each time it is drawn, by a tree of counts.
    scheme 'poisson' gives every row of a drawn group a Poisson(1) count instead: one narrow pass, for very many rows; a
    different scheme, named in the output."""
    inner = [group, *(strata or [])]
    drawn = group_draws(rows, group, n_boot, seed)
    if scheme == "poisson":
        d = rows.select("unit_id", group).join(drawn, group)
        w = poisson1(uniform(seed, F.lit("p"), "draw", "gslot", "unit_id"))
        return d.groupBy("draw", "unit_id").agg(F.sum(w).cast("long").alias("w")).where("w > 0").withColumn("scheme", F.lit("poisson"))
    copies = drawn.groupBy("draw", group).agg(F.count(F.lit(1)).alias("copies"))
    if strata:
        copies = rows.select(*inner).distinct().join(copies, group)
    return multiplicities(rows, inner, copies, seed).select("draw", "unit_id", "w").withColumn("scheme", F.lit("multinomial"))


def bootstrap_rows(rows: DataFrame, by: list[str], n_boot: int, seed) -> DataFrame:
    """One-stage draw inside every group of ``by``: (by, draw, unit_id, w)."""
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    copies = _explode(groups, "draw", n_boot).withColumn("copies", F.lit(1).cast("long"))
    return multiplicities(rows, by, copies, seed).select(*by, "draw", "unit_id", "w")


def with_point(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds draw 0, the data: every unit once."""
    cols = [c for c in draws.columns if c not in ("draw", "w", "scheme")]
    d0 = rows.select(*cols).withColumn("draw", F.lit(0)).withColumn("w", F.lit(1).cast("long"))
    return draws.select(*cols, F.col("draw").cast("int"), F.col("w").cast("long")).unionByName(d0)


def bootstrap_cluster(rows: DataFrame, treated: str, cluster: str, n_boot: int, seed) -> DataFrame:
    """(draw, a, element, w): treated clusters resampled whole, control rows one by one. An element is a cluster label
    or 'unit:<id>'; statistics that are sums join per-element sums, so treated rows are never copied."""
    t = rows.where(F.col(treated) == 1).select(F.col(cluster).cast("string").alias("unit_id"), F.lit(1).alias("a")).distinct()
    c = rows.where(F.col(treated) == 0).select(F.concat(F.lit("unit:"), F.col("unit_id").cast("string")).alias("unit_id"), F.lit(0).alias("a"))
    return bootstrap_rows(t.unionByName(c), ["a"], n_boot, seed).withColumnRenamed("unit_id", "element")


def element_sums(rows: DataFrame, treated: str, cluster: str, sums: dict[str, Column], extra: list[str] = []) -> DataFrame:
    el = F.when(F.col(treated) == 1, F.col(cluster).cast("string")).otherwise(F.concat(F.lit("unit:"), F.col("unit_id").cast("string")))
    return rows.groupBy(*extra, F.col(treated).alias("a"), el.alias("element")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def drawn_sums(sums: DataFrame, draws: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Weighted totals per draw (draw 0 = the data) of per-element sums."""
    d = sums.join(draws, ["a", "element"]).groupBy(*by, "draw").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
    p = sums.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names]).withColumn("draw", F.lit(0))
    return p.unionByName(d)


# ---- statistics over draws
def drawn_medians(values: DataFrame, draws: DataFrame, by: list[str], value: str, key: str = "unit_id", out: str = "median") -> DataFrame:
    """Median of ``value`` per (by, draw); a unit carries all its rows. Values are ranked once for all draws."""
    d = values.select(*by, key, value).withColumn("__id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, key, value]])))
    r = value_rank(d, by, value, 0, ["__id", key], out="__rank", descending=False)
    return weighted_quantile(r.join(draws, key), [*by, "draw"], "__rank", value, "w", 0.5, out)


def bootstrap_cases(cases: DataFrame, draws: DataFrame, layer: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Medians per (layer, draw) of rows resampled with all their cases, and the share of replicates in which each
    layer is the smallest."""
    m = checkpointed(drawn_medians(cases, draws, [layer], value))
    low = m.where("draw > 0").groupBy("draw").agg(F.min_by(layer, F.struct(F.round("median", 9), layer)).alias(layer))
    share = low.groupBy(layer).agg(F.count(F.lit(1)).alias("k")).withColumn("share_lowest", F.col("k") / F.sum("k").over(Window.partitionBy()))
    return m, share


def median_difference(rows: DataFrame, draws: DataFrame, stratum: str, a: str, b: str, value: str) -> DataFrame:
    """Median of stratum a minus median of stratum b per draw, from the same draws."""
    m = drawn_medians(rows.where(F.col(stratum).isin(a, b)), draws, [stratum], value)
    g = m.groupBy("draw").agg(F.max(F.when(F.col(stratum) == a, F.col("median"))).alias("x"), F.max(F.when(F.col(stratum) == b, F.col("median"))).alias("y"))
    return g.select("draw", (F.col("x") - F.col("y")).alias("value"))


BINS = 255             # value ranges of a stratum, at least, in which the medians of all draws are looked for


def median_difference_by_row(rows: DataFrame, group: str, n_boot: int, seed, stratum: str, a: str, b: str, value: str) -> DataFrame:
    """``median_difference`` of two-stage draws and of the data (draw 0), for very many draws: see ``drawn_medians_by_row``. rows:
    unit_id (one row for each unit), group, stratum, value."""
    code = F.when(F.col(stratum) == a, 0).when(F.col(stratum) == b, 1)
    m = drawn_medians_by_row(rows.select("unit_id", group, F.array(F.struct(code.alias("code"), F.col(value).cast("double").alias("v"))).alias("values")), group, n_boot, seed, 2)
    of = lambda c: F.max(F.when(F.col("code") == c, F.col("median")))
    return m.groupBy("draw").agg((of(0) - of(1)).alias("value"))


def drawn_medians_by_row(rows: DataFrame, group: str, n_boot: int, seed, codes: int) -> DataFrame:
    """(draw, code, median) of two-stage draws and of the data (draw 0). rows: unit_id (one row for each unit), group, values
    (array of code from 0 to ``codes`` - 1, v; without either a value has no part in it).

    A unit stays one row (``RowDraws``). The counts of a draw are summed over ranges of values; then only values in the range
    that holds a draw's median are counted once more, value by value."""
    rows = checkpointed(rows.select("unit_id", group, F.filter("values", lambda x: x["code"].isNotNull() & x["v"].isNotNull()).alias("values")))
    copies = group_draws(rows, group, n_boot, seed).groupBy("draw", group).agg(F.count(F.lit(1)).alias("copies"))
    d = RowDraws(rows, [group], copies, seed, block=4 * BLOCK)
    numbered, sent = checkpointed(d.rows), checkpointed(d.sent)
    k = min(4 * BINS, max(BINS, rows.count() >> 16))
    probs = [(j + 1) / (k + 1) for j in range(k)]
    found = {r.code: sorted(set(r.e)) for r in rows.select(F.inline("values")).groupBy("code").agg(F.percentile_approx("v", probs, 10 * (k + 1)).alias("e")).collect()}
    edges = [np.array(found.get(c, []), float) for c in range(codes)]

    def ranges(v: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of all values in the order of range and value, their ranges, the values."""
        held = v["values"].combine_chunks()
        own = np.repeat(np.arange(len(v)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
        c, x = (held.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("code", "v"))
        at = np.zeros(len(c), int)
        for s in range(codes):
            at[c == s] = s * (k + 1) + np.searchsorted(edges[s], x[c == s])
        order = np.lexsort((x, at))
        return own[order], at[order], x[order]

    def histogram(v: pa.Table, each: Callable, _: pa.Table) -> pa.Table:
        order, at, _ = ranges(v)
        out = [(draw, np.bincount(at, w[order], codes * (k + 1)).astype(np.int64).tobytes()) for draw, w in each()]
        return pa.table({"draw": pa.array([o[0] for o in out], pa.int32()), "h": pa.array([o[1] for o in out], pa.binary())})

    def locate(t: pa.Table) -> pa.Table:
        h = sum(np.frombuffer(x, np.int64) for x in t["h"].to_pylist()).reshape(codes, -1)
        out = []
        for s in range(codes):
            held = np.cumsum(h[s])
            if held[-1]:
                middle = (int(held[-1]) - 1) / 2
                at = [(p, int(np.searchsorted(held, p, side="right"))) for p in (int(middle), -int(-middle // 1))]
                out.append((t["draw"][0].as_py(), s, middle % 1, *[z for p, r in at for z in (s * (k + 1) + r, p - int(held[r] - h[s][r]))]))
        names = ["draw", "code", "t", "at_a", "k_a", "at_b", "k_b"]
        return pa.table({c: pa.array([o[j] for o in out], pa.float64() if c == "t" else pa.int64() if c[0] == "k" else pa.int32()) for j, c in enumerate(names)})

    where = d.over(histogram, "draw int, h binary", numbered, sent).groupBy("draw").applyInArrow(locate, "draw int, code int, t double, at_a int, k_a long, at_b int, k_b long")
    where = checkpointed(where)
    asked = where.groupBy("draw").agg(F.array_distinct(F.flatten(F.collect_list(F.array("at_a", "at_b")))).alias("ranges"))     # at most two for each code

    def pick(v: pa.Table, each: Callable, c: pa.Table) -> pa.Table:
        order, at, x = ranges(v)
        of = dict(zip(c["draw"].to_pylist(), c["ranges"].to_pylist()))
        span = {r: slice(*np.searchsorted(at, [r, r + 1])) for r in {r for rs in of.values() for r in rs}}
        first = {r: np.flatnonzero(np.append(True, x[s][1:] != x[s][:-1])) for r, s in span.items() if s.stop > s.start}       # equal values are one row
        out = []
        for draw, w in each(lambda draw: np.concatenate([order[span[r]] for r in of[draw]])):
            for r in of[draw]:
                if r in first:
                    held = np.add.reduceat(w[order[span[r]]], first[r])
                    hit = held > 0
                    out.append((np.full(hit.sum(), draw), np.full(hit.sum(), r), x[span[r]][first[r]][hit], held[hit]))
        cols = [np.concatenate(z) for z in zip(*out)] if out else [[]] * 4
        return pa.table({n: pa.array(z, t) for n, z, t in zip(("draw", "at", "v", "w"), cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))})

    near = d.over(pick, "draw int, at int, v double, w long", numbered, sent.join(asked, "draw"))
    near = near.groupBy("draw", "at", "v").agg(F.sum("w").alias("w"))
    near = near.withColumn("upto", F.sum("w").over(Window.partitionBy("draw", "at").orderBy("v")))             # a range of the values
    m = where.join(near, "draw").groupBy("draw", "code", "t").agg(*[F.min(F.when((F.col("at") == F.col(f"at_{z}")) & (F.col("upto") > F.col(f"k_{z}")), F.col("v"))).alias(z) for z in ("a", "b")])
    return m.select("draw", "code", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("median"))


def mode_fraction(tops: DataFrame, draws: DataFrame, top: str) -> DataFrame:
    """Most frequent value and its share per draw (the one seen first in the data wins ties)."""
    pos = tops.groupBy(top).agg(F.min("unit_id").alias("__p"))
    c = tops.join(draws, "unit_id").groupBy("draw", top).agg(F.sum("w").alias("k")).join(pos, top)
    g = c.groupBy("draw").agg(F.max_by(top, F.struct("k", -F.col("__p"))).alias("mode"), F.max("k").alias("k"), F.sum("k").alias("n"))
    return g.select("draw", "mode", (F.col("k") / F.col("n")).alias("value"))


def percentile_ci(stats: DataFrame, by: list[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Point (draw 0), percentile interval over the finite replicates, how many were undefined. One row per draw."""
    v = F.col(value)
    fin = F.when((F.col("draw") > 0) & v.isNotNull() & ~F.isnan(v), v)
    a = (1 - level) / 2
    return stats.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, v)).alias("point"), F.percentile(fin, F.lit(a)).alias("lo"), F.percentile(fin, F.lit(1 - a)).alias("hi"),
                                  F.count(fin).alias("n_finite"), (F.sum((F.col("draw") > 0).cast("long")) - F.count(fin)).alias("n_undefined"))


# ---- permutation nulls
def share_null(called: DataFrame, n_perm: int, seed) -> DataFrame:
    """Null of the marker shares: per unit the identities of the called class's features are permuted over its credits.
    Per (cls, feature): observed share within class, null mean and two-sided p. A unit's panel is one short array, so a
    permutation is a sort inside the row. called: unit_id, cls, feature, v."""
    g = called.groupBy("unit_id", "cls").agg(F.sort_array(F.collect_list(F.struct("feature", "v"))).alias("p"))
    top = F.array_max(F.transform("p", lambda x: x["v"]))
    g = g.withColumn("__top", top).withColumn("m", F.size(F.filter("p", lambda x: x["v"] == F.col("__top"))))
    g = g.withColumn("credit", F.transform("p", lambda x: F.when(x["v"] == F.col("__top"), 1.0 / F.col("m")).otherwise(0.0))).withColumn("f", F.transform("p", lambda x: x["feature"]))
    g = _explode(g, "perm", n_perm, 0)
    order = F.transform(F.sort_array(F.transform("f", lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("unit_id").cast("string"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])
    ids = F.when(F.col("perm") == 0, F.col("f")).otherwise(order)
    d = g.select("perm", "cls", F.inline(F.arrays_zip(ids.alias("feature"), F.col("credit"))))
    d = d.groupBy("perm", "cls", "feature").agg(F.sum("credit").alias("credit"))
    n = called.groupBy("cls").agg(F.count_distinct("unit_id").alias("n_calls"))
    s = d.join(n, "cls").withColumn("share", F.round(F.col("credit") / F.col("n_calls"), 12))
    w = Window.partitionBy("cls", "feature")                                  # n_perm + 1 rows
    s = s.withColumn("obs", F.max(F.when(F.col("perm") == 0, F.col("share"))).over(w)).withColumn("centre", F.avg(F.when(F.col("perm") > 0, F.col("share"))).over(w))
    far = (F.col("perm") > 0) & (F.round(F.abs(F.col("share") - F.col("centre")), 12) >= F.round(F.abs(F.col("obs") - F.col("centre")), 12))
    return s.groupBy("cls", "feature").agg(F.max("obs").alias("share"), F.max("centre").alias("null_mean"), ((1 + F.sum(far.cast("long"))) / (1 + F.sum((F.col("perm") > 0).cast("long")))).alias("p"))


def permutation_null(events: DataFrame, classes: list[str], n_perm: int, seed, mode: str = "within_class") -> DataFrame:
    """Share of the most frequent top feature of the called class, observed and when values move among the events of a
    class ('within_class') or of the unit ('within_unit'); one-sided p. events: unit_id, cls, feature, v."""
    g = events.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("cls", "feature", "v"))).alias("e"))
    g = _explode(g, "perm", n_perm, 0)
    h = lambda x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("unit_id").cast("string"), x["feature"]))
    key = (lambda x: F.struct(x["cls"].alias("c"), h(x).alias("h"), x["v"].alias("v"))) if mode == "within_class" else (lambda x: F.struct(F.lit("").alias("c"), h(x).alias("h"), x["v"].alias("v")))
    moved = F.transform(F.sort_array(F.transform("e", key)), lambda s: s["v"])
    vals = F.when(F.col("perm") == 0, F.transform("e", lambda x: x["v"])).otherwise(moved)
    g = g.withColumn("e", F.zip_with("e", vals, lambda x, v: F.struct(x["cls"].alias("cls"), x["feature"].alias("feature"), v.alias("v"))))
    s = [F.aggregate(F.filter("e", lambda x: x["cls"] == c), F.lit(0.0), lambda a, x: a + x["v"]) for c in classes]
    arr = F.array(*[F.round(x, 12) for x in s])
    call = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(arr, F.array_max(arr)).cast("int"))
    g = g.withColumn("call", call)
    best = F.array_min(F.transform(F.filter("e", lambda x: x["cls"] == F.col("call")), lambda x: F.struct((-x["v"]).alias("nv"), x["feature"].alias("feature"))))
    t = g.select("perm", best["feature"].alias("top")).groupBy("perm", "top").agg(F.count(F.lit(1)).alias("k"))
    m = t.groupBy("perm").agg((F.max("k") / F.sum("k")).alias("share"))
    obs = F.max(F.when(F.col("perm") == 0, F.col("share"))).over(Window.partitionBy())                     # n_perm + 1 rows
    m = m.withColumn("obs", obs)
    return m.agg(F.max("obs").alias("observed"), F.avg(F.when(F.col("perm") > 0, F.col("share"))).alias("null_mean"), ((1 + F.sum(((F.col("perm") > 0) & (F.col("share") >= F.col("obs"))).cast("long"))) / F.count(F.lit(1))).alias("p"))


# ---- decision rules on result rows
def _all(arr: str, cond) -> Column:
    return F.coalesce(F.forall(F.col(arr), lambda v: F.coalesce(cond(v), F.lit(False))), F.lit(False))


def win_rule(margin: float, point: str = "point", lo: str = "lo", hi: str = "hi", per_group: str = "per_group") -> Column:
    """win: point >= m, lower > 0, every group >= m / 2; loss: the mirror; equivalent: interval inside (-m, m)."""
    p, a, b, m = F.col(point), F.col(lo), F.col(hi), F.lit(float(margin))
    ok = p.isNotNull() & ~F.isnan(p) & a.isNotNull() & b.isNotNull()
    return (F.when(~ok, "inconclusive").when((p >= m) & (a > 0) & _all(per_group, lambda v: v >= m / 2), "win")
             .when((p <= -m) & (b < 0) & _all(per_group, lambda v: v <= -m / 2), "loss").when((a > -m) & (b < m), "equivalent").otherwise("inconclusive"))


def positive_condition(point: str = "point", lo: str = "lo", per_group: str = "per_group") -> Column:
    return F.coalesce((F.col(point) > 0) & (F.col(lo) > 0) & (F.size(per_group) > 0), F.lit(False)) & _all(per_group, lambda v: v > 0)


def scale_artefact_rule(registered: Column, cond_b: Column, cond_c: Column) -> Column:
    """A win stays a win only when two further positive conditions hold."""
    return F.when(registered != "win", registered).when(cond_b & cond_c, "win").otherwise("not supported (scale artefact)")


def share_criterion(share_margin: float, diff: str = "point", lo: str = "lo", hi: str = "hi", per_group: str = "per_group") -> Column:
    """|difference| >= margin, interval off 0 on its side, and in every group the same sign and at least half the margin."""
    d = F.col(diff)
    side = ((d > 0) & (F.col(lo) > 0)) | ((d < 0) & (F.col(hi) < 0))
    return F.coalesce((F.abs(d) >= share_margin) & side & (F.size(per_group) > 0), F.lit(False)) & _all(per_group, lambda v: (F.signum(v) == F.signum(d)) & (F.abs(v) >= share_margin / 2))


def comparable_units(stats: DataFrame, loss: str, n_lost: str, tol: float, min_lost: int) -> DataFrame:
    """Pairs of perturbation levels with near equal loss and enough lost rows (levels are declared, so pairs are few)."""
    s = stats.where(F.col(n_lost) >= min_lost)
    a = s.select(F.col("level").alias("level_a"), F.col(loss).alias("loss_a"))
    b = s.select(F.col("level").alias("level_b"), F.col(loss).alias("loss_b"))
    # losses within the tolerance lie in the same or in neighbouring buckets of its width
    bucket = lambda c: F.floor(F.col(c) / tol) if tol > 0 else F.col(c)
    near = F.array(*[bucket("loss_a") + k for k in ((-1, 0, 1) if tol > 0 else (0,))])
    pairs = a.withColumn("__b", F.explode(near)).join(b.withColumn("__b", bucket("loss_b")), "__b").drop("__b")
    return pairs.where((F.col("level_a") < F.col("level_b")) & (F.abs(F.col("loss_a") - F.col("loss_b")) <= tol))


def replication_rule(first: str, point: str = "point", lo: str = "lo", hi: str = "hi", per_group: str = "per_group") -> Column:
    """The sign of the first study in a strict majority of the groups and an interval off 0 on that side."""
    d = F.signum(F.col(first))
    same = F.size(F.filter(per_group, lambda v: F.coalesce(F.signum(v) == d, F.lit(False))))
    ok = (same * 2 > F.size(per_group)) & F.coalesce(((d > 0) & (F.col(lo) > 0)) | ((d < 0) & (F.col(hi) < 0)), F.lit(False))
    return F.when(F.coalesce(d == 0, F.lit(True)), "no direction").when(ok, "replicates").otherwise("does not replicate")


# ---- comparisons built from the parts
def method_curves(rows: DataFrame, draws: DataFrame, methods: list[str], correct: str, scored: str, grid: list[float], seed) -> DataFrame:
    """(method, draw, coverage, accuracy): every method ranked once, accuracy at matched coverage in every draw.
    rows: unit_id, one confidence column per method, correct and scored as 0 / 1."""
    m = F.array(*[F.struct(F.lit(n).alias("method"), F.round(F.col(n), 12).alias("conf")) for n in methods])
    long = rows.select("unit_id", correct, scored, F.inline(m))
    r = value_rank(long, ["method"], "conf", seed, ["unit_id"])
    return weighted_selective_accuracy(r.join(draws, "unit_id"), ["method", "draw"], "rank", "w", correct, scored, grid)


def method_comparison(rows: DataFrame, group: str, methods: tuple[str, str], correct: str, scored: str, grid: list[float], n_boot: int, seed, margin: float) -> DataFrame:
    """Accuracy of one method minus another at every coverage: point, paired two-stage interval, per-group values, decision."""
    rows = checkpointed(rows)
    draws = with_point(bootstrap_two_stage(rows, group, n_boot, seed), rows)
    diff = lambda c, by: (c.groupBy(*by, "coverage").agg(F.max(F.when(F.col("method") == methods[0], F.col("accuracy"))).alias("x"), F.max(F.when(F.col("method") == methods[1], F.col("accuracy"))).alias("y"))
                            .withColumn("value", F.col("x") - F.col("y")))
    ci = percentile_ci(diff(method_curves(rows, draws, list(methods), correct, scored, grid, seed), ["draw"]), ["coverage"])
    m = F.array(*[F.struct(F.lit(n).alias("method"), F.round(F.col(n), 12).alias("conf")) for n in methods])
    long = rows.select("unit_id", group, correct, scored, F.inline(m))
    r = value_rank(long, ["method", group], "conf", seed, ["unit_id"]).withColumn("w", F.lit(1).cast("long"))
    per = diff(weighted_selective_accuracy(r, ["method", group], "rank", "w", correct, scored, grid), [group])
    per = per.groupBy("coverage").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.coalesce("value", F.lit(float("nan"))).alias("v")))), lambda s: F.nanvl(s["v"], F.lit(None).cast("double"))).alias("per_group"))      # one entry per group
    return ci.join(per, "coverage").withColumn("decision", win_rule(margin))


def gap_inference(pairs: DataFrame, group: str, flag: str, features: list[str], kinds: dict[str, int], n_features: int, readout: str, head: str, null: str, n_boot: int, seed) -> DataFrame:
    """D contrast of gap ratios per draw: pairs resampled two-stage within groups, medians per (readout, flag, feature), ratios,
    contrast. pairs: unit_id (pair), group, flag, gaps (array of feature: its place in ``features``, meas, preds: for each of
    ``kinds``, the readouts by place, the predicted gap). A ratio counts where all ``n_features`` have one.

    A pair stays one row with all its gaps; measured gaps, which readouts share, are there once."""
    from .metrics import gap_contrast_by
    width = len(kinds) + 1                                  # measured, then the readouts
    code = lambda x, j: ((x["feature"] * 2 + F.col(flag).cast("int")) * width + j).cast("int").alias("code")
    of = lambda x: F.array(F.struct(code(x, 0), x["meas"].alias("v")), *[F.struct(code(x, j + 1), x["preds"][j].alias("v")) for j in kinds.values()])
    m = drawn_medians_by_row(pairs.select("unit_id", group, F.flatten(F.transform("gaps", of)).alias("values")), group, n_boot, seed, 2 * width * max(1, len(features)))
    m = m.withColumn("kind", F.col("code") % width).withColumn("cell", F.floor(F.col("code") / width).cast("int"))
    e = m.groupBy("draw", "cell").agg(*[F.max(F.when(F.col("kind") == j, F.col("median"))).alias(f"m{j}") for j in range(width)])
    e = e.select("draw", (F.col("cell") % 2 == 1).alias("flagged"), F.inline(F.array(*[F.struct(F.lit(n).alias("readout"), F.when(F.col("m0") > 0, F.col(f"m{j + 1}") / F.col("m0")).alias("ratio")) for n, j in kinds.items()])))
    gr = e.groupBy("draw", "readout", "flagged").agg(F.when(F.count("ratio") == n_features, F.avg("ratio")).alias("gap_ratio"))
    return gap_contrast_by(gr, ["draw"], readout, head, null)

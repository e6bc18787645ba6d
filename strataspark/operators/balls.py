"""Exact nearest neighbours by a tree of balls whose bounds skip what can't hold a neighbour.

Equal vectors of a group are one row with their smallest ids. Reference rows are split, level by level, among pivots of
their own cell until a cell is one block; query rows follow the same pivots to a home cell. The k-th similarity found
at home bounds what a query still needs: by the triangle inequality a cell with centre c and radius R holds nothing
nearer than |q - c| - R. Neighbouring blocks of queries form packs, which descend the tree under that bound; the blocks
that one of a pack's own blocks still needs are sent to the pack, once for all its queries, in stretches of bounded size.
There each query asks the bound again, and only the best rows of a stretch leave its task. All steps are joins and bounded
cogroups: a full cell is split by salt, and no group lies in one task."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw_key
from ..functions.vectors import minus
from ..session import checkpointed, ship_code
from .ranking import top_n_by_hash

DECIMALS = 9        # similarities are rounded before they are compared, so float noise cannot split a tie
FAN = 64            # pivots of a cell, at most
LEVELS = 8          # after so many splits a cell is cut by hash
SLACK = 1e-6        # bounds are compared with this much room
CHUNK = 4           # query rows of a task, in blocks
PACK = 16384        # query rows that share the reference rows sent to them
STRETCH = 65536     # reference rows of a task
TILE = 2048         # query rows of a matrix product
BALLS = 4096        # reference balls that a pack's balls are compared with at once


def matrix(u: pd.Series) -> np.ndarray:
    return np.stack(u.to_numpy()).astype(np.float64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of an Arrow column of equally long lists."""
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _product(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    s = a @ b.T
    if metric == "euclidean":
        s = 2 * s - (a * a).sum(1)[:, None] - (b * b).sum(1)[None, :]
    return s


def similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return np.round(_product(a, b, metric), DECIMALS)


def _distance2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _around(u: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Centre, radius and largest norm of some rows."""
    c = u.mean(0)
    return c, float(np.sqrt(((u - c) ** 2).sum(1).max())), float(np.sqrt((u * u).sum(1).max()))


def _reach(a: tuple, b: tuple, metric: str) -> np.ndarray:
    """The largest similarity that rows of balls ``a`` and rows of balls ``b`` can have, with the room for float noise.
    Balls: centres, radii, largest norms."""
    near = np.maximum(np.sqrt(_distance2(a[0], b[0])) - a[1][:, None] - b[1][None, :], 0.0)
    far = (a[2] * a[2])[:, None] + (b[2] * b[2])[None, :]
    return (-near * near if metric == "euclidean" else (far - near * near) / 2) + SLACK + 1e-12 * far


def _top(q: np.ndarray, low: np.ndarray, r: np.ndarray, ids: np.ndarray, starts: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, similarity): the ``k`` best reference rows (equal ones by id) of each query row that reach
    its similarity ``low``. ``starts``: where the blocks of reference rows begin."""
    ends = np.append(starts[1:], len(r))
    balls = tuple(np.array(x) for x in zip(*[_around(r[a:b]) for a, b in zip(starts, ends)]))
    out = []
    for t in range(0, len(q), TILE):
        u, tau = q[t:t + TILE], low[t:t + TILE].copy()
        reach = _reach((u, np.zeros(len(u)), np.sqrt((u * u).sum(1))), balls, metric)
        x, y, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for n, (a, b) in enumerate(zip(starts, ends)):
            ask = np.flatnonzero(reach[:, n] >= tau)
            if not len(ask):
                continue
            s = _product(u[ask], r[a:b], metric)
            least = tau[ask]
            if b - a > k and np.isneginf(least).any():      # queries without a bound: the k best of this block are enough
                least = np.maximum(least, np.partition(s, b - a - k, axis=1)[:, b - a - k])
            hit = np.flatnonzero(s >= (least - 2 * 10.0 ** -DECIMALS)[:, None])
            x1, y1 = np.divmod(hit, b - a)
            x, y, v = np.concatenate([x, ask[x1]]), np.concatenate([y, y1 + a]), np.concatenate([v, np.round(s.ravel()[hit], DECIMALS)])
            o = np.lexsort((ids[y], -v, x))
            x, y, v = x[o], y[o], v[o]
            count = np.bincount(x, minlength=len(u))
            place = np.arange(len(x)) - (np.cumsum(count) - count)[x]
            last = place == k - 1
            tau[x[last]] = np.maximum(tau[x[last]], v[last])
            stay = (place < k) & (v >= tau[x])
            x, y, v = x[stay], y[stay], v[stay]
        out.append((x + t, y, v))
    return tuple(np.concatenate(z) for z in zip(*out))


def _tau(n: int, x: np.ndarray, v: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The similarity at which each of ``n`` query rows has ``k`` ids (rows in the order of query and similarity)."""
    held = np.cumsum(copies)
    first = np.searchsorted(x, np.arange(n))
    before = np.concatenate([[0], held])[first]
    enough = held - before[x] >= k
    tau = np.full(n, -np.inf)
    np.maximum.at(tau, x[enough], v[enough])
    return tau


def _ids(r: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest id of each reference row, how many ids it has, and where they begin in the column of all ids."""
    n = r["ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return r["id"].to_numpy(), n, np.cumsum(n) - n


def _home(k: int, metric: str) -> Callable:
    """The query rows of a block with the similarity that ``k`` ids of the block reach."""
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        tau = np.full(len(q), -np.inf)
        if len(q) and len(r):
            ids, copies, _ = _ids(r)
            x, y, v = _top(_vectors(q["u"]), tau, _vectors(r["u"]), ids, np.zeros(1, np.int64), k, metric)
            tau = _tau(len(q), x, v, copies[y], k)
        return q.append_column("tau", pa.array(tau))
    return run


def _search(k: int, metric: str, g: list[str]) -> Callable:
    """The best ids of a stretch of reference blocks for each query row of a pack."""
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        names = [*g, "id", "sim", "j"]
        if not len(q) or not len(r):
            return pa.table({n: (q if n in g else r)["id" if n == "j" else n].slice(0, 0) if n != "sim" else pa.array([], pa.float64()) for n in names})
        r = r.sort_by([("cell", "ascending"), ("sub", "ascending"), ("id", "ascending")])
        cell, sub = r["cell"].to_numpy(), r["sub"].to_numpy()
        starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])))
        ids, copies, begin = _ids(r)
        x, y, v = _top(_vectors(q["u"]), q["tau"].to_numpy(), _vectors(r["u"]), ids, starts, k, metric)
        keep = v >= _tau(len(q), x, v, copies[y], k)[x]
        x, y, v = x[keep], y[keep], v[keep]
        n = copies[y]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[y], n)
        own = pa.array(np.repeat(x, n))
        return pa.table({**{c: q[c].take(own) for c in [*g, "id"]}, "sim": np.repeat(v, n), "j": r["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[at]})
    return run


def _asked(metric: str, keep: list[str]) -> Callable:
    """Reference balls that may hold a neighbour for a ball of the pack, and for how many of its balls of other blocks."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        n, own = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        if len(a) and len(b):
            ball = lambda t, p: (_vectors(t[f"{p}_c"]), t[f"{p}_r"].to_numpy(), t[f"{p}_top"].to_numpy())
            asks, balls, low = ball(a, "a"), ball(b, "b"), a["low"].to_numpy()
            cell, sub, at, at_sub = a["cell"].to_numpy(), a["sub"].to_numpy(), b["at"].to_numpy(), b["at_sub"].to_numpy()
            for t in range(0, len(a), TILE // 8):
                s = slice(t, t + TILE // 8)
                may = _reach(tuple(x[s] for x in asks), balls, metric) >= low[s][:, None]
                home = may & (cell[s][:, None] == at[None, :]) & (sub[s][:, None] == at_sub[None, :])
                n += may.sum(0)
                own += home.sum(0)
        return b.select(keep).append_column("asked", pa.array(n - own)).filter(pa.array(n > 0))
    return run


def _fresh(df: DataFrame) -> DataFrame:
    """Own column identities, for a cogroup of tables with a common origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each row's nearest pivot of its cell; ties go to the first by id."""
    if not len(rows):
        return rows
    pivots = pivots.sort_by("id")
    near = _distance2(_vectors(rows["u"]), _vectors(pivots["u"])).argmin(1)
    return rows.set_column(rows.schema.get_field_index("cell"), "cell", pa.array(rows["cell"].to_numpy() * FAN + 1 + near))


def _ball(names: list[str]) -> Callable:
    """Centre, radius and largest norm of the rows of a block, their number and their least bound."""
    def run(t: pa.Table) -> pa.Table:
        c, r, top = _around(_vectors(t["u"]))
        low = float(t["tau"].to_numpy().min()) if "tau" in t.schema.names else 0.0
        return pa.table({**{n: t[n].slice(0, 1) for n in names}, "c": pa.array([c], pa.list_(pa.float64())), "r": [r], "top": [top], "n": [len(t)], "low": [low]})
    return run


def _distinct(rows: DataFrame, g: list[str], k: int) -> DataFrame:
    """One row per group and vector: id (the smallest), ids (the k smallest), u."""
    d = rows.withColumn("h", F.xxhash64("u")).withColumn("h2", F.xxhash64(F.lit(1), "u"))
    d = checkpointed(d)
    one = d.groupBy(*g, "h", "h2").agg(F.min(F.struct("i", "u")).alias("m"), F.count(F.lit(1)).alias("copies"))
    many = d.select(*g, "h", "h2", "i").join(one.where("copies > 1").select(*g, "h", "h2"), [*g, "h", "h2"])
    least = _first_in_order(many, [*g, "h", "h2"], "i", k).groupBy(*g, "h", "h2").agg(F.sort_array(F.collect_list("i")).alias("least"))   # at most k ids
    return one.join(least, [*g, "h", "h2"], "left").select(*g, "h", "h2", F.col("m.i").alias("id"), F.coalesce("least", F.array("m.i")).alias("ids"), F.col("m.u").alias("u"))


def _first_in_order(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order of a column: first in hash buckets, then among what these leave."""
    d = df.withColumn("__b", F.substring(draw_key("top", order), 1, 2))
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order))).where(F.col("__rn") <= n)
    return d.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__rn") <= n).drop("__b", "__rn")


def _bound(a: str, b: str, metric: str) -> Column:
    """The largest similarity that rows of ball ``a`` and rows of ball ``b`` can have (columns <x>_c, <x>_r, <x>_top)."""
    d = F.sqrt(F.aggregate(minus(f"{a}_c", f"{b}_c"), F.lit(0.0), lambda s, x: s + x * x))
    near = F.greatest(d - F.col(f"{a}_r") - F.col(f"{b}_r"), F.lit(0.0))
    if metric == "euclidean":
        return -near * near
    return (F.col(f"{a}_top") * F.col(f"{a}_top") + F.col(f"{b}_top") * F.col(f"{b}_top") - near * near) / 2


def _as(df: DataFrame, p: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(f"{p}_{c}") for c in ("c", "r", "top")))


def _tree(rows: DataFrame, g: list[str], block: int) -> DataFrame:
    """Rows with their cell and the block inside it (``sub``: 0, but for cells that no pivot could split)."""
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    schema = rows.schema
    settled = []
    for level in range(LEVELS + 1):
        rows = checkpointed(rows)
        sizes = rows.groupBy(*g, "cell").agg(F.sum((F.col("side") != 1).cast("long")).alias("n"), F.count(F.lit(1)).alias("all"))
        full = checkpointed(sizes.where(F.col("n") > block).withColumn("parts", F.ceil(F.col("all") / (CHUNK * block)).cast("int")))
        if level == LEVELS or not full.take(1):
            break
        own = rows.join(full.select(*g, "cell", "n", "parts"), [*g, "cell"])
        pivots = top_n_by_hash(own.where("side != 1").select(*g, "cell", "id", "u", "n", "parts"), [*g, "cell"], f"pivot{level}", ["id"], FAN)
        # a cell needs about twice as many pivots as it will have blocks
        pivots = pivots.withColumn("__p", F.row_number().over(Window.partitionBy(*g, "cell").orderBy("id"))).where(F.col("__p") <= F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block)))
        key = [*g, "cell", "part"]
        left = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(*schema.names, "part")
        right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "id", "u")
        moved = left.groupBy(*key).cogroup(_fresh(right).groupBy(*key)).applyInArrow(_assign, left.schema).drop("part")
        settled.append(rows.join(full.select(*g, "cell"), [*g, "cell"], "left_anti").select(*schema.names))
        rows = moved
    cut = full.select(*g, "cell", F.ceil(F.col("n") / block).alias("subs"))
    return reduce(DataFrame.unionByName, settled, rows).join(cut, [*g, "cell"], "left").withColumn("sub", F.when(F.col("subs").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(3)), F.col("subs"))).cast("int")).drop("subs")


def _nodes(leaves: DataFrame, g: list[str]) -> DataFrame:
    """All cells of the tree with balls around their rows: (g, cell, parent, leaf, c, r, top)."""
    def around(kids: DataFrame) -> DataFrame:
        """The ball of a cell: the centre of its fullest part, and the reach of the others from there."""
        main = kids.groupBy(*g, "cell").agg(F.max_by("c", F.struct("n", "r")).alias("m"))
        far = F.sqrt(F.aggregate(minus("c", "m"), F.lit(0.0), lambda s, x: s + x * x)) + F.col("r")
        return kids.join(main, [*g, "cell"]).groupBy(*g, "cell").agg(F.first("m").alias("c"), F.max(far).alias("r"), F.max("top").alias("top"), F.sum("n").alias("n"))
    parent = F.when(F.col("cell") > 0, F.expr(f"(cell - 1) div {FAN}"))
    own = around(leaves.select(*g, "cell", "c", "r", "top", "n")).withColumn("leaf", F.lit(True))
    inner = around(leaves.select(*g, F.explode(_ancestors("cell")).alias("cell"), "c", "r", "top", "n")).withColumn("leaf", F.lit(False))
    return checkpointed(own.unionByName(inner).withColumn("parent", parent).select(*g, "cell", "parent", "leaf", "c", "r", "top"))


def _ancestors(cell: str) -> Column:
    """The cells above a cell, up to the root (cell 0)."""
    up = F.sequence(F.lit(1), F.lit(LEVELS))
    steps = F.transform(up, lambda _: F.lit(1))
    return F.filter(F.aggregate(steps, F.array(F.col(cell)), lambda a, _: F.array_append(a, F.when(F.element_at(a, -1) > 0, F.floor((F.element_at(a, -1) - 1) / FAN).cast("long")).otherwise(F.lit(-1).cast("long")))),
                    lambda x: (x >= 0) & (x != F.col(cell)))


def _packs(asking: DataFrame, g: list[str], unit: list[str]) -> DataFrame:
    """The pack of each block of queries (unit): the largest subtrees of at most PACK rows, and runs of these below one cell."""
    above = asking.select(*unit, "n", F.explode(F.concat(F.array("cell"), _ancestors("cell"))).alias("top"))
    held = above.groupBy(*g, "top").agg(F.sum("n").alias("held")).where(F.col("held") <= PACK)
    mine = checkpointed(above.join(held, [*g, "top"]).groupBy(*unit).agg(F.min(F.struct("top", "held")).alias("t")).select(*unit, "t.top", "t.held"))
    parent = F.when(F.col("top") > 0, F.expr(f"(top - 1) div {FAN}")).otherwise(F.lit(-1)).cast("long")
    kids = mine.select(*g, "top", "held").distinct().withColumn("pack", parent)
    before = F.sum("held").over(Window.partitionBy(*g, "pack").orderBy("top")) - F.col("held")        # at most FAN cells
    kids = kids.withColumn("run", F.floor(before / PACK).cast("long")).select(*g, "top", "pack", "run")
    # blocks of a cell that is too full itself are packs of their own
    alone = F.when(F.col("pack").isNull(), F.struct(F.col("cell").alias("pack"), (-1 - F.pmod(F.xxhash64("sub", "chunk"), F.lit(1 << 40))).alias("run"))).otherwise(F.struct("pack", "run"))
    return asking.select(*unit).join(mine.drop("held"), unit, "left").join(kids, [*g, "top"], "left").withColumn("p", alone).select(*unit, "p.pack", "p.run")


class _Search:
    """The tables of one search up to the blocks that each pack of queries needs."""

    def __init__(self, queries: DataFrame, reference: DataFrame, g: list[str], k: int, metric: str, block: int, same: bool):
        ship_code(queries.sparkSession)
        ref = _distinct(reference, g, k)
        qry = ref if same else _distinct(queries, g, k)
        # ids of queries and of reference rows are apart: side 0 reference, 1 query, 2 both
        cols = [*g, "h", "h2", "id", "ids", "u"]
        both = ref.select(*cols).withColumn("side", F.lit(2)) if same else ref.select(*cols).withColumn("side", F.lit(0)).unionByName(qry.select(*cols).withColumn("side", F.lit(1)))
        rows = checkpointed(_tree(both, g, block))
        place = [*g, "cell", "sub"]
        unit = [*place, "chunk"]
        pack = [*g, "pack", "run"]
        chunks = rows.where("side > 0").groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / (CHUNK * block)).cast("int").alias("chunks"))
        self.r = r = rows.where("side != 1").select(*place, "id", "ids", "u")
        q = rows.where("side > 0").join(chunks, place).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")).cast("int")).select(*unit, "h", "h2", "id", "u")
        home_r = r.join(chunks, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*unit, "id", "ids", "u")
        kinds = {f.name: f.dataType.simpleString() for f in q.schema}
        ddl = lambda names: ", ".join(f"`{n}` {kinds.get(n, 'bigint')}" for n in names)
        q = checkpointed(q.groupBy(*unit).cogroup(_fresh(home_r).groupBy(*unit)).applyInArrow(_home(k, metric), ddl(q.columns) + ", tau double"))
        ball = ", c array<double>, r double, top double, n bigint, low double"
        self.leaves = leaves = checkpointed(r.groupBy(*place).applyInArrow(_ball(place), ddl(place) + ball))
        asking = checkpointed(q.groupBy(*unit).applyInArrow(_ball(unit), ddl(unit) + ball))
        self.asking = asking = checkpointed(asking.join(_packs(asking, g, unit), unit))
        # packs descend from the root; what their bound excludes isn't opened
        main = asking.groupBy(*pack).agg(F.max_by("c", F.struct("n", "r")).alias("m"))
        far = F.sqrt(F.aggregate(minus("c", "m"), F.lit(0.0), lambda s, x: s + x * x)) + F.col("r")
        whole = asking.join(main, pack).groupBy(*pack).agg(F.first("m").alias("c"), F.max(far).alias("r"), F.max("top").alias("top"), F.min("low").alias("low"))
        ask = checkpointed(_as(whole, "a", [*pack, "low"]))
        kids = _as(_nodes(leaves, g), "b", [*g, F.col("cell").alias("at"), "parent", "leaf"])
        near = _bound("a", "b", metric) >= F.col("low") - 2 * SLACK
        open_ = ask.join(kids.where("parent IS NULL").drop("parent"), g).where(near)
        found = []
        for _ in range(LEVELS + 1):
            open_ = checkpointed(open_.select(*pack, "at", "leaf"))
            found.append(open_.where("leaf").select(*pack, "at"))
            inner = open_.where("NOT leaf").select(*pack, F.col("at").alias("parent"))
            if not inner.take(1):
                break
            open_ = inner.join(kids, [*g, "parent"]).join(ask, pack).where(near)
        # the bound once more for each block of a pack
        ends = _as(leaves, "b", [*g, F.col("cell").alias("at"), F.col("sub").alias("at_sub"), F.col("n").alias("b_n")])
        near = reduce(DataFrame.unionByName, found).join(ends, [*g, "at"])
        parts = near.groupBy(*pack).agg(F.ceil(F.count(F.lit(1)) / BALLS).cast("int").alias("parts"))
        key = [*pack, "part"]
        b = near.join(parts, pack).withColumn("part", F.pmod(F.xxhash64("at", "at_sub"), F.col("parts")).cast("int")).select(*key, "at", "at_sub", "b_n", "b_c", "b_r", "b_top")
        a = _as(asking, "a", [*pack, "cell", "sub", "low"]).join(parts, pack).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keep = [*pack, "at", "at_sub", "b_n"]
        kinds["at_sub"] = "int"
        self.pairs = checkpointed(a.groupBy(*key).cogroup(_fresh(b).groupBy(*key)).applyInArrow(_asked(metric, keep), ddl(keep) + ", asked bigint"))
        self.q, self.g, self.k, self.metric, self.place, self.unit, self.pack, self.ddl = q, g, k, metric, place, unit, pack, ddl


def ball_search(queries: DataFrame, reference: DataFrame, g: list[str], k: int, metric: str, block: int, same: bool) -> DataFrame:
    """(g, h, h2, near), the ``k`` nearest (sim, j) of each different query vector."""
    s = _Search(queries, reference, g, k, metric, block, same)
    key = [*s.pack, "part"]
    parts = checkpointed(s.pairs.groupBy(*s.pack).agg(F.ceil(F.sum("b_n") / STRETCH).cast("int").alias("parts")))
    need = s.pairs.join(parts, s.pack).withColumn("part", F.pmod(F.xxhash64("at", "at_sub", F.lit(7)), F.col("parts")).cast("int")).select(*key, F.col("at").alias("cell"), F.col("at_sub").alias("sub"))
    r = s.r.join(need, s.place).select(*key, "cell", "sub", "id", "ids", "u")
    q = s.q.join(s.asking.select(*s.unit, "pack", "run"), s.unit).join(parts, s.pack).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "id", "u", "tau")
    hits = q.groupBy(*key).cogroup(_fresh(r).groupBy(*key)).applyInArrow(_search(k, metric, g), s.ddl([*g, "id"]) + ", sim double, j bigint")
    w = Window.partitionBy(*g, "id").orderBy(F.desc("sim"), "j")
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    near = best.groupBy(*g, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sim", "j"))), lambda x: F.struct(x["sim"].alias("sim"), x["j"].alias("j"))).alias("near"))    # k entries
    return s.q.select(*g, "h", "h2", "id").join(near, [*g, "id"]).select(*g, "h", "h2", "near")


def block_counts(queries: DataFrame, reference: DataFrame, g: list[str], k: int, metric: str, block: int, same: bool) -> DataFrame:
    """(g, n_pairs, n_searched): the pairs of query and reference blocks, and those that the bounds leave. Nothing is searched
    beyond the home blocks."""
    s = _Search(queries, reference, g, k, metric, block, same)
    searched = s.pairs.groupBy(*g).agg(F.sum("asked").alias("away"))
    blocks = s.asking.groupBy(*g).agg(F.count(F.lit(1)).alias("n_asking")).join(s.leaves.groupBy(*g).agg(F.count(F.lit(1)).alias("n_blocks")), g, "left").join(searched, g, "left")
    return blocks.select(*g, (F.col("n_asking") * F.coalesce("n_blocks", F.lit(0))).alias("n_pairs"), (F.col("n_asking") + F.coalesce("away", F.lit(0))).alias("n_searched"))

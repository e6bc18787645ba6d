"""Exact nearest neighbours in blocks, pairs built from them and statistics of pairs."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.draws import slot
from ..functions.vectors import dot, l2_normalise, minus
from ..session import checkpointed, ship_code
from .balls import ball_search, block_counts, matrix, similarity
from .ranking import group_percentile, hash_rank

def _whole_groups(k: int, exclude_self: bool, metric: str) -> Callable:
    """Top ``k`` reference rows of a small group for every query row: one matrix product."""
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "sim": np.zeros(0), "rank": np.zeros(0, np.int32)})
        if len(q) == 0 or len(r) == 0:
            return empty
        r = r.sort_values("i", kind="stable")                # columns by id, so equal scores keep id order
        s = similarity(matrix(q["u"]), matrix(r["u"]), metric)
        qi, rj = q["i"].to_numpy(), r["i"].to_numpy()
        if exclude_self:
            s[qi[:, None] == rj[None, :]] = -np.inf
        m = min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        rows = np.repeat(np.arange(len(qi)), m)
        out = pd.DataFrame({"i": qi[rows], "j": rj[top.ravel()], "sim": s[rows, top.ravel()], "rank": np.tile(np.arange(1, m + 1, dtype=np.int32), len(qi))})
        return out[np.isfinite(out["sim"])]
    return run


def _sides(queries: DataFrame, reference: DataFrame, by: list[str], z: str, metric: str, eps: float) -> tuple[DataFrame, DataFrame, list[str]]:
    prep = (lambda c: l2_normalise(c, eps)) if metric == "cosine" else (lambda c: F.transform(c, lambda x: x.cast("double")))
    keys = [F.col(c) for c in by] or [F.lit(0).alias("__g")]
    side = lambda d: checkpointed(d.select(*keys, F.col("unit_id").cast("long").alias("i"), F.transform(prep(z), lambda x: x + F.lit(0.0)).alias("u")))
    q = side(queries)
    return q, q if reference is queries else side(reference), by or ["__g"]


def nearest(queries: DataFrame, reference: DataFrame, by: list[str], k: int, z: str = "z", exclude_self: bool = False,
            metric: str = "cosine", eps: float = 1e-8, block: int = 2048) -> DataFrame:
    """Exact ``k`` nearest reference rows (i, j, sim, rank) of every query row inside its group.

    Where every group is one block, each is one bounded task. Larger groups are searched through a tree of balls
    (``balls.ball_search``): rows go only to blocks that may hold a neighbour, equal vectors are searched once."""
    q, r, g = _sides(queries, reference, by, z, metric, eps)
    ship_code(queries.sparkSession)
    most = max(x.agg(F.max("n")).first()[0] or 0 for x in {id(d): d.groupBy(*g).agg(F.count(F.lit(1)).alias("n")) for d in (q, r)}.values())
    if most <= block:
        r = r.select(*[F.col(c).alias(c) for c in [*g, "i", "u"]])           # own column identities when both sides are one table
        return q.groupBy(*g).cogroup(r.groupBy(*g)).applyInPandas(_whole_groups(k, exclude_self, metric), "i long, j long, sim double, rank int")
    found = ball_search(q, r, g, k + int(exclude_self), metric, block, r is q)
    d = q.select(*g, "i", F.xxhash64("u").alias("h"), F.xxhash64(F.lit(1), "u").alias("h2")).join(found, [*g, "h", "h2"])
    near = F.filter("near", lambda x: x["j"] != F.col("i")) if exclude_self else F.col("near")
    d = d.select("i", F.posexplode(F.slice(near, 1, k)).alias("p", "x"))
    return d.select("i", F.col("x.j").alias("j"), F.col("x.sim").alias("sim"), (F.col("p") + 1).cast("int").alias("rank"))


def block_pairs(queries: DataFrame, reference: DataFrame, by: list[str], k: int, z: str = "z", exclude_self: bool = False, metric: str = "cosine", eps: float = 1e-8, block: int = 2048) -> DataFrame:
    """Per group: pairs of a query block and a reference block (n_pairs), those that the search compares (n_searched), and
    the share that the bounds skip."""
    q, r, g = _sides(queries, reference, by, z, metric, eps)
    blocks = block_counts(q, r, g, k + int(exclude_self), metric, block, r is q)
    return blocks.select(*by, "n_pairs", "n_searched", (1 - F.col("n_searched") / F.col("n_pairs")).alias("share_skipped"))


def knn_within_group(df: DataFrame, group: str, k: int, **kw) -> DataFrame:
    return nearest(df, df, [group], k, exclude_self=True, **kw)


def undirected_edges(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.max("sim").alias("cos"))


def with_both(pairs: DataFrame, rows: DataFrame, i: str, j: str, cols: list[str]) -> DataFrame:
    """Attach columns of both ends of a pair as <col>_i and <col>_j."""
    a = rows.select(F.col("unit_id").alias(i), *[F.col(c).alias(f"{c}_i") for c in cols])
    b = rows.select(F.col("unit_id").alias(j), *[F.col(c).alias(f"{c}_j") for c in cols])
    return pairs.join(a, i).join(b, j)


def cross_class_pairs(edges: DataFrame, rows: DataFrame, key: str, x: str, y: str, flag_cos: float, extra: list[str] = []) -> DataFrame:
    """Edges that join class x to class y, oriented (x, y), flagged when cos reaches the threshold."""
    d = with_both(edges, rows, "lo", "hi", [key, *extra])
    a, b = F.col(f"{key}_i"), F.col(f"{key}_j")
    d = d.where(((a == x) & (b == y)) | ((a == y) & (b == x)))
    return d.select(F.when(a == x, F.col("lo")).otherwise(F.col("hi")).alias("x"), F.when(a == x, F.col("hi")).otherwise(F.col("lo")).alias("y"), "cos",
                    (F.round("cos", 6) >= flag_cos).alias("flagged"), *[F.col(f"{c}_i").alias(c) for c in extra])


def random_pair_control(rows: DataFrame, key: str, x: str, y: str, n: int, seeds: list[int], edges: DataFrame) -> DataFrame:
    """n seeded (x, y) pairs per seed without the neighbour edges: pair slots draw positions in the two pools,
    positions join densely numbered rows, so nothing is enumerated."""
    px = hash_rank(rows.where(F.col(key) == x).select("unit_id"), [], "px", ["unit_id"], out="rx").withColumnRenamed("unit_id", "x")
    py = hash_rank(rows.where(F.col(key) == y).select("unit_id"), [], "py", ["unit_id"], out="ry").withColumnRenamed("unit_id", "y")
    size = lambda c: rows.where(F.col(key) == c).agg(F.count(F.lit(1)).alias("n")).scalar()
    s = rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "s").withColumn("seed", F.explode(F.array(*[F.lit(v) for v in seeds])))
    s = s.withColumn("rx", slot(size(x), "x", "seed", "s")).withColumn("ry", slot(size(y), "y", "seed", "s"))
    p = s.join(px, "rx").join(py, "ry").withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y"))
    return p.join(edges.select("lo", "hi"), ["lo", "hi"], "left_anti").select("seed", "s", "x", "y")


def knn_label_disagreement(queries: DataFrame, reference: DataFrame, label: str, call: str, k: int, **kw) -> DataFrame:
    """Share of a query's k nearest reference rows whose label differs from its call."""
    nb = nearest(queries, reference, [], k, **kw)
    d = nb.join(reference.select(F.col("unit_id").alias("j"), F.col(label).alias("__l")), "j").join(queries.select(F.col("unit_id").alias("i"), F.col(call).alias("__c")), "i")
    return d.groupBy(F.col("i").alias("unit_id")).agg(F.avg((F.col("__l") != F.col("__c")).cast("double")).alias("disagreement"))


def knn_regression(train: DataFrame, val: DataFrame, test: DataFrame, y: str, grid: list[int], metric: str = "cosine") -> DataFrame:
    """Mean target of the k nearest training rows; k chosen by validation MSE (smallest k on ties)."""
    # one search for the rows of both tables
    asked = val.select("unit_id", "z").unionByName(test.select("unit_id", "z")).dropDuplicates(["unit_id"])
    nb = nearest(asked, train, [], max(grid), metric=metric).join(train.select(F.col("unit_id").alias("j"), F.col(y).alias("__y")), "j")
    w = Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)        # max(grid) rows
    curve = checkpointed(nb.withColumn("pred", F.avg("__y").over(w)).where(F.col("rank").isin(grid)).select(F.col("i").alias("unit_id"), F.col("rank").alias("k"), "pred"))
    mse = curve.join(val.select("unit_id", y), "unit_id").groupBy("k").agg(F.avg((F.col("pred") - F.col(y)) ** 2).alias("mse"))
    best = mse.agg(F.min_by("k", F.struct(F.round("mse", 12), "k")).alias("k")).scalar()
    return curve.where(F.col("k") == best).join(test.select("unit_id"), "unit_id", "left_semi")


def neighbour_overlap(pairs: DataFrame, neighbours: DataFrame, i: str, j: str, k: int) -> DataFrame:
    """Share of the k neighbours two rows have in common (k ids per row)."""
    n = neighbours.where(F.col("rank") <= k).groupBy("i").agg(F.collect_set("j").alias("nb")).withColumnRenamed("i", "unit_id")
    d = with_both(pairs, n, i, j, ["nb"])
    return d.withColumn("overlap", F.size(F.array_intersect("nb_i", "nb_j")) / k).drop("nb_i", "nb_j")


# ---- pairs that must be told apart
def must_separate_pairs(edges: DataFrame, rows: DataFrame, min_cos: float, rel_l1: float, abstain: str = "abstain", other: list[str] = ["other"], plain_or: bool = False) -> DataFrame:
    """Near pairs with their reasons. rows: unit_id, lineage, key_cls, coarse, m (panel array). A pair must be separated
    if its lineages differ (no abstention), or its key class or its coarse type differs and the panels differ enough
    (mean absolute difference over the panel's mean absolute value); ``plain_or`` drops the panel condition."""
    scale = rows.agg(F.avg(F.aggregate("m", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("m")).alias("s")).scalar()
    d = with_both(edges.where(F.round("cos", 6) >= min_cos), rows, "lo", "hi", ["lineage", "key_cls", "coarse", "m"])
    l1 = F.aggregate(minus("m_i", "m_j"), F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("m_i")
    d = d.withColumn("rel_l1", l1 / scale)
    d = (d.withColumn("diff_lineage", (F.col("lineage_i") != F.col("lineage_j")) & (F.col("lineage_i") != abstain) & (F.col("lineage_j") != abstain))
          .withColumn("diff_key", F.col("key_cls_i") != F.col("key_cls_j"))
          .withColumn("diff_coarse", (F.col("coarse_i") != F.col("coarse_j")) & ~F.col("coarse_i").isin(other) & ~F.col("coarse_j").isin(other))
          .withColumn("diff_profile", F.round("rel_l1", 9) >= rel_l1))
    far = F.lit(True) if plain_or else F.col("diff_profile")
    return d.withColumn("must", F.col("diff_lineage") | (F.col("diff_key") & far) | (F.col("diff_coarse") & far)).drop("m_i", "m_j")


def must_separate_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of near pairs, must pairs, each reason and distinct rows touched for several cosine thresholds. A pair
    meets each declared threshold once."""
    d = pairs.withColumn("t", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.round("cos", 6) >= t)))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"n_{c}")
    g = d.groupBy("t").agg(F.count(F.lit(1)).alias("n_near"), *[n(c) for c in ("must", "diff_lineage", "diff_key", "diff_coarse", "diff_profile")])
    u = d.where("must").select("t", F.explode(F.array("lo", "hi")).alias("u")).distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n_rows_touched"))
    return g.join(u, "t", "left").fillna(0, subset=["n_rows_touched"]).withColumn("share_must", F.col("n_must") / F.col("n_near"))


def pair_decision_metrics(pairs: DataFrame, decisions: DataFrame, i: str = "lo", j: str = "hi") -> DataFrame:
    """Both rows' decisions on every pair; a pair with a missing decision counts in n only. decisions: unit_id, call
    ('' = no call), expected (NULL = none)."""
    decisions = checkpointed(decisions.select("unit_id", "call", "expected"))          # read for both ends
    a = decisions.select(F.col("unit_id").alias(i), F.col("call").alias("ca"), F.col("expected").alias("ea"), F.lit(True).alias("ha"))
    b = decisions.select(F.col("unit_id").alias(j), F.col("call").alias("cb"), F.col("expected").alias("eb"), F.lit(True).alias("hb"))
    d = pairs.join(a, i, "left").join(b, j, "left")
    have = F.coalesce(F.col("ha") & F.col("hb"), F.lit(False))
    da, db = have & (F.col("ca") != ""), have & (F.col("cb") != "")
    same = da & db & (F.col("ca") == F.col("cb"))
    diff = da & db & (F.col("ca") != F.col("cb"))
    right_a, right_b = da & F.coalesce(F.col("ca") == F.col("ea"), F.lit(False)), db & F.coalesce(F.col("cb") == F.col("eb"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    e = {"n_pairs": F.count(F.lit(1)), "both_decided": n(da & db), "same_call": n(same), "differ_call": n(diff), "any_no_call": n(have & ~(da & db)), "both_no_call": n(have & ~da & ~db),
         "soft_separated": n(have & ~same), "correct_separated": n(diff & right_a & right_b), "n_with_expected": n(da & F.col("ea").isNotNull()) + n(db & F.col("eb").isNotNull()), "n_right": n(right_a) + n(right_b)}
    g = d.agg(*[v.alias(k) for k, v in e.items()])
    den = F.greatest(F.col("n_pairs"), F.lit(1))
    return (g.withColumn("false_agreement_rate", F.when(F.col("both_decided") > 0, F.col("same_call") / F.col("both_decided")))
             .withColumn("soft_separation_rate", F.col("soft_separated") / den).withColumn("correct_separation_rate", F.col("correct_separated") / den)
             .withColumn("accuracy_decided", F.when(F.col("n_with_expected") > 0, F.col("n_right") / F.col("n_with_expected"))))


def pair_cosine_under_views(pairs: DataFrame, rows: DataFrame, views: dict[str, list[int]], i: str, j: str, z: str = "m", high: float = 0.98, low: float = 0.95) -> DataFrame:
    """Cosine of fixed pairs when only some positions of the vectors are kept: mean, median, shares above / below."""
    d = with_both(pairs.select(i, j), checkpointed(rows.select("unit_id", z)), i, j, [z])
    pick = lambda c, idx: F.array(*[F.col(c)[k] for k in idx])
    cos = [F.struct(F.lit(n).alias("view"), dot(l2_normalise(pick(f"{z}_i", idx)), l2_normalise(pick(f"{z}_j", idx))).alias("cos")) for n, idx in views.items()]
    d = checkpointed(d.select(F.inline(F.array(*cos))))
    g = d.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean"), F.avg((F.round("cos", 9) >= high).cast("double")).alias("share_high"), F.avg((F.round("cos", 9) < low).cast("double")).alias("share_low"))
    return g.join(group_percentile(d, ["view"], "cos", {"median": 0.5}), "view")


def centred_distance_ratio(near: DataFrame, random: DataFrame, rows: DataFrame, train: DataFrame, z: str = "z") -> DataFrame:
    """Median 1 - cos of neighbour pairs over that of random pairs, raw and with the train mean subtracted."""
    dim = train.select(F.posexplode(z).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"))
    mean = dim.agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c")).scalar()     # one row per dimension
    both = rows.withColumn("__c", mean).select("unit_id", F.transform(z, lambda x: x.cast("double")).alias("raw"), minus(z, "__c").alias("centred"))
    both = checkpointed(both)
    out = []
    for name, p in (("near", near), ("random", random)):
        d = with_both(p.select("x", "y"), both, "x", "y", ["raw", "centred"])
        out.append(d.select(F.lit(name).alias("kind"), F.inline(F.array(*[F.struct(F.lit(g).alias("geometry"), (1 - dot(l2_normalise(f"{g}_i"), l2_normalise(f"{g}_j"))).alias("d")) for g in ("raw", "centred")]))))
    m = group_percentile(checkpointed(out[0].unionByName(out[1])), ["kind", "geometry"], "d", {"median": 0.5})
    g = m.groupBy("geometry").agg(F.max(F.when(F.col("kind") == "near", F.col("median"))).alias("near"), F.max(F.when(F.col("kind") == "random", F.col("median"))).alias("random"))
    return g.withColumn("ratio", F.when(F.col("random") > 0, F.col("near") / F.col("random")))


def pair_gaps(pairs: DataFrame, panel: DataFrame, by: list[str], x: str, y: str, pred: str, meas: str) -> DataFrame:
    """Absolute predicted and measured gaps of every pair and feature, and whether x is predicted higher."""
    a = panel.select(F.col("unit_id").alias(x), "feature", F.col(pred).alias("pa"), F.col(meas).alias("ma"))
    b = panel.select(F.col("unit_id").alias(y), "feature", F.col(pred).alias("pb"), F.col(meas).alias("mb"))
    d = pairs.join(a, x).join(b, [y, "feature"])
    return d.select(*by, x, y, "feature", F.abs(F.col("pa") - F.col("pb")).alias("d_pred"), F.abs(F.col("ma") - F.col("mb")).alias("d_meas"), (F.col("pa") > F.col("pb")).alias("x_higher"))

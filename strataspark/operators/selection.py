"""Selection along a ranking, seeded folds, halves, draws and samples."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw_key
from ..session import checkpointed
from .ranking import group_percentile, hash_rank, running_sum, top_n_by_hash, value_rank


def needed(coverage: Column, n: Column) -> Column:
    """ceil(coverage * n), guarded against float noise just above a whole number."""
    return F.ceil(coverage * n - F.lit(1e-9)).cast("long")


# ---- coverage
def coverage_rank(df: DataFrame, by: list[str], conf: str, seed, sums: dict[str, str] | None = None) -> DataFrame:
    """rank (most confident first, missing last, ties in seeded order of the unit id) and n of the group."""
    r = value_rank(df, by, conf, seed, ["unit_id"], sums=sums)
    if not by:
        return r.withColumn("n", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    return r.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)


def coverage_select(df: DataFrame, by: list[str], conf: str, coverage: float, seed) -> DataFrame:
    """The ceil(c * n) most confident rows of every group."""
    r = coverage_rank(df, by, conf, seed)
    return r.where(F.col("rank") <= needed(F.lit(float(coverage)), F.col("n")))


def select_lowest(df: DataFrame, by: list[str], conf: str, n: int, seed) -> DataFrame:
    """The ``n`` least confident rows (missing last)."""
    return value_rank(df, by, conf, seed, ["unit_id"], descending=False).where(F.col("rank") <= n)


def selective_accuracy_at(df: DataFrame, by: list[str], conf: str, correct: Column, scored: Column, grid: list[float], seed) -> DataFrame:
    """Accuracy of the scored rows among the selected at every coverage of a grid. Ranked once with running
    counts; a coverage then reads the one row whose rank is its k."""
    d = df.select(*by, "unit_id", conf, correct.cast("long").alias("is_right"), scored.cast("long").alias("is_scored"))
    r = value_rank(d, by, conf, seed, ["unit_id"], sums={"n_right": "is_right", "n_scored": "is_scored"})
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    g = n.withColumn("coverage", F.explode(F.array(*[F.lit(float(c)) for c in grid]))).withColumn("rank", needed(F.col("coverage"), F.col("n")))
    j = g.join(r.select(*by, "rank", "n_right", "n_scored"), [*by, "rank"], "left")
    return j.select(*by, "coverage", F.col("rank").alias("k"), "n_scored", F.when(F.col("n_scored") > 0, F.col("n_right") / F.col("n_scored")).alias("accuracy"))


def weighted_select(ranked: DataFrame, by: list[str], rank: str, weight: str, grid: list[float], block: int = 1 << 20) -> DataFrame:
    """Copies of each row selected at every coverage when rows have multiplicities: the first k copies along the
    order, the last row partly. ``by`` includes the draw; the order is fixed, only weights differ."""
    tot = ranked.groupBy(*by).agg(F.sum(weight).alias("__n"))
    r = running_sum(ranked.where(F.col(weight) > 0), by, rank, {"__cum": weight}, block).join(tot, by)
    r = r.withColumn("coverage", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    k = needed(F.col("coverage"), F.col("__n")) - (F.col("__cum") - F.col(weight))
    return r.withColumn("copies", F.least(F.greatest(k, F.lit(0)), F.col(weight))).drop("__cum", "__n")


def weighted_selective_accuracy(ranked: DataFrame, by: list[str], rank: str, weight: str, correct: str, scored: str, grid: list[float]) -> DataFrame:
    s = weighted_select(ranked, by, rank, weight, grid)
    g = s.groupBy(*by, "coverage").agg(F.sum(F.col("copies") * F.col(correct)).alias("__c"), F.sum(F.col("copies") * F.col(scored)).alias("n_scored"))
    return g.select(*by, "coverage", "n_scored", F.when(F.col("n_scored") > 0, F.col("__c") / F.col("n_scored")).alias("accuracy"))


def aurc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area of accuracy over the coverage grid over the grid's range; NULL if any point is. A grid is short."""
    w = Window.partitionBy(*by).orderBy("coverage")
    d = curve.withColumn("__pa", F.lag("accuracy").over(w)).withColumn("__pc", F.lag("coverage").over(w))
    area = F.sum(0.5 * (F.col("accuracy") + F.col("__pa")) * (F.col("coverage") - F.col("__pc")))
    return d.groupBy(*by).agg(F.when((F.count("accuracy") == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2), area / (F.max("coverage") - F.min("coverage"))).alias("aurc"))


def monotonic_rise(curve: DataFrame, by: list[str], min_labelled: int = 30, region: float = 0.4) -> DataFrame:
    """As coverage falls: share of steps in which accuracy does not fall, its peak, the best at coverage >= region."""
    d = curve.where(F.col("accuracy").isNotNull() & (F.col("n_labelled") >= min_labelled))
    w = Window.partitionBy(*by).orderBy(F.desc("coverage"), "tau")
    d = d.withColumn("__p", F.lag("accuracy").over(w))
    up = F.when(F.col("__p").isNotNull(), (F.col("accuracy") >= F.col("__p") - 1e-12).cast("double"))
    first = F.struct(F.round("accuracy", 9), "coverage")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), F.avg(up).alias("share_rising"), F.max("accuracy").alias("peak"), F.max_by("coverage", first).alias("coverage_at_peak"),
                           F.max(F.when(F.col("coverage") >= region, F.col("accuracy"))).alias("best_in_region"))
    return g.withColumn("share_rising", F.when(F.col("n_points") >= 3, F.col("share_rising")))


# ---- folds and halves
def fold_by_cluster(df: DataFrame, cluster: str, k: int, seed) -> DataFrame:
    """Whole clusters dealt to k folds in seeded order."""
    c = hash_rank(df.select(cluster).distinct(), [], seed, [cluster], out="__r")
    return df.join(c.select(cluster, ((F.col("__r") - 1) % k).alias("fold")), cluster)


def fold_by_row(df: DataFrame, block: str, k: int, seed) -> DataFrame:
    """Rows of every block dealt evenly to k folds."""
    return hash_rank(df, [block], seed, ["unit_id"], out="__r").withColumn("fold", (F.col("__r") - 1) % k).drop("__r")


def pseudo_blocks(df: DataFrame, control: Column, block: str, k: int, seed, prefix: str = "ctl") -> DataFrame:
    """Rows without a unit of their own (controls) get one of k seeded pseudo-blocks."""
    d = hash_rank(df.withColumn("__c", control), ["__c"], seed, ["unit_id"], out="__r")
    return d.withColumn(block, F.when(F.col("__c"), F.concat(F.lit(f"{prefix}:"), ((F.col("__r") - 1) % k).cast("string"))).otherwise(F.col(block))).drop("__c", "__r")


def usable_folds(df: DataFrame, cluster: str, treated: str, k: int, seed: int, tries: int) -> DataFrame:
    """First seed for which every training part holds treated and control rows. Clusters are reduced to two counts
    before the candidate seeds are laid out; the answer is one row (NULL when no seed works)."""
    c = df.groupBy(cluster).agg(F.sum(F.col(treated)).alias("__n1"), F.sum(1 - F.col(treated)).alias("__n0"))
    c = c.withColumn("fold_seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + tries - 1))))
    c = c.withColumn("__h", F.md5(F.concat_ws("|", F.col("fold_seed").cast("string"), F.col(cluster).cast("string"))))
    r = hash_rank_col(c, ["fold_seed"], "__h", [cluster]).withColumn("fold", (F.col("__r") - 1) % k)
    f = r.groupBy("fold_seed", "fold").agg(F.sum("__n1").alias("n1"), F.sum("__n0").alias("n0"))
    w = Window.partitionBy("fold_seed")                                     # k rows per seed
    ok = f.withColumn("ok", (F.sum("n1").over(w) - F.col("n1") > 0) & (F.sum("n0").over(w) - F.col("n0") > 0))
    return ok.groupBy("fold_seed").agg(F.bool_and("ok").alias("ok")).where("ok").agg(F.min("fold_seed").alias("fold_seed"))


def hash_rank_col(df: DataFrame, by: list[str], h: str, keys: list[str]) -> DataFrame:
    from .ranking import _conf, _rank_in_buckets
    digits = _conf(df, "rankDigits", 2)
    return _rank_in_buckets(df.withColumn("__b", F.substring(h, 1, digits)), by, ["__b"], [h, *keys], "__r", {}).drop(h)


def stratified_halves(df: DataFrame, by: list[str], share: float, seed) -> DataFrame:
    """first_half: a seeded round(share * n) rows of every group."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return hash_rank(df, by, seed, ["unit_id"], out="__r").join(n, by).withColumn("first_half", F.col("__r") <= F.rint(F.lit(share) * F.col("__n"))).drop("__r", "__n")


def nested_draw(pool: DataFrame, sizes: list, seed) -> DataFrame:
    """The first n of one seeded permutation for every size: smaller draws are inside larger ones. The size ``all`` is
    the whole pool under its number of rows. Only the largest draw is numbered, not the pool."""
    numbers = [n for n in sizes if n != "all"]
    out = []
    if numbers:
        top = top_n_by_hash(pool.select("unit_id"), [], seed, ["unit_id"], max(numbers))
        r = hash_rank(top, [], seed, ["unit_id"], out="__r").withColumn("size", F.explode(F.array(*[F.lit(n).cast("long") for n in numbers])))
        out.append(r.where(F.col("__r") <= F.col("size")).drop("__r"))
    if "all" in sizes:
        out.append(pool.select("unit_id").withColumn("size", pool.agg(F.count(F.lit(1)).alias("n")).scalar()))
    return reduce(lambda a, b: a.unionByName(b), out)


def round_robin_pick(df: DataFrame, group: str, queue: str, n: int, seed) -> DataFrame:
    """Members taken from the queues of a group in turn until n are picked. One row per member (a donor table)."""
    w = Window.partitionBy(group, queue).orderBy(draw_key(seed, "unit_id"), "unit_id")
    d = df.withColumn("turn", F.row_number().over(w))
    d = d.where(F.col("turn") <= n)
    return d.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy("turn", queue))).where(F.col("pick") <= n)


# ---- samples
def sample_per_group(df: DataFrame, by: list[str], n: int, seed) -> DataFrame:
    return top_n_by_hash(df, by, seed, ["unit_id"], n)


def label_cost_split(df: DataFrame, share: float, seed) -> DataFrame:
    """Disjoint train pool and evaluation rows of one permutation."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hash_rank(df, [], seed, ["unit_id"], out="__r").withColumn("part", F.when(F.col("__r") <= F.floor(n * F.lit(share)), "train").otherwise("eval")).drop("__r")


def matched_random_sample(pool: DataFrame, reference: DataFrame, by: list[str], covariate: str, wanted: DataFrame, seed) -> DataFrame:
    """Random comparison rows per group, matched to the reference on quintiles of a covariate.

    Quintile quotas come from the reference shares by largest remainder; a bin that runs short is filled at
    random from the group's other pool rows, and ``filled`` marks those. ``wanted``: one row per group (want)."""
    probs = {f"e{k}": k / 5 for k in range(1, 5)}
    edges = group_percentile(reference, by, covariate, probs)
    q = sum((F.when(F.col(covariate) >= F.col(e), 1).otherwise(0) for e in probs), F.lit(0)).alias("bin")
    ref = reference.join(edges, by).select(*by, q).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"))
    bins = edges.select(*by, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("bin")).join(ref, [*by, "bin"], "left").fillna(0).join(wanted, by)
    w = Window.partitionBy(*by)                                             # five bins per group
    exact = F.col("k") / F.sum("k").over(w) * F.col("want")
    bins = bins.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    rem = F.round(F.col("exact") - F.col("base"), 9)
    left = F.col("want") - F.sum("base").over(w)
    bins = bins.withColumn("quota", F.col("base") + (F.row_number().over(w.orderBy(F.desc(rem), "bin")) <= left).cast("long"))
    p = checkpointed(pool.join(edges, by).select("unit_id", *by, q))
    r = hash_rank(p, [*by, "bin"], seed, ["unit_id"], out="__r").join(bins.select(*by, "bin", "quota"), [*by, "bin"])
    first = r.where(F.col("__r") <= F.col("quota")).select("unit_id", *by, "bin", F.lit(False).alias("filled"))
    got = first.groupBy(*by).agg(F.count(F.lit(1)).alias("__got"))
    rest = hash_rank(p.join(first.select("unit_id"), "unit_id", "left_anti"), by, f"{seed}f", ["unit_id"], out="__r")
    short = rest.join(wanted, by).join(got, by, "left").where(F.col("__r") <= F.col("want") - F.coalesce(F.col("__got"), F.lit(0)))
    return first.unionByName(short.select("unit_id", *by, "bin", F.lit(True).alias("filled")))


def shuffle_labels(df: DataFrame, by: list[str], label: str, seed) -> DataFrame:
    """A label permuted inside each group: rows numbered in two independent seeded orders and joined."""
    rows = hash_rank(df.drop(label), by, f"{seed}a", ["unit_id"], out="__r")
    labels = hash_rank(df.select(*by, "unit_id", label), by, f"{seed}b", ["unit_id"], out="__r").drop("unit_id")
    return rows.join(labels, [*by, "__r"]).drop("__r")


# ---- chains of stages (result tables)
def stage_walk(stages: DataFrame, by: list[str]) -> DataFrame:
    """Along an ordered chain: the last supported stage before the first rejected one and the pending stages between.
    ``stages``: pos, stage, verdict; a chain is a declared list of a few stages."""
    w = Window.partitionBy(*by).orderBy("pos")
    d = stages.withColumn("__last", F.last(F.when(F.col("verdict") == "support", F.struct("pos", "stage")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__rej", F.min(F.when(F.col("verdict") == "reject", F.col("pos"))).over(Window.partitionBy(*by)))
    end = F.coalesce(F.col("__rej"), F.lit(1 << 30))
    upto = d.where(F.col("pos") <= end)
    g = upto.groupBy(*by).agg(F.max_by("__last", "pos").alias("__l"), F.max(F.when(F.col("pos") == F.col("__rej"), F.col("stage"))).alias("rejected"),
                              F.sort_array(F.collect_list(F.struct("pos", "stage", "verdict"))).alias("__s"))
    pend = F.transform(F.filter("__s", lambda s: (s["verdict"] == "unresolved") & (s["pos"] > F.coalesce(F.col("__l.pos"), F.lit(-1)))), lambda s: s["stage"])
    return g.select(*by, F.col("__l.stage").alias("last_supported"), "rejected", F.array_join(pend, ",").alias("pending"))


def step_difference(draws: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """Change of a statistic from each stage to the next, draw by draw, with its percentile interval; draw 0 is the
    point. ``draws``: pos, stage, draw, value."""
    w = Window.partitionBy(*by, "draw").orderBy("pos")
    d = draws.withColumn("from_stage", F.lag("stage").over(w)).withColumn("__d", F.col("value") - F.lag("value").over(w)).where(F.col("from_stage").isNotNull())
    b = F.when(F.col("draw") > 0, F.col("__d"))
    return d.groupBy(*by, "from_stage", F.col("stage").alias("to_stage")).agg(
        F.max(F.when(F.col("draw") == 0, F.col("__d"))).alias("step"), F.percentile(b, F.lit(alpha / 2)).alias("lo"), F.percentile(b, F.lit(1 - alpha / 2)).alias("hi"))

"""Normalisation and preparation of long count tables; splits."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import group_percentile, hash_rank


def densify(long: DataFrame, features: list[str], value: str) -> DataFrame:
    """Wide view, one column per declared feature; an absent feature is 0."""
    g = long.groupBy("unit_id").pivot("feature", features).agg(F.first(value))
    return g.fillna(0.0, subset=features)


def size_factors(counts: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Unit total over the median of positive totals; a total of 0 or less gets 1."""
    t = counts.groupBy("unit_id").agg(F.sum("count").alias("total"))
    if units is not None:
        t = units.select("unit_id").join(t, "unit_id", "left").fillna(0.0, subset=["total"])
    med = group_percentile(t.where("total > 0"), [], "total", {"m": 0.5})
    return t.withColumn("size_factor", F.when(F.col("total") > 0, F.col("total") / med.scalar()).otherwise(1.0))


def eval_size_factor(factors: DataFrame, split: DataFrame, evaluated: DataFrame, mode: str) -> DataFrame:
    """Size factor of evaluated units: 'train_median' (train units not evaluated), 'one' or 'measured'.
    An evaluated unit that is also a train unit is an error."""
    ev = evaluated.select("unit_id")
    train = split.where("split = 'train'").select("unit_id")
    overlap = ev.join(train, "unit_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    ev = ev.where(F.when(overlap > 0, F.raise_error(F.lit("evaluated units occur in the train split")).cast("boolean")).otherwise(True))
    if mode == "one":
        return ev.withColumn("size_factor", F.lit(1.0))
    if mode == "measured":
        return ev.join(factors.select("unit_id", "size_factor"), "unit_id")
    med = group_percentile(factors.join(train, "unit_id", "left_semi").join(ev, "unit_id", "left_anti"), [], "size_factor", {"m": 0.5})
    return ev.withColumn("size_factor", med.scalar())


def log1p_cp10k(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p(x / max(total, 1) * scale) per entry; the total is a per-unit aggregate (a unit is one panel wide)."""
    tot = F.sum("count").over(Window.partitionBy("unit_id"))
    return counts.withColumn("value", F.log1p(F.col("count") / F.greatest(tot, F.lit(1.0)) * F.lit(scale)))


def mean_log_readout(counts: DataFrame, pattern: str, left_out: list[str], n_features: int | None = None, scale: float = 1e4) -> DataFrame:
    """Mean over the selected features of log1p CP10k; an absent feature counts as 0."""
    sel = F.col("feature").rlike(pattern) & ~F.col("feature").isin(left_out)
    k = F.lit(n_features) if n_features else counts.where(sel).agg(F.count_distinct("feature").alias("k")).scalar()
    s = log1p_cp10k(counts, scale).groupBy("unit_id").agg(F.coalesce(F.sum(F.when(sel, F.col("value"))), F.lit(0.0)).alias("__s"))
    return s.select("unit_id", (F.col("__s") / k).alias("y"))


def clr(panel: DataFrame, value: str, form: str, n_features: int, eps: float = 1e-6) -> DataFrame:
    """Centred log ratios over a panel of ``n_features`` (an absent feature is 0).

    'log1p': log1p(x) - mean log1p x; 'log': log(max(x, 0) + eps) minus its mean; 'geometric': log1p(x / g)."""
    w = Window.partitionBy("unit_id")
    x = F.col(value).cast("double")
    if form == "log":
        lx = F.log(F.greatest(x, F.lit(0.0)) + F.lit(eps))
        mean = (F.sum(lx).over(w) + (F.lit(n_features) - F.count(F.lit(1)).over(w)) * F.log(F.lit(eps))) / n_features
        return panel.withColumn("clr", lx - mean)
    mean = F.sum(F.log1p(x)).over(w) / F.lit(n_features)
    return panel.withColumn("clr", F.log1p(x) - mean if form == "log1p" else F.log1p(x / F.exp(mean)))


def clr_readout(panel: DataFrame, value: str, features: list[str], n_features: int, log_only: bool = False) -> DataFrame:
    """Mean over the chosen features of CLR (or of log1p)."""
    w = Window.partitionBy("unit_id")
    lx = F.log1p(F.col(value).cast("double"))
    mean = F.lit(0.0) if log_only else F.sum(lx).over(w) / F.lit(n_features)
    d = panel.withColumn("__m", mean).withColumn("__l", lx)
    return (d.groupBy("unit_id").agg(((F.coalesce(F.sum(F.when(F.col("feature").isin(features), F.col("__l"))), F.lit(0.0)))
                                      / len(features) - F.first("__m")).alias("y")))


def depth_features(counts: DataFrame) -> DataFrame:
    return counts.groupBy("unit_id").agg(F.log(F.greatest(F.sum("count"), F.lit(1.0))).alias("log_total"),
                                         F.log(F.greatest(F.count(F.lit(1)), F.lit(1))).alias("log_detected"))


def median_scaled(counts: DataFrame, medians: DataFrame, normalised_total: float = 1e4) -> DataFrame:
    """x / total * scale / feature median; a feature without a median keeps factor 1."""
    tot = F.sum("count").over(Window.partitionBy("unit_id"))
    return (counts.withColumn("__v", F.col("count") / tot * F.lit(normalised_total)).join(medians, "feature", "left")
                  .withColumn("value", F.col("__v") * F.coalesce(1.0 / F.col("median"), F.lit(1.0))).drop("__v", "median"))


def panel_free_shares(stored: DataFrame, panel_features: list[str], scale: float = 1e4) -> DataFrame:
    """log1p(scale * share) over the non-panel features of u = max(expm1(stored), 0); a unit without any gets 0."""
    d = stored.where(~F.col("feature").isin(panel_features)).withColumn("u", F.greatest(F.expm1("stored"), F.lit(0.0)))
    # added up in the order of the features: the last digits of a sum of doubles depend on its order
    w = Window.partitionBy("unit_id").orderBy("feature", "u").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tot = F.sum("u").over(w)
    return d.select("unit_id", "feature", F.when(tot > 0, F.log1p(F.lit(scale) * F.col("u") / tot)).otherwise(0.0).alias("w"))


def panel_invariance(stored: DataFrame, panel_features: list[str], overwrite) -> DataFrame:
    """Units whose panel-free shares change when the stored panel values are overwritten (must be 0)."""
    before = panel_free_shares(stored, panel_features)
    poisoned = stored.withColumn("stored", F.when(F.col("feature").isin(panel_features), overwrite).otherwise(F.col("stored")))
    after = panel_free_shares(poisoned, panel_features).withColumnRenamed("w", "w2")
    j = before.join(after, ["unit_id", "feature"], "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~F.col("w").eqNullSafe(F.col("w2"))).cast("long")), F.lit(0)).alias("n_changed"))


def donor_site_split(units: DataFrame, test_sites: list[str], val_share: float, seed) -> DataFrame:
    """Rows of a test site are 'test'; of the other rows' groups a seeded max(1, round(n * share)) are 'val'; halves go to the even number.
    Site names compare in lower case without spaces. A group may be in train and in test at another site."""
    clean = lambda c: F.lower(F.regexp_replace(c, " ", ""))
    is_test = clean(F.col("site")).isin([s.lower().replace(" ", "") for s in test_sites])
    g = units.where(~is_test).select("group_id").distinct()                 # one row per group
    n = g.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = hash_rank(g, [], seed, ["group_id"], out="__rk").withColumn("__n", n)
    val = F.col("__rk") <= F.greatest(F.lit(1), F.rint(F.col("__n") * val_share))
    return (units.join(g, "group_id", "left")
                 .withColumn("split", F.when(is_test, "test").when(val, "val").otherwise("train")).drop("__rk", "__n"))


def q_scale(panel: DataFrame, split: DataFrame, value: str, prob: float = 0.95, floor: float | None = None) -> DataFrame:
    """Per-feature percentile over train units; a scale below ``floor`` becomes 1."""
    tr = panel.join(split.where("split = 'train'").select("unit_id"), "unit_id", "left_semi")
    q = group_percentile(tr, ["feature"], value, {"q": prob})
    return q if floor is None else q.withColumn("q", F.when(F.col("q") < floor, 1.0).otherwise(F.col("q")))


def evidence(panel: DataFrame, q: DataFrame, value: str, clip: bool = True, eps: float = 1e-12, out: str = "v") -> DataFrame:
    """clip(value / max(q, eps), 0, 1)"""
    v = F.col(value) / F.greatest(F.col("q"), F.lit(eps))
    return panel.join(q, "feature").withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if clip else v)


def detected_feature_filter(counts: DataFrame, control_units: DataFrame, min_share: float = 0.01) -> DataFrame:
    """Features present in at least a share of the control units, with that share."""
    n = control_units.select("unit_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    c = counts.join(control_units.select("unit_id").distinct(), "unit_id", "left_semi")
    return (c.where("count > 0").groupBy("feature").agg((F.count_distinct("unit_id") / n).alias("share")).where(F.col("share") >= min_share))


def standardise_on_reference(long: DataFrame, reference: DataFrame, value: str = "value", by: list[str] = ["feature"]) -> DataFrame:
    """(x - mean) / sd with mean and population sd of the reference rows; an sd below 1e-8 becomes 1."""
    s = (long.join(reference.select("unit_id").distinct(), "unit_id", "left_semi")
             .groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s")))
    sd = F.when(F.col("__s") < 1e-8, 1.0).otherwise(F.col("__s"))
    return long.join(s, by).withColumn("z", (F.col(value) - F.col("__m")) / sd).drop("__m", "__s")


def stack_studies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two wide studies under one another; a feature a study did not measure is NULL."""
    return a.withColumn("study", F.lit("first")).unionByName(b.withColumn("study", F.lit("second")), allowMissingColumns=True)

"""Response audit: cross-fitted residuals, unexplained fraction, verdicts, localisation of a loss."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from ..functions.vectors import dot
from .fit import crossfit, gram_table, leave_out, ridge_solve
from .metrics import auroc
from .resample import drawn_sums, element_sums
from .selection import stage_walk

VIEWS: dict[str, Callable] = {}
OUTCOMES: dict[str, Callable] = {}


def register_view(name: str):
    """Registers ``fn(units, arg) -> (unit_id, x)`` under an operation name; a node asks for it as 'name:arg'."""
    def wrap(fn):
        VIEWS[name] = fn
        return fn
    return wrap


def register_outcome(name: str):
    """Registers ``fn(units, arg) -> (unit_id, y)``."""
    def wrap(fn):
        OUTCOMES[name] = fn
        return fn
    return wrap


def resolve(table: dict[str, Callable], op: str, units: DataFrame) -> DataFrame:
    name, _, arg = op.partition(":")
    if name not in table:
        raise ValueError(f"unknown operation {op!r}: one of {sorted(table)}")
    return table[name](units, arg or None)


# ---- residuals
def crossfit_residuals(rows: DataFrame, views: dict[str, DataFrame], k: int, classes: dict[str, dict], a: str = "a", y: str = "y") -> DataFrame:
    """(unit_id, state, cls, ra, ry): out-of-fold residuals of the treatment and of the outcome on every view for every
    learner class. rows: unit_id, fold, a, y; a view: unit_id, x (array). classes: name -> {regressor, classifier, ...}."""
    out = None
    if any(s["regressor"] == "gram_ridge" == s["classifier"] for s in classes.values()):
        # every view and both targets from one table of cross products
        long = None
        for state, x in views.items():
            v = x.select("unit_id", F.lit(state).alias("state"), F.transform("x", lambda e: e.cast("double")).alias("x"))
            long = v if long is None else long.unionByName(v)
        d = checkpointed(long.join(rows.select("unit_id", "fold", F.col(a).cast("double").alias("__a"), F.col(y).cast("double").alias("__y")), "unit_id"))
        g = checkpointed(leave_out(gram_table(d, ["state", "fold"], "x", ["__a", "__y"]), "fold", ["state"]))
        for cls, spec in classes.items():
            if spec["regressor"] == "gram_ridge" == spec["classifier"]:
                c = ridge_solve(g, ["state", "fold"], None, [float(spec.get("alpha", 1.0))], bool(spec.get("standardise")), n_targets=2)
                c = c.groupBy("state", "fold").agg(*[F.max(F.when(F.col("target") == t, F.struct("intercept", "coef"))).alias(f"__m{t}") for t in (0, 1)])
                p = [F.col(f"__m{t}.intercept") + dot(F.col(f"__m{t}.coef"), "x") for t in (0, 1)]
                r = d.join(c, ["state", "fold"]).select("unit_id", "state", F.lit(cls).alias("cls"), (F.col("__a") - p[0]).alias("ra"), (F.col("__y") - p[1]).alias("ry"))
                out = r if out is None else out.unionByName(r)
    for state, x in views.items():
        d = rows.select("unit_id", "fold", a, y).join(x.select("unit_id", "x"), "unit_id")
        for cls, spec in classes.items():
            if spec["regressor"] == "gram_ridge" == spec["classifier"]:
                continue
            ra = crossfit(d, a, k, spec, "e").select("unit_id", (F.col(a) - F.col("pred")).alias("ra"))
            ry = crossfit(d, y, k, spec, "m").select("unit_id", (F.col(y) - F.col("pred")).alias("ry"))
            r = ra.join(ry, "unit_id").select("unit_id", F.lit(state).alias("state"), F.lit(cls).alias("cls"), "ra", "ry")
            out = r if out is None else out.unionByName(r)
    return out


def unexplained_fraction(rows: DataFrame, residuals: DataFrame, draws: DataFrame, a: str = "a", y: str = "y", cluster: str = "cluster") -> DataFrame:
    """(state, cls, draw, theta, delta, u): theta = sum ry ra / sum ra^2, delta the same on the centred outcome and
    treatment, u = theta / delta. Both come from sums per resampled element, so draws never copy rows."""
    m = rows.agg(F.avg(a).alias("ma"), F.avg(y).alias("my"))
    c = rows.withColumn("__a", F.col(a) - m.select("ma").scalar()).withColumn("__y", F.col(y) - m.select("my").scalar())
    s0 = element_sums(c, a, cluster, {"s1": F.col("__y") * F.col("__a"), "s2": F.col("__a") * F.col("__a")})
    d0 = drawn_sums(s0, draws, [], ["s1", "s2"]).select("draw", (F.col("s1") / F.col("s2")).alias("delta"))
    r = residuals.join(rows.select("unit_id", a, cluster), "unit_id")
    s = element_sums(r, a, cluster, {"s1": F.col("ry") * F.col("ra"), "s2": F.col("ra") * F.col("ra")}, ["state", "cls"])
    t = drawn_sums(s, draws, ["state", "cls"], ["s1", "s2"]).select("state", "cls", "draw", (F.col("s1") / F.col("s2")).alias("theta"))
    return t.join(d0, "draw").withColumn("u", F.when(F.col("delta") != 0, F.col("theta") / F.col("delta")))


def forward_auc(rows: DataFrame, residuals: DataFrame, draws: DataFrame, a: str = "a", cluster: str = "cluster") -> DataFrame:
    """(state, cls, draw, auroc): AUC of the out-of-fold probability of treatment, weighted by the draw's multiplicities."""
    el = F.when(F.col(a) == 1, F.col(cluster).cast("string")).otherwise(F.concat(F.lit("unit:"), F.col("unit_id").cast("string")))
    r = residuals.join(rows.select("unit_id", a, cluster), "unit_id").select("state", "cls", F.col(a).alias("a"), el.alias("element"), F.round(F.col(a) - F.col("ra"), 12).alias("score"))
    # equal scores of an element collapse before the draws multiply them
    r = checkpointed(r.groupBy("state", "cls", "a", "element", "score").agg(F.count(F.lit(1)).alias("k")))
    w = r.join(draws, ["a", "element"]).select("state", "cls", "draw", "score", "a", (F.col("w") * F.col("k")).alias("w"))
    w = w.unionByName(r.select("state", "cls", F.lit(0).alias("draw"), "score", "a", F.col("k").alias("w")))
    return auroc(w, ["state", "cls", "draw"], "score", "a", "w")


# ---- verdicts
def verdict(lo: Column, hi: Column, margin: float, signed: bool = False) -> Column:
    """support: the upper bound is below the margin; reject: the lower bound above it. ``signed`` reads both sides."""
    if signed:
        return F.when((lo > -margin) & (hi < margin), "support").when((lo > margin) | (hi < -margin), "reject").otherwise("unresolved")
    return F.when(hi < margin, "support").when(lo > margin, "reject").otherwise("unresolved")


def verdict_union(table: DataFrame, by: list[str], margin: float, signed: bool = False) -> DataFrame:
    """Over the declared learner classes: support if some class supports (the one with the tightest bound), reject only
    if every class rejects, else unresolved (the class with the smallest u). table: cls, u, lo, hi."""
    d = table.withColumn("__v", verdict(F.col("lo"), F.col("hi"), margin, signed))
    bound = F.greatest(F.abs("lo"), F.abs("hi")) if signed else F.col("hi")
    size = F.abs("u") if signed else F.col("u")
    best_s, best_u = F.min_by("cls", F.when(F.col("__v") == "support", F.struct(bound.alias("b"), F.col("cls")))), F.min_by("cls", F.struct(size.alias("b"), F.col("cls")))
    g = d.groupBy(*by).agg(F.bool_or(F.col("__v") == "support").alias("__s"), F.bool_and(F.col("__v") == "reject").alias("__r"), best_s.alias("__bs"), best_u.alias("__bu"))
    g = g.select(*by, F.when(F.col("__s"), "support").when(F.col("__r"), "reject").otherwise("unresolved").alias("verdict"), F.when(F.col("__s"), F.col("__bs")).otherwise(F.col("__bu")).alias("cls"))
    return g.join(table, [*by, "cls"])


def localise_loss(runs: DataFrame, stages: DataFrame, steps: DataFrame, by: list[str], step_margin: float) -> DataFrame:
    """Where along a chain a response is lost. runs: delta_lo, delta_hi, control (verdict of the positive control or NULL);
    stages: pos, stage, verdict; steps: pos, from_stage, to_stage, lo. First match: no_effect, control_failed,
    relative_loss_at / reference_unresolved (when the first stage is not supported), loss_at, unresolved, no_deficit."""
    ref = stages.groupBy(*by).agg(F.min_by("verdict", "pos").alias("ref_verdict"))
    walk = stage_walk(stages, by)
    rel = steps.where(F.col("lo") > step_margin).groupBy(*by).agg(F.min_by(F.struct("from_stage", "to_stage"), "pos").alias("__rel"))
    d = runs.join(ref, by, "left").join(walk, by, "left").join(rel, by, "left")
    none = F.lit(None).cast("string")
    cause = (F.when((F.col("delta_lo") <= 0) & (F.col("delta_hi") >= 0), "no_effect").when(F.coalesce(F.col("control") != "support", F.lit(False)), "control_failed")
              .when((F.col("ref_verdict") != "support") & F.col("__rel").isNotNull(), "relative_loss_at").when(F.col("ref_verdict") != "support", "reference_unresolved")
              .when(F.col("rejected").isNotNull(), "loss_at").when(F.col("pending") != "", "unresolved").otherwise("no_deficit"))
    d = d.withColumn("cause", cause)
    return d.select(*by, "cause", F.when(F.col("cause") == "relative_loss_at", F.col("__rel.from_stage")).when(F.col("cause") == "loss_at", F.col("last_supported")).otherwise(none).alias("from_stage"),
                    F.when(F.col("cause") == "relative_loss_at", F.col("__rel.to_stage")).when(F.col("cause") == "loss_at", F.col("rejected")).otherwise(none).alias("to_stage"),
                    F.when(F.col("cause").isin("loss_at", "unresolved"), F.col("pending")).otherwise("").alias("pending"))


def reread_verdicts(draws: DataFrame, by: list[str], margin: float, alpha: float, signed: bool = False) -> DataFrame:
    """Verdicts under another margin from the stored draws: by (run, outcome, stage), cls, draw, u."""
    b = F.when(F.col("draw") > 0, F.col("u"))
    iv = draws.groupBy(*by, "cls").agg(F.max(F.when(F.col("draw") == 0, F.col("u"))).alias("u"), F.percentile(b, F.lit(alpha / 2)).alias("lo"), F.percentile(b, F.lit(1 - alpha / 2)).alias("hi"))
    return verdict_union(iv, by, margin, signed)

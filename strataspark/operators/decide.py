"""Weighted scores, the linear evidence field, channel fusion and re-decision under edits (row expressions)."""
from __future__ import annotations

from dataclasses import dataclass, field as dc_field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.draws import binomial, draw_key, uniform


# ---- questions (weighted criteria)
@dataclass
class Question:
    """Declared weights of a question over a class panel."""
    panel: dict[str, list[str]]
    key_marker: dict[str, str]
    feature_weight: float = 1.0
    key_boost: float = 1.0
    secondary_weight: float = 1.0
    class_weight: dict[str, float] = dc_field(default_factory=dict)
    threshold: float = 0.0
    margin: float = 0.0

    def raw(self) -> dict[str, float]:
        return {f: self.feature_weight * (self.key_boost if self.key_marker[c] == f else self.secondary_weight) * self.class_weight.get(c, 1.0)
                for c, fs in self.panel.items() for f in fs}

    def weights(self) -> dict[str, float]:
        """each weight over the largest"""
        w = self.raw()
        top = max(w.values())
        return {f: (x / top if top > 0 else 0.0) for f, x in w.items()}

    def normaliser(self) -> float:
        """largest weight sum of a class, so that the strongest class saturates at 1"""
        w = self.weights()
        return max(sum(w[f] for f in fs) for fs in self.panel.values()) or 1.0

    def scale(self) -> float:
        return max(self.class_weight.get(c, 1.0) for c in self.panel)


def weighted_class_scores(evidence: DataFrame, q: Question, value: str = "v") -> DataFrame:
    """S_c = sum of weight * evidence over the class panel / normaliser; one conditional aggregate by unit."""
    w, c0 = q.weights(), q.normaliser()
    aggs = []
    for c, fs in q.panel.items():
        wc = F.coalesce(*[F.when(F.col("feature") == f, F.lit(w[f])) for f in fs])
        aggs.append((F.coalesce(F.sum(wc * F.col(value)), F.lit(0.0)) / c0).alias(c))
    return evidence.groupBy("unit_id").agg(*aggs)


def legacy_class_scores(evidence: DataFrame, q: Question, mode: str, value: str = "v") -> DataFrame:
    """Earlier scale. 'key_marker_priority': weighted panel mean; 'equal_panel_mean': mean with the boosted key value
    clipped at 1; both times the class weight."""
    aggs = []
    for c, fs in q.panel.items():
        k = F.col("feature") == q.key_marker[c]
        on = F.col("feature").isin(fs)
        if mode == "key_marker_priority":
            s = F.coalesce(F.sum(F.when(on, F.col(value) * F.when(k, 1.0).otherwise(q.secondary_weight))), F.lit(0.0))
            den = 1.0 + q.secondary_weight * (len(fs) - 1)
            base = s / den
        else:
            x = F.when(k & F.lit(q.key_boost != 1.0), F.least(F.lit(1.0), F.col(value) * q.key_boost)).otherwise(F.col(value))
            base = F.coalesce(F.sum(F.when(on, x)), F.lit(0.0)) / len(fs)
        aggs.append((base * q.class_weight.get(c, 1.0)).alias(c))
    return evidence.groupBy("unit_id").agg(*aggs)


def event_value(value: str, is_key: str, action: str, q: Question, reliability: Column | None = None) -> Column:
    """weight * clip(value, 0, 1), optionally times the declared reliability of the modality mask"""
    top = max(q.raw().values())
    w = F.lit(q.feature_weight) * F.when(F.col(is_key), q.key_boost).otherwise(q.secondary_weight)
    cw = F.coalesce(*[F.when(F.col(action) == c, F.lit(q.class_weight.get(c, 1.0))) for c in q.panel], F.lit(1.0))
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * w * cw / top
    return v if reliability is None else v * reliability


def modality_reliability(mask: str, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col(mask) == m, F.lit(float(r))) for m, r in table.items()], F.lit(1.0))


# ---- linear field
@dataclass
class Field:
    """A star of n event sites around one action site; weights of the two edge directions are fixed values."""
    steps: int = fixed.FIELD_STEPS
    retention: float = fixed.FIELD_RETENTION
    diffusion: float = fixed.FIELD_DIFFUSION
    source_scale: float = fixed.FIELD_SOURCE_SCALE
    forward_weight: float = fixed.FIELD_FORWARD_WEIGHT
    feedback_weight: float = fixed.FIELD_FEEDBACK_WEIGHT

    def response(self, n: int, ticks: int, propagate: bool = True) -> tuple[float, float]:
        """(action state, sum of event states) after ``ticks`` updates for a unit total injected at the first one.

        By symmetry only (action, sum of sites) matters, so the field is a power of a 2 x 2 matrix."""
        r, d = self.retention, (self.diffusion if propagate else 0.0)
        step = np.array([[r, d * self.forward_weight * r], [n * d * self.feedback_weight * r, r]])
        start = np.array([d * self.forward_weight, 1.0]) * self.source_scale
        a, e = np.linalg.matrix_power(step, max(ticks - 1, 0)) @ start if ticks > 0 else (0.0, 0.0)
        return float(a), float(e)

    def gain(self, n: int) -> float:
        return self.response(n, self.steps + 1)[0]

    def deletion_ratio(self, n: int) -> float:
        return 1.0 if n <= 1 else self.gain(n - 1) / self.gain(n)


def field_scores(evidence: DataFrame, panel: dict[str, list[str]], fld: Field, closure: tuple[float, float, float] | None = None, value: str = "v") -> DataFrame:
    """Action score per class, all events at once: G(n) * sum. With ``closure`` weights (least site, mean site, action)
    the read-out over the event sites: every site ends at keep * v + a share of the feedback common to all sites."""
    aggs = []
    for c, fs in panel.items():
        n, on = len(fs), F.col("feature").isin(fs)
        s = F.coalesce(F.sum(F.when(on, F.col(value))), F.lit(0.0))
        a = s * fld.gain(n)
        if closure is None:
            aggs.append(a.alias(c))
            continue
        low = F.when(F.count(F.when(on, 1)) < n, F.least(F.lit(0.0), F.coalesce(F.min(F.when(on, F.col(value))), F.lit(0.0)))).otherwise(F.min(F.when(on, F.col(value))))
        keep = fld.source_scale * fld.retention ** fld.steps
        mean_site = s * (fld.response(n, fld.steps + 1)[1] / n)
        least_site = low * keep + mean_site - s * (keep / n)
        aggs.append((closure[0] * least_site + closure[1] * mean_site + closure[2] * a).alias(c))
    return evidence.groupBy("unit_id").agg(*aggs)


def field_threshold(fld: Field, n: int, bar: float) -> float:
    return fld.gain(n) * n * bar


# ---- fusion of two channels
def fuse(classes: list[str], how: str, trust: tuple[float, float] = (1.0, 1.0), a: str = "a_", b: str = "b_") -> list[Column]:
    """'mean' or 'trust': (weighted) average of two channels' class scores (columns a_<class>, b_<class>)."""
    t1, t2 = (1.0, 1.0) if how == "mean" or sum(trust) <= 0 else trust
    return [((F.lit(t1) * F.col(a + c) + F.lit(t2) * F.col(b + c)) / (t1 + t2)).alias(c) for c in classes]


def fuse_field(classes: list[str], n_panel: dict[str, int], fld: Field, scale: tuple[float, float], delay: int = 0, contradiction: bool = True,
               factor: float = fixed.CONTRADICTION_FACTOR, a: str = "a_", b: str = "b_") -> list[Column]:
    """Field scores of two channels: supports s * n * S and, from each channel, one contradiction of half its top score
    against every other class. The response constant depends on the number of sites of a class (2n, 2n + 1 or 2n + 2)."""
    total = fld.steps + 1 + max(0, delay)
    ticks = (total, total - delay)
    out = []
    tops = [(F.greatest(*[F.col(p + k) for k in classes]), argmax_prefixed(classes, p)) for p in (a, b)]
    for c in classes:
        n = n_panel[c]
        hits = [(tops[j][1] != c) if contradiction else F.lit(False) for j in (0, 1)]
        score = F.lit(0.0)
        for j, p in enumerate((a, b)):
            drive = F.lit(scale[j] * n) * F.col(p + c) - F.when(hits[j], F.lit(scale[j] * factor) * tops[j][0]).otherwise(0.0)
            extra = hits[0].cast("int") + hits[1].cast("int")
            resp = F.coalesce(*[F.when(extra == x, F.lit(fld.response(2 * n + x, ticks[j])[0])) for x in (0, 1, 2)])
            score = score + resp * drive
        out.append(score.alias(c))
    return out


def argmax_prefixed(classes: list[str], prefix: str) -> Column:
    arr = F.array(*[F.col(prefix + c) for c in classes])
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(arr, F.array_max(arr)).cast("int"))


# ---- edits
def deletion_flips(classes: list[str], call: str, top_value: str, n: int, bar: float, rho: float = 1.0) -> Column:
    """Deleting the called class's top event flips the call: rho * (S_called - v_top / n) < max(bar, best other).
    rho = 1 is the form that zeroes the event instead of deleting its site."""
    own = F.coalesce(*[F.when(F.col(call) == c, F.col(c)) for c in classes])
    other = F.greatest(*[F.when(F.col(call) != c, F.col(c)) for c in classes])
    return F.lit(rho) * (own - F.col(top_value) / n) < F.greatest(F.lit(bar), other)


def edit_context(events: DataFrame, scores: DataFrame, classes: list[str], n_panel: dict[str, int]) -> DataFrame:
    """What a change of one event needs: the score of its class, the best other class (first in class order) and its
    score, and whether the event's class comes first on ties. Only the event's class moves under an edit.
    events: unit_id, feature, cls, v; scores: unit_id, classes..., call."""
    d = events.join(scores, "unit_id")
    pos = lambda c: F.array_position(F.array(*[F.lit(k) for k in classes]), c)
    others = F.array(*[F.when(F.col("cls") != c, F.col(c)) for c in classes])
    d = d.withColumn("__own", F.coalesce(*[F.when(F.col("cls") == c, F.col(c)) for c in classes]))
    d = d.withColumn("__n", F.coalesce(*[F.when(F.col("cls") == c, F.lit(n_panel[c])) for c in classes])).withColumn("__o", F.array_max(others))
    d = d.withColumn("__oc", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(others, F.col("__o")).cast("int")))
    return d.withColumn("__first", pos(F.col("cls")) < pos(F.col("__oc")))


def call_at(new_value: Column, bar: float) -> Column:
    """Call when the event takes ``new_value`` (over the columns of edit_context)."""
    s = F.col("__own") + (new_value - F.col("v")) / F.col("__n")
    wins = (s > F.col("__o")) | ((s == F.col("__o")) & F.col("__first"))
    return F.when(wins, F.when(s >= bar, F.col("cls")).otherwise("")).otherwise(F.when(F.col("__o") >= bar, F.col("__oc")).otherwise(""))


def decision_under_edit(events: DataFrame, scores: DataFrame, classes: list[str], n_panel: dict[str, int], bar: float, grid: int = 21) -> DataFrame:
    """Per (unit, feature): change of the chosen score when the event is removed, whether the call flips, and the
    nearest grid value of the event that flips it. Everything stays inside the row; no grid is exploded."""
    d = edit_context(events, scores, classes, n_panel)
    removed = call_at(F.lit(0.0), bar)
    steps = F.array(*[F.lit(k / (grid - 1)) for k in range(grid)])
    dist = F.array_min(F.transform(F.filter(steps, lambda g: call_at(g, bar) != F.col("call")), lambda g: F.abs(g - F.col("v"))))
    chosen = F.when(F.col("call") == F.col("cls"), -F.col("v") / F.col("__n")).otherwise(0.0)
    return d.select("unit_id", "feature", "call", removed.alias("call_removed"), (removed != F.col("call")).alias("flipped"), chosen.alias("delta_chosen"), dist.alias("flip_distance"))


def nudge_flips(bar: float, eps: float) -> dict[str, Column]:
    """Flip flags of the call when the event moves by +-eps and +-eps/2 (values stay in [0, 1]), over edit_context."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    flip = lambda dv: call_at(clip(F.col("v") + dv), bar) != F.col("call")
    return {"up": flip(eps), "down": flip(-eps), "half_up": flip(eps / 2), "half_down": flip(-eps / 2)}


# ---- perturbed counts
def recover_counts(stored: DataFrame, value: str, abs_tol: float = fixed.COUNT_TOL_ABS, rel_tol: float = fixed.COUNT_TOL_REL) -> DataFrame:
    """count = value / smallest positive value of the unit, rounded; ratio of the deviation to its tolerance."""
    unit = F.min(F.when(F.col(value) > 0, F.col(value))).over(Window.partitionBy("unit_id"))
    q = F.col(value) / unit
    d = stored.withColumn("__q", q)
    return d.withColumn("recovered", F.rint("__q").cast("long")).withColumn("deviation", F.abs(F.col("__q") - F.rint("__q")) / (F.lit(abs_tol) + F.lit(rel_tol) * F.rint("__q"))).drop("__q")


def thin_counts(counts: DataFrame, keep: float, seed, out: str = "thinned") -> DataFrame:
    """Binomial thinning: every counted item is kept with probability ``keep``; one draw of O(log count) steps a row, for
    whole counts up to 2^53."""
    return counts.withColumn(out, F.when(F.col("count") >= 1, binomial("count", keep, seed, "unit_id", "feature")).otherwise(F.lit(0).cast("long")))


def count_split(counts: DataFrame, seed) -> DataFrame:
    """Two independent halves of every count: thinning at one half and its complement."""
    return thin_counts(counts, 0.5, seed, "half_a").withColumn("half_b", F.col("count").cast("long") - F.col("half_a"))


def dropout_inputs(inputs: DataFrame, share: float, seed, n_inputs: int, value: str = "w") -> DataFrame:
    """round(share * n_inputs) seeded inputs of every unit set to 0 (a unit is one panel wide)."""
    k = int(round(share * n_inputs))
    rn = F.row_number().over(Window.partitionBy("unit_id").orderBy(draw_key(seed, "unit_id", "feature"), "feature"))
    return inputs.withColumn(value, F.when(rn <= k, 0.0).otherwise(F.col(value)))


def rank_encode(values: DataFrame, max_len: int, value: str = "value", token: str = "token") -> DataFrame:
    """Tokens of a unit in the order of value (largest first, token order on ties), zeros dropped, at most ``max_len``."""
    g = values.where(F.col(value) > 0).groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(token).alias("t")))).alias("__s"))
    return g.select("unit_id", F.transform(F.slice("__s", 1, max_len), lambda s: s["t"]).alias("tokens"))


def rank_view(encoded: DataFrame, width: int = 2049) -> DataFrame:
    """(width - rank) / (width - 1) per kept token, presence 1; an absent token is 0 (no row)."""
    d = encoded.select("unit_id", F.posexplode("tokens").alias("p", "token"))
    return d.select("unit_id", "token", ((F.lit(width) - (F.col("p") + 1)) / F.lit(float(width - 1))).alias("value"), F.lit(1).alias("present"))


def scale_feature(values: DataFrame, feature: str, eps: list[float], max_len: int, value: str = "value", token: str = "token") -> DataFrame:
    """Token arrays of every variant in which one feature is multiplied by 1 - eps, and whether they equal the base."""
    v = values.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in [0.0, *eps]])))
    v = v.withColumn(value, F.when(F.col(token) == feature, F.col(value) * (1 - F.col("eps"))).otherwise(F.col(value)))
    g = v.where(F.col(value) > 0).groupBy("unit_id", "eps").agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(token).alias("t")))).alias("__s"))
    t = g.select("unit_id", "eps", F.transform(F.slice("__s", 1, max_len), lambda s: s["t"]).alias("tokens"))
    base = F.max(F.when(F.col("eps") == 0, F.col("tokens"))).over(Window.partitionBy("unit_id"))
    return t.withColumn("same_as_base", F.col("tokens") == base)


# ---- responses of vectors
def linearity(d_eps: str, d_half: str, floor: Column, rho_tol: float = fixed.RHO_TOLERANCE, min_cos: float = fixed.MIN_COSINE, floor_mult: float = fixed.FLOOR_MULTIPLE) -> dict[str, Column]:
    from ..functions.vectors import dot, norm
    na, nb = norm(d_eps), norm(d_half)
    rho = F.when(nb > 0, na / (2 * nb))
    cos = F.when((na > 0) & (nb > 0), dot(d_eps, d_half) / (na * nb))
    above = F.coalesce(nb > floor * floor_mult, F.lit(False))
    lin = F.coalesce(above & (F.abs(rho - 1) <= rho_tol) & (cos >= min_cos), F.lit(False))
    return {"rho": rho, "cos": cos, "linear": lin, "below_floor": ~above}


def extrapolate(base: Column, small: Column, eps_small: float, eps_target: float) -> Column:
    return base + F.lit(eps_target / eps_small) * (small - base)


def modality_mask(df: DataFrame, drop_rna: float, drop_adt: float, seed) -> DataFrame:
    """Seeded keep flags of two modalities; when both would go, the first is kept."""
    r, a = uniform(seed, F.lit("rna"), "unit_id") >= drop_rna, uniform(seed, F.lit("adt"), "unit_id") >= drop_adt
    return df.withColumn("keep_rna", r | ~a).withColumn("keep_adt", a)


def fuse_masked(x: str, y: str, mode: str = "mean") -> Column:
    """Two latent vectors over the modalities kept: 'mean', 'sum' or 'rna_priority'."""
    kx, ky = F.col("keep_rna"), F.col("keep_adt")
    if mode == "rna_priority":
        return F.when(kx, F.col(x)).otherwise(F.col(y))
    n = F.lit(1) if mode == "sum" else F.greatest(kx.cast("int") + ky.cast("int"), F.lit(1))
    return F.zip_with(x, y, lambda p, q: (F.when(kx, p).otherwise(0.0) + F.when(ky, q).otherwise(0.0)) / n)


def simulated_panel(mask: str, predicted: str, measured: str) -> Column:
    return F.when(F.col(mask) == "rna_only", F.col(predicted)).when(F.col(mask) == "adt_only", F.col(measured)).otherwise(0.5 * F.col(predicted) + 0.5 * F.col(measured))


def lead_score(arr: Column, k: int = 3) -> Column:
    """mean of the first k outputs minus the next one"""
    return F.aggregate(F.slice(arr, 1, k), F.lit(0.0), lambda a, x: a + x) / k - F.element_at(arr, k + 1)


def observable_delta(cases: DataFrame, out: str, ref: str, units: list[float], score_unit: float) -> DataFrame:
    """Per (unit, kind): largest panel difference max_f |O - Oref| / unit_f and largest score difference over its cases."""
    from ..functions.vectors import max_abs_diff
    u = F.array(*[F.lit(float(x)) for x in units])
    d = cases.select("unit_id", "kind", max_abs_diff(out, ref, u).alias("d"), (F.abs(lead_score(F.col(out)) - lead_score(F.col(ref))) / score_unit).alias("s"))
    return d.groupBy("unit_id", "kind").agg(F.max("d").alias("panel_delta"), F.max("s").alias("score_delta"))

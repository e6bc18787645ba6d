"""Typed events, comparison of runs, hypotheses and their tests (result tables and declarations)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.draws import draw_key
from ..session import checkpointed
from .audit import verdict_union
from .ranking import value_rank

LEAK = fixed.LEAK_ORDER


def worst_status(cols: list[str]) -> Column:
    """Worst of several route statuses: fail > unknown > flag > pass."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == s, F.lit(k)) for s, k in LEAK.items()])
    top = F.greatest(*[rank(c) for c in cols])
    return F.coalesce(*[F.when(top == k, F.lit(s)) for s, k in LEAK.items()])


def leak_status(sources: DataFrame, readouts: DataFrame) -> DataFrame:
    """Three routes by which a hidden measurement can reach a source event, the worst of them and its reason.
    sources: event, site (NULL for a control), from_guides, label_basis; readouts: feature, is_input, sharing, excludes_targets."""
    basis = F.coalesce(F.col("label_basis"), F.lit("undeclared"))
    assign = F.when(F.col("from_guides"), "pass").when(basis == "design", "pass").when(basis == "response", "fail").otherwise("unknown")
    m = F.when(~F.col("is_input"), 0).when(F.col("sharing") == "count_split", 0).when(F.col("sharing") == "declared_shared", 1).otherwise(3)
    meas = readouts.agg(F.max(m).alias("k")).scalar()
    norm = lambda c: F.upper(F.regexp_replace(c, "_", "-"))
    own = readouts.groupBy(norm("feature").alias("__f")).agg(F.bool_and("excludes_targets").alias("__x"))
    d = sources.withColumn("__f", norm("site")).join(own, "__f", "left")
    site = F.when(F.col("site").isNull() | F.col("__x").isNull(), "pass").when(F.col("__x"), "pass").otherwise("flag")
    d = d.withColumn("assignment", assign).withColumn("measurement", F.coalesce(*[F.when(meas == k, F.lit(s)) for s, k in LEAK.items()])).withColumn("site_route", site)
    d = d.withColumn("status", worst_status(["assignment", "measurement", "site_route"]))
    reason = F.when(F.col("status") == "pass", "").when(F.col("assignment") == F.col("status"), "assignment").when(F.col("measurement") == F.col("status"), "measurement").otherwise("site")
    return d.withColumn("reason", reason).select("event", "assignment", "measurement", "site_route", "status", "reason")


def source_events(units: DataFrame, strata: list[str], name: str, kind: str, trail: DataFrame | None = None) -> DataFrame:
    """One event per treated unit and stratum plus one control event per stratum, with admission counts.
    units: site (declared treated labels); trail: site, admitted, rejected."""
    st = F.explode(F.array(*[F.lit(s) for s in strata])).alias("stratum")
    t = units.select("site", st).withColumn("role", F.lit("treated"))
    c = units.sparkSession.range(1).select(F.lit(None).cast("string").alias("site"), st).withColumn("role", F.lit("control"))
    e = t.unionByName(c)
    if trail is not None:
        e = e.join(trail, "site", "left")
    else:
        e = e.withColumn("admitted", F.lit(None).cast("long")).withColumn("rejected", F.lit(None).cast("long"))
    tr = F.col("role") == "treated"
    return e.select(F.concat_ws(":", F.lit(name), F.when(tr, F.lit(kind)).otherwise("control"), F.col("site"), F.col("stratum")).alias("event_id"), "site", "stratum", "role", F.when(tr, -1).otherwise(0).alias("sign"),
                    F.when(tr, 1.0).otherwise(0.0).alias("amplitude"), F.lit(0).alias("time"), F.concat(F.lit(f"{name}:A="), F.when(tr, "1").otherwise("0")).alias("pool"),
                    F.col("admitted").alias("n_admitted"), (F.col("admitted") + F.coalesce(F.col("rejected"), F.lit(0))).alias("n_attempted"))


def pool_closure(events: DataFrame, fields: list[str], pattern: str = r"[\^$*+?()\[\]|\\]") -> DataFrame:
    """Per pool the fields whose values differ among the pooled events (NULL counts as a value), or a site that is a pattern."""
    f = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias("v")) for c in fields])
    d = events.where(F.col("pool").isNotNull()).select("pool", F.inline(f))
    d = d.withColumn("__p", (F.col("field") == "site") & F.col("v").rlike(pattern))
    g = d.groupBy("pool", "field").agg(F.count_distinct("v").alias("n_values"), F.bool_or("__p").alias("is_pattern"))
    return g.where((F.col("n_values") > 1) | F.col("is_pattern"))


def admission_share(applied: DataFrame, n_cells: Column | int, sites: list[str], channels: list[str]) -> DataFrame:
    """Share of cells in which each (site, channel) event can be applied; a missing pair is 0. applied: site, channel, n."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    grid = applied.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in sites])).alias("site")).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return grid.join(applied.groupBy("site", "channel").agg(F.sum("n").alias("k")), ["site", "channel"], "left").select("site", "channel", (F.coalesce(F.col("k"), F.lit(0)) / n).alias("share"))


def contrast_rules(specs: DataFrame, kinds: list[str] = fixed.CONTRAST_KINDS, min_units: int = fixed.MIN_UNITS) -> DataFrame:
    """C1-C6 on a table of contrasts: name, kind, label_basis, confounded_with (array or NULL), study, control_study, treated
    (array), n_control, pooled_site (pooling of sites declared)."""
    k, n = F.col("kind"), F.size("treated")
    few = lambda x: (x > 1) & (x < min_units)
    rules = [("C1", "error", ~k.isin(kinds)), ("C2", "error", F.col("label_basis") == "response"), ("C2", "warning", F.coalesce(~F.col("label_basis").isin("design", "response"), F.lit(True))),
             ("C3", "warning", F.col("confounded_with").isNull()), ("C4", "error", (F.col("control_study") != F.col("study")) & (k != "study")), ("C5", "warning", (n > 1) & ~F.col("pooled_site")),
             ("C6", "warning", few(n) | few(F.col("n_control")))]
    rows = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules])
    return specs.select("name", F.inline(F.array_compact(rows)))


# ---- forward responses and verdict ledgers
def forward_inverse_join(forward: DataFrame, inverse: DataFrame) -> DataFrame:
    """Slopes along the measured direction beside the measured change and the inverse verdicts, per (dataset, readout).
    forward: dataset, readout, site, eps, slope, is_random; inverse: dataset, readout, delta, stage, verdict."""
    keys = ["dataset", "readout"]
    ko = forward.where(~F.col("is_random")).groupBy(*keys).agg(F.max_by("slope", "eps").alias("s1"), F.min_by("slope", "eps").alias("s2"), F.max("eps").alias("__e"))
    rnd = forward.where("is_random").join(ko.select(*keys, "__e"), keys).where(F.col("eps") == F.col("__e"))
    r = rnd.join(ko.select(*keys, "s1"), keys).groupBy(*keys).agg(F.percentile(F.abs("slope"), F.lit(0.5)).alias("random_abs_median"), F.max(F.abs("slope")).alias("random_abs_max"), F.count(F.lit(1)).alias("n_random"),
                                                                  F.avg((F.abs("slope") < F.abs("s1")).cast("double")).alias("rank_among_random"))
    d = inverse.join(ko, keys).join(r, keys, "left")
    return d.select(*keys, "stage", "verdict", "delta", F.col("s1").alias("head_response"), (F.abs(F.col("s1") - F.col("s2")) / F.greatest(F.abs("s1"), F.abs("s2"), F.lit(1e-12))).alias("step_difference"),
                    (F.col("s1") * F.col("delta") > 0).alias("same_sign"), F.when(F.col("delta") != 0, F.col("s1") / F.col("delta")).alias("share_of_measured"), "random_abs_median", "random_abs_max", "n_random", "rank_among_random")


def distinguishable_sites(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """Pairs of sites of one channel whose intervals do not overlap (the pairs are the answer). rows: site, channel, lo, hi."""
    b = rows.select(*by, "channel", F.col("site").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return rows.join(b, [*by, "channel"]).where((F.col("site") < F.col("other")) & ((F.col("hi") < F.col("lo2")) | (F.col("hi2") < F.col("lo")))).select(*by, "channel", "site", "other")


def distinguishable_counts(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """The same relation in one row per site, by a sweep over the ends of all intervals: ``pos``, the site's number in its
    channel by (lo, site); ``n_below`` sites whose interval ends below its own, ``n_above`` whose interval begins above.
    The sites above are those with pos > n - n_above, so the pairs follow from these rows; no pair is written.
    Intervals without one of their ends are left out.

    A channel's ends are ranked in value ranges and summed up over these, so no channel lies in one task."""
    g = [*by, "channel"]
    d = checkpointed(rows.select(*g, "site", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).where("lo IS NOT NULL AND hi IS NOT NULL"))
    ends = d.select(*g, F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("begins"), F.lit(0).alias("ends")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("begins"), F.lit(1).alias("ends")))))
    ends = ends.groupBy(*g, "at").agg(F.sum("begins").cast("long").alias("begins"), F.sum("ends").cast("long").alias("ends"))
    swept = value_rank(ends, g, "at", 0, ["at"], out="__r", descending=False, sums={"begun": "begins", "ended": "ends"})
    swept = checkpointed(swept.select(*g, "at", "begun", (F.col("ended") - F.col("ends")).alias("ended_before")))
    n = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    pos = value_rank(d, g, "lo", 0, ["site"], out="pos", descending=False).select(*g, "site", "lo", "hi", "pos")
    up = swept.select(*g, F.col("at").alias("hi"), "begun")
    down = swept.select(*g, F.col("at").alias("lo"), F.col("ended_before").alias("n_below"))
    return pos.join(n, g).join(up, [*g, "hi"]).join(down, [*g, "lo"]).select(*g, "site", "pos", "n", "n_below", (F.col("n") - F.col("begun")).alias("n_above"))


def ledger_conflicts(events: DataFrame) -> DataFrame:
    """Pairs of runs with opposite resolved verdicts at the same readout, stage, scope and target, with the fields in which
    they differ. Supports meet rejects only, so a key without both sides makes no pair."""
    keys, extra = ["readout", "stage", "scope", "target"], ["run", "u", "source_site", "context"]
    side = lambda v, s: events.where(F.col("verdict") == v).select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in extra])
    d = side("support", "s").join(side("reject", "r"), keys).where("run_s <> run_r")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"{f}_s").eqNullSafe(F.col(f"{f}_r")), F.lit(f)) for f in ("source_site", "context")]))
    return d.select(*keys, F.col("run_s").alias("run_support"), F.col("run_r").alias("run_reject"), F.col("u_s").alias("u_support"), F.col("u_r").alias("u_reject"), F.array_join(diff, ",").alias("differ_in"))


def conflict_classes(events: DataFrame) -> DataFrame:
    """The conflicts in one row per class of runs (readout, stage, scope, target, verdict, source_site, context): ``n_runs``, the
    verdicts in the class, and ``n_links``, the opposite verdicts of other runs that they meet, over all of them. Classes of
    the two sides at one key are linked all with all, so the pairs of ``ledger_conflicts`` follow by joining runs to them."""
    keys = ["readout", "stage", "scope", "target"]
    e = events.where(F.col("verdict").isin("support", "reject")).select(*keys, "run", "verdict", "source_site", "context")
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    total = e.groupBy(*keys).agg(n("support").alias("t_s"), n("reject").alias("t_r"))
    own = e.groupBy(*keys, "run").agg(n("support").alias("o_s"), n("reject").alias("o_r"))
    # a run doesn't conflict with itself; few runs have both verdicts at a key
    both = own.where("o_s > 0 AND o_r > 0")
    same = e.join(both, [*keys, "run"]).groupBy(*keys, "verdict", F.coalesce("source_site", F.lit("")).alias("__s"), F.coalesce("context", F.lit("")).alias("__c"), F.col("source_site").isNull().alias("__sn"), F.col("context").isNull().alias("__cn")).agg(
        F.sum(F.when(F.col("verdict") == "support", F.col("o_r")).otherwise(F.col("o_s"))).alias("same"))
    c = e.groupBy(*keys, "verdict", "source_site", "context").agg(F.count(F.lit(1)).alias("n_runs")).join(total, keys)
    c = c.withColumn("__s", F.coalesce("source_site", F.lit(""))).withColumn("__c", F.coalesce("context", F.lit(""))).withColumn("__sn", F.col("source_site").isNull()).withColumn("__cn", F.col("context").isNull())
    c = c.join(same, [*keys, "verdict", "__s", "__c", "__sn", "__cn"], "left")
    links = F.col("n_runs") * F.when(F.col("verdict") == "support", F.col("t_r")).otherwise(F.col("t_s")) - F.coalesce("same", F.lit(0))
    return c.select(*keys, "verdict", "source_site", "context", "n_runs", links.alias("n_links"))


def ledger_rules(hypotheses: DataFrame, tests: DataFrame) -> DataFrame:
    """H1-H5. hypotheses: id, own, controls (array), forecast (map), basis (array), retrospective; tests: hypothesis, runs
    (array), arms (array)."""
    t = tests.withColumn("test_no", F.col("hypothesis"))
    j = t.join(hypotheses, F.col("hypothesis") == F.col("id"), "left")
    known = j.where(F.col("id").isNotNull())
    row = lambda d, code, sev, detail: d.select(F.col("hypothesis").alias("id"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), detail.alias("detail"))
    none = F.lit("")
    shared = F.array_sort(F.array_intersect("basis", "runs"))
    out = row(j.where(F.col("id").isNull()), "H1", "error", none)
    out = out.unionByName(row(known.where(F.size(shared) > 0), "H2", "error", F.array_join(shared, ",")))
    out = out.unionByName(row(known.where("retrospective"), "H2", "warning", none))
    out = out.unionByName(row(known.where(~F.array_contains("arms", F.col("own")) | (F.size(F.array_intersect("arms", "controls")) == 0)), "H3", "error", none))
    out = out.unionByName(row(known.select("hypothesis", F.explode(F.array_except("arms", F.map_keys("forecast"))).alias("arm")), "H4", "warning", F.col("arm")))
    op = hypotheses.join(tests.select(F.col("hypothesis").alias("id")), "id", "left_anti").select("id", F.lit("H5").alias("code"), F.lit("note").alias("severity"), none.alias("detail"))
    return out.unionByName(op)


def verdict_events(verdicts: DataFrame, run: str) -> DataFrame:
    """Verdict rows as typed events with a sign: support 1, reject -1, else 0."""
    return verdicts.withColumn("event_id", F.concat_ws(":", F.lit("verdict"), F.col(run), F.col("readout"), F.col("stage"))).withColumn("sign", F.when(F.col("verdict") == "support", 1).when(F.col("verdict") == "reject", -1).otherwise(0))


def heterogeneity_q(sites: DataFrame, by: list[str]) -> DataFrame:
    """Cochran's Q over sites with standard errors read off 95% interval widths: weighted mean, Q, df, p, and the label of
    the pooling. sites: by..., v, lo, hi, pooled_v, has_support, has_reject (at some stage). p is the chi-square upper tail
    by its finite series (even df) or the complementary error function plus a series (odd df)."""
    se = F.greatest((F.col("hi") - F.col("lo")) / (2 * 1.959963984540054), F.lit(1e-12))
    d = sites.withColumn("w", 1 / (se * se)).withColumn("__res", (F.col("lo") > 0) | (F.col("hi") < 0))
    w, v = F.col("w"), F.col("v")
    g = d.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * v).alias("swv"), F.sum(w * v * v).alias("swvv"), F.count(F.lit(1)).alias("n"),
                           F.bool_or(F.col("__res") & (v * F.col("pooled_v") < 0)).alias("opposite"), F.bool_and(F.col("__res") & (v * F.col("pooled_v") > 0)).alias("same"), F.bool_or(F.col("has_support") & F.col("has_reject")).alias("conflict"))
    g = g.withColumn("weighted_mean", F.col("swv") / F.col("sw")).withColumn("q", F.greatest(F.col("swvv") - F.col("swv") * F.col("swv") / F.col("sw"), F.lit(0.0))).withColumn("df", F.col("n") - 1)
    label = F.when(F.col("opposite") | F.col("conflict"), "differs").when(F.col("same"), "holds").otherwise("weak")
    return g.select(*by, "n", "weighted_mean", "q", "df", chi2_sf(F.col("q"), F.col("df")).alias("p"), label.alias("label"))


def chi2_sf(q: Column, df: Column) -> Column:
    """Upper tail of chi-square: e^(-q/2) * sum over terms t_0 = 1 (even) or the half-integer series after erfc (odd)."""
    h = q / 2
    even = F.aggregate(F.sequence(F.lit(1), F.greatest((df / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                       lambda a, i: F.struct((a["t"] * h / i).alias("t"), F.when(i <= (df / 2).cast("int") - 1, a["s"] + a["t"] * h / i).otherwise(a["s"]).alias("s")))["s"] * F.exp(-h)
    x = F.sqrt(h)
    t = 1 / (1 + 0.5 * x)
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]      # erfc, fractional error below 1.2e-7
    poly = F.lit(c[9])
    for k in reversed(c[:9]):
        poly = F.lit(k) + t * poly
    erfc = t * F.exp(-x * x + poly)
    odd = erfc + F.exp(-h) * F.aggregate(F.sequence(F.lit(1), F.greatest(((df - 1) / 2).cast("int"), F.lit(1))), F.struct((F.sqrt(h) / 0.886226925452758).alias("t"), F.lit(0.0).alias("s")),
                                         lambda a, i: F.struct((a["t"] * h / (i + 0.5)).alias("t"), F.when(i <= ((df - 1) / 2).cast("int"), a["s"] + a["t"]).otherwise(a["s"]).alias("s")))["s"]
    return F.when(df <= 0, 1.0).when(df % 2 == 0, even).otherwise(odd)


def forecast_record(tests: DataFrame) -> DataFrame:
    """Measured gains of tested arms against their forecasts. tests: hypothesis, arm, gain, f_lo, f_hi (NULL = no forecast)."""
    d = tests.where(F.col("f_lo").isNotNull()).withColumn("err", F.col("gain") - (F.col("f_lo") + F.col("f_hi")) / 2).withColumn("inside", (F.col("gain") >= F.col("f_lo")) & (F.col("gain") <= F.col("f_hi")))
    return d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("inside").cast("long")), F.lit(0)).alias("n_inside"), F.avg(F.abs("err")).alias("mean_abs_error"))


# ---- comparison of runs
def stage_verdicts(table: DataFrame, margin: float) -> DataFrame:
    """Two-sided verdict of every (run, outcome, stage) over the learner classes."""
    return verdict_union(table, ["run", "outcome", "stage"], margin, signed=True)


def _span_draws(stages: DataFrame, draws: DataFrame, span: tuple[str, str]) -> DataFrame:
    """|u| at the end of a span minus |u| at its start, draw by draw, with the class each stage's verdict rests on."""
    s = stages.where(F.col("stage").isin(*span)).select("run", "outcome", "stage", "cls")
    d = draws.where(F.col("draw") > 0).join(s, ["run", "outcome", "stage", "cls"])
    at = lambda k: F.max(F.when(F.col("stage") == span[k], F.abs("u")))
    return d.groupBy("run", "outcome", "draw").agg((at(1) - at(0)).alias("d"))


def span_loss(stages: DataFrame, draws: DataFrame, span: tuple[str, str], step_margin: float, alpha: float) -> DataFrame:
    """Added |u| over a span with its interval: loss, no added loss or unresolved."""
    at = lambda k, c: F.max(F.when(F.col("stage") == span[k], c))
    p = stages.where(F.col("stage").isin(*span)).groupBy("run", "outcome").agg((at(1, F.abs("u")) - at(0, F.abs("u"))).alias("added"), at(0, F.col("verdict")).alias("ref_verdict"), at(1, F.col("verdict")).alias("end_verdict"),
                                                                              at(1, (F.col("hi") - F.col("lo")) / 2).alias("end_half"))
    iv = _span_draws(stages, draws, span).groupBy("run", "outcome").agg(F.percentile("d", F.lit(alpha / 2)).alias("lo"), F.percentile("d", F.lit(1 - alpha / 2)).alias("hi"))
    r = F.when(F.col("lo") > step_margin, "loss").when(F.col("hi") < step_margin, fixed.NO_ADDED_LOSS).otherwise("unresolved")
    return p.join(iv, ["run", "outcome"]).withColumn("half_width", (F.col("hi") - F.col("lo")) / 2).withColumn("reading", r)


def paired_runs(delta_draws: DataFrame, pairs: DataFrame) -> DataFrame:
    """True when two runs drew the same rows: their response draws are identical. pairs: base, arm."""
    a = delta_draws.select(F.col("run").alias("base"), "outcome", "draw", F.col("delta").alias("x"))
    b = delta_draws.select(F.col("run").alias("arm"), "outcome", "draw", F.col("delta").alias("y"))
    j = pairs.join(a, "base").join(b, ["arm", "outcome", "draw"])
    return j.groupBy("base", "arm", "outcome").agg(F.bool_and(F.col("x") == F.col("y")).alias("paired"))


def admit_run(spans: DataFrame, runs: DataFrame, margin: float, step_margin: float, min_snr: float, min_clusters: int) -> DataFrame:
    """What an audit can decide about a change over a span before any is made. spans: span_loss; runs: run, outcome, delta,
    delta_lo, delta_hi, n_clusters, sealed."""
    d = runs.join(spans.withColumnsRenamed({"lo": "s_lo", "hi": "s_hi"}), ["run", "outcome"], "left")
    half = (F.col("delta_hi") - F.col("delta_lo")) / 2
    resolved = ~((F.col("delta_lo") <= 0) & (F.col("delta_hi") >= 0))
    snr = F.when(half > 0, F.abs("delta") / F.when(half > 0, half)).otherwise(F.lit(float("inf")))
    d = d.withColumn("resolved", resolved).withColumn("snr", snr)
    ready = F.coalesce(F.col("resolved") & (F.col("snr") >= min_snr) & (F.col("ref_verdict") != "reject") & (F.col("reading") == "loss"), F.lit(False))
    d = d.withColumn("diagnostic", F.when(ready, "ready").otherwise("not ready"))
    w = F.col("half_width")
    cert = (F.when(F.col("diagnostic") != "ready", fixed.NOT_ATTAINABLE).when((F.col("ref_verdict") == "support") & (F.col("end_half") < margin), "absolute").when(w <= step_margin / 2, "relative")
             .when(w < step_margin, "marginal").otherwise(fixed.NOT_ATTAINABLE))
    return d.select("run", "outcome", "resolved", "snr", "diagnostic", cert.alias("certification"), F.when(F.col("sealed") & (F.col("n_clusters") >= min_clusters), fixed.CONFIRMATORY).otherwise("exploratory").alias("grade"))


def contrast_draws(stages: DataFrame, draws: DataFrame, delta_draws: DataFrame, pairs: DataFrame, span: tuple[str, str], seed=0) -> DataFrame:
    """Removed part of the added loss per draw for (base, arm); draws of unpaired runs are permuted first."""
    s = _span_draws(stages, draws, span)
    w = Window.partitionBy("run", "outcome").orderBy(draw_key(seed, "draw"), "draw")                    # one row per draw
    s = s.withColumn("perm", F.row_number().over(w))
    order = Window.partitionBy("run", "outcome").orderBy("draw")
    s = s.withColumn("no", F.row_number().over(order))
    p = paired_runs(delta_draws, pairs)
    a = s.select(F.col("run").alias("base"), "outcome", F.col("no").alias("bn"), F.col("perm").alias("bp"), F.col("d").alias("d0"))
    b = s.select(F.col("run").alias("arm"), "outcome", F.col("no").alias("k"), F.col("d").alias("d1"))
    j = p.join(a, ["base", "outcome"]).withColumn("k", F.when(F.col("paired"), F.col("bn")).otherwise(F.col("bp"))).join(b, ["arm", "outcome", "k"])
    return j.select("base", "arm", "outcome", "paired", "k", "d0", "d1", (F.col("d0") - F.col("d1")).alias("removed"))


def contrast_arms(spans: DataFrame, cdraws: DataFrame, step_margin: float, alpha: float) -> DataFrame:
    """Part of the loss an arm removes, absolute and as a share, with a reading. cdraws: contrast_draws."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    lo, hi = alpha / 2, 1 - alpha / 2
    share = F.when(F.col("d0") != 0, 1 - F.col("d1") / F.when(F.col("d0") != 0, F.col("d0")))
    g = cdraws.groupBy("base", "arm", "outcome", "paired").agg(q("removed", lo).alias("lo"), q("removed", hi).alias("hi"), q(share, lo).alias("share_lo"), q(share, hi).alias("share_hi"))
    b = spans.select(F.col("run").alias("base"), "outcome", F.col("added").alias("added_base"), F.col("lo").alias("base_lo"), F.col("reading").alias("base_reading"))
    a = spans.select(F.col("run").alias("arm"), "outcome", F.col("added").alias("added_arm"))
    d = g.join(b, ["base", "outcome"]).join(a, ["arm", "outcome"])
    small = F.col("hi") < step_margin
    r = F.when(F.col("lo") > 0, F.when(small, fixed.REDUCES_BELOW_MARGIN).otherwise(fixed.REDUCES)).when(F.col("hi") < 0, fixed.ADDS).when(small, fixed.DOES_NOT_REDUCE).otherwise("unresolved")
    ok = F.col("base_lo") > 0
    return d.select("base", "arm", "outcome", "paired", (F.col("added_base") - F.col("added_arm")).alias("removed"), "lo", "hi", small.alias("below_margin"), r.alias("reading"), "base_reading",
                    F.when(ok, 1 - F.col("added_arm") / F.when(ok, F.col("added_base"))).alias("share_removed"), F.when(ok, F.col("share_lo")).alias("share_lo"), F.when(ok, F.col("share_hi")).alias("share_hi"))


def diagnose(contrasts: DataFrame, cdraws: DataFrame, base: str, located: str, control: str, alpha: float, seed=1) -> DataFrame:
    """The change at the located step against the change made elsewhere, per outcome."""
    c = lambda arm, pre: contrasts.where((F.col("base") == base) & (F.col("arm") == arm)).select("outcome", *[F.col(x).alias(f"{pre}_{x}") for x in ("reading", "below_margin", "removed", "paired", "base_reading")])
    d = c(located, "l").join(c(control, "c"), "outcome")
    w = Window.partitionBy("outcome").orderBy(draw_key(seed, "k"), "k")
    x = cdraws.where((F.col("base") == base) & (F.col("arm") == located)).select("outcome", "k", F.col("removed").alias("rl"))
    y = cdraws.where((F.col("base") == base) & (F.col("arm") == control)).withColumn("perm", F.row_number().over(w)).select("outcome", F.col("k").alias("ck"), F.col("perm"), F.col("removed").alias("rc"))
    y = y.join(d.select("outcome", (F.col("l_paired") & F.col("c_paired")).alias("ap")), "outcome").withColumn("k", F.when(F.col("ap"), F.col("ck")).otherwise(F.col("perm")))
    diff = x.join(y, ["outcome", "k"]).groupBy("outcome").agg(F.percentile(F.col("rl") - F.col("rc"), F.lit(alpha / 2)).alias("lo"), F.percentile(F.col("rl") - F.col("rc"), F.lit(1 - alpha / 2)).alias("hi"))
    d = d.join(diff, "outcome")
    o = (F.when(F.col("l_base_reading") != "loss", "not testable").when((F.col("l_reading") == fixed.REDUCES) & (F.col("lo") > 0), fixed.STEP_CONFIRMED)
          .when(F.col("l_below_margin") | (F.col("hi") < 0), fixed.STEP_NOT_CONFIRMED).otherwise("unresolved"))
    return d.select("outcome", o.alias("diagnosis"), (F.col("l_removed") - F.col("c_removed")).alias("located_minus_control"), "lo", "hi", F.col("c_below_margin").alias("selective"))


def closure(spans: DataFrame, arm: str, control: str) -> DataFrame:
    """Whether the changed system is free of the loss the control still shows, graded."""
    s = lambda r, p: spans.where(F.col("run") == r).select("outcome", F.col("reading").alias(f"{p}_reading"), F.col("end_verdict").alias(f"{p}_end"))
    d = s(arm, "a").join(s(control, "c"), "outcome")
    ar, cr, ae, ce = (F.col(x) for x in ("a_reading", "c_reading", "a_end", "c_end"))
    g = (F.when((cr != "loss") & (ce != "reject"), "not testable").when((ae == "support") & (ce == "reject"), "absolute").when(ar == "loss", "not closed")
          .when((ar == fixed.NO_ADDED_LOSS) & (cr == "loss"), "relative").when((ar == "unresolved") & (cr == "loss"), fixed.LOSS_UNRESOLVED).otherwise("not testable"))
    return d.select("outcome", g.alias("grade"))


def guard(baseline: Column, score: Column, allowed_fall: float) -> Column:
    return (baseline - score) <= F.lit(allowed_fall)


def hypothesis_test(hypotheses: DataFrame, arms: DataFrame) -> DataFrame:
    """confirmed / refuted / unresolved / not testable per hypothesis. hypotheses: id, own, at_least, controls (map arm ->
    at most); arms: id, arm, lo, hi, admitted."""
    j = hypotheses.join(arms, "id", "left")
    own, bound = F.col("arm") == F.col("own"), F.col("controls")[F.col("arm")]
    is_c = F.coalesce(bound.isNotNull() & ~own, F.lit(False))
    any_, all_ = (lambda c: F.coalesce(F.bool_or(c), F.lit(False))), (lambda c: F.coalesce(F.bool_and(c), F.lit(True)))
    g = j.groupBy("id").agg(any_(own).alias("has_own"), F.sum(is_c.cast("long")).alias("n_controls"), any_((own | is_c) & ~F.col("admitted")).alias("bad"), any_(own & (F.col("lo") >= F.col("at_least"))).alias("own_ok"),
                            any_(own & (F.col("hi") < F.col("at_least"))).alias("own_fail"), all_(F.when(is_c, F.col("hi") <= bound)).alias("c_ok"), any_(F.when(is_c, F.col("lo") > bound)).alias("c_fail"))
    o = (F.when(~F.col("has_own") | (F.col("n_controls") == 0) | F.col("bad"), "not testable").when(F.col("own_fail") | F.col("c_fail"), "refuted").when(F.col("own_ok") & F.col("c_ok"), "confirmed").otherwise("unresolved"))
    return g.select("id", o.alias("outcome"))


def outcome_of_round(by_seed: DataFrame, together: DataFrame) -> DataFrame:
    """The outcome over all seeds, stated only if each seed alone reads the same."""
    s = by_seed.join(together.withColumnRenamed("outcome", "all"), "id").groupBy("id").agg(F.first("all").alias("all"), F.bool_and(F.col("outcome") == F.col("all")).alias("same"))
    return s.select("id", F.when(F.col("same"), F.col("all")).otherwise("unresolved").alias("outcome"))


def mark_rule(table: DataFrame, by: list[str], base: str, with_arm: str, without_arm: str) -> DataFrame:
    """Outcome against the mark half of the baseline's u. table: by..., arm, u, verdict."""
    c = lambda a, x: F.max(F.when(F.col("arm") == a, F.col(x)))
    g = table.groupBy(*by).agg(*[c(a, x).alias(f"{x}_{k}") for k, a in (("b", base), ("w", with_arm), ("o", without_arm)) for x in ("u", "verdict")])
    mark = 0.5 * F.col("u_b")
    meets = lambda k: (F.col(f"verdict_{k}") != "reject") & (F.col(f"u_{k}") <= mark)
    still = lambda k: (F.col(f"verdict_{k}") == "reject") & (F.col(f"u_{k}") > mark)
    o = (F.when(F.col("verdict_b") != "reject", fixed.MARK_NOT_HERE).when(meets("o"), fixed.MARK_NOT_SUPPORTED).when(meets("w") & still("o"), "supported").when(still("w"), "not answered").otherwise(fixed.MARK_BETWEEN))
    return g.select(*by, o.alias("outcome"))


def gate_checks(scores: DataFrame, history: DataFrame, fit_units: DataFrame, scored_units: DataFrame, floor: float, fall: float, allowed: float) -> DataFrame:
    """Per run: the own objective rose by a floor, the last five epochs did not fall against the five before, no scored
    row was fitted, the guard score held. scores: run, fit_score, base_fit_score, guard_score, base_guard_score; history: run,
    epoch, score; fit_units / scored_units: run, unit_id."""
    w = Window.partitionBy("run").orderBy(F.desc("epoch"))                       # one row per epoch
    h = history.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("run").agg(F.avg(F.when(F.col("r") <= 5, F.col("score"))).alias("last"), F.avg(F.when(F.col("r") > 5, F.col("score"))).alias("before"))
    s = fit_units.join(scored_units, ["run", "unit_id"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n_shared"))
    d = scores.join(h, "run").join(s, "run", "left").fillna(0, subset=["n_shared"])
    own, ran, clean = F.col("fit_score") - F.col("base_fit_score") >= floor, F.col("last") >= F.col("before") - fall, F.col("n_shared") == 0
    ok = guard(F.col("base_guard_score"), F.col("guard_score"), allowed)
    return d.select("run", own.alias("own_objective"), ran.alias("ran"), clean.alias("no_scored_in_fit"), ok.alias("guard"), (own & ran & clean & ok).alias("admitted"))


def candidate_support(medians: DataFrame, q95: DataFrame, by: list[str], tol: float) -> DataFrame:
    """rejected: lower bound of the median of per-unit maxima above tol, pooled and in every group; supported: upper bound of
    their 95th percentile at most tol, likewise. Both tables: by..., scope ('*' or a group), lo, hi."""
    m = medians.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("lo") > tol, F.lit(False))).alias("rej"))
    q = q95.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("hi") <= tol, F.lit(False))).alias("sup"))
    return m.join(q, by).select(*by, F.when(F.col("rej"), "rejected").when(F.col("sup"), "supported").otherwise("unresolved").alias("status"))


def candidate_selection(points: DataFrame, by: list[str], tol: float) -> DataFrame:
    """The first retained candidate in declared order (q95 of the per-unit maxima at most tol). points: order, candidate, q95."""
    return points.groupBy(*by).agg(F.min_by("candidate", F.when(F.col("q95") <= tol, F.col("order"))).alias("__c"), F.bool_or(F.coalesce(F.col("q95") <= tol, F.lit(False))).alias("__any")).select(*by, F.when(F.col("__any"), F.col("__c")).alias("selected"))


def poison_invariance(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two results of one computation (0 = the poisoned rows had no influence)."""
    cols = [c for c in before.columns if c not in keys]
    b = after.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    j = before.join(b, keys, "full")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("n_changed"))

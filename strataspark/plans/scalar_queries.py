"""Queries over scalar, array and map functions and over re-decisions under edits."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import l2_normalise, norm
from ..operators import classify as C, decide as D, prepare as P
from . import bindings as B
from .bindings import hash_key, hash_unit
from .metric_queries import called_panel
from .prepare_queries import events_of
from .registry import query

TOT = "sum(count) OVER (PARTITION BY unit_id)"


@query("log1p_cp10k", f"SELECT unit_id, feature, round(ln(1 + count / greatest({TOT}, 1) * 1e4), 6) AS value FROM counts")
def _(i):
    return P.log1p_cp10k(i.counts).select("unit_id", "feature", "value")


@query("mean_log_readout", f"""SELECT unit_id, round(coalesce(sum(v) FILTER (regexp_matches(feature, '^Brand#1') AND feature <> 'Brand#11'), 0) / (SELECT count(DISTINCT feature) FROM counts WHERE regexp_matches(feature, '^Brand#1') AND feature <> 'Brand#11'), 6) AS y
 FROM (SELECT unit_id, feature, ln(1 + count / greatest({TOT}, 1) * 1e4) AS v FROM counts) GROUP BY 1""")
def _(i):
    return P.mean_log_readout(i.counts, "^Brand#1", ["Brand#11"])


@query("clr", """SELECT unit_id, feature, round(ln(1 + measured) - sum(ln(1 + measured)) OVER w / 6, 6) AS clr_log1p, round(ln(1 + measured / exp(sum(ln(1 + measured)) OVER w / 6)), 6) AS clr_geometric,
 round(ln(greatest(measured, 0) + 1e-6) - (sum(ln(greatest(measured, 0) + 1e-6)) OVER w + (6 - count(*) OVER w) * ln(1e-6)) / 6, 6) AS clr_log FROM panel WINDOW w AS (PARTITION BY unit_id)""")
def _(i):
    p = i.panel.select("unit_id", "feature", "measured")
    out = P.clr(p, "measured", "log1p", 6).withColumnRenamed("clr", "clr_log1p")
    out = P.clr(out, "measured", "geometric", 6).withColumnRenamed("clr", "clr_geometric")
    return P.clr(out, "measured", "log", 6).withColumnRenamed("clr", "clr_log").drop("measured")


@query("clr_readout", """SELECT unit_id, round(coalesce(sum(ln(1 + measured)) FILTER (feature IN ('SMALL', 'PROMO')), 0) / 2 - sum(ln(1 + measured)) / 6, 6) AS y FROM panel GROUP BY 1""")
def _(i):
    return P.clr_readout(i.panel, "measured", ["SMALL", "PROMO"], 6)


@query("depth_features", "SELECT unit_id, round(ln(greatest(sum(count), 1)), 6) AS log_total, round(ln(greatest(count(*), 1)), 6) AS log_detected FROM counts GROUP BY 1")
def _(i):
    return P.depth_features(i.counts)


@query("median_scaled", f"""SELECT unit_id, feature, round(count / {TOT} * 1e4 * coalesce(1 / m, 1), 6) AS value FROM counts LEFT JOIN (SELECT feature, quantile_cont(count, 0.5) AS m FROM counts GROUP BY 1) USING (feature)""")
def _(i):
    from ..operators.ranking import group_percentile
    med = group_percentile(i.counts, ["feature"], "count", {"median": 0.5})
    return P.median_scaled(i.counts, med).select("unit_id", "feature", "value")


PANEL_B = ["Brand#1", "Brand#2", "Brand#3"]
STORED = "(SELECT unit_id, feature, ln(1 + count / 7) AS stored FROM counts)"


def stored_of(i):
    return i.counts.select("unit_id", "feature", F.log1p(F.col("count") / 7).alias("stored"))


@query("panel_free_shares", f"""SELECT unit_id, feature, CASE WHEN t > 0 THEN round(ln(1 + 1e4 * u / t), 6) ELSE 0 END AS w FROM (SELECT *, sum(u) OVER (PARTITION BY unit_id) AS t FROM
 (SELECT unit_id, feature, greatest(exp(stored) - 1, 0) AS u FROM {STORED} WHERE feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3')))""")
def _(i):
    return P.panel_free_shares(stored_of(i), PANEL_B)


@query("panel_invariance", "SELECT count(*) AS n, 0::BIGINT AS n_changed FROM counts WHERE feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def _(i):
    from ..functions.draws import uniform
    return P.panel_invariance(stored_of(i), PANEL_B, uniform(3, "unit_id", "feature") * 5)


@query("l2_normalise", "SELECT unit_id, round(sqrt(list_dot_product(z, z)) / (sqrt(list_dot_product(z, z)) + 1e-6), 6) AS norm_after, round(z[1] / (sqrt(list_dot_product(z, z)) + 1e-6), 6) AS z1 FROM (SELECT unit_id, CAST(z AS DOUBLE[]) AS z FROM vectors)")
def _(i):
    d = i.vectors.select("unit_id", l2_normalise("z", 1e-6).alias("u"))
    return d.select("unit_id", norm("u").alias("norm_after"), F.col("u")[0].alias("z1"))


@query("evidence", "SELECT unit_id, feature, round(v, 6) AS v, round(predicted / greatest(q, 1e-12), 6) AS unclipped FROM evidence JOIN panel USING (unit_id, feature) JOIN q_scale USING (feature)")
def _(i):
    d = P.evidence(i.stored_panel, i.q_scale, "predicted")
    return d.select("unit_id", "feature", "v", (F.col("predicted") / F.greatest(F.col("q"), F.lit(1e-12))).alias("unclipped"))


@query("class_scores", "SELECT unit_id, round(A, 6) AS A, round(B, 6) AS B, round(C, 6) AS C FROM scores")
def _(i):
    return i.scores


@query("class_scores_reduced", """SELECT unit_id, round(coalesce(max(v) FILTER (feature = 'ECONOMY'), 0), 6) AS A, round(coalesce(sum(v) FILTER (feature IN ('MEDIUM', 'PROMO')), 0) / 2, 6) AS B,
 round(coalesce(max(v) FILTER (feature = 'SMALL'), 0), 6) AS C FROM evidence GROUP BY 1""")
def _(i):
    return C.class_scores(i.evidence, C.reduced_panel(B.PANEL, ["ECONOMY", "MEDIUM", "PROMO", "SMALL"]))


Q2 = D.Question(B.PANEL, B.KEY_MARKER, key_boost=3.0, secondary_weight=0.5, class_weight={"A": 1.5, "B": 1.3, "C": 0.5}, threshold=0.2, margin=0.06)
W2 = {f: (3.0 if B.KEY_MARKER[c] == f else 0.5) * {"A": 1.5, "B": 1.3, "C": 0.5}[c] / 4.5 for c in B.CLASSES for f in B.PANEL[c]}
WS = ", ws AS (SELECT unit_id, " + ", ".join(f"({' + '.join(f'''{W2[f]} * coalesce(max(v) FILTER (feature = '{f}'), 0)''' for f in B.PANEL[c])}) / {max(sum(W2[f] for f in B.PANEL[k]) for k in B.CLASSES)} AS {c}" for c in B.CLASSES) + " FROM evidence GROUP BY 1)"
ARG = "CASE WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END"


@query("weighted_lineage_scores", WS + f" SELECT unit_id, round(A, 6) AS A, round(B, 6) AS B, round(C, 6) AS C, CASE WHEN greatest(A, B, C) >= 0.2 / 1.5 THEN {ARG} ELSE '' END AS call FROM ws")
def _(i):
    return D.weighted_class_scores(i.evidence, Q2).withColumn("call", C.argmax_call(B.CLASSES, Q2.threshold / Q2.scale()))


@query("legacy_lineage_scores", """SELECT unit_id, round(1.5 * (coalesce(max(v) FILTER (feature = 'ECONOMY'), 0) + 0.5 * coalesce(max(v) FILTER (feature = 'LARGE'), 0)) / 1.5, 6) AS A,
 round(1.3 * (coalesce(max(v) FILTER (feature = 'MEDIUM'), 0) + 0.5 * coalesce(max(v) FILTER (feature = 'PROMO'), 0)) / 1.5, 6) AS B, round(0.5 * (coalesce(max(v) FILTER (feature = 'SMALL'), 0) + 0.5 * coalesce(max(v) FILTER (feature = 'STANDARD'), 0)) / 1.5, 6) AS C FROM evidence GROUP BY 1""")
def _(i):
    return D.legacy_class_scores(i.evidence, Q2, "key_marker_priority")


@query("expected_label", WS + f" SELECT unit_id, CASE WHEN greatest(A, B, C) - list_reverse_sort([A, B, C])[2] >= 0.06 / 1.5 THEN {ARG} END AS expected FROM ws")
def _(i):
    return D.weighted_class_scores(i.evidence, Q2).select("unit_id", C.expected_label(B.CLASSES, Q2.margin / Q2.scale()).alias("expected"))


EVV = "least(greatest(v, 0), 1) * CASE WHEN feature IN ('ECONOMY', 'MEDIUM', 'SMALL') THEN 3.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN feature IN ('ECONOMY', 'LARGE') THEN 1.5::DOUBLE WHEN feature IN ('MEDIUM', 'PROMO') THEN 1.3::DOUBLE ELSE 0.5::DOUBLE END / 4.5::DOUBLE"


@query("event_value", f"SELECT unit_id, feature, round({EVV} * CASE unit_id % 3 WHEN 0 THEN 0.35::DOUBLE ELSE 1::DOUBLE END, 6) AS value FROM evidence")
def _(i):
    e = events_of(i).withColumn("mask", F.when(F.col("unit_id") % 3 == 0, "adt_only").otherwise("joint"))
    rel = D.modality_reliability("mask", {"rna_only": 1.0, "joint": 1.0, "adt_only": 0.35})
    return e.select("unit_id", "feature", D.event_value("value", "is_key_marker", "action", Q2, rel).alias("value"))


@query("margin", """SELECT unit_id, round(margin, 6) AS margin, round(A - greatest(B, C), 6) AS signed_a, ((A = conf)::INT + (B = conf)::INT + (C = conf)::INT) > 1 AS tied, round(conf, 6) AS top,
 round(CASE WHEN A + B + C > 0 THEN 1 + (CASE WHEN A > 0 THEN A / (A + B + C) * ln(A / (A + B + C)) ELSE 0 END + CASE WHEN B > 0 THEN B / (A + B + C) * ln(B / (A + B + C)) ELSE 0 END
   + CASE WHEN C > 0 THEN C / (A + B + C) * ln(C / (A + B + C)) ELSE 0 END) / ln(3) ELSE 0 END, 6) AS entropy_conf FROM calls""")
def _(i):
    k = B.CLASSES
    return i.scores.select("unit_id", C.margin(k).alias("margin"), C.signed_margin(k, F.lit("A")).alias("signed_a"), C.tied_top(k).alias("tied"), C.top_score(k).alias("top"), C.entropy_confidence(k).alias("entropy_conf"))


FLD = D.Field()


def star(n: int, ticks: int = fixed.FIELD_STEPS + 1, injected: int | None = None) -> float:
    """Action state per unit injected, from the full (1 + n)-site update matrix (the operator uses a 2 x 2 one)."""
    m, r, d, w = injected or n, fixed.FIELD_RETENTION, fixed.FIELD_DIFFUSION, fixed.FIELD_FEEDBACK_WEIGHT
    T = r * np.eye(n + 1)
    T[0, 1:], T[1:, 0] = d * r, d * w * r
    start = np.r_[d * m, np.ones(m), np.zeros(n - m)]
    return float((np.linalg.matrix_power(T, ticks - 1) @ start)[0] / m)


def field_sql(cls, name):
    """state of a class's action site (a) and of its two event sites (e1, e2), site by site and tick by tick"""
    r, d, w = (f"{x!r}::DOUBLE" for x in (fixed.FIELD_RETENTION, fixed.FIELD_DIFFUSION, fixed.FIELD_FEEDBACK_WEIGHT))
    f1, f2 = B.PANEL[cls]
    out = f", {name}_e AS (SELECT unit_id, coalesce(max(v) FILTER (feature = '{f1}'), 0) AS v1, coalesce(max(v) FILTER (feature = '{f2}'), 0) AS v2 FROM evidence GROUP BY 1), {name}_0 AS (SELECT unit_id, {d} * (v1 + v2) AS a, v1::DOUBLE AS e1, v2::DOUBLE AS e2 FROM {name}_e)"
    for k in range(1, fixed.FIELD_STEPS + 1):
        out += f", {name}_{k} AS (SELECT unit_id, {r} * a + {d} * {r} * (e1 + e2) AS a, {r} * e1 + {d} * {w} * {r} * a AS e1, {r} * e2 + {d} * {w} * {r} * a AS e2 FROM {name}_{k - 1})"
    return out + f", {name} AS (SELECT unit_id, a, e1, e2 FROM {name}_{fixed.FIELD_STEPS})"


@query("linear_field_score", "".join(field_sql(c, f"fd_{c}") for c in B.CLASSES) + " SELECT unit_id, " + ", ".join(f"round(fd_{c}.a, 6) AS {c}" for c in B.CLASSES) + ", call FROM calls " + " ".join(f"JOIN fd_{c} USING (unit_id)" for c in B.CLASSES))
def _(i):
    """field scores call exactly where the rule does when the bar is scaled by the same gain"""
    s = D.field_scores(i.evidence, B.PANEL, FLD)
    return s.withColumn("call", C.argmax_call(B.CLASSES, D.field_threshold(FLD, 2, B.BAR) * (1 - 1e-12)))


@query("field_closure_score", field_sql("A", "fd") + " SELECT unit_id, round(0.5::DOUBLE * least(e1, e2) + 0.3::DOUBLE * (e1 + e2) / 2 + 0.2::DOUBLE * a, 6) AS A FROM fd")
def _(i):
    return D.field_scores(i.evidence, B.PANEL, FLD, (0.5, 0.3, 0.2)).select("unit_id", "A")


TWO = ", tw AS (SELECT unit_id, A AS a_A, B AS a_B, C AS a_C, (A + C) / 2 AS b_A, B * 0.9 AS b_B, C * 1.05 AS b_C FROM scores)"


def two_channels(i):
    s = i.scores
    return s.select("unit_id", F.col("A").alias("a_A"), F.col("B").alias("a_B"), F.col("C").alias("a_C"), ((F.col("A") + F.col("C")) / 2).alias("b_A"), (F.col("B") * 0.9).alias("b_B"), (F.col("C") * 1.05).alias("b_C"))


@query("fuse_channels", TWO + " SELECT unit_id, " + ", ".join(f"round((a_{c} + b_{c}) / 2, 6) AS mean_{c}, round((0.6 * a_{c} + 0.3 * b_{c}) / 0.9, 6) AS trust_{c}" for c in B.CLASSES) + " FROM tw")
def _(i):
    d = two_channels(i)
    m, t = D.fuse(B.CLASSES, "mean"), D.fuse(B.CLASSES, "trust", (0.6, 0.3))
    return d.select("unit_id", *[x.alias(f"mean_{c}") for x, c in zip(m, B.CLASSES)], *[x.alias(f"trust_{c}") for x, c in zip(t, B.CLASSES)])


ARGA = "CASE WHEN {0}_A >= {0}_B AND {0}_A >= {0}_C THEN 'A' WHEN {0}_B >= {0}_C THEN 'B' ELSE 'C' END"


def fuse_sql(c):
    ha, hb = f"(ta <> '{c}')", f"(tb <> '{c}')"
    r = lambda m: f"(CASE {ha}::INT + {hb}::INT " + " ".join(f"WHEN {x} THEN {star(4 + x, m, 1)!r}::DOUBLE" for x in range(3)) + " END)"
    return (f"round({r(6)} * (1.0 * 2 * a_{c} - CASE WHEN {ha} THEN 0.5 * greatest(a_A, a_B, a_C) ELSE 0 END) + {r(5)} * (0.8 * 2 * b_{c} - CASE WHEN {hb} THEN 0.8 * 0.5 * greatest(b_A, b_B, b_C) ELSE 0 END), 6) AS {c}")


@query("fuse_channels_field", TWO + f", tt AS (SELECT *, {ARGA.format('a')} AS ta, {ARGA.format('b')} AS tb FROM tw) SELECT unit_id, {', '.join(fuse_sql(c) for c in B.CLASSES)} FROM tt")
def _(i):
    return two_channels(i).select("unit_id", *D.fuse_field(B.CLASSES, {c: 2 for c in B.CLASSES}, FLD, (1.0, 0.8), delay=1))


RHO = f"({star(1)!r}::DOUBLE / {star(2)!r}::DOUBLE)"
LOO = ", lo AS (SELECT c.*, t.vt, CASE call WHEN 'A' THEN A WHEN 'B' THEN B ELSE C END AS own, CASE call WHEN 'A' THEN greatest(B, C) WHEN 'B' THEN greatest(A, C) ELSE greatest(A, B) END AS other FROM calls c JOIN (SELECT e.unit_id, max(v) AS vt FROM calls c JOIN (SELECT *, " + B._case("feature", B.F2C) + " AS fc FROM evidence) e ON c.unit_id = e.unit_id AND c.call = fc GROUP BY 1) t USING (unit_id))"


@query("leave_one_out_flip", LOO + f" SELECT unit_id, call, {RHO} * (own - vt / 2) < greatest({B.BAR}, other) AS flips, own - vt / 2 < greatest({B.BAR}, other) AS flips_zeroed FROM lo")
def _(i):
    top = called_panel(i).groupBy("unit_id").agg(F.max("v").alias("vt"))
    d = i.calls.join(top, "unit_id")
    return d.select("unit_id", "call", D.deletion_flips(B.CLASSES, "call", "vt", 2, B.BAR, FLD.deletion_ratio(2)).alias("flips"), D.deletion_flips(B.CLASSES, "call", "vt", 2, B.BAR).alias("flips_zeroed"))


NP = {c: 2 for c in B.CLASSES}


def edits_of(i):
    e = i.evidence.withColumn("cls", C.map_expr(B.F2C)[F.col("feature")])
    return e, i.calls.select("unit_id", *B.CLASSES, "call")


def edited_call(v):
    s = {c: f"({c} + CASE WHEN cls = '{c}' THEN ({v} - v) / 2 ELSE 0 END)" for c in B.CLASSES}
    return f"(CASE WHEN greatest({s['A']}, {s['B']}, {s['C']}) < {B.BAR} THEN '' WHEN {s['A']} >= {s['B']} AND {s['A']} >= {s['C']} THEN 'A' WHEN {s['B']} >= {s['C']} THEN 'B' ELSE 'C' END)"


EV = f"(SELECT e.unit_id, e.feature, e.v, {B._case('feature', B.F2C)} AS cls, A, B, C, call FROM evidence e JOIN calls USING (unit_id))"


@query("decision_under_edit", f""", ev AS (SELECT * FROM {EV}), g AS (SELECT unit_id, feature, min(abs(g - v)) AS dist FROM ev, (SELECT k / 20.0::DOUBLE AS g FROM (SELECT unnest(range(0, 21)) AS k)) WHERE {edited_call('g')} <> call GROUP BY 1, 2)
 SELECT unit_id, feature, call, {edited_call('0.0::DOUBLE')} AS call_removed, {edited_call('0.0::DOUBLE')} <> call AS flipped, round(CASE WHEN call = cls THEN -v / 2 ELSE 0 END, 6) AS delta_chosen, round(dist, 6) AS flip_distance FROM ev LEFT JOIN g USING (unit_id, feature)""")
def _(i):
    e, s = edits_of(i)
    return D.decision_under_edit(e, s, B.CLASSES, NP, B.BAR)


def nudge(dv):
    return f"({edited_call(f'least(greatest(v + {dv}::DOUBLE, 0), 1)')} <> call)"


@query("nudge_class", f"""SELECT unit_id, feature, CASE WHEN u <> d OR hu <> hd THEN 'G4' WHEN hu THEN 'G3' WHEN u THEN 'G2' ELSE 'G1' END AS nudge FROM
 (SELECT unit_id, feature, {nudge(0.1)} AS u, {nudge(-0.1)} AS d, {nudge(0.05)} AS hu, {nudge(-0.05)} AS hd FROM {EV})""")
def _(i):
    e, s = edits_of(i)
    f = D.nudge_flips(B.BAR, 0.1)
    return D.edit_context(e, s, B.CLASSES, NP).select("unit_id", "feature", C.nudge_class(f["up"], f["down"], f["half_up"], f["half_down"]).alias("nudge"))


@query("recover_counts", """, st AS (SELECT unit_id, feature, count, count * 0.37 AS v FROM counts), m AS (SELECT *, v / min(v) OVER (PARTITION BY unit_id) AS q FROM st WHERE v > 0)
 SELECT unit_id, feature, CAST(round_even(q, 0) AS BIGINT) AS recovered, round(abs(q - round_even(q, 0)) / (1e-3 + 4e-7 * round_even(q, 0)), 3) AS deviation FROM m""")
def _(i):
    d = D.recover_counts(i.counts.withColumn("v", F.col("count") * 0.37), "v")
    return d.select("unit_id", "feature", "recovered", F.round("deviation", 3).alias("deviation"))


def gamma_sql(shape, side, seed, level):
    """first accepted of six tries of a gamma draw"""
    u = [f"({hash_unit(seed, 'unit_id', 'feature', repr(side), str(level), str(k), 't')} + {2.0 ** -53!r}::DOUBLE)" for k in range(3)]
    d = f"({shape} - {1.0 / 3.0!r}::DOUBLE)"
    x = f"sqrt(-2.0::DOUBLE * ln({u[0]})) * cos(6.283185307179586::DOUBLE * {u[1]})"
    tries = f"list_transform(list_transform(range(1, 7), lambda t: {{'x': {x}, 'v': power(1.0::DOUBLE + {x} / sqrt(9.0::DOUBLE * {d}), 3.0::DOUBLE), 'lu': ln({u[2]})}}), lambda s: CASE WHEN s.v > 0 AND s.lu < 0.5::DOUBLE * s.x * s.x + {d} - {d} * s.v + {d} * ln(greatest(s.v, 1e-300::DOUBLE)) THEN {d} * s.v END)"
    return f"coalesce(list_filter({tries}, lambda g: g IS NOT NULL)[1], {d})"


def thin_sql(p, seed, name, levels=10):
    """CTEs of the binomial draw (unit_id, feature, k): halves are decided by a Beta draw while over 32 items are left (counts up to 32,768)"""
    out = f", {name}0 AS (SELECT unit_id, feature, CAST(count AS BIGINT) AS n, {p!r}::DOUBLE AS p, 0::BIGINT AS k FROM counts)"
    for l in range(1, levels + 1):
        i = "CAST((n + 1) // 2 AS DOUBLE)"
        out += f""", {name}{l} AS (SELECT unit_id, feature, CASE WHEN n <= 32 THEN n WHEN y <= p THEN n - (n + 1) // 2 ELSE (n + 1) // 2 - 1 END AS n, CASE WHEN n <= 32 THEN p WHEN y <= p THEN (p - y) / (1.0::DOUBLE - y) ELSE p / y END AS p, CASE WHEN n > 32 AND y <= p THEN k + (n + 1) // 2 ELSE k END AS k
 FROM (SELECT *, a / (a + b) AS y FROM (SELECT *, CASE WHEN n > 32 THEN {gamma_sql(i, 'a', seed, l)} END AS a, CASE WHEN n > 32 THEN {gamma_sql(f'(CAST(n AS DOUBLE) + 1 - {i})', 'b', seed, l)} END AS b FROM {name}{l - 1})))"""
    u = hash_unit(seed, "unit_id", "feature", "s")
    return out + f", {name} AS (SELECT unit_id, feature, k + len(list_filter(range(1, n + 1), lambda s: {u} < p)) AS k FROM {name}{levels})"


@query("thin_counts", thin_sql(0.25, 21, "tq") + " SELECT unit_id, feature, k AS thinned FROM tq")
def _(i):
    return D.thin_counts(i.counts, 0.25, 21).select("unit_id", "feature", "thinned")


@query("count_split", thin_sql(0.5, 21, "th") + " SELECT unit_id, feature, k AS half_a, CAST(count AS BIGINT) - k AS half_b FROM th JOIN counts USING (unit_id, feature)")
def _(i):
    return D.count_split(i.counts, 21).select("unit_id", "feature", "half_a", "half_b")


@query("dropout_inputs", f"SELECT unit_id, feature, CASE WHEN row_number() OVER (PARTITION BY unit_id ORDER BY {hash_key(22, 'unit_id', 'feature')}, feature) <= 2 THEN 0 ELSE measured END AS w FROM panel")
def _(i):
    return D.dropout_inputs(i.panel.select("unit_id", "feature", F.col("measured").alias("w")), 0.3, 22, 6)


@query("scale_feature", """, v AS (SELECT unit_id, eps, feature, CASE WHEN feature = 'SMALL' THEN measured * (1 - eps) ELSE measured END AS x FROM panel, (SELECT unnest([0, 0.1, 0.5]::DOUBLE[]) AS eps)),
 t AS (SELECT unit_id, eps, string_agg(feature, ',' ORDER BY x DESC, feature) AS tokens FROM v WHERE x > 0 GROUP BY 1, 2)
 SELECT unit_id, eps, tokens, tokens = max(tokens) FILTER (eps = 0) OVER (PARTITION BY unit_id) AS same_as_base FROM t""")
def _(i):
    t = D.scale_feature(i.panel.select("unit_id", F.col("feature").alias("token"), F.col("measured").alias("value")), "SMALL", [0.1, 0.5], 2048)
    return t.select("unit_id", "eps", F.array_join("tokens", ",").alias("tokens"), "same_as_base")


LIN = "(SELECT unit_id, list_transform(z, lambda x: x * 0.5 + x * x * 0.3) AS de, list_transform(z, lambda x: x * 0.25 + x * x * 0.075 + CASE WHEN unit_id % 3 = 0 THEN 0.01::DOUBLE ELSE 0::DOUBLE END) AS dh FROM (SELECT unit_id, CAST(z AS DOUBLE[]) AS z FROM vectors))"


@query("linearity", f"""SELECT unit_id, round(na / (2 * nb), 6) AS rho, round(ab / (na * nb), 6) AS cos, nb > 3 * 0.08 AND abs(na / (2 * nb) - 1) <= 0.1 AND ab / (na * nb) >= 0.9 AS linear, NOT nb > 3 * 0.08 AS below_floor
 FROM (SELECT unit_id, sqrt(list_dot_product(de, de)) AS na, sqrt(list_dot_product(dh, dh)) AS nb, list_dot_product(de, dh) AS ab FROM {LIN})""")
def _(i):
    d = i.vectors.select("unit_id", F.transform("z", lambda x: x.cast("double") * 0.5 + x.cast("double") * x.cast("double") * 0.3).alias("de"),
                         F.transform("z", lambda x: x.cast("double") * 0.25 + x.cast("double") * x.cast("double") * 0.075 + F.when(F.col("unit_id") % 3 == 0, 0.01).otherwise(0.0)).alias("dh"))
    return d.select("unit_id", *[c.alias(n) for n, c in D.linearity("de", "dh", F.lit(0.08)).items()])


@query("modality_mask", f"""SELECT unit_id, r OR NOT a AS keep_rna, a AS keep_adt, round(CASE WHEN (r OR NOT a) AND a THEN (z[1] + z[2]) / 2 WHEN r OR NOT a THEN z[1] ELSE z[2] END, 6) AS fused_mean,
 round(CASE WHEN r OR NOT a THEN z[1] ELSE z[2] END, 6) AS fused_priority FROM (SELECT unit_id, CAST(z AS DOUBLE[]) AS z, {hash_unit(23, "'rna'", 'unit_id')} >= 0.3 AS r, {hash_unit(23, "'adt'", 'unit_id')} >= 0.4 AS a FROM vectors)""")
def _(i):
    d = i.vectors.select("unit_id", F.array(F.col("z")[0].cast("double")).alias("x"), F.array(F.col("z")[1].cast("double")).alias("y"))
    from ..functions.draws import uniform
    r, a = uniform(23, F.lit("rna"), "unit_id") >= 0.3, uniform(23, F.lit("adt"), "unit_id") >= 0.4
    d = D.modality_mask(d, 0.3, 0.4, 23)
    return d.select("unit_id", "keep_rna", "keep_adt", D.fuse_masked("x", "y")[0].alias("fused_mean"), D.fuse_masked("x", "y", "rna_priority")[0].alias("fused_priority"))


@query("simulated_panel", "SELECT unit_id, feature, CASE unit_id % 3 WHEN 0 THEN predicted WHEN 1 THEN measured ELSE 0.5 * predicted + 0.5 * measured END AS value FROM panel")
def _(i):
    m = F.when(F.col("unit_id") % 3 == 0, "rna_only").when(F.col("unit_id") % 3 == 1, "adt_only").otherwise("joint")
    return i.panel.withColumn("mask", m).select("unit_id", "feature", D.simulated_panel("mask", "predicted", "measured").alias("value"))


@query("observable_delta", """, o AS (SELECT unit_id, CASE WHEN o.eps < 0.3 THEN 'small' ELSE 'large' END AS kind, ECONOMY, LARGE, MEDIUM, PROMO, eps FROM measured_wide, (SELECT unnest([0.1, 0.2, 0.5]::DOUBLE[]) AS eps) o),
 d AS (SELECT unit_id, kind, greatest(ECONOMY * eps / 10, LARGE * eps / 20, 0, 0) AS d, abs((ECONOMY * (1 - eps) + LARGE * (1 - eps) + MEDIUM) / 3 - PROMO - ((ECONOMY + LARGE + MEDIUM) / 3 - PROMO)) / 5 AS s FROM o)
 SELECT unit_id, kind, round(max(d), 6) AS panel_delta, round(max(s), 6) AS score_delta FROM d GROUP BY 1, 2""")
def _(i):
    """two outputs of the panel scaled down by three steps against the unchanged panel"""
    w = i.measured_wide.withColumn("eps", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.5))))
    k = 1 - F.col("eps")
    c = w.select("unit_id", F.when(F.col("eps") < 0.3, "small").otherwise("large").alias("kind"), F.array(F.col("ECONOMY") * k, F.col("LARGE") * k, "MEDIUM", "PROMO").alias("o"), F.array("ECONOMY", "LARGE", "MEDIUM", "PROMO").alias("r"))
    return D.observable_delta(c, "o", "r", [10, 20, 10, 10], 5.0)

"""Queries over aggregations and evaluation metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C, metrics as M, prepare as P
from . import bindings as B
from .bindings import hash_key
from .prepare_queries import CASES_SQL, LABEL_SQL, cases_of
from .registry import query

LABELS = ["A", "B", "C", "OUT"]


def lit_list(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query("size_factors", """SELECT unit_id, total, CASE WHEN total > 0 THEN round(total / (SELECT quantile_cont(t, 0.5) FROM (SELECT sum(count) AS t FROM counts GROUP BY unit_id) WHERE t > 0), 6) ELSE 1 END AS size_factor
 FROM (SELECT unit_id, coalesce(sum(count), 0) AS total FROM units LEFT JOIN counts USING (unit_id) GROUP BY 1)""")
def _(i):
    return P.size_factors(i.counts, i.units)


@query("eval_size_factor", """, t AS (SELECT unit_id, coalesce(sum(count), 0) AS total FROM units LEFT JOIN counts USING (unit_id) GROUP BY 1),
 f AS (SELECT unit_id, CASE WHEN total > 0 THEN total / (SELECT quantile_cont(total, 0.5) FROM t WHERE total > 0) ELSE 1 END AS size_factor FROM t)
 SELECT unit_id, round((SELECT quantile_cont(size_factor, 0.5) FROM f JOIN split USING (unit_id) WHERE split = 'train'), 6) AS size_factor FROM split WHERE split = 'test'""")
def _(i):
    return P.eval_size_factor(P.size_factors(i.counts, i.units), i.split, i.split.where("split = 'test'"), "train_median")


@query("q_scale", "SELECT feature, round(q, 6) AS q FROM q_scale")
def _(i):
    return i.q_scale


def drawn_sql(seed, n_draws):
    return (f"(SELECT draw, unit_id, row_number() OVER (PARTITION BY draw ORDER BY {hash_key(seed, 'draw', 'unit_id')}, draw, unit_id) AS r "
            f"FROM (SELECT unit_id FROM split WHERE split = 'train'), (SELECT unnest(range(0, {n_draws + 1})) AS draw))")


@query("quantile_sample_check", f""", dq AS (SELECT draw, feature, quantile_cont(predicted, 0.95) AS q FROM panel JOIN {drawn_sql(5, 6)} USING (unit_id) WHERE r <= 300 GROUP BY 1, 2)
 SELECT feature, round(q_all, 6) AS q_all, round(q_sample, 6) AS q_sample, round(sd_draws, 6) AS sd_draws, round((q_sample - q_all) / q_all, 6) AS rel_diff, round((q_sample - q_all) / sd_draws, 6) AS z
 FROM (SELECT feature, max(q) FILTER (draw = 0) AS q_sample, stddev_samp(q) FILTER (draw > 0) AS sd_draws FROM dq GROUP BY 1) JOIN (SELECT feature, q AS q_all FROM q_scale) USING (feature)""")
def _(i):
    return M.quantile_sample_check(i.panel, i.split.where("split = 'train'"), "predicted", 0.95, 300, 6, 5)


@query("standardise_on_reference", """SELECT unit_id, feature, round((measured - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS z FROM panel JOIN
 (SELECT feature, avg(measured) AS m, stddev_pop(measured) AS s FROM panel JOIN split USING (unit_id) WHERE split = 'train' GROUP BY 1) USING (feature)""")
def _(i):
    return P.standardise_on_reference(i.panel, i.split.where("split = 'train'"), "measured").select("unit_id", "feature", "z")


def auroc_sql(src, by, score, y):
    """rank-sum AUROC with average ranks per group"""
    g = (by + ", ") if by else ""
    pb = f"PARTITION BY {by} " if by else ""
    return (f"SELECT {g}(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auroc "
            f"FROM (SELECT {g}{y} AS y, rank() OVER ({pb}ORDER BY {score}) + (count(*) OVER ({'PARTITION BY ' + by + ', ' if by else 'PARTITION BY '}{score}) - 1) / 2.0 AS r FROM {src})"
            + (f" GROUP BY {by}" if by else ""))


@query("auroc", f"SELECT lang, round(auroc, 6) AS auroc FROM ({auroc_sql('(SELECT lang, n_chars, quality FROM labels JOIN documents USING (doc_id))', 'lang', 'n_chars', 'quality')})")
def _(i):
    d = i.table("labels").join(i.table("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return M.auroc(d, ["lang"], "n_chars", "quality")


def panel_rows(i):
    k = i.keys.select("unit_id", F.col("key").alias("cls")).where("cls <> 'unscored'")
    return i.stored_panel.join(i.q_scale, "feature").join(k, "unit_id").select("unit_id", "cls", "feature", F.round(F.col("predicted") / F.col("q"), 9).alias("value"))


FPS = f""", pr AS (SELECT unit_id, key AS cls, feature, round(predicted / q, 9) AS value FROM panel JOIN q_scale USING (feature) JOIN keys USING (unit_id) WHERE key <> 'unscored'),
 sides AS (SELECT c.k, o.o AS other, c.k AS cls, 1 AS y FROM (VALUES ('A'), ('B'), ('C')) c(k), (VALUES ('A'), ('B'), ('C'), ('OUT')) o(o) WHERE c.k <> o.o
  UNION ALL SELECT c.k, o.o, o.o, 0 FROM (VALUES ('A'), ('B'), ('C')) c(k), (VALUES ('A'), ('B'), ('C'), ('OUT')) o(o) WHERE c.k <> o.o
  UNION ALL SELECT c.k, 'rest', o.o, CASE WHEN c.k = o.o THEN 1 ELSE 0 END FROM (VALUES ('A'), ('B'), ('C')) c(k), (VALUES ('A'), ('B'), ('C'), ('OUT')) o(o)),
 contest AS (SELECT k, other, feature, value, y FROM pr JOIN sides USING (cls)),
 au AS ({auroc_sql('contest', 'k, other, feature', 'value', 'y')}),
 worst AS (SELECT k, feature, min(auroc) AS worst FROM au WHERE other IN (SELECT cls FROM (SELECT cls, count(DISTINCT unit_id) AS n FROM pr GROUP BY 1) WHERE n >= 20) GROUP BY 1, 2),
 ovr AS (SELECT k, feature, auroc AS ovr FROM au WHERE other = 'rest'),
 cd AS (SELECT k, feature, (avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) / sqrt(0.5 * (var_pop(value) FILTER (y = 1) + var_pop(value) FILTER (y = 0)) + 1e-12) AS d FROM contest WHERE other = 'rest' GROUP BY 1, 2),
 cs AS (SELECT * FROM worst JOIN ovr USING (k, feature) JOIN cd USING (k, feature))"""


@query("feature_scores", FPS + " SELECT k, feature, round(worst, 6) AS worst, round(ovr, 6) AS ovr, round(d, 6) AS d FROM cs")
def _(i):
    return M.class_feature_scores(panel_rows(i), B.CLASSES, LABELS, 20)


@query("feature_panel_select", FPS + """ SELECT k, feature, round(worst, 6) AS worst, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY worst DESC, ovr DESC, feature) AS pos FROM
 (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY worst DESC, k) AS b FROM cs) WHERE b = 1 AND worst >= 0.4) WHERE pos <= 2""")
def _(i):
    s = M.class_feature_scores(panel_rows(i), B.CLASSES, LABELS, 20)
    return M.feature_panel_select(s, B.CLASSES, 2, 0.4).select("k", "feature", "worst", "pos")


def kappa_sql(src, by, a, b):
    g = by + ", " if by else ""
    pe = " + ".join(f"(count(*) FILTER ({a} = '{c}') / n) * (count(*) FILTER ({b} = '{c}') / n)" for c in LABELS)
    return (f"SELECT {g}cnt AS n, po AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT {g}count(*) AS cnt, count(*) FILTER ({a} = {b}) / count(*)::DOUBLE AS po, "
            + pe.replace(" / n)", " / count(*)::DOUBLE)") + f" AS pe FROM {src} {'GROUP BY ' + by if by else ''})")


@query("cohen_kappa", f"SELECT group_id, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM ({kappa_sql('keys', 'group_id', 'annot', 'gated')})")
def _(i):
    return M.cohen_kappa(i.keys, ["group_id"], "annot", "gated", LABELS)


@query("agreement_report", f""", k2 AS (SELECT '*' AS scope, annot, gated FROM keys UNION ALL SELECT group_id, annot, gated FROM keys), kk AS ({kappa_sql('k2', 'scope', 'annot', 'gated')})
 SELECT scope, n, round(kappa, 6) AS kappa, CASE WHEN coalesce(kappa, -2) >= 0.1 THEN 'agreement key' ELSE 'annotation key' END AS decision, cls, n_a, n_b, n_agree, round(n_agree / nullif(n_a, 0), 6) AS recall, round(n_agree / nullif(n_b, 0), 6) AS precision
 FROM (SELECT scope, cls, count(*) FILTER (annot = cls) AS n_a, count(*) FILTER (gated = cls) AS n_b, count(*) FILTER (annot = cls AND gated = cls) AS n_agree FROM k2, (VALUES ('A'), ('B'), ('C'), ('OUT')) c(cls) GROUP BY 1, 2) JOIN kk USING (scope)""")
def _(i):
    return M.agreement_report(i.keys, "annot", "gated", LABELS, "group_id", 0.1)


@query("crosstab", "SELECT key, " + ", ".join(f"count(*) FILTER (cell_type = '{t}') AS {t}" for t in B.ANNOTATION) + " FROM keys GROUP BY 1")
def _(i):
    return M.crosstab(i.keys, "key", "cell_type", list(B.ANNOTATION))


ACC = "round(count(*) FILTER ({0}) / nullif(count(*) FILTER ({1}), 0), 6)"


@query("score_predictions", f"""SELECT split, count(*) AS n, count(label) AS n_labelled, count(*) FILTER (call = '') AS n_abstain, round(count(*) FILTER (call = '') / count(*), 6) AS abstain_rate,
 count(*) FILTER (call <> '' AND label IS NOT NULL) AS n_decided, {ACC.format("call <> '' AND call = label", "call <> '' AND label IS NOT NULL")} AS accuracy, {ACC.format("call <> '' AND call = label", "label IS NOT NULL")} AS accuracy_strict
 FROM (SELECT split, call, CASE WHEN key IN ('A', 'B', 'C') THEN key END AS label FROM evaluated) GROUP BY 1""")
def _(i):
    return M.score_predictions(i.evaluated.withColumn("label", F.when(F.col("key").isin("A", "B", "C"), F.col("key"))), ["split"], "call", "label")


@query("call_counts", "SELECT split, call, count(*) AS n FROM evaluated WHERE call <> '' GROUP BY 1, 2")
def _(i):
    return M.call_counts(i.evaluated, ["split"], "call")


@query("selective_accuracy", f"""SELECT group_id, count(*) AS n, count(*) FILTER (key <> 'unscored') AS n_scored, round(count(*) FILTER (call <> '') / count(*), 6) AS coverage,
 count(*) FILTER (key <> 'unscored' AND call <> '') AS n_called, {ACC.format("key <> 'unscored' AND call <> '' AND call = key", "key <> 'unscored' AND call <> ''")} AS accuracy_of_calls,
 {ACC.format("key <> 'unscored' AND (call <> '' AND call = key OR call = '' AND key = 'OUT')", "key <> 'unscored'")} AS decision_accuracy, {ACC.format("key = 'OUT' AND call = ''", "key = 'OUT'")} AS out_decline_rate FROM evaluated GROUP BY 1""")
def _(i):
    return M.selective_accuracy(i.evaluated, ["group_id"], "call", "key")


SCOPE = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "C"}


@query("annotation_graded", f"""SELECT scope_group, in_scope, count(*) AS n, count(*) FILTER (call <> '') AS n_called, round(count(*) FILTER (call <> '') / count(*), 6) AS call_share,
 CASE WHEN in_scope THEN {ACC.format("call <> '' AND call = scope_group", "call <> ''")} END AS accuracy, count(DISTINCT cell_type) FILTER (cell_type NOT IN {lit_list(SCOPE)}) AS n_unmapped_labels
 FROM (SELECT *, scope_group IN ('A', 'B', 'C') AS in_scope FROM (SELECT *, coalesce({B._case('cell_type', SCOPE)}, 'other') AS scope_group FROM evaluated)) GROUP BY 1, 2""")
def _(i):
    return M.annotation_graded(i.evaluated, "call", "cell_type", SCOPE, ["A", "B", "C"])


Q3 = f""", ql AS (SELECT unit_id, CASE WHEN margin >= 0.02 THEN call0 END AS q1, CASE WHEN margin >= 0.1 THEN call0 END AS q2, CASE WHEN w1 > w2 THEN 'A' WHEN w1 < w2 THEN 'B' END AS q3, CASE WHEN conf < 0.3 THEN '' ELSE call0 END AS call_q1,
  CASE WHEN conf < 0.5 THEN '' ELSE call0 END AS call_q2, CASE WHEN conf < 0.4 THEN '' ELSE call0 END AS call_q3
  FROM (SELECT *, CASE WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END AS call0, A * 1.5 AS w1, B AS w2 FROM calls))"""


def question_labels(i):
    c = i.calls.withColumn("call0", C.argmax_class(B.CLASSES))
    w1, w2 = F.col("A") * 1.5, F.col("B")
    return c.select("unit_id", F.when(F.col("margin") >= 0.02, F.col("call0")).alias("q1"), F.when(F.col("margin") >= 0.1, F.col("call0")).alias("q2"),
                    F.when(w1 > w2, "A").when(w1 < w2, "B").alias("q3"), *[F.when(F.col("conf") < b, "").otherwise(F.col("call0")).alias(f"call_q{k}") for k, b in ((1, 0.3), (2, 0.5), (3, 0.4))])


@query("question_disagreement", Q3 + " UNION ALL ".join(f""" SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS both, count(*) FILTER ({a} = {b}) AS agree, count(*) FILTER ({a} <> {b}) AS disagree,
 count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS a_only, count(*) FILTER ({a} IS NULL AND {b} IS NOT NULL) AS b_only, count(*) FILTER (call_{a} <> '' AND call_{b} = '') AS over_answer,
 round(count(*) FILTER ({a} <> {b}) / greatest(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), 1), 6) AS disagree_rate FROM ql""" for a, b in (("q1", "q2"), ("q1", "q3"), ("q2", "q3"))))
def _(i):
    q = question_labels(i)
    return M.question_disagreement(q.select("unit_id", "q1", "q2", "q3"), ["q1", "q2", "q3"], q.select("unit_id", "call_q1", "call_q2", "call_q3"))


@query("question_flips", Q3 + " SELECT q1 AS \"from\", q3 AS \"to\", count(*) AS n FROM ql WHERE q1 <> q3 GROUP BY 1, 2")
def _(i):
    return M.question_flips(question_labels(i), "q1", "q3")


N_TAU = 8
TAUS = f"""SELECT DISTINCT tau FROM (SELECT 0.0::DOUBLE AS tau UNION ALL SELECT unnest(quantile_cont(conf, [{', '.join(str(k / N_TAU) for k in range(1, N_TAU))}])) FROM evaluated)"""


@query("coverage_curve_tau", f"""SELECT round(tau, 6) AS tau, round(count(*) FILTER (call <> '' AND conf >= tau) / (SELECT count(*) FROM evaluated), 6) AS coverage, count(*) FILTER (call <> '' AND conf >= tau) AS n_answered,
 count(*) FILTER (call <> '' AND conf >= tau AND key <> 'unscored') AS n_labelled, {ACC.format("call <> '' AND conf >= tau AND call = key", "call <> '' AND conf >= tau AND key <> 'unscored'")} AS accuracy FROM evaluated, ({TAUS}) GROUP BY tau""")
def _(i):
    return M.coverage_curve_tau(i.evaluated.withColumn("label", F.when(F.col("key") != "unscored", F.col("key"))), "conf", "call", "label", N_TAU)


SUBSETS = [("keys", "ECONOMY"), ("keys", "MEDIUM"), ("keys", "SMALL"), ("seconds", "LARGE"), ("seconds", "PROMO"), ("seconds", "STANDARD"), ("all", "ECONOMY"), ("all", "LARGE"), ("all", "MEDIUM"), ("all", "PROMO"), ("all", "SMALL"), ("all", "STANDARD")]


@query("subset_accuracy", f""", sub AS (SELECT * FROM (VALUES {', '.join(str(s) for s in SUBSETS)}) t(subset_id, feature)),
 sc AS (SELECT subset_id, unit_id, coalesce(sum(v) FILTER (cls = 'A'), 0) / 2 AS A, coalesce(sum(v) FILTER (cls = 'B'), 0) / 2 AS B, coalesce(sum(v) FILTER (cls = 'C'), 0) / 2 AS C
   FROM (SELECT unit_id, feature, v, {B._case('feature', B.F2C)} AS cls FROM evidence) JOIN sub USING (feature) GROUP BY 1, 2)
 SELECT subset_id, count(*) AS n_labelled, round(avg(CASE WHEN {"CASE WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END"} = key THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy
 FROM sc JOIN keys USING (unit_id) WHERE key IN ('A', 'B', 'C') GROUP BY 1""")
def _(i):
    sub = i.spark.createDataFrame(SUBSETS, "subset_id string, feature string")
    lab = i.keys.where(F.col("key").isin("A", "B", "C")).select("unit_id", F.col("key").alias("label"))
    ev = i.evidence.withColumn("cls", C.map_expr(B.F2C)[F.col("feature")])
    return M.subset_accuracy(ev, lab, sub, B.CLASSES, {c: len(f) for c, f in B.PANEL.items()})


@query("random_unit_subset_accuracy", f""", s AS (SELECT unit_id, draw, call = key AS ok, row_number() OVER (PARTITION BY draw ORDER BY {hash_key(11, 'draw', 'unit_id')}, draw, unit_id) AS r
   FROM evaluated, (SELECT unnest(range(1, 13)) AS draw) WHERE key <> 'unscored')
 SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS sd, round(min(acc), 6) AS min, round(max(acc), 6) AS max FROM (SELECT draw, avg(ok::INT)::DOUBLE AS acc FROM s WHERE r <= 100 GROUP BY 1)""")
def _(i):
    d = i.evaluated.where("key <> 'unscored'").select("unit_id", (F.col("call") == F.col("key")).alias("correct"))
    return M.random_unit_subset_accuracy(d, 100, 12, 11)


@query("composition_enrichment", """SELECT cell_type, count(*) AS n_all, count(*) FILTER (call = '') AS n_flagged, round(count(*) / sum(count(*)) OVER (), 6) AS frac_all,
 round(count(*) FILTER (call = '') / greatest(sum(count(*) FILTER (call = '')) OVER (), 1), 6) AS frac_flagged, round(count(*) FILTER (call = '') / count(*), 6) AS flag_rate,
 round((count(*) FILTER (call = '') / greatest(sum(count(*) FILTER (call = '')) OVER (), 1)) / (count(*) / sum(count(*)) OVER ()), 6) AS enrichment FROM evaluated GROUP BY 1""")
def _(i):
    return M.composition_enrichment(i.evaluated.withColumn("flag", F.col("call") == ""), "cell_type", "flag")


@query("pearson_by_feature", """SELECT group_id, feature, count(*) AS n, round(corr(predicted, measured), 6) AS r, round(1 - sum(power(measured - predicted / 1500, 2)) / nullif(var_pop(measured) * count(*), 0), 6) AS r2
 FROM panel JOIN units USING (unit_id) GROUP BY 1, 2""")
def _(i):
    d = i.panel.join(i.units, "unit_id").withColumn("predicted", F.col("predicted") / 1500)
    return M.pearson_by_feature(d, ["group_id", "feature"], "predicted", "measured")


PS = ", ps AS (SELECT feature, corr(predicted, measured) AS r, corr(unit_id % 7 + predicted / 1e5, measured) AS r0 FROM panel GROUP BY 1)"


@query("paired_score_change", PS + """ SELECT round(avg(r), 6) AS score, round(avg(r0), 6) AS base_score, round(avg(r - r0), 6) AS change, arg_min(feature, r - r0) AS worst_feature, round(min(r - r0), 6) AS worst_change FROM ps""")
def _(i):
    return M.paired_score_change(i.panel.withColumn("base", F.col("unit_id") % 7 + F.col("predicted") / 1e5), "predicted", "base", "measured")


CH = "(SELECT 'priced' AS channel, unit_id, feature, predicted AS v, measured FROM panel UNION ALL SELECT 'noisy', unit_id, feature, measured * (1 + unit_id % 5), measured FROM panel UNION ALL SELECT 'flat', unit_id, feature, 1, measured FROM panel)"


def channels_of(i):
    p = i.panel.select("unit_id", "feature", "measured", "predicted")
    return (p.select(F.lit("priced").alias("channel"), "unit_id", "feature", F.col("predicted").alias("v"), "measured")
             .unionByName(p.select(F.lit("noisy").alias("channel"), "unit_id", "feature", (F.col("measured") * (1 + F.col("unit_id") % 5)).alias("v"), "measured"))
             .unionByName(p.select(F.lit("flat").alias("channel"), "unit_id", "feature", F.lit(1.0).alias("v"), "measured")))


@query("channel_trust", f""", r AS (SELECT channel, feature, CASE WHEN max(v) > min(v) AND max(measured) > min(measured) THEN corr(v, measured) ELSE 0 END AS r FROM {CH} GROUP BY 1, 2),
 t AS (SELECT channel, avg(greatest(r, 0)) AS trust FROM r GROUP BY 1) SELECT channel, round(trust, 6) AS trust, round(trust / max(trust) OVER (), 6) AS scale FROM t""")
def _(i):
    return M.channel_trust(channels_of(i), "measured")


@query("cross_feature_correlation", """, g AS (SELECT group_id, a.feature AS pair, corr(a.measured, b.count) AS r, stddev_pop(a.measured) AS sx, stddev_pop(b.count) AS sy FROM panel a JOIN
 (SELECT unit_id, CASE feature WHEN 'Brand#1' THEN 'ECONOMY' WHEN 'Brand#2' THEN 'LARGE' WHEN 'Brand#3' THEN 'PROMO' END AS feature, count FROM counts) b ON a.unit_id = b.unit_id AND a.feature = b.feature JOIN units u ON u.unit_id = a.unit_id GROUP BY 1, 2)
 SELECT pair, count(*) AS n_groups, round(avg(r), 6) AS r FROM g WHERE sx > 1e-8 AND sy > 1e-8 GROUP BY 1""")
def _(i):
    pairs = {"Brand#1": "ECONOMY", "Brand#2": "LARGE", "Brand#3": "PROMO"}
    c = i.counts.where(F.col("feature").isin(list(pairs))).select("unit_id", C.map_expr(pairs)[F.col("feature")].alias("feature"), "count")
    d = i.panel.select("unit_id", "feature", "measured").join(c, ["unit_id", "feature"]).join(i.units.select("unit_id", "group_id"), "unit_id")
    return M.cross_feature_correlation(d.withColumnRenamed("feature", "pair"), "pair", "measured", "count")


@query("rank_correlation", """, r AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS a, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0 AS b
 FROM (SELECT sum(count) AS qty, round(max(c_acctbal) / 100) AS bal FROM counts JOIN customer ON unit_id = c_custkey GROUP BY unit_id)) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def _(i):
    q = i.counts.groupBy("unit_id").agg(F.sum("count").alias("qty"))
    c = i.table("customer").select(F.col("c_custkey").alias("unit_id"), F.round(F.col("c_acctbal") / 100).alias("bal"))
    return M.rank_correlation(q.join(c, "unit_id"), "qty", "bal")


@query("channel_disagreement", f"""SELECT channels, count(*) AS n, round(avg(CASE WHEN call <> '' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS selection_rate, {ACC.format("call <> '' AND call = key", "call <> ''")} AS accuracy, round(count(*) / sum(count(*)) OVER (), 6) AS share
 FROM (SELECT *, CASE WHEN CASE WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END = gated THEN 'agree' ELSE 'differ' END AS channels FROM evaluated) GROUP BY 1""")
def _(i):
    e = i.evaluated.withColumn("top", C.argmax_class(B.CLASSES)).withColumn("ok", F.col("call") == F.col("key")).withColumn("sel", F.col("call") != "")
    return M.channel_disagreement(e, "top", "gated", "ok", "sel")


CALLED = f"(SELECT c.unit_id, c.call AS cls, feature, v FROM calls c JOIN (SELECT *, {B._case('feature', B.F2C)} AS fc FROM evidence) e ON c.unit_id = e.unit_id AND c.call = fc)"


def called_panel(i):
    """evidence of the called class only"""
    ev = i.evidence.withColumn("cls", C.map_expr(B.F2C)[F.col("feature")])
    return ev.join(i.calls.select("unit_id", F.col("call").alias("cls")), ["unit_id", "cls"])


@query("marker_shares", f""", t AS (SELECT *, v = max(v) OVER (PARTITION BY unit_id) AS top FROM {CALLED}), m AS (SELECT *, sum(top::INT) OVER (PARTITION BY unit_id) AS k FROM t),
 nc AS (SELECT cls, count(DISTINCT unit_id) AS n FROM t GROUP BY 1)
 SELECT cls, feature, round(sum(CASE WHEN top THEN 1.0 / k ELSE 0 END)::DOUBLE / (SELECT sum(n) FROM nc), 6) AS share_all, round(sum(CASE WHEN top THEN 1.0 / k ELSE 0 END)::DOUBLE / any_value(n), 6) AS share_within FROM m JOIN nc USING (cls) GROUP BY 1, 2""")
def _(i):
    return M.marker_shares(called_panel(i))


@query("attribution_summary", f""", t AS (SELECT unit_id, cls, arg_max(feature, row(v, feature)) AS top, max(v) AS d FROM {CALLED} GROUP BY 1, 2), md AS (SELECT cls, top, count(*) AS k FROM t GROUP BY 1, 2)
 SELECT cls, n, round(flip_rate, 6) AS flip_rate, mode, round(d25, 6) AS d25, round(d50, 6) AS d50, round(d75, 6) AS d75, round(k / n, 6) AS mode_fraction FROM
 (SELECT cls, count(*) AS n, avg((d < 0.6)::INT)::DOUBLE AS flip_rate, quantile_cont(d, 0.25) AS d25, quantile_cont(d, 0.5) AS d50, quantile_cont(d, 0.75) AS d75 FROM t GROUP BY 1)
 JOIN (SELECT cls, arg_max(top, row(k, top)) AS mode, max(k) AS k FROM md GROUP BY 1) USING (cls)""")
def _(i):
    t = called_panel(i).groupBy("unit_id", "cls").agg(F.max_by("feature", F.struct("v", "feature")).alias("top"), F.max("v").alias("d"))
    return M.attribution_summary(t.withColumn("flip", F.col("d") < 0.6), ["cls"], "top", "flip", "d")


LOST = "base <> '' AND base = key AND pert <> key"
CASE_SUM_SQL = {"n_cases": "TRUE", "n_scored": "key <> 'unscored'", "called_base": "base <> ''", "called_pert": "pert <> ''",
                "dec_ok_base": "key <> 'unscored' AND (base <> '' AND base = key OR base = '' AND key = 'OUT')", "dec_ok_pert": "key <> 'unscored' AND (pert <> '' AND pert = key OR pert = '' AND key = 'OUT')",
                "sel_ok_base": "key <> 'unscored' AND base <> '' AND base = key", "sel_ok_pert": "key <> 'unscored' AND pert <> '' AND pert = key",
                "sel_n_base": "key <> 'unscored' AND base <> ''", "sel_n_pert": "key <> 'unscored' AND pert <> ''", "call_changed": "base <> pert", "lost": LOST,
                **{f"lost_{x}": f"{LOST} AND {LABEL_SQL} = '{x}'" for x in ("representation", "head", "decision")}}
CASE_TABLE = f"(SELECT group_id, unit_id, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in CASE_SUM_SQL.items())} FROM {CASES_SQL} GROUP BY 1, 2)"


def case_table(i):
    return M.unit_case_tables(cases_of(i).withColumn("label", C.lost_label("probe", "argmax", "key")), ["group_id", "unit_id"])


@query("unit_case_tables", f"SELECT * FROM {CASE_TABLE}")
def _(i):
    return case_table(i)


def r(a, b):
    return f"sum({a})::DOUBLE / nullif(sum({b}), 0)::DOUBLE"


@query("unit_stats", f"""SELECT group_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in {
    'decision_acc_base': r('dec_ok_base', 'n_scored'), 'decision_acc_pert': r('dec_ok_pert', 'n_scored'), 'selective_acc_base': r('sel_ok_base', 'sel_n_base'), 'selective_acc_pert': r('sel_ok_pert', 'sel_n_pert'),
    'coverage_base': r('called_base', 'n_cases'), 'coverage_pert': r('called_pert', 'n_cases'), 'call_change_rate': r('call_changed', 'n_cases'), 'share_representation': r('lost_representation', 'lost'),
    'share_head': r('lost_head', 'lost'), 'share_decision': r('lost_decision', 'lost'), 'decision_loss': r('dec_ok_base', 'n_scored') + ' - ' + r('dec_ok_pert', 'n_scored'),
    'selective_loss': r('sel_ok_base', 'sel_n_base') + ' - ' + r('sel_ok_pert', 'sel_n_pert')}.items())}, count(*) FILTER (lost > 0) AS n_lost_units FROM {CASE_TABLE} GROUP BY 1""")
def _(i):
    return M.unit_stats(case_table(i), ["group_id"])


CM = f"(SELECT site, c.conf - greatest(c.A * 0.8, c.B * 1.1, c.C * 0.6) AS d_score, c.A - c.A * 0.8 AS d_a, (c.conf < 0.35) <> (greatest(c.A * 0.8, c.B * 1.1, c.C * 0.6) < 0.35) AS changed FROM calls c JOIN units USING (unit_id))"


@query("case_medians", f"""SELECT site, count(*) AS n, round(avg(changed::INT)::DOUBLE, 6) AS call_change_rate, round(avg(d_score), 6) AS mean_d_score, round(avg(d_a), 6) AS mean_d_a,
 round(quantile_cont(d_score, 0.5), 6) AS median_d_score, round(quantile_cont(d_a, 0.5), 6) AS median_d_a FROM {CM} GROUP BY 1""")
def _(i):
    top2 = F.greatest(F.col("A") * 0.8, F.col("B") * 1.1, F.col("C") * 0.6)
    c = i.calls.join(i.units.select("unit_id", "site"), "unit_id").select("site", (F.col("conf") - top2).alias("d_score"), (F.col("A") - F.col("A") * 0.8).alias("d_a"),
                                                                            ((F.col("conf") < 0.35) != (top2 < 0.35)).alias("changed"))
    return M.case_medians(c, ["site"], ["d_score", "d_a"], "changed")


# ---- treated vs control
KC = "(SELECT o_orderstatus AS cond, CASE o_orderpriority WHEN '5-LOW' THEN 0 ELSE 1 END AS a, o_orderpriority AS target, p_type AS feature, sum(l_quantity) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, 1, 2, 3, 4)"


def order_panel(i):
    """per order and part type the quantity; orders of priority 5-LOW are the controls, the others the targets"""
    li, o, p = i.table("lineitem"), i.table("orders"), i.table("part")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("o_orderkey", F.col("o_orderstatus").alias("cond"), (F.col("o_orderpriority") != "5-LOW").cast("int").alias("a"),
                       F.col("o_orderpriority").alias("target"), F.col("p_type").alias("feature")).agg(F.sum("l_quantity").alias("value")))


@query("knockout_census", f""", g AS (SELECT cond, a, target, feature, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM {KC} GROUP BY 1, 2, 3, 4),
 x AS (SELECT t.cond, t.target, t.feature, t.n, (t.m - c.m) / sqrt(c.v) AS shift_sd, abs(t.m - c.m) / (1.96 * sqrt(t.v / t.n + c.v / c.n)) AS over_half_width FROM g t JOIN g c ON t.cond = c.cond AND t.feature = c.feature AND t.a = 1 AND c.a = 0 WHERE t.n >= 30 AND c.n >= 30 AND t.feature <> 'PROMO')
 SELECT cond, target, feature, n, round(shift_sd, 6) AS shift_sd, round(over_half_width, 6) AS over_half_width FROM x WHERE abs(shift_sd) >= 0.02 AND over_half_width >= 0.2""")
def _(i):
    return M.knockout_census(order_panel(i), ["cond"], 30, 0.02, 0.2, ["PROMO"])


STAGED = f"(SELECT 'raw' AS stage, a, target, feature, value FROM {KC} UNION ALL SELECT 'log', a, target, feature, ln(1 + value) FROM {KC})"


def staged(i):
    o = order_panel(i)
    return o.select(F.lit("raw").alias("stage"), "a", "target", "feature", "value").unionByName(o.select(F.lit("log").alias("stage"), "a", "target", "feature", F.log1p("value").alias("value")))


GS = f""", t AS (SELECT stage, target, feature, avg(value) AS m1 FROM {STAGED} WHERE a = 1 GROUP BY 1, 2, 3), c AS (SELECT stage, feature, avg(value) AS m0, var_pop(value) AS v0 FROM {STAGED} WHERE a = 0 GROUP BY 1, 2),
 d AS (SELECT stage, target, feature, m1 - m0 AS d, v0 FROM t JOIN c USING (stage, feature))"""


@query("group_shift_over_spread", GS + " SELECT stage, target, round(sqrt(sum(d * d)), 6) AS shift, round(sqrt(sum(v0)), 6) AS spread, round(sqrt(sum(d * d)) / sqrt(sum(v0)), 6) AS ratio FROM d GROUP BY 1, 2")
def _(i):
    return M.group_shift_over_spread(staged(i))


@query("shift_cosines", GS + " SELECT x.stage, x.target, y.target AS other, round(sum(x.d * y.d) / (sqrt(sum(x.d * x.d)) * sqrt(sum(y.d * y.d))), 6) AS cosine FROM d x JOIN d y ON x.stage = y.stage AND x.feature = y.feature AND x.target < y.target GROUP BY 1, 2, 3")
def _(i):
    return M.shift_cosines(staged(i))


# ---- bars and thresholds
@query("bar_from_quantile", "SELECT split, round(quantile_cont(conf, 0.2), 6) AS bar FROM evaluated GROUP BY 1")
def _(i):
    return M.bar_from_quantile(i.evaluated, ["split"], "conf", 0.2)


GRID = [round(0.05 * k, 2) for k in range(1, 20)]


@query("calibrate_to_abstain", f""", g AS (SELECT t, avg((conf < t)::INT)::DOUBLE AS rate FROM evaluated, (SELECT unnest({GRID}::DOUBLE[]) AS t) GROUP BY 1)
 SELECT t AS threshold, round(rate, 6) AS abstain_rate FROM g ORDER BY round(abs(rate - 0.33), 12), t LIMIT 1""")
def _(i):
    return M.calibrate_to_abstain(i.evaluated, "conf", 0.33, GRID)


@query("tau_selection", f""", x AS (SELECT t AS tau, annot, CASE WHEN conf < t THEN 'OUT' WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END AS k FROM evaluated, (SELECT unnest({GRID}::DOUBLE[]) AS t) WHERE split = 'val'),
 kk AS (SELECT tau, round(kappa, 6) AS kappa FROM ({kappa_sql('x', 'tau', 'k', 'annot')})) SELECT tau, kappa FROM kk ORDER BY kappa DESC, tau LIMIT 1""")
def _(i):
    return M.tau_selection(i.evaluated.where("split = 'val'"), B.CLASSES, "annot", LABELS, GRID)


@query("gate_variant_grid", f""", v AS (SELECT 'full' AS variant, 6 AS n_markers, k.unit_id, site || '|' || group_id AS batch, annot, gated FROM keys k
  UNION ALL SELECT 'lean', 3, k.unit_id, site || '|' || group_id, annot, CASE WHEN h_ECONOMY AND NOT h_MEDIUM THEN 'A' WHEN h_MEDIUM THEN 'B' WHEN h_SMALL THEN 'C' ELSE 'OUT' END FROM keys k JOIN flags USING (unit_id)),
 kk AS ({kappa_sql('v', 'variant, n_markers, batch', 'annot', 'gated')})
 SELECT variant, n_markers, round(avg(kappa), 6) AS mean_kappa, round(min(kappa), 6) AS min_kappa, row_number() OVER (ORDER BY round(avg(kappa), 6) DESC, n_markers, variant) = 1 AS chosen FROM kk GROUP BY 1, 2""")
def _(i):
    lean = [{"label": "A", "all_high": ["ECONOMY"], "none_high": ["MEDIUM"]}, {"label": "B", "all_high": ["MEDIUM"]}, {"label": "C", "all_high": ["SMALL"]}]
    d = (C.high_flags(i.measured_wide, B.THRESHOLDS).join(i.units, "unit_id").withColumn("batch", F.concat_ws("|", "site", "group_id"))
          .withColumn("annot", C.map_expr(B.ANNOTATION)[F.col("cell_type")]))
    return M.gate_variant_grid(d, "batch", "annot", {"full": C.gate(B.GATE), "lean": C.gate(lean)}, {"full": 6, "lean": 3}, LABELS)


@query("threshold_otsu", """, x AS (SELECT feature, measured AS v FROM panel WHERE measured > 0), lim AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1),
 hist AS (SELECT l.feature, lo, hi, b AS bin, (SELECT count(*) FROM x WHERE x.feature = l.feature AND least(floor((v - lo) / (hi - lo) * 64), 63) = b) AS n FROM lim l, (SELECT unnest(range(0, 64)) AS b)),
 p AS (SELECT *, lo + (hi - lo) / 64 * (bin + 0.5) AS c, n / sum(n) OVER (PARTITION BY feature) AS p FROM hist),
 w AS (SELECT *, sum(p) OVER u AS w0, sum(p * c) OVER u AS mc, sum(p * c) OVER (PARTITION BY feature) AS mt FROM p WINDOW u AS (PARTITION BY feature ORDER BY bin)),
 s AS (SELECT *, round(w0 * (1 - w0) * power(mc / greatest(w0, 1e-12) - (mt - mc) / greatest(1 - w0, 1e-12), 2), 9) AS sb FROM w WHERE bin < 63)
 SELECT feature, round(lo + (hi - lo) / 64 * (bin + 1), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY sb DESC, bin) AS r FROM s) WHERE r = 1""")
def _(i):
    return M.threshold_otsu(i.panel, ["feature"], "measured", 64)


@query("donor_eligibility", """, d AS (SELECT o_custkey AS g, o_orderstatus AS st, o_orderpriority AS ce, 's' || CAST(o_orderkey % 3 AS VARCHAR) AS sm FROM orders),
 f AS (SELECT g, count(DISTINCT st) AS n_status, count(DISTINCT ce) AS n_centres, count(DISTINCT sm) AS n_samples, min(st) AS st, min(ce) AS centre, min(sm) AS first_sample, count(*) AS n FROM d GROUP BY 1)
 SELECT g, n_status, n_centres, n_samples, centre, first_sample, n, n_first, CASE WHEN n_status = 1 THEN CASE st WHEN 'F' THEN 'healthy' WHEN 'O' THEN 'patient' END END AS kind,
  CASE WHEN n_status = 1 AND st IN ('F', 'O') THEN n_centres = 1 AND n_first >= 1 ELSE false END AS eligible
 FROM f JOIN (SELECT g, sm AS first_sample, count(*) AS n_first FROM d GROUP BY 1, 2) USING (g, first_sample)""")
def _(i):
    o = i.table("orders")
    d = o.select(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("ce"), F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("sm"))
    return M.donor_eligibility(d, "g", "st", "ce", "sm", {"F": "healthy", "O": "patient"}, 1)

"""Queries over rankings, folds, halves, draws, samples and chains of stages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D, metrics as M, prepare as P, ranking as R, selection as S
from .bindings import hash_key, hash_unit
from .metric_queries import TAUS
from .registry import query

RANK = "row_number() OVER (PARTITION BY {by} ORDER BY {v} DESC NULLS LAST, " + hash_key(1, "unit_id") + ", unit_id)"


@query("rank_encode", """SELECT unit_id, array_to_string(list_slice(list(feature ORDER BY value DESC, feature), 1, 10), ',') AS tokens, least(count(*), 10) AS n FROM (SELECT unit_id, feature, count AS value FROM counts WHERE count > 0) GROUP BY 1""")
def _(i):
    t = D.rank_encode(i.counts.select("unit_id", F.col("feature").alias("token"), F.col("count").alias("value")), 10)
    return t.select("unit_id", F.array_join("tokens", ",").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@query("rank_view", """SELECT unit_id, feature AS token, round((2049 - r) / 2048.0::DOUBLE, 6) AS value, 1::BIGINT AS present FROM
 (SELECT unit_id, feature, row_number() OVER (PARTITION BY unit_id ORDER BY count DESC, feature) AS r FROM counts WHERE count > 0)""")
def _(i):
    return D.rank_view(D.rank_encode(i.counts.select("unit_id", F.col("feature").alias("token"), F.col("count").alias("value")), 2048))


@query("coverage_select", f"""SELECT unit_id, split, r AS rank FROM (SELECT unit_id, split, {RANK.format(by='split', v='round(margin, 12)')} AS r, count(*) OVER (PARTITION BY split) AS n FROM evaluated) WHERE r <= ceil(0.3 * n - 1e-9)""")
def _(i):
    d = i.evaluated.select("unit_id", "split", F.round("margin", 12).alias("margin"))
    return S.coverage_select(d, ["split"], "margin", 0.3, 1).select("unit_id", "split", "rank")


GRID = [0.2, 0.4, 0.6, 0.8, 1.0]
SAA = f""", rk AS (SELECT *, {RANK.format(by='scope', v='round(conf, 12)')} AS r, count(*) OVER (PARTITION BY scope) AS n FROM (SELECT '*' AS scope, unit_id, conf, call, key FROM evaluated UNION ALL SELECT group_id, unit_id, conf, call, key FROM evaluated)),
 cv AS (SELECT scope, c AS coverage, CAST(ceil(c * any_value(n) - 1e-9) AS BIGINT) AS k, count(*) FILTER (key <> 'unscored' AND r <= ceil(c * n - 1e-9)) AS n_scored, count(*) FILTER (call <> '' AND call = key AND r <= ceil(c * n - 1e-9)) AS ok
  FROM rk, (SELECT unnest({GRID}::DOUBLE[]) AS c) GROUP BY 1, 2)"""


def scoped(i):
    """every evaluated unit under its group and under the pooled scope '*'"""
    e = i.evaluated
    return e.select("unit_id", F.round("conf", 12).alias("conf"), "call", "key", "margin", F.explode(F.array(F.lit("*"), F.col("group_id"))).alias("scope"))


def curve_of(i):
    ok = (F.col("call") != "") & (F.col("call") == F.col("key"))
    return S.selective_accuracy_at(scoped(i), ["scope"], "conf", ok, F.col("key") != "unscored", GRID, 1)


@query("selective_accuracy_at", SAA + " SELECT scope, coverage, k, n_scored, round(ok / nullif(n_scored, 0), 6) AS accuracy FROM cv")
def _(i):
    return curve_of(i)


@query("accuracy_at_matched_coverage", SAA + " SELECT scope, coverage, k, n_scored, round(ok / nullif(n_scored, 0), 6) AS accuracy FROM cv WHERE n_scored > 0")
def _(i):
    """flagship: counts -> scale -> evidence -> scores -> calls, measured gate -> key, accuracy at matched coverage"""
    return curve_of(i).where("n_scored > 0")


@query("aurc", SAA + """ SELECT scope, CASE WHEN count(acc) = count(*) THEN round(sum(0.5 * (acc + pa) * (coverage - pc)) / (max(coverage) - min(coverage)), 6) END AS aurc FROM
 (SELECT scope, coverage, acc, lag(acc) OVER w AS pa, lag(coverage) OVER w AS pc FROM (SELECT *, ok / nullif(n_scored, 0) AS acc FROM cv) WINDOW w AS (PARTITION BY scope ORDER BY coverage)) GROUP BY 1""")
def _(i):
    return S.aurc(curve_of(i), ["scope"])


@query("weighted_select", f""", w AS (SELECT unit_id, split, CAST(floor({hash_unit(4, 'unit_id')} * 4) AS BIGINT) AS w, {RANK.format(by='split', v='round(margin, 12)')} AS r FROM evaluated),
 b AS (SELECT *, sum(w) OVER (PARTITION BY split ORDER BY r) - w AS before, sum(w) OVER (PARTITION BY split) AS n FROM w)
 SELECT unit_id, split, c AS coverage, CAST(least(greatest(ceil(c * n - 1e-9) - before, 0), w) AS BIGINT) AS copies FROM b, (SELECT unnest([0.3, 0.7]::DOUBLE[]) AS c) WHERE w > 0""")
def _(i):
    from ..functions.draws import uniform
    d = i.evaluated.select("unit_id", "split", F.round("margin", 12).alias("margin"), F.floor(uniform(4, "unit_id") * 4).cast("long").alias("w"))
    r = R.value_rank(d, ["split"], "margin", 1, ["unit_id"])
    return S.weighted_select(r, ["split"], "rank", "w", [0.3, 0.7]).select("unit_id", "split", "coverage", "copies")


@query("select_lowest", f"""SELECT unit_id, r AS rank FROM (SELECT unit_id, row_number() OVER (ORDER BY round(margin, 12), {hash_key(1, 'unit_id')}, unit_id) AS r FROM evaluated WHERE call <> '') WHERE r <= 50""")
def _(i):
    d = i.evaluated.where("call <> ''").select("unit_id", F.round("margin", 12).alias("margin"))
    return S.select_lowest(d, [], "margin", 50, 1).select("unit_id", "rank")


@query("monotonic_rise", f""", t AS (SELECT tau, count(*) FILTER (call <> '' AND conf >= tau) / (SELECT count(*) FROM evaluated) AS coverage, count(*) FILTER (call <> '' AND conf >= tau AND key <> 'unscored') AS nl,
  count(*) FILTER (call <> '' AND conf >= tau AND call = key) / nullif(count(*) FILTER (call <> '' AND conf >= tau AND key <> 'unscored'), 0) AS acc FROM evaluated, ({TAUS}) GROUP BY 1),
 p AS (SELECT *, lag(acc) OVER (ORDER BY coverage DESC, tau) AS pa FROM t WHERE acc IS NOT NULL AND nl >= 30)
 SELECT 'conf' AS curve, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN round(avg(CASE WHEN pa IS NOT NULL THEN (acc >= pa - 1e-12)::INT END)::DOUBLE, 6) END AS share_rising, round(max(acc), 6) AS peak,
  round(arg_max(coverage, row(round(acc, 9), coverage)), 6) AS coverage_at_peak, round(max(acc) FILTER (coverage >= 0.4), 6) AS best_in_region FROM p""")
def _(i):
    lab = i.evaluated.withColumn("label", F.when(F.col("key") != "unscored", F.col("key")))
    c = M.coverage_curve_tau(lab, "conf", "call", "label", 8).withColumn("curve", F.lit("conf"))
    return S.monotonic_rise(c, ["curve"])


@query("cumulative_negatives", """SELECT o_orderstatus AS g, score, pos, neg, sum(neg) OVER (PARTITION BY o_orderstatus ORDER BY score) - neg AS below FROM
 (SELECT o_orderstatus, round(o_totalprice / 5000) AS score, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS pos, count(*) FILTER (o_orderpriority <> '1-URGENT')::DOUBLE AS neg FROM orders GROUP BY 1, 2)""")
def _(i):
    o = i.table("orders").select(F.col("o_orderstatus").alias("g"), F.round(F.col("o_totalprice") / 5000).alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("y"))
    t = o.groupBy("g", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return M.cumulative_negatives(t, ["g"])


@query("fold_assignment", f"SELECT unit_id, cluster, (dense_rank() OVER (ORDER BY h, cluster) - 1) % 5 AS fold FROM (SELECT unit_id, cluster, {hash_key(7, 'cluster')} AS h FROM trial)")
def _(i):
    return S.fold_by_cluster(i.trial.select("unit_id", "cluster"), "cluster", 5, 7).select("unit_id", "cluster", "fold")


@query("fold_by_row", f"SELECT unit_id, cluster, (row_number() OVER (PARTITION BY cluster ORDER BY {hash_key(7, 'unit_id')}, unit_id) - 1) % 5 AS fold FROM trial")
def _(i):
    return S.fold_by_row(i.trial.select("unit_id", "cluster"), "cluster", 5, 7)


@query("pseudo_blocks", f"SELECT unit_id, CASE WHEN a = 0 THEN 'ctl:' || CAST((row_number() OVER (PARTITION BY a ORDER BY {hash_key(2, 'unit_id')}, unit_id) - 1) % 5 AS VARCHAR) ELSE cluster END AS block FROM trial")
def _(i):
    d = i.trial.select("unit_id", "a", F.col("cluster").alias("block"))
    return S.pseudo_blocks(d, F.col("a") == 0, "block", 5, 2).select("unit_id", "block")


@query("usable_folds", """, c AS (SELECT cluster AS cl, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 0) AS n0 FROM trial GROUP BY 1),
 f AS (SELECT s, cl, n1, n0, (row_number() OVER (PARTITION BY s ORDER BY md5(CAST(s AS VARCHAR) || '|' || cl), cl) - 1) % 5 AS fold FROM c, (SELECT unnest(range(3, 7)) AS s)),
 g AS (SELECT s, fold, sum(n1) AS n1, sum(n0) AS n0 FROM f GROUP BY 1, 2), o AS (SELECT s, (sum(n1) OVER w - n1 > 0) AND (sum(n0) OVER w - n0 > 0) AS ok FROM g WINDOW w AS (PARTITION BY s))
 SELECT min(s) AS fold_seed FROM (SELECT s, bool_and(ok) AS ok FROM o GROUP BY 1) WHERE ok""")
def _(i):
    return S.usable_folds(i.trial, "cluster", "a", 5, 3, 4)


@query("stratified_halves", f"SELECT unit_id, r <= round_even(0.3 * n, 0) AS first_half FROM (SELECT unit_id, row_number() OVER (PARTITION BY group_id, site ORDER BY {hash_key(9, 'unit_id')}, unit_id) AS r, count(*) OVER (PARTITION BY group_id, site) AS n FROM units)")
def _(i):
    return S.stratified_halves(i.units, ["group_id", "site"], 0.3, 9).select("unit_id", "first_half")


@query("nested_draw", f"SELECT unit_id, size FROM (SELECT unit_id, row_number() OVER (ORDER BY {hash_key(6, 'unit_id')}, unit_id) AS r FROM units), (SELECT unnest([10, 50, 200]::BIGINT[]) AS size) WHERE r <= size")
def _(i):
    return S.nested_draw(i.units, [10, 50, 200], 6)


@query("round_robin_pick", f""", m AS (SELECT DISTINCT o_custkey AS unit_id, min(o_orderstatus) OVER w AS grp, min(o_orderpriority) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey)),
 t AS (SELECT *, row_number() OVER (PARTITION BY grp, q ORDER BY {hash_key(8, 'unit_id')}, unit_id) AS turn FROM m)
 SELECT unit_id, grp, q, turn, pick FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn, q) AS pick FROM t WHERE turn <= 7) WHERE pick <= 7""")
def _(i):
    m = i.table("orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.min("o_orderstatus").alias("grp"), F.min("o_orderpriority").alias("q"))
    return S.round_robin_pick(m, "grp", "q", 7, 8).select("unit_id", "grp", "q", "turn", "pick")


VERD = "CASE WHEN 0.1 * (a + pos) < 0.25 THEN 'support' WHEN 0.1 * (a + pos) > 0.45 THEN 'reject' ELSE 'unresolved' END"
STG = f"(SELECT g AS run, pos, 's' || CAST(pos AS VARCHAR) AS stage, {VERD} AS verdict FROM (SELECT group_id AS g, count(*) % 4 AS a FROM units GROUP BY 1), (SELECT unnest(range(0, 5)) AS pos))"


def stage_table(i):
    """five stages per group whose verdicts depend on the group's size modulo 4"""
    g = i.units.groupBy(F.col("group_id").alias("run")).agg((F.count(F.lit(1)) % 4).alias("a"))
    d = g.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(4))))
    x = F.lit(0.1) * (F.col("a") + F.col("pos"))
    return d.select("run", "a", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("stage"), F.when(x < 0.25, "support").when(x > 0.45, "reject").otherwise("unresolved").alias("verdict"))


@query("stage_walk", f""", v AS (SELECT * FROM {STG}), rj AS (SELECT run, min(pos) FILTER (verdict = 'reject') AS rej FROM v GROUP BY 1),
 u AS (SELECT v.*, rej, max(pos) FILTER (verdict = 'support') OVER (PARTITION BY run) AS ls FROM v JOIN rj USING (run) WHERE pos <= coalesce(rej, 99))
 SELECT run, max(stage) FILTER (pos = ls) AS last_supported, max(stage) FILTER (pos = rej) AS rejected, coalesce(string_agg(stage, ',' ORDER BY pos) FILTER (verdict = 'unresolved' AND pos > coalesce(ls, -1)), '') AS pending FROM u GROUP BY 1""")
def _(i):
    return S.stage_walk(stage_table(i), ["run"])


DRAWS = f"(SELECT cluster, b AS draw, pos, 's' || CAST(pos AS VARCHAR) AS stage, avg(y) * (pos + 1) + {hash_unit(1, 'cluster', 'b', 'pos')} AS value FROM trial, (SELECT unnest(range(0, 41)) AS b), (SELECT unnest(range(0, 3)) AS pos) GROUP BY 1, 2, 3)"


def draw_table(i):
    from ..functions.draws import uniform
    g = i.trial.groupBy("cluster").agg(F.avg("y").alias("m"))
    d = g.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return d.select("cluster", "draw", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("stage"), (F.col("m") * (F.col("pos") + 1) + uniform(1, "cluster", "draw", "pos")).alias("value"))


@query("step_difference", f""", d AS (SELECT *, lag(stage) OVER w AS fs, value - lag(value) OVER w AS dv FROM {DRAWS} WINDOW w AS (PARTITION BY cluster, draw ORDER BY pos))
 SELECT cluster, fs AS from_stage, stage AS to_stage, round(max(dv) FILTER (draw = 0), 6) AS step, round(quantile_cont(dv, 0.025) FILTER (draw > 0), 6) AS lo, round(quantile_cont(dv, 0.975) FILTER (draw > 0), 6) AS hi FROM d WHERE fs IS NOT NULL GROUP BY 1, 2, 3""")
def _(i):
    return S.step_difference(draw_table(i), ["cluster"], 0.05)


# ---- samples
@query("sample_per_donor", f"SELECT unit_id, group_id FROM (SELECT unit_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {hash_key(12, 'unit_id')}, unit_id) AS r FROM units) WHERE r <= 20")
def _(i):
    return S.sample_per_group(i.units.select("unit_id", "group_id"), ["group_id"], 20, 12)


@query("sample_population", f"SELECT unit_id FROM (SELECT unit_id, row_number() OVER (ORDER BY {hash_key(13, 'unit_id')}, unit_id) AS r FROM split WHERE split = 'train') WHERE r <= 100")
def _(i):
    return S.sample_per_group(i.split.where("split = 'train'").select("unit_id"), [], 100, 13)


@query("label_cost_split", f"SELECT unit_id, CASE WHEN r <= floor(n * 0.4) THEN 'train' ELSE 'eval' END AS part FROM (SELECT unit_id, row_number() OVER (ORDER BY {hash_key(14, 'unit_id')}, unit_id) AS r, count(*) OVER () AS n FROM units)")
def _(i):
    return S.label_cost_split(i.units.select("unit_id"), 0.4, 14)


@query("top_k_by_count", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_pos FROM orders GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 25")
def _(i):
    return R.top_k_by_count(i.table("orders"), "o_custkey", "o_orderkey", 25)


MR = f""", pool AS (SELECT u.unit_id, site, total FROM units u JOIN (SELECT unit_id, sum(count) AS total FROM counts GROUP BY 1) USING (unit_id) WHERE cell_type <> 'BUILDING'),
 ref AS (SELECT u.unit_id, site, total FROM units u JOIN (SELECT unit_id, sum(count) AS total FROM counts GROUP BY 1) USING (unit_id) WHERE cell_type = 'BUILDING' AND unit_id % 2 = 0),
 e AS (SELECT site, quantile_cont(total, 0.2) AS e1, quantile_cont(total, 0.4) AS e2, quantile_cont(total, 0.6) AS e3, quantile_cont(total, 0.8) AS e4 FROM ref GROUP BY 1),
 rb AS (SELECT site, (total >= e1)::INT + (total >= e2)::INT + (total >= e3)::INT + (total >= e4)::INT AS bin FROM ref JOIN e USING (site)),
 pb AS (SELECT unit_id, site, (total >= e1)::INT + (total >= e2)::INT + (total >= e3)::INT + (total >= e4)::INT AS bin FROM pool JOIN e USING (site)),
 q0 AS (SELECT site, bin, count(rbin) / sum(count(rbin)) OVER (PARTITION BY site) * 40 AS exact FROM (SELECT s.site, b.bin, rb.bin AS rbin FROM (SELECT DISTINCT site FROM ref) s CROSS JOIN (SELECT unnest(range(0, 5)) AS bin) b LEFT JOIN rb ON rb.site = s.site AND rb.bin = b.bin) GROUP BY 1, 2),
 q1 AS (SELECT site, bin, floor(exact) + CASE WHEN row_number() OVER (PARTITION BY site ORDER BY round(exact - floor(exact), 9) DESC, bin) <= 40 - sum(floor(exact)) OVER (PARTITION BY site) THEN 1 ELSE 0 END AS quota FROM q0),
 f AS (SELECT unit_id, site, pb.bin FROM (SELECT *, row_number() OVER (PARTITION BY site, bin ORDER BY {hash_key(15, 'unit_id')}, unit_id) AS r FROM pb) pb JOIN q1 USING (site, bin) WHERE r <= quota),
 rest AS (SELECT unit_id, site, bin, row_number() OVER (PARTITION BY site ORDER BY {hash_key('15f', 'unit_id')}, unit_id) AS r FROM pb WHERE unit_id NOT IN (SELECT unit_id FROM f))
 SELECT unit_id, site, bin::BIGINT AS bin, false AS filled FROM f UNION ALL SELECT unit_id, site, bin::BIGINT, true FROM rest WHERE r <= 40 - (SELECT count(*) FROM f WHERE f.site = rest.site)"""


@query("matched_random_sample", MR)
def _(i):
    t = i.units.join(i.counts.groupBy("unit_id").agg(F.sum("count").alias("total")), "unit_id").select("unit_id", "site", "cell_type", "total")
    ref = t.where("cell_type = 'BUILDING' and unit_id % 2 = 0")
    wanted = t.select("site").distinct().withColumn("want", F.lit(40).cast("long"))
    return S.matched_random_sample(t.where("cell_type <> 'BUILDING'"), ref, ["site"], "total", wanted, 15)


@query("stack_studies", f""", w AS (SELECT unit_id, sum(count) FILTER (feature = 'Brand#1') AS b1, sum(count) FILTER (feature = 'Brand#2') AS b2 FROM counts GROUP BY 1)
 SELECT unit_id, b1, b2, 'first' AS study FROM w WHERE unit_id % 2 = 0 UNION ALL SELECT unit_id, b1, NULL, 'second' FROM w WHERE unit_id % 2 = 1""")
def _(i):
    w = i.counts.groupBy("unit_id").pivot("feature", ["Brand#1", "Brand#2"]).agg(F.sum("count")).withColumnsRenamed({"Brand#1": "b1", "Brand#2": "b2"})
    return P.stack_studies(w.where("unit_id % 2 = 0"), w.where("unit_id % 2 = 1").drop("b2"))


@query("shuffle_labels", f"""SELECT a.unit_id, a.group_id, b.cell_type FROM (SELECT unit_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {hash_key('16a', 'unit_id')}, unit_id) AS r FROM units) a
 JOIN (SELECT group_id, cell_type, row_number() OVER (PARTITION BY group_id ORDER BY {hash_key('16b', 'unit_id')}, unit_id) AS r FROM units) b USING (group_id, r)""")
def _(i):
    return S.shuffle_labels(i.units.select("unit_id", "group_id", "cell_type"), ["group_id"], "cell_type", 16)

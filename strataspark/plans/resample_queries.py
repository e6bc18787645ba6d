"""Queries over bootstrap draws, permutation nulls and decision rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M, resample as R
from ..session import checkpointed
from . import bindings as B
from .bindings import hash_key, hash_unit
from .metric_queries import CALLED, CASE_TABLE, called_panel, case_table
from .pair_queries import CP, DGAP, cross_of, ends_of
from .registry import query


def slot_sql(n, seed, *parts):
    return f"(CAST(floor({hash_unit(seed, *parts)} * {n}) AS BIGINT) + 1)"


def thrown_sql(numbered, totals, inner, seed, name):
    """CTE ``name`` (draw, inner, r_no, w): the balls of ``totals`` (draw, inner, n_in, balls) thrown into buckets of 32 of the
    rows that ``numbered`` numbers, then into the rows of a bucket (groups of at most 131,072 rows)"""
    g = "".join(f"{c}, " for c in inner)
    return f""", {name}_b AS (SELECT draw, {g}n_in, CAST(floor({hash_unit(seed, "'b'", 'draw', *inner, '0', 'ball')} * n_in) AS BIGINT) // 32 AS bucket, count(*) AS balls FROM (SELECT *, unnest(range(1, balls + 1)) AS ball FROM {totals}) GROUP BY ALL),
 {name} AS (SELECT draw, {g}bucket * 32 + CAST(floor({hash_unit(seed, "'r'", 'draw', *inner, 'bucket', 'ball')} * least(32, n_in - bucket * 32)) AS BIGINT) + 1 AS r_no, count(*) AS w FROM (SELECT *, unnest(range(1, balls + 1)) AS ball FROM {name}_b) GROUP BY ALL)"""


def two_stage_sql(src, group, n_boot, seed, strata=(), name="ts"):
    """CTEs of the two-stage multiplicities (draw, unit_id, w) over ``src`` (unit_id, group, strata)"""
    keys = [group, *strata]
    inner = ", ".join(keys)
    return f""", {name}_g AS (SELECT {group}, row_number() OVER (ORDER BY {hash_key(f'{seed}g', group)}, {group}) AS g_no, count(*) OVER () AS ng FROM (SELECT DISTINCT {group} FROM {src})),
 {name}_d AS (SELECT draw, gslot, {slot_sql('ng', seed, "'g'", 'draw', 'gslot')} AS g_no FROM (SELECT g_no AS gslot, ng FROM {name}_g), (SELECT unnest(range(1, {n_boot + 1})) AS draw)),
 {name}_n AS (SELECT unit_id, {inner}, row_number() OVER (PARTITION BY {inner} ORDER BY {hash_key(f'{seed}r', 'unit_id')}, unit_id) AS r_no, count(*) OVER (PARTITION BY {inner}) AS n_in FROM {src}),
 {name}_t AS (SELECT draw, {inner}, n_in, count(*) * any_value(n_in) AS balls FROM {name}_d JOIN {name}_g USING (g_no) JOIN (SELECT DISTINCT {inner}, n_in FROM {name}_n) USING ({group}) GROUP BY ALL){thrown_sql(f'{name}_n', f'{name}_t', keys, seed, f'{name}_c')},
 {name} AS (SELECT draw, unit_id, w FROM {name}_c JOIN {name}_n USING ({inner}, r_no))"""


TS = two_stage_sql("(SELECT unit_id, site FROM units)", "site", 8, 31)


@query("bootstrap_two_stage", TS + " SELECT draw, unit_id, w FROM ts")
def _(i):
    return R.bootstrap_two_stage(i.units.select("unit_id", "site"), "site", 8, 31).select("draw", "unit_id", "w")


@query("bootstrap_two_stage_strata", two_stage_sql("(SELECT unit_id, site, cell_type FROM units)", "site", 4, 32, ("cell_type",)) + " SELECT draw, unit_id, w FROM ts")
def _(i):
    return R.bootstrap_two_stage(i.units.select("unit_id", "site", "cell_type"), "site", 4, 32, ["cell_type"]).select("draw", "unit_id", "w")


def poisson_sql(u):
    import math
    c, p, out = 0.0, math.exp(-1), []
    for k in range(12):
        c += p
        out.append(f"({u} >= {c!r})::INT")
        p /= k + 1
    return " + ".join(out)


@query("bootstrap_two_stage_poisson", TS + f", pw AS (SELECT draw, gslot, unit_id, {hash_unit(31, chr(39) + 'p' + chr(39), 'draw', 'gslot', 'unit_id')} AS u FROM ts_d JOIN ts_g USING (g_no) JOIN units USING (site)) SELECT draw, unit_id, CAST(sum({poisson_sql('u')}) AS BIGINT) AS w FROM pw GROUP BY 1, 2 HAVING w > 0")
def _(i):
    return R.bootstrap_two_stage(i.units.select("unit_id", "site"), "site", 8, 31, scheme="poisson").select("draw", "unit_id", "w")


def cluster_sql(src, n_boot, seed, name="cb"):
    return f""", {name}_e AS (SELECT DISTINCT 1 AS a, cluster AS element FROM {src} WHERE a = 1 UNION ALL SELECT 0, 'unit:' || CAST(unit_id AS VARCHAR) FROM {src} WHERE a = 0),
 {name}_n AS (SELECT a, element, row_number() OVER (PARTITION BY a ORDER BY {hash_key(f'{seed}r', 'element')}, element) AS r_no, count(*) OVER (PARTITION BY a) AS n_in FROM {name}_e),
 {name}_t AS (SELECT a, draw, n_in, n_in AS balls FROM (SELECT DISTINCT a, n_in FROM {name}_n), (SELECT unnest(range(1, {n_boot + 1})) AS draw)){thrown_sql(f'{name}_n', f'{name}_t', ['a'], seed, f'{name}_c')},
 {name} AS (SELECT a, draw, element, w FROM {name}_c JOIN {name}_n USING (a, r_no)),
 {name}_w AS (SELECT a, 0 AS draw, element, 1 AS w FROM {name}_e UNION ALL SELECT a, draw, element, w FROM {name})"""


@query("bootstrap_cluster", cluster_sql("trial", 10, 33) + """, es AS (SELECT a, CASE WHEN a = 1 THEN cluster ELSE 'unit:' || CAST(unit_id AS VARCHAR) END AS element, count(*) AS n, sum(y) AS sy FROM trial GROUP BY 1, 2)
 SELECT a, draw, CAST(sum(w * n) AS BIGINT) AS n, round(sum(w * sy) / sum(w * n), 6) AS mean_y FROM es JOIN cb_w USING (a, element) GROUP BY 1, 2""")
def _(i):
    d = R.bootstrap_cluster(i.trial, "a", "cluster", 10, 33)
    s = R.element_sums(i.trial, "a", "cluster", {"n": F.lit(1), "sy": F.col("y")})
    return R.drawn_sums(s, d, ["a"], ["n", "sy"]).select("a", "draw", F.col("n").cast("long").alias("n"), (F.col("sy") / F.col("n")).alias("mean_y"))


# ---- medians over draws
TS2 = two_stage_sql("(SELECT unit_id, site FROM units)", "site", 6, 34)
W2 = "(SELECT draw, unit_id, w FROM ts UNION ALL SELECT 0, unit_id, 1 FROM units)"


def unit_draws(i, n=6, seed=34):
    u = i.units.select("unit_id", "site")
    return checkpointed(R.with_point(R.bootstrap_two_stage(u, "site", n, seed), u))


LAYERS = TS2 + f", md AS (SELECT draw, feature, quantile_cont(measured, 0.5) AS median FROM (SELECT draw, feature, measured, unnest(range(w)) FROM panel JOIN {W2} USING (unit_id)) GROUP BY 1, 2)"


@query("bootstrap_cases", LAYERS + " SELECT draw, feature, round(median, 6) AS median FROM md")
def _(i):
    """units resampled with all their panel rows: median quantity per feature and draw"""
    return R.drawn_medians(i.panel.select("unit_id", "feature", "measured"), unit_draws(i), ["feature"], "measured")


@query("bootstrap_cases_lowest", LAYERS + ", lw AS (SELECT draw, arg_min(feature, row(round(median, 9), feature)) AS feature FROM md WHERE draw > 0 GROUP BY 1) SELECT feature, count(*) AS k, round(count(*) / sum(count(*)) OVER (), 6) AS share_lowest FROM lw GROUP BY 1")
def _(i):
    return R.bootstrap_cases(i.panel.select("unit_id", "feature", "measured"), unit_draws(i), "feature", "measured")[1]


NI = 2000           # draws behind an interval, as the reference's two-stage bootstraps have


@query("bootstrap_stat", two_stage_sql("(SELECT unit_id, site FROM units)", "site", NI, 34) + f""", v AS (SELECT draw, cell_type, c_acctbal AS x FROM (SELECT draw, unit_id, unnest(range(w)) FROM {W2}) JOIN units USING (unit_id) JOIN customer ON c_custkey = unit_id),
 d AS (SELECT draw, quantile_cont(x, 0.5) FILTER (cell_type = 'BUILDING') - quantile_cont(x, 0.5) FILTER (cell_type = 'MACHINERY') AS value FROM v GROUP BY 1)
 SELECT round(max(value) FILTER (draw = 0), 6) AS point, round(quantile_cont(value, 0.025) FILTER (draw > 0), 6) AS lo, round(quantile_cont(value, 0.975) FILTER (draw > 0), 6) AS hi, count(value) FILTER (draw > 0) AS n_finite, 0::BIGINT AS n_undefined FROM d""")
def _(i):
    """difference of two strata's medians with its two-stage interval"""
    r = i.units.join(i.table("customer").select(F.col("c_custkey").alias("unit_id"), "c_acctbal"), "unit_id")
    return R.percentile_ci(R.median_difference_by_row(r, "site", NI, 34, "cell_type", "BUILDING", "MACHINERY", "c_acctbal"), [])


@query("mode_fraction", TS2 + f""", k AS (SELECT draw, cell_type, sum(w) AS k FROM {W2} JOIN units USING (unit_id) GROUP BY 1, 2) SELECT draw, arg_max(cell_type, row(k, -p)) AS mode, round(max(k) / sum(k), 6) AS value FROM k JOIN (SELECT cell_type, min(unit_id) AS p FROM units GROUP BY 1) USING (cell_type) GROUP BY 1""")
def _(i):
    return R.mode_fraction(i.units.select("unit_id", F.col("cell_type").alias("top")), unit_draws(i), "top")


@query("percentile_ci", f""", v AS (SELECT cluster, b AS draw, CASE WHEN b % 9 = 4 THEN NULL ELSE avg(y) + {hash_unit(35, 'cluster', 'b')} END AS value FROM trial, (SELECT unnest(range(0, 60)) AS b) GROUP BY 1, 2)
 SELECT cluster, round(max(value) FILTER (draw = 0), 6) AS point, round(quantile_cont(value, 0.05) FILTER (draw > 0), 6) AS lo, round(quantile_cont(value, 0.95) FILTER (draw > 0), 6) AS hi, count(value) FILTER (draw > 0) AS n_finite, count(*) FILTER (draw > 0 AND value IS NULL) AS n_undefined FROM v GROUP BY 1""")
def _(i):
    from ..functions.draws import uniform
    g = i.trial.groupBy("cluster").agg(F.avg("y").alias("m")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(59))))
    d = g.withColumn("value", F.when(F.col("draw") % 9 != 4, F.col("m") + uniform(35, "cluster", "draw")))
    return R.percentile_ci(d, ["cluster"], level=0.9)


# ---- permutation nulls
NP_ = 30
SN = f""", cl AS (SELECT unit_id, cls, feature, CASE WHEN v = max(v) OVER w THEN 1.0::DOUBLE / sum(CASE WHEN v = mx THEN 1 ELSE 0 END) OVER w ELSE 0 END AS credit FROM (SELECT *, max(v) OVER (PARTITION BY unit_id) AS mx FROM {CALLED}) WINDOW w AS (PARTITION BY unit_id)),
 po AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY feature) AS pos FROM cl), pm AS (SELECT unnest(range(0, {NP_ + 1})) AS perm),
 idn AS (SELECT perm, unit_id, feature, row_number() OVER (PARTITION BY perm, unit_id ORDER BY CASE WHEN perm = 0 THEN '' ELSE md5('41|' || CAST(perm AS VARCHAR) || '|' || CAST(unit_id AS VARCHAR) || '|' || feature) END, feature) AS pos FROM cl, pm),
 sh AS (SELECT perm, cls, idn.feature, round(sum(credit) / any_value(n), 12) AS share FROM idn JOIN po USING (unit_id, pos) JOIN (SELECT cls, count(DISTINCT unit_id) AS n FROM cl GROUP BY 1) USING (cls) GROUP BY 1, 2, 3),
 ce AS (SELECT cls, feature, max(share) FILTER (perm = 0) AS obs, avg(share) FILTER (perm > 0) AS c FROM sh GROUP BY 1, 2)"""


@query("marker_share_null", SN + f" SELECT cls, feature, round(any_value(obs), 6) AS share, round(any_value(c), 6) AS null_mean, round((1 + count(*) FILTER (perm > 0 AND round(abs(share - c), 12) >= round(abs(obs - c), 12))) / (1.0 + {NP_}), 6)::DOUBLE AS p FROM sh JOIN ce USING (cls, feature) GROUP BY 1, 2")
def _(i):
    return R.share_null(called_panel(i), NP_, 41)


def perm_sql(part):
    return f""", ev AS (SELECT unit_id, feature, v, {B._case('feature', B.F2C)} AS cls FROM evidence), pm AS (SELECT unnest(range(0, 21)) AS perm),
 sv AS (SELECT perm, unit_id, cls, v, row_number() OVER (PARTITION BY perm, unit_id{part} ORDER BY CASE WHEN perm = 0 THEN '' ELSE md5('42|' || CAST(perm AS VARCHAR) || '|' || CAST(unit_id AS VARCHAR) || '|' || feature) END, cls, feature) AS pos FROM ev, pm),
 sf AS (SELECT perm, unit_id, cls, feature, row_number() OVER (PARTITION BY perm, unit_id{part} ORDER BY cls, feature) AS pos FROM ev, pm),
 mv AS (SELECT perm, unit_id, sf.cls, feature, v FROM sf JOIN sv USING (perm, unit_id{part}, pos)),
 sc AS (SELECT perm, unit_id, cls, round(sum(v), 12) AS s FROM mv GROUP BY 1, 2, 3), cc AS (SELECT perm, unit_id, arg_max(cls, row(s, CASE cls WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END)) AS call FROM sc GROUP BY 1, 2),
 tp AS (SELECT perm, unit_id, arg_min(feature, row(-v, feature)) AS top FROM mv JOIN cc USING (perm, unit_id) WHERE cls = call GROUP BY 1, 2), sr AS (SELECT perm, max(k) / sum(k) AS share FROM (SELECT perm, top, count(*) AS k FROM tp GROUP BY 1, 2) GROUP BY 1)
 SELECT round(any_value(o), 6) AS observed, round(avg(share) FILTER (perm > 0), 6) AS null_mean, round((1 + count(*) FILTER (perm > 0 AND share >= o)) / 21.0, 6)::DOUBLE AS p FROM sr, (SELECT share AS o FROM sr WHERE perm = 0)"""


def events_long(i):
    from ..operators import classify as C
    return i.evidence.withColumn("cls", C.map_expr(B.F2C)[F.col("feature")])


@query("permutation_null", perm_sql(", cls"))
def _(i):
    return R.permutation_null(events_long(i), B.CLASSES, 20, 42, "within_class")


@query("permutation_null_within_unit", perm_sql(""))
def _(i):
    return R.permutation_null(events_long(i), B.CLASSES, 20, 42, "within_unit")


# ---- rules on result rows
RES = """, rs AS (SELECT p_brand AS run, avg(p_retailprice) / 2000 - 0.7 AS point, avg(p_retailprice) / 2000 - 0.7 - count(*) % 7 * 0.01 AS lo, avg(p_retailprice) / 2000 - 0.7 + count(*) % 5 * 0.02 AS hi, list(sz ORDER BY ty) AS per_group FROM part
 JOIN (SELECT p_brand, p_type AS ty, avg(p_retailprice) / 2000 - 0.7 AS sz FROM part GROUP BY 1, 2) g USING (p_brand) GROUP BY 1)"""


def result_rows(i):
    """one result row per brand: a point, an interval around it and values per part type"""
    p = i.table("part")
    g = p.groupBy("p_brand", "p_type").agg((F.avg("p_retailprice") / 2000 - 0.7).alias("sz"))
    per = g.groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_type", "sz"))), lambda s: s["sz"]).alias("per_group"), F.count(F.lit(1)).alias("nt"))
    r = p.groupBy("p_brand").agg((F.avg("p_retailprice") / 2000 - 0.7).alias("point"), F.count(F.lit(1)).alias("n")).join(per, "p_brand")
    n = F.col("n") * F.col("nt")
    return r.select(F.col("p_brand").alias("run"), "point", (F.col("point") - n % 7 * 0.01).alias("lo"), (F.col("point") + n % 5 * 0.02).alias("hi"), "per_group")


def all_sql(cond):
    return f"list_bool_and(list_transform(per_group, lambda v: {cond}))"


WIN = f"CASE WHEN point >= {{m}} AND lo > 0 AND {all_sql('v >= {m} / 2')} THEN 'win' WHEN point <= -{{m}} AND hi < 0 AND {all_sql('v <= -{m} / 2')} THEN 'loss' WHEN lo > -{{m}} AND hi < {{m}} THEN 'equivalent' ELSE 'inconclusive' END"


@query("win_rule", RES + f" SELECT run, {WIN.format(m=0.02)} AS decision, {WIN.format(m=0.06)} AS decision_wide FROM rs")
def _(i):
    return result_rows(i).select("run", R.win_rule(0.02).alias("decision"), R.win_rule(0.06).alias("decision_wide"))


@query("replication_rule", RES + """ SELECT run, CASE WHEN len(list_filter(per_group, lambda v: sign(v) = d)) * 2 > len(per_group) AND (d > 0 AND lo > 0 OR d < 0 AND hi < 0) THEN 'replicates' ELSE 'does not replicate' END AS status FROM (SELECT *, CASE WHEN right(run, 1) IN ('1', '3', '5') THEN -1 ELSE 1 END AS d FROM rs)""")
def _(i):
    d = result_rows(i).withColumn("first", F.when(F.substring("run", -1, 1).isin("1", "3", "5"), -1.0).otherwise(1.0))
    return d.select("run", R.replication_rule("first").alias("status"))


POS = f"(point > 0 AND lo > 0 AND {all_sql('v > 0')})"


@query("scale_artefact_rule", RES + f" SELECT run, CASE WHEN d <> 'win' THEN d WHEN {POS} AND hi > 0.03 THEN 'win' ELSE 'not supported (scale artefact)' END AS decision, abs(point) >= 0.01 AND (point > 0 AND lo > 0 OR point < 0 AND hi < 0) AND {all_sql('sign(v) = sign(point) AND abs(v) >= 0.005')} AS passes FROM (SELECT *, {WIN.format(m=0.005)} AS d FROM rs)")
def _(i):
    d = result_rows(i).withColumn("d", R.win_rule(0.005))
    return d.select("run", R.scale_artefact_rule(F.col("d"), R.positive_condition(), F.col("hi") > 0.03).alias("decision"), R.share_criterion(0.01).alias("passes"))


@query("comparable_units", f", st AS (SELECT group_id AS level, sum(dec_ok_base)::DOUBLE / sum(n_scored) - sum(dec_ok_pert)::DOUBLE / sum(n_scored) AS loss, count(*) FILTER (lost > 0) AS n FROM {CASE_TABLE} GROUP BY 1) SELECT a.level AS level_a, b.level AS level_b, round(a.loss, 6) AS loss_a, round(b.loss, 6) AS loss_b FROM st a JOIN st b ON a.level < b.level AND abs(a.loss - b.loss) <= 0.02 AND a.n >= 1 AND b.n >= 1")
def _(i):
    s = checkpointed(M.unit_stats(case_table(i), ["group_id"]).withColumnRenamed("group_id", "level"))
    return R.comparable_units(s, "decision_loss", "n_lost_units", 0.02, 1)


# ---- comparisons
MC_GRID = [0.3, 0.6, 1.0]
MCR = "(SELECT unit_id, site, round(conf, 12) AS conf, round(margin, 12) AS margin, (call <> '' AND call = key)::INT AS ok, (key <> 'unscored')::INT AS sc FROM evaluated)"
ONE = hash_key(36, "unit_id")


def acc_sql(src, by):
    """accuracy at matched coverage of rows with weights: (by, coverage)"""
    return f"""SELECT {by}, c AS coverage, sum(least(greatest(ceil(c * n - 1e-9) - (cum - w), 0), w) * ok) / nullif(sum(least(greatest(ceil(c * n - 1e-9) - (cum - w), 0), w) * sc), 0) AS acc FROM
 (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY r) AS cum, sum(w) OVER (PARTITION BY {by}) AS n FROM {src}), (SELECT unnest({MC_GRID}::DOUBLE[]) AS c) GROUP BY {by}, c"""


MC = two_stage_sql("(SELECT unit_id, site FROM evaluated)", "site", 6, 36) + f""", mr AS (SELECT * FROM {MCR}),
 rk AS (SELECT unit_id, site, ok, sc, method, row_number() OVER (PARTITION BY method ORDER BY CASE method WHEN 'conf' THEN conf ELSE margin END DESC, {ONE}, unit_id) AS r, row_number() OVER (PARTITION BY method, site ORDER BY CASE method WHEN 'conf' THEN conf ELSE margin END DESC, {ONE}, unit_id) AS rg FROM mr, (VALUES ('conf'), ('margin')) m(method)),
 wd AS (SELECT draw, unit_id, w FROM ts UNION ALL SELECT 0, unit_id, 1 FROM mr), aw AS ({acc_sql('(SELECT method, draw, r, w, ok, sc FROM rk JOIN wd USING (unit_id))', 'method, draw')}),
 df AS (SELECT draw, coverage, max(acc) FILTER (method = 'margin') - max(acc) FILTER (method = 'conf') AS v FROM aw GROUP BY 1, 2),
 ag AS ({acc_sql('(SELECT method, site, rg AS r, 1 AS w, ok, sc FROM rk)', 'method, site')}), pg AS (SELECT coverage, list(v ORDER BY site) AS per_group FROM (SELECT site, coverage, max(acc) FILTER (method = 'margin') - max(acc) FILTER (method = 'conf') AS v FROM ag GROUP BY 1, 2) GROUP BY 1),
 ci AS (SELECT coverage, max(v) FILTER (draw = 0) AS point, quantile_cont(v, 0.025) FILTER (draw > 0) AS lo, quantile_cont(v, 0.975) FILTER (draw > 0) AS hi FROM df GROUP BY 1)"""


@query("method_comparison", MC + f" SELECT coverage, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, {WIN.format(m=0.01)} AS decision FROM ci JOIN pg USING (coverage)")
def _(i):
    e = i.evaluated.select("unit_id", "site", "conf", "margin", ((F.col("call") != "") & (F.col("call") == F.col("key"))).cast("long").alias("ok"), (F.col("key") != "unscored").cast("long").alias("sc"))
    return R.method_comparison(e, "site", ("margin", "conf"), "ok", "sc", MC_GRID, 6, 36, 0.01).select("coverage", "point", "lo", "hi", "decision")


GI = CP + f""", pr AS (SELECT CAST(x AS VARCHAR) || ':' || CAST(y AS VARCHAR) AS unit_id, group_id, x, y, flagged FROM cp)""" + two_stage_sql("pr", "group_id", 4, 37) + f""", wd AS (SELECT draw, unit_id, w FROM ts UNION ALL SELECT 0, unit_id, 1 FROM pr),
 gp AS (SELECT draw, readout, flagged, a.feature, abs(a.predicted * f - b.predicted * f + o) / 1000 AS d_pred, abs(a.measured - b.measured) AS d_meas, unnest(range(w)) FROM pr JOIN wd USING (unit_id) JOIN panel a ON a.unit_id = x JOIN panel b ON b.unit_id = y AND a.feature = b.feature, (VALUES ('repair', 1.3, 0.0), ('head', 1.0, 0.0), ('null', 0.9, 100.0)) r(readout, f, o)),
 ge AS (SELECT draw, readout, flagged, feature, quantile_cont(d_pred, 0.5) / nullif(quantile_cont(d_meas, 0.5), 0) AS ratio FROM gp GROUP BY 1, 2, 3, 4), gr AS (SELECT draw, readout, flagged, CASE WHEN count(ratio) = 6 THEN avg(ratio) END AS gap_ratio FROM ge GROUP BY 1, 2, 3)"""


@query("gap_inference", GI + f" SELECT draw, round({DGAP(lambda x: x)}, 6) AS d, round({DGAP(lambda x: f'ln({x})')}, 6) AS d_log FROM gr GROUP BY 1")
def _(i):
    p = checkpointed(cross_of(i))
    panel = i.panel_of(ends_of(p)).where("feature is not null")
    features = sorted(r.feature for r in panel.select("feature").distinct().collect())                                    # part types
    at = F.create_map(*[x for j, f in enumerate(features) for x in (F.lit(f), F.lit(j))]) if features else F.create_map().cast("map<string,int>")
    one = checkpointed(panel.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("feature")].alias("feature"), F.struct("predicted", "measured")))).alias("of")))       # one entry per part type
    readouts = {"repair": (1.3, 0.0), "head": (1.0, 0.0), "null": (0.9, 100.0)}

    def gap(j):
        a, b = (F.try_element_at(f"of_{s}", j) for s in ("x", "y"))
        preds = F.array(*[F.abs(a["predicted"] * f - b["predicted"] * f + o) / 1000 for f, o in readouts.values()])
        return F.struct(j.alias("feature"), F.abs(a["measured"] - b["measured"]).cast("double").alias("meas"), preds.alias("preds"))
    d = p.join(one.select(F.col("unit_id").alias("x"), F.col("of").alias("of_x")), "x", "left").join(one.select(F.col("unit_id").alias("y"), F.col("of").alias("of_y")), "y", "left")
    both = F.coalesce(F.array_intersect(F.map_keys("of_x"), F.map_keys("of_y")), F.array().cast("array<int>"))
    d = d.select(F.concat_ws(":", F.col("x").cast("string"), F.col("y").cast("string")).alias("unit_id"), "group_id", "flagged", F.transform(both, gap).alias("gaps"))
    return R.gap_inference(d, "group_id", "flagged", features, {n: j for j, n in enumerate(readouts)}, len(B.FEATURES), "repair", "head", "null", 4, 37)

"""Queries over joins, nearest neighbours and pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C, joins as J, metrics as M, pairs as K
from . import bindings as B
from .bindings import hash_key, hash_unit
from .registry import query


# ---- states and identifiers
@query("join_states_by_id", "SELECT unit_id, site, o_totalprice AS state FROM units JOIN (SELECT o_custkey AS unit_id, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) USING (unit_id)")
def _(i):
    """state = price of the latest order (by key) of a unit; units without orders are left out beforehand"""
    s = i.table("orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_totalprice").alias("state"), "o_orderkey")
    have = i.units.select("unit_id", "site").join(s.select("unit_id"), "unit_id", "left_semi")
    return J.join_states_by_id(have, s, "o_orderkey")


@query("missing_states", "SELECT unit_id FROM units WHERE unit_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(i):
    return J.missing_states(i.units, i.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("unit_id")))


MERGED = {**{f"M{k}": [f"Brand#{2 * k - 1}", f"Brand#{2 * k}"] for k in range(1, 6)}, "solo": ["Brand#24"], "none": []}
MERGED_SQL = "(VALUES " + ", ".join(f"('{o}', '{s}', {len(v)})" for o, v in MERGED.items() for s in v) + ") m(ours, feature, n)"


@query("harmonise_features", f"""SELECT unit_id, g.ours, g.ours <> 'none' AS present, CASE WHEN g.ours <> 'none' THEN coalesce(value, 0) END AS value FROM units CROSS JOIN (VALUES {', '.join(f"('{o}')" for o in MERGED)}) g(ours)
 LEFT JOIN (SELECT unit_id, ours, sum(count) / any_value(n) AS value FROM counts JOIN {MERGED_SQL} USING (feature) GROUP BY 1, 2) v USING (unit_id, ours)""")
def _(i):
    return J.harmonise_features(i.counts, MERGED, i.units)


@query("symbol_to_id_unique", """, k AS (SELECT p_partkey AS id, p_name AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
 SELECT s AS alias, id FROM k WHERE k = 0 UNION ALL SELECT s || '.' || CAST(k AS VARCHAR), id FROM k WHERE k > 0 UNION ALL SELECT s || '-' || CAST(k AS VARCHAR), id FROM k WHERE k > 0""")
def _(i):
    return J.symbol_to_id_unique(i.table("part"), "p_name", "p_partkey", "p_partkey")


IDS = """, f AS (SELECT p_partkey AS symbol, 'own' || CAST(p_size AS VARCHAR) AS own_id, CASE WHEN p_partkey % 3 <> 0 THEN 'ref' || CAST(p_partkey % 50 AS VARCHAR) END AS ref_id FROM part),
 v AS (SELECT DISTINCT 'ref' || CAST(p_size AS VARCHAR) AS id FROM part WHERE p_size < 20 UNION SELECT DISTINCT 'own' || CAST(p_size AS VARCHAR) FROM part WHERE p_size > 30),
 mp AS (SELECT symbol, own_id, ref_id, ref_id IN (SELECT id FROM v) AS r, own_id IN (SELECT id FROM v) AS o FROM f),
 mm AS (SELECT symbol, CASE WHEN ref_id IS NOT NULL AND (r OR NOT o) THEN ref_id WHEN o THEN own_id END AS id, CASE WHEN ref_id IS NOT NULL AND (r OR NOT o) THEN 'reference' WHEN o THEN 'file' ELSE 'none' END AS source FROM mp)"""


def id_map(i):
    p = i.table("part")
    f = p.select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("own"), F.col("p_size").cast("string")).alias("own_id"))
    r = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("ref"), (F.col("p_partkey") % 50).cast("string")).alias("ref_id"))
    v = p.where("p_size < 20").select(F.concat(F.lit("ref"), F.col("p_size").cast("string")).alias("id")).unionByName(p.where("p_size > 30").select(F.concat(F.lit("own"), F.col("p_size").cast("string")).alias("id")))
    return J.two_source_id_map(f, r, v)


@query("two_source_id_map", IDS + " SELECT symbol, id, source FROM mm")
def _(i):
    return id_map(i)


@query("id_map_coverage", IDS + " SELECT source, count(*) AS n FROM mm GROUP BY 1")
def _(i):
    return J.id_map_coverage(id_map(i))


@query("disjointness_check", "SELECT count(*) FILTER (split = 'train' AND unit_id % 5 = 0) AS n_units, (SELECT count(DISTINCT group_id) FROM split WHERE (split = 'test' OR unit_id % 5 = 0) AND group_id IN (SELECT group_id FROM split WHERE split = 'train')) AS n_groups, false AS passed FROM split")
def _(i):
    """evaluated = the test split and every fifth unit, fit = the train split: they must not meet, and here they do"""
    return J.disjointness_check(i.split.where("split = 'test' or unit_id % 5 = 0"), i.split.where("split = 'train'"))


# ---- neighbours
KN = """, u AS (SELECT unit_id, group_id, cls, list_transform(z, lambda x: x / (nz + 1e-8::DOUBLE)) AS u FROM (SELECT unit_id, group_id, cls, CAST(z AS DOUBLE[]) AS z, sqrt(list_dot_product(CAST(z AS DOUBLE[]), CAST(z AS DOUBLE[]))) AS nz FROM vectors)),
 nn AS (SELECT * FROM (SELECT a.unit_id AS i, b.unit_id AS j, round(list_dot_product(a.u, b.u), 9) AS sim, row_number() OVER (PARTITION BY a.unit_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.unit_id) AS rank
  FROM u a JOIN u b ON a.group_id = b.group_id AND a.unit_id <> b.unit_id) WHERE rank <= 10),
 ed AS (SELECT least(i, j) AS lo, greatest(i, j) AS hi, max(sim) AS cos FROM nn GROUP BY 1, 2)"""


def edges_of(i):
    from ..session import checkpointed
    return checkpointed(K.undirected_edges(K.knn_within_group(i.vectors, "group_id", 10)))


@query("knn_within_group", KN + " SELECT i, j, round(sim, 6) AS sim, rank FROM nn")
def _(i):
    return K.knn_within_group(i.vectors, "group_id", 10)


@query("knn_block_pairs")
def _(i):
    """block pairs of the neighbour search inside each group, and the share that the bounds skip"""
    return K.block_pairs(i.vectors, i.vectors, ["group_id"], 10, exclude_self=True, block=64)


@query("undirected_edges", KN + " SELECT lo, hi, round(cos, 6) AS cos FROM ed")
def _(i):
    return edges_of(i)


CP = KN + """, cp AS (SELECT CASE WHEN a.cls < '5' THEN lo ELSE hi END AS x, CASE WHEN a.cls < '5' THEN hi ELSE lo END AS y, cos, round(cos, 6) >= 0.3 AS flagged, a.group_id FROM ed JOIN vectors a ON a.unit_id = lo JOIN vectors b ON b.unit_id = hi WHERE (a.cls < '5') <> (b.cls < '5'))"""


def keyed(i):
    """two key classes from the ten labels: low (0-4) and high (5-9)"""
    return i.vectors.withColumn("key", F.when(F.col("cls") < "5", "low").otherwise("high"))


def cross_of(i, e=None):
    return K.cross_class_pairs(edges_of(i) if e is None else e, keyed(i), "key", "low", "high", 0.3, ["group_id"])


@query("cross_class_pairs", CP + " SELECT x, y, round(cos, 6) AS cos, flagged, group_id FROM cp")
def _(i):
    return cross_of(i)


RP = KN + f""", px AS (SELECT unit_id AS x, row_number() OVER (ORDER BY {hash_key('px', 'unit_id')}, unit_id) AS rx, count(*) OVER () AS nx FROM vectors WHERE cls < '5'),
 py AS (SELECT unit_id AS y, row_number() OVER (ORDER BY {hash_key('py', 'unit_id')}, unit_id) AS ry, count(*) OVER () AS ny FROM vectors WHERE cls >= '5'),
 sl AS (SELECT seed, s FROM (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest(range(1, 301)) AS s)),
 rp AS (SELECT seed, s, x, y FROM sl JOIN px ON rx = CAST(floor({hash_unit('x', 'seed', 's')} * nx) AS BIGINT) + 1 JOIN py ON ry = CAST(floor({hash_unit('y', 'seed', 's')} * ny) AS BIGINT) + 1
  WHERE (least(x, y), greatest(x, y)) NOT IN (SELECT (lo, hi) FROM ed))"""


def random_of(i, e):
    return K.random_pair_control(keyed(i), "key", "low", "high", 300, [1, 2, 3], e)


@query("random_pair_control", RP + " SELECT seed, s, x, y FROM rp")
def _(i):
    return random_of(i, edges_of(i))


QR = """, u AS (SELECT unit_id, cls, list_transform(z, lambda x: x / (nz + 1e-8::DOUBLE)) AS u FROM (SELECT unit_id, cls, CAST(z AS DOUBLE[]) AS z, sqrt(list_dot_product(CAST(z AS DOUBLE[]), CAST(z AS DOUBLE[]))) AS nz FROM vectors)),
 nr AS (SELECT a.unit_id AS i, b.unit_id AS j, a.cls AS call, b.cls AS label, row_number() OVER (PARTITION BY a.unit_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.unit_id) AS rank FROM u a JOIN u b ON a.unit_id % 5 = 0 AND b.unit_id % 5 <> 0)"""


@query("knn_label_disagreement", QR + " SELECT i AS unit_id, round(avg(CASE WHEN label <> call THEN 1.0 ELSE 0 END), 6)::DOUBLE AS disagreement FROM nr WHERE rank <= 10 GROUP BY 1")
def _(i):
    return K.knn_label_disagreement(i.vectors.where("unit_id % 5 = 0"), i.vectors.where("unit_id % 5 <> 0"), "cls", "cls", 10)


KR = """, u AS (SELECT unit_id, CAST(cls AS DOUBLE) AS y, list_transform(z, lambda x: x / (nz + 1e-8::DOUBLE)) AS u FROM (SELECT unit_id, cls, CAST(z AS DOUBLE[]) AS z, sqrt(list_dot_product(CAST(z AS DOUBLE[]), CAST(z AS DOUBLE[]))) AS nz FROM vectors)),
 nr AS (SELECT a.unit_id AS i, a.y AS yi, b.y AS yj, row_number() OVER (PARTITION BY a.unit_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.unit_id) AS rank FROM u a JOIN u b ON a.unit_id % 5 < 2 AND b.unit_id % 5 > 1),
 cv AS (SELECT i, yi, rank AS k, avg(yj) OVER (PARTITION BY i ORDER BY rank) AS pred FROM nr WHERE rank <= 20),
 ms AS (SELECT k, avg(power(pred - yi, 2)) AS mse FROM cv WHERE i % 5 = 1 AND k IN (1, 3, 5, 10, 20) GROUP BY 1)"""


@query("knn_regression", KR + " SELECT i AS unit_id, k, round(pred, 6) AS pred FROM cv WHERE i % 5 = 0 AND k = (SELECT k FROM ms ORDER BY round(mse, 12), k LIMIT 1)")
def _(i):
    v = i.vectors.withColumn("y", F.col("cls").cast("double"))
    return K.knn_regression(v.where("unit_id % 5 > 1"), v.where("unit_id % 5 = 1"), v.where("unit_id % 5 = 0"), "y", [1, 3, 5, 10, 20])


@query("neighbour_overlap", CP + """, nb AS (SELECT i, list(j) AS nb FROM nn WHERE rank <= 10 GROUP BY 1)
 SELECT x, y, flagged, round(len(list_intersect(a.nb, b.nb)) / 10, 6) AS overlap FROM cp JOIN nb a ON a.i = x JOIN nb b ON b.i = y""")
def _(i):
    from ..session import checkpointed
    nn = checkpointed(K.knn_within_group(i.vectors, "group_id", 10))
    p = cross_of(i, K.undirected_edges(nn))
    return K.neighbour_overlap(p, nn, "x", "y", 10).select("x", "y", "flagged", "overlap")


MUST_ROWS = f""", mr AS (SELECT k.unit_id, gated AS lineage, annot AS key_cls, CASE WHEN cell_type = 'HOUSEHOLD' THEN 'other' ELSE cell_type END AS coarse, [ECONOMY, LARGE, MEDIUM, PROMO, SMALL, STANDARD]::DOUBLE[] AS m FROM keys k JOIN measured_wide USING (unit_id)),
 mp AS (SELECT lo, hi, cos, a.lineage <> b.lineage AND a.lineage <> 'OUT' AND b.lineage <> 'OUT' AS diff_lineage, a.key_cls <> b.key_cls AS diff_key, a.coarse <> b.coarse AND a.coarse <> 'other' AND b.coarse <> 'other' AS diff_coarse,
  list_sum(list_transform(list_zip(a.m, b.m), lambda t: abs(t[1] - t[2]))) / 6 / (SELECT avg(list_sum(m) / 6) FROM mr) AS rel_l1 FROM ed JOIN mr a ON a.unit_id = lo JOIN mr b ON b.unit_id = hi WHERE round(cos, 6) >= 0.2),
 mq AS (SELECT *, round(rel_l1, 9) >= 0.35 AS diff_profile, diff_lineage OR (diff_key AND round(rel_l1, 9) >= 0.35) OR (diff_coarse AND round(rel_l1, 9) >= 0.35) AS must FROM mp)"""


def must_rows(i):
    """embedding rows carry the measured panel, gate, annotation and segment of the unit with the same id"""
    # the panel is made once: gates and panels come from the same wide rows
    w = i.measured_wide
    w = w.select("*", *[C.is_high(F.col(f), F.lit(float(t))).alias(f"h_{f}") for f, t in B.THRESHOLDS.items()])
    w = w.select("unit_id", F.array(*B.FEATURES).alias("m"), C.gate(B.GATE, "OUT").alias("lineage"))
    a = C.label_map(i.units, "cell_type", B.ANNOTATION, "key_cls")
    return a.join(w, "unit_id").select("unit_id", "lineage", "key_cls", F.when(F.col("cell_type") == "HOUSEHOLD", "other").otherwise(F.col("cell_type")).alias("coarse"), "m")


def must_of(i):
    from ..session import checkpointed
    return K.must_separate_pairs(edges_of(i), checkpointed(must_rows(i)), 0.2, 0.35, abstain="OUT")


@query("must_separate_pairs", KN + MUST_ROWS + " SELECT lo, hi, round(cos, 6) AS cos, round(rel_l1, 6) AS rel_l1, diff_lineage, diff_key, diff_coarse, diff_profile, must FROM mq")
def _(i):
    return must_of(i).select("lo", "hi", "cos", "rel_l1", "diff_lineage", "diff_key", "diff_coarse", "diff_profile", "must")


@query("must_separate_sweep", KN + MUST_ROWS + """ SELECT t, count(*) AS n_near, count(*) FILTER (must) AS n_must, count(*) FILTER (diff_lineage) AS n_diff_lineage, count(*) FILTER (diff_key) AS n_diff_key, count(*) FILTER (diff_coarse) AS n_diff_coarse,
 count(*) FILTER (diff_profile) AS n_diff_profile, (SELECT count(DISTINCT u) FROM (SELECT lo AS u FROM mq WHERE must AND round(cos, 6) >= t UNION ALL SELECT hi FROM mq WHERE must AND round(cos, 6) >= t)) AS n_rows_touched, round(count(*) FILTER (must) / count(*), 6) AS share_must
 FROM mq JOIN (SELECT unnest([0.2, 0.3, 0.4]::DOUBLE[]) AS t) ON round(cos, 6) >= t GROUP BY t""")
def _(i):
    from ..session import checkpointed
    return K.must_separate_sweep(checkpointed(must_of(i)), [0.2, 0.3, 0.4])


@query("pair_class", KN + MUST_ROWS + """ SELECT pair_class, count(*) AS n FROM (SELECT CASE WHEN diff_lineage THEN 'lineage' WHEN diff_coarse THEN 'coarse_type' WHEN diff_key THEN 'key_marker' WHEN diff_profile AND NOT diff_coarse AND NOT diff_key THEN 'same_type_drift' WHEN diff_profile THEN 'fine_profile' ELSE 'other' END AS pair_class FROM mq) GROUP BY 1""")
def _(i):
    c = C.pair_class([("lineage", F.col("diff_lineage")), ("coarse_type", F.col("diff_coarse")), ("key_marker", F.col("diff_key")), ("same_type_drift", F.col("diff_profile") & ~F.col("diff_coarse") & ~F.col("diff_key")), ("fine_profile", F.col("diff_profile"))])
    return must_of(i).groupBy(c.alias("pair_class")).agg(F.count(F.lit(1)).alias("n"))


@query("pair_decision_metrics", KN + """, dc AS (SELECT unit_id, call, CASE WHEN key IN ('A', 'B', 'C') THEN key END AS expected FROM evaluated WHERE unit_id % 11 <> 0),
 j AS (SELECT a.call AS ca, b.call AS cb, a.expected AS ea, b.expected AS eb, a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL AS h FROM ed LEFT JOIN dc a ON a.unit_id = lo LEFT JOIN dc b ON b.unit_id = hi),
 s AS (SELECT count(*) AS n_pairs, count(*) FILTER (h AND ca <> '' AND cb <> '') AS both_decided, count(*) FILTER (h AND ca <> '' AND ca = cb) AS same_call, count(*) FILTER (h AND ca <> '' AND cb <> '' AND ca <> cb) AS differ_call,
  count(*) FILTER (h AND (ca = '' OR cb = '')) AS any_no_call, count(*) FILTER (h AND ca = '' AND cb = '') AS both_no_call, count(*) FILTER (h AND NOT (ca <> '' AND ca = cb)) AS soft_separated,
  count(*) FILTER (h AND ca <> '' AND cb <> '' AND ca <> cb AND ca = ea AND cb = eb) AS correct_separated, count(*) FILTER (h AND ca <> '' AND ea IS NOT NULL) + count(*) FILTER (h AND cb <> '' AND eb IS NOT NULL) AS n_with_expected,
  count(*) FILTER (h AND ca <> '' AND ca = ea) + count(*) FILTER (h AND cb <> '' AND cb = eb) AS n_right FROM j)
 SELECT *, round(same_call / nullif(both_decided, 0), 6) AS false_agreement_rate, round(soft_separated / greatest(n_pairs, 1), 6) AS soft_separation_rate, round(correct_separated / greatest(n_pairs, 1), 6) AS correct_separation_rate, round(n_right / nullif(n_with_expected, 0), 6) AS accuracy_decided FROM s""")
def _(i):
    d = i.evaluated.where("unit_id % 11 <> 0").select("unit_id", "call", F.when(F.col("key").isin("A", "B", "C"), F.col("key")).alias("expected"))
    return K.pair_decision_metrics(edges_of(i), d)


VIEWS = {"all": [0, 1, 2, 3, 4, 5], "without_a": [2, 3, 4, 5], "keys": [0, 2, 4]}


def cos_sql(idx):
    d = lambda p, q: "(" + " + ".join(f"{p}.m[{k + 1}] * {q}.m[{k + 1}]" for k in idx) + ")"
    return f"{d('a', 'b')} / ((sqrt({d('a', 'a')}) + 1e-8) * (sqrt({d('b', 'b')}) + 1e-8))"


@query("pair_cosine_under_views", KN + MUST_ROWS + ", vc AS (" + " UNION ALL ".join(f"SELECT '{n}' AS view, {cos_sql(x)} AS cos FROM ed JOIN mr a ON a.unit_id = lo JOIN mr b ON b.unit_id = hi" for n, x in VIEWS.items()) +
       ") SELECT view, count(*) AS n, round(avg(cos), 6) AS mean, round(avg((round(cos, 9) >= 0.98)::INT)::DOUBLE, 6) AS share_high, round(avg((round(cos, 9) < 0.95)::INT)::DOUBLE, 6) AS share_low, round(quantile_cont(cos, 0.5), 6) AS median FROM vc GROUP BY 1")
def _(i):
    return K.pair_cosine_under_views(edges_of(i), must_rows(i), VIEWS, "lo", "hi")


@query("centred_distance_ratio", RP + """, cp AS (SELECT CASE WHEN a.cls < '5' THEN lo ELSE hi END AS x, CASE WHEN a.cls < '5' THEN hi ELSE lo END AS y FROM ed JOIN vectors a ON a.unit_id = lo JOIN vectors b ON b.unit_id = hi WHERE (a.cls < '5') <> (b.cls < '5')),
 mu AS (SELECT p, avg(v) AS m FROM (SELECT unnest(CAST(z AS DOUBLE[])) AS v, unnest(range(1, 65)) AS p FROM vectors WHERE group_id <> 'g0') GROUP BY 1), mv AS (SELECT list(m ORDER BY p) AS mu FROM mu),
 g AS (SELECT unit_id, 'raw' AS geometry, CAST(z AS DOUBLE[]) AS w FROM vectors UNION ALL SELECT unit_id, 'centred', list_transform(list_zip(CAST(z AS DOUBLE[]), mu), lambda t: t[1] - t[2]) FROM vectors, mv),
 ds AS (SELECT geometry, kind, 1 - list_dot_product(a.w, b.w) / ((sqrt(list_dot_product(a.w, a.w)) + 1e-8) * (sqrt(list_dot_product(b.w, b.w)) + 1e-8)) AS d
  FROM (SELECT 'near' AS kind, x, y FROM cp UNION ALL SELECT 'random', x, y FROM rp) p JOIN g a ON a.unit_id = x JOIN g b USING (geometry) WHERE b.unit_id = y),
 md AS (SELECT geometry, quantile_cont(d, 0.5) FILTER (kind = 'near') AS near, quantile_cont(d, 0.5) FILTER (kind = 'random') AS random FROM ds GROUP BY 1)
 SELECT geometry, round(near, 6) AS near, round(random, 6) AS random, round(near / random, 6) AS ratio FROM md""")
def _(i):
    e = edges_of(i)
    return K.centred_distance_ratio(cross_of(i, e), random_of(i, e), i.vectors, i.vectors.where("group_id <> 'g0'"))


GAP = CP + """, gp AS (SELECT readout, flagged, a.feature, abs(a.predicted * f - b.predicted * f + CASE WHEN readout = 'null' THEN 100 ELSE 0 END) / 1000 AS d_pred, abs(a.measured - b.measured) AS d_meas FROM cp JOIN panel a ON a.unit_id = x JOIN panel b ON b.unit_id = y AND a.feature = b.feature,
 (VALUES ('repair', 1.3), ('head', 1.0), ('null', 0.9)) r(readout, f)),
 ge AS (SELECT readout, flagged, feature, quantile_cont(d_pred, 0.5) / nullif(quantile_cont(d_meas, 0.5), 0) AS ratio FROM gp GROUP BY 1, 2, 3), gr AS (SELECT readout, flagged, CASE WHEN count(ratio) = 6 THEN avg(ratio) END AS gap_ratio, count(ratio) AS n_features FROM ge GROUP BY 1, 2)"""


def ends_of(pairs):
    return pairs.select(F.explode(F.array("x", "y")).alias("unit_id"))


def gaps_of(i):
    """three readouts of the same pairs: a repaired one, the head and a null, made from the predicted amounts"""
    from ..session import checkpointed
    pairs = checkpointed(cross_of(i))
    p = i.panel_of(ends_of(pairs))
    a = p.select(F.col("unit_id").alias("x"), "feature", F.col("predicted").alias("pa"), F.col("measured").alias("ma"))
    b = p.select(F.col("unit_id").alias("y"), "feature", F.col("predicted").alias("pb"), F.col("measured").alias("mb"))
    r = F.array(*[F.struct(F.lit(n).alias("readout"), F.lit(f).alias("f"), F.lit(o).alias("o")) for n, f, o in (("repair", 1.3, 0.0), ("head", 1.0, 0.0), ("null", 0.9, 100.0))])
    d = pairs.join(a, "x").join(b, ["y", "feature"]).select("flagged", "feature", "pa", "pb", "ma", "mb", F.inline(r))
    return d.select("readout", "flagged", "feature", (F.abs(F.col("pa") * F.col("f") - F.col("pb") * F.col("f") + F.col("o")) / 1000).alias("d_pred"), F.abs(F.col("ma") - F.col("mb")).alias("d_meas"))


@query("pair_gaps", CP + " SELECT x, y, flagged, a.feature, round(abs(a.predicted - b.predicted), 6) AS d_pred, abs(a.measured - b.measured) AS d_meas, a.predicted > b.predicted AS x_higher FROM cp JOIN panel a ON a.unit_id = x JOIN panel b ON b.unit_id = y AND a.feature = b.feature")
def _(i):
    from ..session import checkpointed
    pairs = checkpointed(cross_of(i))
    return K.pair_gaps(pairs, i.panel_of(ends_of(pairs)), ["flagged"], "x", "y", "predicted", "measured")


def gap_table(i):
    from ..session import checkpointed
    return M.gap_ratio(checkpointed(gaps_of(i)), ["readout", "flagged"], B.FEATURES)


@query("gap_ratio", GAP + " SELECT readout, flagged, round(gap_ratio, 6) AS gap_ratio, n_features FROM gr")
def _(i):
    return gap_table(i)


V = lambda n, f: f"max(gap_ratio) FILTER (readout = '{n}' AND flagged = {f})"
DGAP = lambda t: f"(({t(V('repair', 'true'))} - {t(V('head', 'true'))}) - ({t(V('repair', 'false'))} - {t(V('head', 'false'))})) - (({t(V('null', 'true'))} - {t(V('head', 'true'))}) - ({t(V('null', 'false'))} - {t(V('head', 'false'))}))"


@query("gap_contrast", GAP + f" SELECT round({DGAP(lambda x: x)}, 6) AS d, round({DGAP(lambda x: f'ln({x})')}, 6) AS d_log FROM gr")
def _(i):
    return M.gap_contrast(gap_table(i), "repair", "head", "null")

"""Queries over typed events, comparison of runs and hypotheses. Runs, arms and declarations are derived from the tables:
one run per nation, one declaration row per brand or customer group."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..operators import ledger as L, prepare as P
from ..session import checkpointed
from .bindings import hash_key, hash_unit
from .registry import query
from .audit_queries import union_sql

NAMES = "(SELECT group_id AS run, count(*) AS n FROM units GROUP BY 1)"


def sizes(i):
    return i.units.groupBy(F.col("group_id").alias("run")).agg(F.count(F.lit(1)).alias("n"))


# ---- source events
@query("leak_status", """, s AS (SELECT 'e' || CAST(p_partkey AS VARCHAR) AS event, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE upper(replace(p_brand, '#', '_')) END AS site, p_size % 4 = 0 AS fg, CASE p_size % 3 WHEN 0 THEN 'design' WHEN 1 THEN 'response' END AS lb FROM part),
 q AS (SELECT event, CASE WHEN fg OR lb = 'design' THEN 'pass' WHEN lb = 'response' THEN 'fail' ELSE 'unknown' END AS assignment, 'flag' AS measurement, CASE WHEN site = 'BRAND_3' THEN 'flag' ELSE 'pass' END AS site_route FROM s),
 w AS (SELECT *, CASE WHEN assignment = 'fail' THEN 'fail' WHEN assignment = 'unknown' THEN 'unknown' ELSE 'flag' END AS status FROM q) SELECT event, assignment, measurement, site_route, status, CASE WHEN assignment = status THEN 'assignment' ELSE 'measurement' END AS reason FROM w""")
def _(i):
    p = i.table("part")
    s = p.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("event"), F.when(F.col("p_partkey") % 9 != 0, F.upper(F.regexp_replace("p_brand", "#", "_"))).alias("site"), (F.col("p_size") % 4 == 0).alias("from_guides"),
                 F.when(F.col("p_size") % 3 == 0, "design").when(F.col("p_size") % 3 == 1, "response").alias("label_basis"))
    r = i.spark.createDataFrame([("brand-3", True, "declared_shared", False), ("Brand_5", False, None, True)], "feature string, is_input boolean, sharing string, excludes_targets boolean")
    return L.leak_status(s, r)


SEV = """, tr AS (SELECT p_brand AS site, count(*) FILTER (p_size < 30) AS admitted, count(*) FILTER (p_size >= 30) AS rejected FROM part GROUP BY 1),
 se AS (SELECT 'run:knockout:' || site || ':' || st AS event_id, site, st AS stratum, 'treated' AS role, -1 AS sign, 1.0::DOUBLE AS amplitude, 'run:A=1' AS pool, admitted AS n_admitted, admitted + rejected AS n_attempted FROM tr, (VALUES ('F'), ('O')) s(st)
  UNION ALL SELECT 'run:control:' || st, NULL, st, 'control', 0, 0.0::DOUBLE, 'run:A=0', NULL, NULL FROM (VALUES ('F'), ('O')) s(st))"""


def events_of(i):
    p = i.table("part")
    tr = p.groupBy(F.col("p_brand").alias("site")).agg(F.sum((F.col("p_size") < 30).cast("long")).alias("admitted"), F.sum((F.col("p_size") >= 30).cast("long")).alias("rejected"))
    return L.source_events(tr.select("site"), ["F", "O"], "run", "knockout", tr)


@query("source_events", SEV + " SELECT event_id, site, stratum, role, CAST(sign AS BIGINT) AS sign, amplitude, pool, CAST(n_admitted AS DOUBLE) AS n_admitted, CAST(n_attempted AS DOUBLE) AS n_attempted FROM se")
def _(i):
    return events_of(i).drop("time").withColumn("n_admitted", F.col("n_admitted").cast("double")).withColumn("n_attempted", F.col("n_attempted").cast("double"))


@query("pool_closure", SEV + " SELECT pool, field, count(DISTINCT v) AS n_values, false AS is_pattern FROM (SELECT pool, unnest(['site', 'stratum', 'role', 'sign']) AS field, unnest([coalesce(site, ''), stratum, role, CAST(sign AS VARCHAR)]) AS v FROM se) GROUP BY 1, 2 HAVING n_values > 1")
def _(i):
    return L.pool_closure(events_of(i), ["site", "stratum", "role", "sign"])


@query("admission_share", """SELECT site, channel, coalesce(k, 0) / (SELECT count(*) FROM orders) AS share FROM (SELECT site, channel FROM (VALUES ('BUILDING'), ('FURNITURE'), ('SPACE')) s(site), (VALUES ('F'), ('O'), ('X')) c(channel)) g
 LEFT JOIN (SELECT c_mktsegment AS site, o_orderstatus AS channel, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) USING (site, channel)""".replace("coalesce(k, 0) / (SELECT count(*) FROM orders)", "round(coalesce(k, 0) / (SELECT count(*) FROM orders), 6)"))
def _(i):
    a = (i.table("orders").join(i.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("site"), F.col("o_orderstatus").alias("channel")).agg(F.count(F.lit(1)).alias("n")))
    n = i.table("orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    return L.admission_share(a, n, ["BUILDING", "FURNITURE", "SPACE"], ["F", "O", "X"])


@query("contrast_rules", f""", s AS (SELECT run AS name, n, CASE n % 4 WHEN 0 THEN 'donor' WHEN 1 THEN 'study' WHEN 2 THEN 'disease' ELSE 'weather' END AS kind, CASE n % 3 WHEN 0 THEN 'design' WHEN 1 THEN 'response' END AS lb, n % 5 = 0 AS conf, n % 7 < 3 AS other, n % 13 AS nt, n % 11 AS nc FROM {NAMES})
 SELECT name, 'C1' AS code, 'error' AS severity FROM s WHERE kind = 'weather' UNION ALL SELECT name, 'C2', 'error' FROM s WHERE lb = 'response' UNION ALL SELECT name, 'C2', 'warning' FROM s WHERE lb IS NULL UNION ALL SELECT name, 'C3', 'warning' FROM s WHERE NOT conf
 UNION ALL SELECT name, 'C4', 'error' FROM s WHERE other AND kind <> 'study' UNION ALL SELECT name, 'C5', 'warning' FROM s WHERE nt > 1 AND n % 2 = 0 UNION ALL SELECT name, 'C6', 'warning' FROM s WHERE nt > 1 AND nt < 10 OR nc > 1 AND nc < 10""")
def _(i):
    n = F.col("n")
    s = sizes(i).select(F.col("run").alias("name"), F.when(n % 4 == 0, "donor").when(n % 4 == 1, "study").when(n % 4 == 2, "disease").otherwise("weather").alias("kind"), F.when(n % 3 == 0, "design").when(n % 3 == 1, "response").alias("label_basis"),
                        F.when(n % 5 == 0, F.array(F.lit("site"))).alias("confounded_with"), F.lit("s1").alias("study"), F.when(n % 7 < 3, "s2").otherwise("s1").alias("control_study"),
                        F.when(n % 13 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n % 13, F.lit(1))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>")).alias("treated"), (n % 11).alias("n_control"), (n % 2 != 0).alias("pooled_site"))
    return L.contrast_rules(s)


HET = """, h AS (SELECT site AS grp, group_id, avg(c_acctbal) / 1000 AS v, stddev_samp(c_acctbal) / 1000 / sqrt(count(*)) AS s FROM units JOIN customer ON c_custkey = unit_id GROUP BY 1, 2),
 r AS (SELECT grp, v, v - 2 * s AS lo, v + 2 * s AS hi FROM h), w AS (SELECT *, 1 / power((hi - lo) / (2 * 1.959963984540054), 2) AS w FROM r),
 g AS (SELECT grp, count(*) AS n, sum(w * v) / sum(w) AS m, greatest(sum(w * v * v) - power(sum(w * v), 2) / sum(w), 0) AS q, bool_or((lo > 0 OR hi < 0) AND v < 0) AS opp, bool_and((lo > 0 OR hi < 0) AND v > 0) AS same FROM w GROUP BY 1)"""


@query("heterogeneity_q", HET + " SELECT grp, n, round(m, 6) AS weighted_mean, round(q, 6) AS q, n - 1 AS df, CASE WHEN n = 5 THEN round(exp(-q / 2) * (1 + q / 2), 6) END AS p, CASE WHEN opp THEN 'differs' WHEN same THEN 'holds' ELSE 'weak' END AS label FROM g")
def _(i):
    """balance of the nations of a region against the pooled one; five nations per region give the even-df closed form"""
    d = i.units.join(i.table("customer").select(F.col("c_custkey").alias("unit_id"), "c_acctbal"), "unit_id")
    h = d.groupBy(F.col("site").alias("grp"), "group_id").agg((F.avg("c_acctbal") / 1000).alias("v"), (F.stddev_samp("c_acctbal") / 1000 / F.sqrt(F.count(F.lit(1)))).alias("s"))
    r = h.select("grp", "v", (F.col("v") - 2 * F.col("s")).alias("lo"), (F.col("v") + 2 * F.col("s")).alias("hi"), F.lit(1.0).alias("pooled_v"), F.lit(True).alias("has_support"), F.lit(False).alias("has_reject"))
    return L.heterogeneity_q(r, ["grp"])


# ---- forward responses, conflicts, rules
FW = """, fw AS (SELECT dataset, 'price' AS readout, site, eps, m * eps / 1e6 * CASE WHEN site = 'KO' THEN 1.1::DOUBLE ELSE 1::DOUBLE END AS slope, site <> 'KO' AS is_random FROM (SELECT o_orderstatus AS dataset, CASE o_orderpriority WHEN '1-URGENT' THEN 'KO' ELSE o_orderpriority END AS site, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2), (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS eps)),
 iv AS (SELECT o_orderstatus AS dataset, 'price' AS readout, o_orderpriority AS stage, CASE WHEN count(*) % 2 = 0 THEN 'support' ELSE 'reject' END AS verdict, avg(o_totalprice) / 1e6 - 0.25 AS delta FROM orders GROUP BY 1, 3)"""


@query("forward_inverse_join", FW + """, ko AS (SELECT dataset, readout, max(slope) FILTER (eps = 1) AS s1, max(slope) FILTER (eps = 0.5) AS s2 FROM fw WHERE NOT is_random GROUP BY 1, 2),
 rn AS (SELECT dataset, readout, quantile_cont(abs(slope), 0.5) AS md, max(abs(slope)) AS mx, count(*) AS n, avg((abs(slope) < abs(s1))::INT)::DOUBLE AS rk FROM fw JOIN ko USING (dataset, readout) WHERE is_random AND eps = 1 GROUP BY 1, 2)
 SELECT dataset, readout, stage, verdict, round(delta, 6) AS delta, round(s1, 6) AS head_response, round(abs(s1 - s2) / greatest(abs(s1), abs(s2)), 6) AS step_difference, s1 * delta > 0 AS same_sign, round(s1 / delta, 4) AS share_of_measured, round(md, 6) AS random_abs_median, round(mx, 6) AS random_abs_max, n AS n_random, round(rk, 6) AS rank_among_random FROM iv JOIN ko USING (dataset, readout) JOIN rn USING (dataset, readout)""")
def _(i):
    o = i.table("orders").withColumn("site", F.when(F.col("o_orderpriority") == "1-URGENT", "KO").otherwise(F.col("o_orderpriority"))).withColumn("eps", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
    f = o.groupBy(F.col("o_orderstatus").alias("dataset"), F.lit("price").alias("readout"), "site", "eps").agg(F.avg("o_totalprice").alias("m"))
    f = f.select("dataset", "readout", "site", "eps", (F.col("m") * F.col("eps") / 1e6 * F.when(F.col("site") == "KO", 1.1).otherwise(1.0)).alias("slope"), (F.col("site") != "KO").alias("is_random"))
    v = i.table("orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.lit("price").alias("readout"), F.col("o_orderpriority").alias("stage")).agg((F.avg("o_totalprice") / 1e6 - 0.25).alias("delta"), F.count(F.lit(1)).alias("n"))
    v = v.select("dataset", "readout", "stage", F.when(F.col("n") % 2 == 0, "support").otherwise("reject").alias("verdict"), "delta")
    return L.forward_inverse_join(f, v).withColumn("share_of_measured", F.round("share_of_measured", 4))


IV = "(SELECT p_type AS channel, p_brand AS site, avg(p_retailprice) - 2.5 * stddev_samp(p_retailprice) / sqrt(count(*)) AS lo, avg(p_retailprice) + 2.5 * stddev_samp(p_retailprice) / sqrt(count(*)) AS hi FROM part GROUP BY 1, 2)"


@query("distinguishable_sites", f"SELECT a.channel, a.site, b.site AS other FROM {IV} a JOIN {IV} b ON a.channel = b.channel AND a.site < b.site AND (a.hi < b.lo OR b.hi < a.lo)")
def _(i):
    g = i.table("part").groupBy(F.col("p_type").alias("channel"), F.col("p_brand").alias("site")).agg(F.avg("p_retailprice").alias("m"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    return L.distinguishable_sites(g.select("channel", "site", (F.col("m") - 2.5 * F.col("s")).alias("lo"), (F.col("m") + 2.5 * F.col("s")).alias("hi")))


def interval_rows(i):
    g = i.table("part").groupBy(F.col("p_type").alias("channel"), F.col("p_brand").alias("site")).agg(F.avg("p_retailprice").alias("m"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    return g.select("channel", "site", (F.col("m") - 2.5 * F.col("s")).alias("lo"), (F.col("m") + 2.5 * F.col("s")).alias("hi"))


@query("distinguishable_counts", f", iv AS (SELECT * FROM {IV} WHERE lo IS NOT NULL AND hi IS NOT NULL) SELECT a.channel, a.site, row_number() OVER (PARTITION BY a.channel ORDER BY a.lo, {hash_key(0, 'a.site')}) AS pos, count(*) OVER (PARTITION BY a.channel) AS n, (SELECT count(*) FROM iv b WHERE b.channel = a.channel AND b.hi < a.lo) AS n_below, (SELECT count(*) FROM iv b WHERE b.channel = a.channel AND b.lo > a.hi) AS n_above FROM iv a")
def _(i):
    """one row per site of the relation of distinguishable_sites"""
    return L.distinguishable_counts(interval_rows(i))


LC = f", le AS (SELECT run, 'r' || CAST(n % 2 AS VARCHAR) AS readout, st AS stage, 'units' AS scope, 'shift' AS target, CASE (n // k) % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'reject' ELSE 'unresolved' END AS verdict, n * 0.001 AS u, CASE WHEN n % 5 = 0 THEN NULL ELSE 's' || CAST(n % 5 AS VARCHAR) END AS source_site, 'c' || CAST(n % 2 AS VARCHAR) AS context FROM {NAMES}, (VALUES ('z', 2), ('out', 3)) s(st, k))"


def ledger_of(i):
    n = F.col("n")
    d = sizes(i).select("run", "n", F.inline(F.array(F.struct(F.lit("z").alias("stage"), F.lit(2).alias("k")), F.struct(F.lit("out").alias("stage"), F.lit(3).alias("k")))))
    m = F.floor(n / F.col("k")) % 3
    return d.select("run", F.concat(F.lit("r"), (n % 2).cast("string")).alias("readout"), "stage", F.lit("units").alias("scope"), F.lit("shift").alias("target"), F.when(m == 0, "support").when(m == 1, "reject").otherwise("unresolved").alias("verdict"),
                    (n * 0.001).alias("u"), F.when(n % 5 != 0, F.concat(F.lit("s"), (n % 5).cast("string"))).alias("source_site"), F.concat(F.lit("c"), (n % 2).cast("string")).alias("context"))


@query("ledger_conflicts", LC + " SELECT a.readout, a.stage, a.scope, a.target, a.run AS run_support, b.run AS run_reject, round(a.u, 6)::DOUBLE AS u_support, round(b.u, 6)::DOUBLE AS u_reject, concat_ws(',', CASE WHEN a.source_site IS DISTINCT FROM b.source_site THEN 'source_site' END, CASE WHEN a.context IS DISTINCT FROM b.context THEN 'context' END) AS differ_in FROM le a JOIN le b USING (readout, stage, scope, target) WHERE a.verdict = 'support' AND b.verdict = 'reject'")
def _(i):
    return L.ledger_conflicts(ledger_of(i))


@query("conflict_classes", LC + """, v AS (SELECT * FROM le WHERE verdict IN ('support', 'reject')) SELECT readout, stage, scope, target, verdict, source_site, context, count(*) AS n_runs, CAST(sum((SELECT count(*) FROM v b WHERE b.readout = a.readout AND b.stage = a.stage AND b.scope = a.scope AND b.target = a.target AND b.verdict <> a.verdict AND b.run <> a.run)) AS BIGINT) AS n_links FROM v a GROUP BY ALL""")
def _(i):
    """one row per class of runs of the relation of ledger_conflicts"""
    return L.conflict_classes(ledger_of(i))


@query("verdict_events", LC + " SELECT 'verdict:' || run || ':' || readout || ':' || stage AS event_id, verdict, CASE verdict WHEN 'support' THEN 1 WHEN 'reject' THEN -1 ELSE 0 END::BIGINT AS sign FROM le")
def _(i):
    return L.verdict_events(ledger_of(i), "run").select("event_id", "verdict", "sign")


HY = f""", hy AS (SELECT run AS id, CASE WHEN n % 3 = 0 THEN 'repair' ELSE 'coverage' END AS own, n % 2 = 0 AS retro, 'b' || CAST(n % 4 AS VARCHAR) AS basis FROM {NAMES} WHERE n % 4 <> 3),
 te AS (SELECT run AS hypothesis, 'b' || CAST(n % 3 AS VARCHAR) AS rn, n % 5 AS m FROM {NAMES} WHERE n % 6 <> 5), ar AS (SELECT hypothesis, rn, CASE m WHEN 0 THEN ['repair', 'control'] WHEN 1 THEN ['coverage', 'control', 'extra'] WHEN 2 THEN ['coverage'] ELSE ['repair', 'coverage', 'control'] END AS arms FROM te)"""


def hypotheses_of(i):
    n = F.col("n")
    h = sizes(i).where("n % 4 <> 3").select(F.col("run").alias("id"), F.when(n % 3 == 0, "repair").otherwise("coverage").alias("own"), F.array(F.lit("control")).alias("controls"),
                                           F.create_map(F.lit("repair"), F.lit(0.1), F.lit("coverage"), F.lit(0.2), F.lit("control"), F.lit(0.0)).alias("forecast"), F.array(F.concat(F.lit("b"), (n % 4).cast("string"))).alias("basis"), (n % 2 == 0).alias("retrospective"))
    m = n % 5
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    t = sizes(i).where("n % 6 <> 5").select(F.col("run").alias("hypothesis"), F.array(F.concat(F.lit("b"), (n % 3).cast("string"))).alias("runs"),
                                           F.when(m == 0, arr("repair", "control")).when(m == 1, arr("coverage", "control", "extra")).when(m == 2, arr("coverage")).otherwise(arr("repair", "coverage", "control")).alias("arms"))
    return h, t


@query("ledger_rules", HY + """, j AS (SELECT * FROM ar LEFT JOIN hy ON hypothesis = id) SELECT hypothesis AS id, 'H1' AS code, 'error' AS severity, '' AS detail FROM j WHERE id IS NULL UNION ALL SELECT id, 'H2', 'error', rn FROM j WHERE basis = rn UNION ALL SELECT id, 'H2', 'warning', '' FROM j WHERE retro
 UNION ALL SELECT id, 'H3', 'error', '' FROM j WHERE id IS NOT NULL AND (NOT list_contains(arms, own) OR NOT list_contains(arms, 'control')) UNION ALL SELECT id, 'H4', 'warning', 'extra' FROM j WHERE id IS NOT NULL AND list_contains(arms, 'extra') UNION ALL SELECT id, 'H5', 'note', '' FROM hy WHERE id NOT IN (SELECT hypothesis FROM ar)""")
def _(i):
    return L.ledger_rules(*hypotheses_of(i))


# ---- runs with stages, classes and draws
ND = 40
BASE = f"""(SELECT run, n, ((n * 7) % 10) / 10.0::DOUBLE AS f FROM {NAMES})"""
DR = f""", bs AS (SELECT * FROM {BASE}), dr AS (SELECT run, 'y' AS outcome, stage, cls, b AS draw, k0 + k1 * f + CASE cls WHEN 'trees' THEN 0.03::DOUBLE ELSE 0::DOUBLE END + CASE WHEN b = 0 THEN 0 ELSE 0.1::DOUBLE * ({hash_unit(71, 'run', 'stage', 'cls', 'b')} - 0.5::DOUBLE) END AS u
  FROM bs, (VALUES ('input', 0.01::DOUBLE, 0.02::DOUBLE), ('mid', 0.05::DOUBLE, 0.3::DOUBLE), ('end', 0.1::DOUBLE, 0.5::DOUBLE)) s(stage, k0, k1), (VALUES ('ridge'), ('trees')) c(cls), (SELECT unnest(range(0, {ND + 1})) AS b)),
 iv AS (SELECT run, outcome, stage, cls, max(u) FILTER (draw = 0) AS u, quantile_cont(u, 0.025) FILTER (draw > 0) AS lo, quantile_cont(u, 0.975) FILTER (draw > 0) AS hi FROM dr GROUP BY 1, 2, 3, 4), sv AS ({union_sql(0.1, True, 'run, outcome, stage', 'iv')}),
 sd AS (SELECT run, outcome, draw, max(abs(d.u)) FILTER (stage = 'end') - max(abs(d.u)) FILTER (stage = 'input') AS d FROM dr d JOIN (SELECT run, outcome, stage, cls FROM sv) USING (run, outcome, stage, cls) WHERE draw > 0 GROUP BY 1, 2, 3),
 sp AS (SELECT run, outcome, added, ref_verdict, end_verdict, end_half, lo, hi, (hi - lo) / 2 AS half_width, CASE WHEN lo > 0.1 THEN 'loss' WHEN hi < 0.1 THEN 'no added loss' ELSE 'unresolved' END AS reading FROM
  (SELECT run, outcome, max(abs(u)) FILTER (stage = 'end') - max(abs(u)) FILTER (stage = 'input') AS added, max(verdict) FILTER (stage = 'input') AS ref_verdict, max(verdict) FILTER (stage = 'end') AS end_verdict, max((hi - lo) / 2) FILTER (stage = 'end') AS end_half FROM sv GROUP BY 1, 2)
  JOIN (SELECT run, outcome, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM sd GROUP BY 1, 2) USING (run, outcome)),
 dd AS (SELECT run, 'y' AS outcome, b AS draw, CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE * {hash_unit(72, 'n % 2', 'b')} AS delta FROM bs, (SELECT unnest(range(1, {ND + 1})) AS b))"""


def draws_of(i):
    b = sizes(i).withColumn("f", ((F.col("n") * 7) % 10) / 10)
    s = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(a).alias("k0"), F.lit(c).alias("k1")) for n, a, c in (("input", 0.01, 0.02), ("mid", 0.05, 0.3), ("end", 0.1, 0.5))])
    d = b.select("run", "f", F.inline(s)).withColumn("cls", F.explode(F.array(F.lit("ridge"), F.lit("trees")))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(ND))))
    u = F.col("k0") + F.col("k1") * F.col("f") + F.when(F.col("cls") == "trees", 0.03).otherwise(0.0) + F.when(F.col("draw") == 0, 0.0).otherwise(0.1 * (uniform(71, "run", "stage", "cls", "draw") - 0.5))
    return checkpointed(d.select("run", F.lit("y").alias("outcome"), "stage", "cls", "draw", u.alias("u")))


def delta_draws(i):
    b = sizes(i).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(ND))))
    return b.select("run", F.lit("y").alias("outcome"), "draw", (F.when(F.col("n") % 2 == 0, 1.0).otherwise(0.5) + 0.2 * uniform(72, F.col("n") % 2, "draw")).alias("delta"))


def stages_of(i, draws):
    b = F.when(F.col("draw") > 0, F.col("u"))
    iv = draws.groupBy("run", "outcome", "stage", "cls").agg(F.max(F.when(F.col("draw") == 0, F.col("u"))).alias("u"), F.percentile(b, F.lit(0.025)).alias("lo"), F.percentile(b, F.lit(0.975)).alias("hi"))
    return checkpointed(L.stage_verdicts(iv, 0.1))


SPAN = ("input", "end")


def spans_of(i):
    d = draws_of(i)
    st = stages_of(i, d)
    return d, st, checkpointed(L.span_loss(st, d, SPAN, 0.1, 0.05))


@query("stage_verdicts", DR + " SELECT run, outcome, stage, verdict, cls, round(u, 6) AS u, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sv")
def _(i):
    return stages_of(i, draws_of(i))


@query("reread_verdicts", DR + f" SELECT run, outcome, stage, verdict, cls, round(u, 6) AS u, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({union_sql(0.25, False, 'run, outcome, stage', 'iv')})")
def _(i):
    from ..operators.audit import reread_verdicts
    return reread_verdicts(draws_of(i), ["run", "outcome", "stage"], 0.25, 0.05)


@query("span_loss", DR + " SELECT run, outcome, round(added, 6) AS added, ref_verdict, end_verdict, round(end_half, 6) AS end_half, round(lo, 6) AS lo, round(hi, 6) AS hi, round(half_width, 6) AS half_width, reading FROM sp")
def _(i):
    return spans_of(i)[2]


PAIRS = "(SELECT a.run AS base, b.run AS arm FROM bs a JOIN bs b ON a.run <> b.run WHERE a.run IN ('NATION_0', 'NATION_1') AND b.run IN ('NATION_2', 'NATION_3', 'NATION_4', 'NATION_5'))"


def run_pairs(i):
    s = i.spark.createDataFrame([(f"NATION_{a}", f"NATION_{b}") for a in (0, 1) for b in (2, 3, 4, 5)], "base string, arm string")
    return s.join(sizes(i).select(F.col("run").alias("base")), "base").join(sizes(i).select(F.col("run").alias("arm")), "arm").select("base", "arm")


@query("paired_runs", DR + f" SELECT base, arm, x.outcome, bool_and(x.delta = y.delta) AS paired FROM {PAIRS} JOIN dd x ON x.run = base JOIN dd y ON y.run = arm AND x.draw = y.draw GROUP BY 1, 2, 3")
def _(i):
    return L.paired_runs(delta_draws(i), run_pairs(i))


@query("admit_run", DR + """, rn AS (SELECT run, 'y' AS outcome, f - 0.2 AS delta, f - 0.2 - 0.1 AS dl, f - 0.2 + 0.05 AS dh, n % 14 AS nc, n % 3 = 0 AS sealed FROM bs),
 x AS (SELECT rn.*, sp.* EXCLUDE (run, outcome), NOT (dl <= 0 AND dh >= 0) AS resolved, abs(delta) / ((dh - dl) / 2) AS snr FROM rn JOIN sp USING (run, outcome)), y AS (SELECT *, CASE WHEN resolved AND snr >= 2 AND ref_verdict <> 'reject' AND reading = 'loss' THEN 'ready' ELSE 'not ready' END AS diagnostic FROM x)
 SELECT run, outcome, resolved, round(snr, 6) AS snr, diagnostic, CASE WHEN diagnostic <> 'ready' THEN 'not attainable' WHEN ref_verdict = 'support' AND end_half < 0.1 THEN 'absolute' WHEN half_width <= 0.05 THEN 'relative' WHEN half_width < 0.1 THEN 'marginal' ELSE 'not attainable' END AS certification, CASE WHEN sealed AND nc >= 10 THEN 'confirmatory possible' ELSE 'exploratory' END AS grade FROM y""")
def _(i):
    b = sizes(i).withColumn("f", ((F.col("n") * 7) % 10) / 10)
    r = b.select("run", F.lit("y").alias("outcome"), (F.col("f") - 0.2).alias("delta"), (F.col("f") - 0.2 - 0.1).alias("delta_lo"), (F.col("f") - 0.2 + 0.05).alias("delta_hi"), (F.col("n") % 14).alias("n_clusters"), (F.col("n") % 3 == 0).alias("sealed"))
    return L.admit_run(spans_of(i)[2], r, 0.1, 0.1, 2.0, 10)


CD = DR + f""", pr AS (SELECT base, arm, x.outcome, bool_and(x.delta = y.delta) AS paired FROM {PAIRS} JOIN dd x ON x.run = base JOIN dd y ON y.run = arm AND x.draw = y.draw GROUP BY 1, 2, 3),
 sn AS (SELECT run, outcome, d, row_number() OVER (PARTITION BY run, outcome ORDER BY draw) AS no, row_number() OVER (PARTITION BY run, outcome ORDER BY {hash_key(0, 'draw')}, draw) AS perm FROM sd),
 cd AS (SELECT pr.base, pr.arm, pr.outcome, pr.paired, b.no AS k, a.d AS d0, b.d AS d1, a.d - b.d AS removed FROM pr JOIN sn a ON a.run = pr.base JOIN sn b ON b.run = pr.arm AND b.no = CASE WHEN pr.paired THEN a.no ELSE a.perm END),
 ct AS (SELECT c.base, c.arm, c.outcome, paired, bs2.added - ar2.added AS removed, c.lo, c.hi, c.hi < 0.1 AS below_margin, CASE WHEN c.lo > 0 THEN CASE WHEN c.hi < 0.1 THEN 'reduces the loss by less than the margin' ELSE 'reduces the loss' END WHEN c.hi < 0 THEN 'adds to the loss' WHEN c.hi < 0.1 THEN 'does not reduce the loss' ELSE 'unresolved' END AS reading,
   bs2.reading AS base_reading, CASE WHEN bs2.lo > 0 THEN 1 - ar2.added / bs2.added END AS share_removed, CASE WHEN bs2.lo > 0 THEN c.sl END AS share_lo, CASE WHEN bs2.lo > 0 THEN c.sh END AS share_hi FROM
   (SELECT base, arm, outcome, paired, quantile_cont(removed, 0.025) AS lo, quantile_cont(removed, 0.975) AS hi, quantile_cont(1 - d1 / d0, 0.025) AS sl, quantile_cont(1 - d1 / d0, 0.975) AS sh FROM cd GROUP BY 1, 2, 3, 4) c JOIN sp bs2 ON bs2.run = c.base JOIN sp ar2 ON ar2.run = c.arm)"""


def contrasts_of(i):
    d, st, sp = spans_of(i)
    cd = checkpointed(L.contrast_draws(st, d, delta_draws(i), run_pairs(i), SPAN))
    return sp, cd, L.contrast_arms(sp, cd, 0.1, 0.05)


@query("contrast_arms", CD + " SELECT base, arm, outcome, paired, round(removed, 6) AS removed, round(lo, 6) AS lo, round(hi, 6) AS hi, below_margin, reading, base_reading, round(share_removed, 4) AS share_removed, round(share_lo, 4) AS share_lo, round(share_hi, 4) AS share_hi FROM ct")
def _(i):
    c = contrasts_of(i)[2]
    return c.select(*[F.round(x, 4).alias(x) if x.startswith("share") else F.col(x) for x in c.columns])


@query("diagnose_close", CD + f""", l AS (SELECT * FROM ct WHERE base = 'NATION_0' AND arm = 'NATION_2'), c AS (SELECT * FROM ct WHERE base = 'NATION_0' AND arm = 'NATION_3'),
 y AS (SELECT cd.outcome, k, row_number() OVER (PARTITION BY cd.outcome ORDER BY {hash_key(1, 'k')}, k) AS perm, cd.removed FROM cd WHERE base = 'NATION_0' AND arm = 'NATION_3'),
 df AS (SELECT x.outcome, quantile_cont(x.removed - y.removed, 0.025) AS lo, quantile_cont(x.removed - y.removed, 0.975) AS hi FROM cd x JOIN y ON x.outcome = y.outcome JOIN l ON l.outcome = x.outcome JOIN c ON c.outcome = x.outcome WHERE x.base = 'NATION_0' AND x.arm = 'NATION_2' AND x.k = CASE WHEN l.paired AND c.paired THEN y.k ELSE y.perm END GROUP BY 1),
 cl AS (SELECT a.outcome, CASE WHEN c.reading <> 'loss' AND c.end_verdict <> 'reject' THEN 'not testable' WHEN a.end_verdict = 'support' AND c.end_verdict = 'reject' THEN 'absolute' WHEN a.reading = 'loss' THEN 'not closed' WHEN a.reading = 'no added loss' AND c.reading = 'loss' THEN 'relative' WHEN a.reading = 'unresolved' AND c.reading = 'loss' THEN 'loss no longer resolved' ELSE 'not testable' END AS grade FROM sp a JOIN sp c USING (outcome) WHERE a.run = 'NATION_2' AND c.run = 'NATION_3')
 SELECT l.outcome, CASE WHEN l.base_reading <> 'loss' THEN 'not testable' WHEN l.reading = 'reduces the loss' AND df.lo > 0 THEN 'located step confirmed' WHEN l.below_margin OR df.hi < 0 THEN 'located step not confirmed' ELSE 'unresolved' END AS diagnosis, round(l.removed - c.removed, 6) AS located_minus_control, round(df.lo, 6) AS lo, round(df.hi, 6) AS hi, c.below_margin AS selective, grade
 FROM l JOIN c USING (outcome) JOIN df USING (outcome) JOIN cl USING (outcome)""")
def _(i):
    sp, cd, c = contrasts_of(i)
    return L.diagnose(checkpointed(c), cd, "NATION_0", "NATION_2", "NATION_3", 0.05).join(L.closure(sp, "NATION_2", "NATION_3"), "outcome")


# ---- hypotheses and gates
HT = f""", hp AS (SELECT run AS id, n, ((n * 3) % 10) / 10.0::DOUBLE AS g FROM {NAMES}), am AS (SELECT id, 'own' AS arm, g - 0.1 AS lo, g + 0.1 AS hi, n % 9 <> 0 AS adm FROM hp WHERE n % 8 <> 0 UNION ALL SELECT id, 'ctl', 0.3 - g - 0.1, 0.3 - g + 0.1, true FROM hp WHERE n % 7 <> 0),
 ho AS (SELECT h.id, CASE WHEN o.id IS NULL OR c.id IS NULL OR NOT o.adm THEN 'not testable' WHEN o.hi < 0.3 OR c.lo > 0.1 THEN 'refuted' WHEN o.lo >= 0.3 AND c.hi <= 0.1 THEN 'confirmed' ELSE 'unresolved' END AS outcome FROM hp h LEFT JOIN (SELECT * FROM am WHERE arm = 'own') o USING (id) LEFT JOIN (SELECT * FROM am WHERE arm = 'ctl') c USING (id))"""


def tested(i):
    h = sizes(i).select(F.col("run").alias("id"), "n", (((F.col("n") * 3) % 10) / 10).alias("g"))
    hyp = h.select("id", F.lit("own").alias("own"), F.lit(0.3).alias("at_least"), F.create_map(F.lit("ctl"), F.lit(0.1)).alias("controls"))
    own = h.where("n % 8 <> 0").select("id", F.lit("own").alias("arm"), (F.col("g") - 0.1).alias("lo"), (F.col("g") + 0.1).alias("hi"), (F.col("n") % 9 != 0).alias("admitted"))
    ctl = h.where("n % 7 <> 0").select("id", F.lit("ctl").alias("arm"), (0.3 - F.col("g") - 0.1).alias("lo"), (0.3 - F.col("g") + 0.1).alias("hi"), F.lit(True).alias("admitted"))
    return L.hypothesis_test(hyp, own.unionByName(ctl))


@query("hypothesis_test", HT + " SELECT id, outcome FROM ho")
def _(i):
    return tested(i)


@query("outcome_of_round", HT + " SELECT id, CASE WHEN CAST(right(id, 1) AS INT) % 3 = 0 AND outcome <> 'confirmed' THEN 'unresolved' ELSE outcome END AS outcome FROM ho")
def _(i):
    """two seeds: the second reads 'confirmed' for every third hypothesis"""
    t = tested(i)
    second = t.withColumn("outcome", F.when(F.substring("id", -1, 1).cast("int") % 3 == 0, "confirmed").otherwise(F.col("outcome")))
    return L.outcome_of_round(t.unionByName(second), t)


@query("forecast_record", f""", t AS (SELECT run, n % 10 / 10.0::DOUBLE AS gain, CASE WHEN n % 6 = 0 THEN NULL ELSE 0.2::DOUBLE END AS lo, 0.6::DOUBLE AS hi FROM {NAMES}) SELECT count(lo) AS n, count(*) FILTER (lo IS NOT NULL AND gain >= lo AND gain <= hi) AS n_inside, round(avg(abs(gain - (lo + hi) / 2)), 6) AS mean_abs_error FROM t""")
def _(i):
    t = sizes(i).select(F.col("run").alias("hypothesis"), F.lit("own").alias("arm"), (F.col("n") % 10 / 10).alias("gain"), F.when(F.col("n") % 6 != 0, 0.2).alias("f_lo"), F.lit(0.6).alias("f_hi"))
    return L.forecast_record(t)


MK = f""", mk AS (SELECT run, arm, ((n * k) % 10) / 10.0::DOUBLE AS u, CASE (n // k) % 3 WHEN 0 THEN 'support' ELSE 'reject' END AS verdict FROM {NAMES}, (VALUES ('base', 2), ('with', 3), ('without', 7)) a(arm, k)),
 w AS (SELECT run, max(u) FILTER (arm = 'base') / 2 AS m, max(verdict) FILTER (arm = 'base') AS vb, max(u) FILTER (arm = 'with') AS uw, max(verdict) FILTER (arm = 'with') AS vw, max(u) FILTER (arm = 'without') AS uo, max(verdict) FILTER (arm = 'without') AS vo FROM mk GROUP BY 1)"""


@query("mark_rule", MK + " SELECT run, CASE WHEN vb <> 'reject' THEN 'cannot be put on these rows' WHEN vo <> 'reject' AND uo <= m THEN 'not supported' WHEN vw <> 'reject' AND uw <= m AND vo = 'reject' AND uo > m THEN 'supported' WHEN vw = 'reject' AND uw > m THEN 'not answered' ELSE 'between the marks' END AS outcome FROM w")
def _(i):
    a = F.array(*[F.struct(F.lit(x).alias("arm"), F.lit(k).alias("k")) for x, k in (("base", 2), ("with", 3), ("without", 7))])
    d = sizes(i).select("run", "n", F.inline(a))
    d = d.select("run", "arm", ((F.col("n") * F.col("k")) % 10 / 10).alias("u"), F.when(F.floor(F.col("n") / F.col("k")) % 3 == 0, "support").otherwise("reject").alias("verdict"))
    return L.mark_rule(d, ["run"], "base", "with", "without")


GC = f""", hs AS (SELECT run, n, e AS epoch, ((n * e) % 13) / 13.0::DOUBLE AS score FROM {NAMES}, (SELECT unnest(range(1, 16)) AS e)), hh AS (SELECT run, avg(score) FILTER (r <= 5) AS last, avg(score) FILTER (r > 5) AS before FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM hs) WHERE r <= 10 GROUP BY 1),
 sh AS (SELECT group_id AS run, count(*) AS k FROM units WHERE unit_id % 2 = 0 AND unit_id % 31 = 0 GROUP BY 1)"""


@query("gate_checks", GC + f" SELECT run, own_objective, ran, no_scored_in_fit, guard, own_objective AND ran AND no_scored_in_fit AND guard AS admitted FROM (SELECT run, ((n % 10) / 10.0::DOUBLE) - 0.3::DOUBLE >= 0.05::DOUBLE AS own_objective, last >= before - 0.02 AS ran, coalesce(k, 0) = 0 AS no_scored_in_fit, 0.5::DOUBLE - (n % 7) / 7.0::DOUBLE <= 0.1::DOUBLE AS guard FROM {NAMES} JOIN hh USING (run) LEFT JOIN sh USING (run))")
def _(i):
    s = sizes(i)
    n = F.col("n")
    sc = s.select("run", (n % 10 / 10).alias("fit_score"), F.lit(0.3).alias("base_fit_score"), (n % 7 / 7).alias("guard_score"), F.lit(0.5).alias("base_guard_score"))
    h = s.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(15)))).select("run", "epoch", ((n * F.col("epoch")) % 13 / 13).alias("score"))
    u = i.units.select(F.col("group_id").alias("run"), "unit_id")
    return L.gate_checks(sc, h, u.where("unit_id % 2 = 0"), u.where("unit_id % 31 = 0"), 0.05, 0.02, 0.1)


CS = """, cm AS (SELECT site AS cand, '*' AS scope, min(unit_id % 97) / 50.0::DOUBLE AS lo, max(unit_id % 89) / 100.0::DOUBLE AS hi FROM units GROUP BY 1 UNION ALL SELECT site, group_id, (count(*) % 9) / 20.0::DOUBLE, (count(*) % 9) / 8.0::DOUBLE FROM units GROUP BY 1, 2)"""


@query("candidate_support", CS + " SELECT cand, CASE WHEN bool_and(lo > 0.1) THEN 'rejected' WHEN bool_and(hi <= 0.9) THEN 'supported' ELSE 'unresolved' END AS status FROM cm GROUP BY 1")
def _(i):
    u = i.units
    a = u.groupBy(F.col("site").alias("cand")).agg((F.min(F.col("unit_id") % 97) / 50).alias("lo"), (F.max(F.col("unit_id") % 89) / 100).alias("hi")).withColumn("scope", F.lit("*"))
    b = u.groupBy(F.col("site").alias("cand"), F.col("group_id").alias("scope")).agg((F.count(F.lit(1)) % 9 / 20).alias("lo"), (F.count(F.lit(1)) % 9 / 8).alias("hi"))
    t = a.unionByName(b)
    m = L.candidate_support(t.select("cand", "scope", "lo", "hi"), t.select("cand", "scope", "lo", (F.col("hi")).alias("hi")), ["cand"], 0.1)
    s = L.candidate_support(t.select("cand", "scope", F.lit(-1.0).alias("lo"), "hi"), t, ["cand"], 0.9).withColumnRenamed("status", "s2")
    return m.join(s, "cand").select("cand", F.when(F.col("status") == "rejected", "rejected").otherwise(F.col("s2")).alias("status"))


@query("candidate_selection", """, cp AS (SELECT group_id, o AS "order", 'c' || CAST(o AS VARCHAR) AS candidate, ((count(*) * (4 - o)) % 10) / 10.0::DOUBLE AS q95 FROM units, (SELECT unnest(range(1, 4)) AS o) GROUP BY 1, 2) SELECT group_id, arg_min(candidate, "order") FILTER (q95 <= 0.3) AS selected FROM cp GROUP BY 1""")
def _(i):
    d = i.units.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(3))))
    d = d.select("group_id", "order", F.concat(F.lit("c"), F.col("order").cast("string")).alias("candidate"), (F.col("n") * (4 - F.col("order")) % 10 / 10).alias("q95"))
    return L.candidate_selection(d, ["group_id"], 0.3)


@query("poison_invariance", "SELECT 'test' AS poisoned, 6::BIGINT AS n, 0::BIGINT AS n_changed UNION ALL SELECT 'train', 6, 6")
def _(i):
    """the scale is rebuilt after the test rows, then the training rows, are overwritten by hash-random values"""
    out = None
    p = i.stored_panel.join(i.split.select("unit_id", "split"), "unit_id")
    for s in ("test", "train"):
        bad = p.withColumn("predicted", F.when(F.col("split") == s, uniform(81, "unit_id", "feature") * 1e7).otherwise(F.col("predicted"))).drop("split")
        r = L.poison_invariance(i.q_scale, P.q_scale(bad, i.split, "predicted"), ["feature"]).withColumn("poisoned", F.lit(s))
        out = r if out is None else out.unionByName(r)
    return out

"""The study tables every registered query starts from, as DataFrames and as SQL.

unit = customer, group = nation, site = region, cell_type = market segment;
counts = quantity per (unit, brand); panel = measured quantity and predicted (priced) amount per
(unit, part type); two part types per class, the first of each is the key marker."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import classify, prepare
from ..session import checkpointed

CLASSES = ["A", "B", "C"]
PANEL = {"A": ["ECONOMY", "LARGE"], "B": ["MEDIUM", "PROMO"], "C": ["SMALL", "STANDARD"]}
KEY_MARKER = {"A": "ECONOMY", "B": "MEDIUM", "C": "SMALL"}
FEATURES = [f for c in CLASSES for f in PANEL[c]]
ANNOTATION = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "C", "HOUSEHOLD": "OUT", "MACHINERY": "A"}
TEST_SITES = ["EUROPE"]
VAL_SHARE = 0.25
SEED = 0
BAR = 0.35
THRESHOLDS = {"ECONOMY": 190.0, "LARGE": 200.0, "MEDIUM": 200.0, "PROMO": 200.0, "SMALL": 190.0, "STANDARD": 260.0}
GATE = [
    {"label": "OUT", "all_high": ["STANDARD"]},
    {"label": "A", "all_high": ["ECONOMY"], "none_high": ["MEDIUM", "SMALL"]},
    {"label": "B", "all_high": ["MEDIUM"], "none_high": ["ECONOMY", "SMALL"]},
    {"label": "C", "none_high": ["ECONOMY", "MEDIUM"], "count_high": {"features": ["SMALL", "PROMO", "LARGE"], "min": 1}},
]


class Inputs:
    """Lazy study tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def units(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
                 .select(F.col("c_custkey").alias("unit_id"), F.col("r_name").alias("site"), F.col("n_name").alias("group_id"),
                         F.col("c_mktsegment").alias("cell_type")))

    @cached_property
    def lines(self) -> DataFrame:
        return self._lines(self.table("orders"))

    def _lines(self, o: DataFrame) -> DataFrame:
        li, p = self.table("lineitem"), self.table("part")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
                  .select(F.col("o_custkey").alias("unit_id"), "p_brand", "p_type", F.col("l_quantity").alias("qty"),
                          F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")))

    @cached_property
    def counts(self) -> DataFrame:
        return self.lines.groupBy("unit_id", F.col("p_brand").alias("feature")).agg(F.sum("qty").alias("count"))

    @cached_property
    def panel(self) -> DataFrame:
        return self._panel(self.lines)

    def panel_of(self, units: DataFrame) -> DataFrame:
        """The panel of some units, written once: only their orders are joined with the lines."""
        o = self.table("orders").join(units.select(F.col("unit_id").alias("o_custkey")).distinct(), "o_custkey", "left_semi")
        return checkpointed(self._panel(self._lines(o)))

    @staticmethod
    def _panel(lines: DataFrame) -> DataFrame:
        return (lines.groupBy("unit_id", F.col("p_type").alias("feature"))
                    .agg(F.sum("qty").alias("measured"), (F.sum("cents").cast("double") / F.lit(100.0)).alias("predicted")))

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel written once: it feeds the scale, the evidence and the measured side of one query."""
        return checkpointed(self.panel)

    @cached_property
    def split(self) -> DataFrame:
        """units + split, by site and by donor"""
        return prepare.donor_site_split(self.units, TEST_SITES, VAL_SHARE, SEED)

    @cached_property
    def q_scale(self) -> DataFrame:
        return prepare.q_scale(self.stored_panel, self.split, "predicted")

    @cached_property
    def evidence(self) -> DataFrame:
        """unit_id, feature, v in [0, 1]"""
        return prepare.evidence(self.stored_panel, self.q_scale, "predicted", out="v").select("unit_id", "feature", "v")

    @cached_property
    def scores(self) -> DataFrame:
        """unit_id, A, B, C"""
        return classify.class_scores(self.evidence, PANEL, "v")

    @cached_property
    def calls(self) -> DataFrame:
        s = self.scores
        return s.select("*", classify.argmax_call(CLASSES, BAR).alias("call"), classify.top_score(CLASSES).alias("conf"),
                        classify.margin(CLASSES).alias("margin"))

    @cached_property
    def measured_wide(self) -> DataFrame:
        return prepare.densify(self.panel, FEATURES, "measured")

    @cached_property
    def keys(self) -> DataFrame:
        """unit_id, site, group_id, cell_type, annot, gated, key"""
        wide = prepare.densify(self.stored_panel, FEATURES, "measured")
        flags = classify.high_flags(wide, THRESHOLDS)
        g = flags.select("unit_id", classify.gate(GATE, "OUT").alias("gated"))
        a = classify.label_map(self.units, "cell_type", ANNOTATION, "annot")
        return a.join(g, "unit_id").withColumn("key", classify.agreement("annot", "gated"))

    @cached_property
    def evaluated(self) -> DataFrame:
        """calls with keys and split of all units"""
        return self.calls.join(self.keys, "unit_id").join(self.split.select("unit_id", "split"), "unit_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("z"),
                                               F.col("label").cast("string").alias("cls"),
                                               F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("group_id"))

    @cached_property
    def trial(self) -> DataFrame:
        """orders as treated (1-URGENT) / control (5-LOW) rows: unit_id, a, cluster, y, x (log quantity), g (block)"""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        q = self.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("nl"))
        return (o.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
                 .join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                 .join(q, F.col("o_orderkey") == F.col("l_orderkey"))
                 .select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("a"),
                         F.col("n_name").alias("cluster"), F.log1p("o_totalprice").alias("y"), F.log1p("qty").alias("x"),
                         F.col("nl").cast("double").alias("x2"), F.col("o_orderstatus").alias("stratum")))


def hash_unit(seed, *parts: str) -> str:
    """SQL of the uniform draw"""
    s = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5({s}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def hash_key(seed, *parts: str) -> str:
    s = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({s})"


def _case(col: str, mapping: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


F2C = {f: c for c in CLASSES for f in PANEL[c]}
_HIGH = ", ".join(f"coalesce({f}, 0) > {THRESHOLDS[f]} AS h_{f}" for f in FEATURES)
PRELUDE = f"""WITH units AS (SELECT c_custkey AS unit_id, r_name AS site, n_name AS group_id, c_mktsegment AS cell_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lines AS (SELECT o_custkey AS unit_id, p_brand, p_type, l_quantity AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
counts AS (SELECT unit_id, p_brand AS feature, sum(qty) AS count FROM lines GROUP BY 1, 2),
panel AS (SELECT unit_id, p_type AS feature, sum(qty) AS measured, CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE AS predicted FROM lines GROUP BY 1, 2),
train_groups AS (SELECT group_id, row_number() OVER (ORDER BY {hash_key(SEED, 'group_id')}, group_id) AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT group_id FROM units WHERE site NOT IN ('EUROPE'))),
split AS (SELECT u.*, CASE WHEN site IN ('EUROPE') THEN 'test'
    WHEN rk <= greatest(1, round_even(n * {VAL_SHARE}, 0)) THEN 'val' ELSE 'train' END AS split FROM units u LEFT JOIN train_groups USING (group_id)),
q_scale AS (SELECT feature, quantile_cont(predicted, 0.95) AS q FROM panel JOIN split USING (unit_id) WHERE split = 'train' GROUP BY 1),
evidence AS (SELECT unit_id, feature, least(greatest(predicted / greatest(q, 1e-12), 0), 1)::DOUBLE AS v FROM panel JOIN q_scale USING (feature)),
scores_long AS (SELECT unit_id, cls, sum(v) / 2 AS s FROM (SELECT unit_id, v, {_case('feature', F2C)} AS cls FROM evidence) GROUP BY 1, 2),
scores AS (SELECT unit_id, coalesce(max(s) FILTER (cls = 'A'), 0) AS A, coalesce(max(s) FILTER (cls = 'B'), 0) AS B,
  coalesce(max(s) FILTER (cls = 'C'), 0) AS C FROM scores_long GROUP BY 1),
calls AS (SELECT *, greatest(A, B, C) AS conf, greatest(A, B, C) - list_reverse_sort([A, B, C])[2] AS margin,
  CASE WHEN greatest(A, B, C) < {BAR} THEN '' WHEN A >= B AND A >= C THEN 'A' WHEN B >= C THEN 'B' ELSE 'C' END AS call FROM scores),
measured_wide AS (SELECT unit_id, {", ".join(f"coalesce(max(measured) FILTER (feature = '{f}'), 0) AS {f}" for f in FEATURES)} FROM panel GROUP BY 1),
flags AS (SELECT unit_id, {_HIGH} FROM measured_wide),
gated AS (SELECT unit_id, CASE WHEN h_STANDARD THEN 'OUT' WHEN h_ECONOMY AND NOT h_MEDIUM AND NOT h_SMALL THEN 'A'
  WHEN h_MEDIUM AND NOT h_ECONOMY AND NOT h_SMALL THEN 'B'
  WHEN NOT h_ECONOMY AND NOT h_MEDIUM AND (h_SMALL::INT + h_PROMO::INT + h_LARGE::INT) >= 1 THEN 'C' ELSE 'OUT' END AS gated FROM flags),
keys AS (SELECT u.*, gated, CASE WHEN annot = gated THEN annot ELSE 'unscored' END AS key
  FROM (SELECT *, {_case('cell_type', ANNOTATION)} AS annot FROM units) u JOIN gated USING (unit_id)),
evaluated AS (SELECT c.*, k.* EXCLUDE (unit_id), split FROM calls c JOIN keys k USING (unit_id) JOIN (SELECT unit_id, split FROM split) USING (unit_id)),
vectors AS (SELECT vec_id AS unit_id, embedding AS z, CAST(label AS VARCHAR) AS cls, 'g' || CAST(vec_id % 4 AS VARCHAR) AS group_id FROM embeddings),
trial AS (SELECT o_orderkey AS unit_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS a, n_name AS cluster,
    ln(1 + o_totalprice) AS y, ln(1 + qty) AS x, CAST(nl AS DOUBLE) AS x2, o_orderstatus AS stratum
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS nl FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
"""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import classify as C, decide as D, prepare as P
from strataspark.sources import io

RULES = [
    {"label": "OUT", "all_high": ["E"]},
    {"label": "T", "all_high": ["C3"], "none_high": ["B1", "B2", "M1"]},
    {"label": "B", "any_high": ["B1", "B2"], "none_high": ["C3", "M1"]},
    {"label": "NK", "none_high": ["C3", "B1", "B2", "M1"], "count_high": {"features": ["N1", "N2", "N3"], "min": 2}},
    {"label": "M", "any_high": ["M1", "M2"], "none_high": ["C3", "B1", "B2"]},
]
FE = ["E", "C3", "B1", "B2", "M1", "M2", "N1", "N2", "N3"]


def flags(spark, *high_sets):
    rows = [(i, *[(f in h) for f in FE]) for i, h in enumerate(high_sets)]
    return spark.createDataFrame(rows, "unit_id int, " + ", ".join(f"h_{f} boolean" for f in FE))


def test_gate_one_row_per_rule(spark):
    d = flags(spark, {"E", "C3"}, {"C3"}, {"B2"}, {"N1", "N3"}, {"N1"}, {"M2", "N1"}, {"C3", "B1"}, set())
    got = [r.g for r in d.orderBy("unit_id").select(C.gate(RULES).alias("g")).collect()]
    assert got == ["OUT", "T", "B", "NK", "OUT", "M", "OUT", "OUT"]


def test_reduced_gate_drops_rules_that_cannot_pass():
    r = C.reduced_gate(RULES, ["C3", "B1", "M1", "N1", "N2"])
    assert [x["label"] for x in r] == ["T", "B", "NK", "M"]
    assert r[1]["any_high"] == ["B1"] and r[2]["count_high"]["features"] == ["N1", "N2"]
    assert [x["label"] for x in C.reduced_gate(RULES, ["B1", "M1", "N1"])] == ["B", "M"]


def test_missing_is_never_high(spark):
    d = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 1.0)], "unit_id int, x double")
    assert [r.h for r in d.orderBy("unit_id").select(C.is_high(F.col("x"), F.lit(1.0)).alias("h")).collect()] == [True, False, False, False]


def test_unknown_label_fails(spark):
    d = spark.createDataFrame([("a",), ("zz",)], "t string")
    with pytest.raises(Exception, match="label without a class"):
        C.label_map(d, "t", {"a": "A"}, "c").collect()


def test_guides(spark):
    d = spark.createDataFrame([("",), ("NT1;NT2",), ("G1_g1; NT1",), ("G1_g1;G1_g2",), ("G1_g1;G2_g1",), (None,)], "g string")
    got = [r[0] for r in d.select(C.target_from_guides("g", r"^(.*)_g\d+$", ["NT1", "NT2"])).collect()]
    assert got == ["", "control", "G1", "G1", "", ""]


def test_calls_margins_entropy(spark):
    d = spark.createDataFrame([(0.5, 0.5, 0.1), (0.2, 0.1, 0.1), (0.0, 0.0, 0.0), (0.9, 0.3, 0.3)], "A double, B double, C double")
    k = ["A", "B", "C"]
    r = d.select(C.argmax_call(k, 0.3).alias("call"), C.margin(k).alias("m"), C.tied_top(k).alias("t"), C.entropy_confidence(k).alias("e"), C.signed_margin(k, F.lit("B")).alias("s")).collect()
    assert [x.call for x in r] == ["A", "", "", "A"] and [x.t for x in r] == [True, False, True, False]
    q = [0.6, 0.2, 0.2]
    assert math.isclose(r[3].e, 1 + sum(x * math.log(x) for x in q) / math.log(3)) and r[2].e == 0.0
    assert math.isclose(r[0].s, 0.0) and math.isclose(r[3].s, -0.6)


def test_question_key(spark):
    rows = [("M", "classic", True), ("M", "classic", False), ("M", "other", False), ("M", "third", True), ("T", "x", True)]
    d = spark.createDataFrame(rows, "key string, t string, h boolean")
    got = [r[0] for r in d.select(C.question_key("key", "t", "M", ["classic"], ["other"], F.col("h"))).collect()]
    assert got == ["M", "unscored", "OUT", "unscored", "T"]


def test_nudge_and_lost(spark):
    d = spark.createDataFrame([(False, False, False, False), (True, True, False, False), (True, True, True, True), (True, False, False, False)], "u boolean, d boolean, hu boolean, hd boolean")
    assert [r[0] for r in d.select(C.nudge_class(*[F.col(c) for c in ("u", "d", "hu", "hd")])).collect()] == ["G1", "G2", "G3", "G4"]
    e = spark.createDataFrame([("A", "", "A", "A", "A"), ("A", "B", "A", "A", "B"), ("A", "B", "A", "B", "B"), ("", "B", "A", "A", "A")], "base string, pert string, key string, probe string, arg string")
    got = [(r[0], r[1]) for r in e.select(C.lost("base", "pert", "key"), C.lost_label("probe", "arg", "key")).collect()]
    assert got == [(True, "decision"), (True, "head"), (True, "representation"), (False, "decision")]


def test_field_equals_the_full_site_matrix():
    f = D.Field()
    for n in (1, 2, 3, 5):
        T = f.retention * np.eye(n + 1)
        T[0, 1:], T[1:, 0] = f.diffusion * f.retention, f.diffusion * f.feedback_weight * f.retention
        s = np.linalg.matrix_power(T, f.steps) @ np.r_[f.diffusion * n, np.ones(n)]
        assert math.isclose(f.gain(n), s[0] / n) and math.isclose(f.response(n, f.steps + 1)[1] * n, s[1:].sum())
    assert f.deletion_ratio(1) == 1.0 and 0.99 < f.deletion_ratio(3) < 1.0


def test_question_weights():
    q = D.Question({"A": ["a1", "a2"], "B": ["b1", "b2"]}, {"A": "a1", "B": "b1"}, key_boost=3, secondary_weight=0.5, class_weight={"A": 1.5, "B": 1.0})
    assert q.weights() == {"a1": 1.0, "a2": 0.75 / 4.5, "b1": 3 / 4.5, "b2": 0.5 / 4.5} and math.isclose(q.normaliser(), 1 + 0.75 / 4.5) and q.scale() == 1.5


def test_zero_total_and_panel_free_shares(spark):
    c = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 0.0)], "unit_id long, feature string, count double")
    sf = {r.unit_id: r.size_factor for r in P.size_factors(c).collect()}
    assert sf == {1: 1.0, 2: 1.0}
    v = {(r.unit_id, r.feature): r.value for r in P.log1p_cp10k(c).collect()}
    assert v[(2, "a")] == 0.0 and math.isclose(v[(1, "a")], math.log1p(7500))
    s = spark.createDataFrame([(1, "p", 5.0), (1, "q", 0.0)], "unit_id long, feature string, stored double")
    assert [r.w for r in P.panel_free_shares(s, ["p"]).collect()] == [0.0]
    with pytest.raises(ValueError):
        C.class_scores(c, {"A": []})


def test_donor_split_rules(spark):
    rows = [(i, "Site 4" if i % 5 == 0 else "s1", f"d{i % 8}") for i in range(80)]
    u = spark.createDataFrame(rows, "unit_id long, site string, group_id string")
    p = P.donor_site_split(u, ["site4"], 0.2, 7).toPandas()
    assert (p[p.site == "Site 4"].split == "test").all()
    assert p[p.split == "val"].group_id.nunique() == max(1, round(8 * 0.2))
    o = {r.group_id: r.role for r in C.donor_overlap(spark.createDataFrame(p)).collect()}
    train = set(p[p.split == "train"].group_id)
    assert all((r == "secondary") == (g in train) for g, r in o.items())


def test_eval_size_factor_refuses_overlap(spark):
    f = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "unit_id long, size_factor double")
    s = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "unit_id long, split string")
    ok = P.eval_size_factor(f, s, s.where("split = 'test'"), "train_median").collect()
    assert ok[0].size_factor == 2.0
    with pytest.raises(Exception, match="evaluated units occur"):
        P.eval_size_factor(f, s, s.where("unit_id = 1"), "train_median").collect()


def test_thinning_and_recovery(spark):
    c = spark.createDataFrame([(u, f"f{k}", float(10 * k + 1)) for u in range(40) for k in range(4)], "unit_id long, feature string, count double")
    a = D.count_split(c, 5).toPandas()
    assert (a.half_a + a.half_b == a["count"]).all() and abs(a.half_a.sum() / a["count"].sum() - 0.5) < 0.05
    b = D.count_split(c.repartition(11), 5).toPandas()
    assert a.sort_values(["unit_id", "feature"]).half_a.tolist() == b.sort_values(["unit_id", "feature"]).half_a.tolist()
    r = D.recover_counts(c.withColumn("x", F.col("count") * 0.3), "x").toPandas()
    assert (r.recovered == r["count"]).all() and r.deviation.max() < 1


def test_thinning_of_large_counts_is_binomial(spark):
    """Mean, variance and third moment for counts on both sides of the limit of single draws, and up to 2^40."""
    for count, keep, rows in ((32, 0.25, 3000), (33, 0.25, 3000), (500, 0.9, 3000), (2 ** 40, 0.3, 1500)):
        c = spark.range(rows).select(F.col("id").alias("unit_id"), F.lit("f").alias("feature"), F.lit(float(count)).alias("count"))
        x = D.thin_counts(c, keep, 7).toPandas().thinned.to_numpy(float)
        sd = (count * keep * (1 - keep)) ** 0.5
        z = (x - count * keep) / sd
        assert x.min() >= 0 and x.max() <= count and abs(z.mean()) < 4 / rows ** 0.5 and abs(z.var() - 1) < 0.12 and abs((z ** 3).mean() - (1 - 2 * keep) / sd) < 0.25
    edge = spark.createDataFrame([(1, "f", 1000.0), (2, "f", 0.0), (3, "f", None)], "unit_id long, feature string, count double")
    got = {r.unit_id: (r.a, r.b) for r in D.thin_counts(D.thin_counts(edge, 1.0, 1, "a"), 0.0, 1, "b").collect()}
    assert got == {1: (1000, 0), 2: (0, 0), 3: (0, 0)}


def test_events_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, "a1", 2.0), (1, "b1", 8.0), (2, "a1", 1.0)], "unit_id long, feature string, predicted double")
    q = spark.createDataFrame([("a1", 4.0), ("b1", 4.0)], "feature string, q double")
    e = io.export_evidence_events(p, q, {"A": ["a1"], "B": ["b1"]}, {"A": "a1", "B": "b1"}, timing="order")
    io.write_events_jsonl(e, str(tmp_path / "e"))
    back = io.read_events_jsonl(spark, str(tmp_path / "e"), spark.createDataFrame([(1,)], "unit_id long")).toPandas()
    assert sorted(back.value) == [0.5, 1.0] and sorted(back.time) == [0, 1]


def test_mtx_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(0, 1, 3.0), (2, 0, 5.0), (1, 1, 1.0)], "row long, col long, value double")
    io.write_mtx(d, str(tmp_path / "m"), 3, 2)
    assert io.mtx_header(spark, str(tmp_path / "m")) == (3, 2, 3)
    assert sorted(map(tuple, io.read_mtx_long(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, d.collect()))


def test_integrity_counts_violations(spark):
    c = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.5), (2, "a", 0.0)], "unit_id long, feature string, count double")
    t = spark.createDataFrame([(1, 4.5), (2, 1.0), (2, 0.0)], "unit_id long, total double")
    v = {r.rule: r.violations for r in io.counts_integrity(c, t, spark.createDataFrame([(5,)], "n long")).collect()}
    assert v == {"counts are positive": 1, "counts are whole": 1, "entries equal the header": 2, "one entry per unit and feature": 1, "totals equal the published ones": 1, "unit ids are unique": 1}


def test_mtx_keeps_an_entry_like_its_size_line(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 3 2\n1 1 5\n2 3 2\n")
    assert sorted(map(tuple, io.read_mtx_long(spark, str(tmp_path / "a.mtx")).collect())) == [(0, 0, 5.0), (1, 2, 2.0)]
    (tmp_path / "b.mtx").write_text("2 3 2\n1 1 5\n2 x 2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_mtx_long(spark, str(tmp_path / "b.mtx")).collect()
    (tmp_path / "c.mtx").write_text("2 3 3\n1 1 5\n2 3 2\n")
    with pytest.raises(ValueError, match="size line"):
        io.read_mtx_long(spark, str(tmp_path / "c.mtx"))


def test_mtx_keeps_fractions(spark, tmp_path):
    d = spark.createDataFrame([(0, 0, 1.7), (1, 1, 2.0)], "row long, col long, value double")
    io.write_mtx(d, str(tmp_path / "m"), 2, 2)
    assert sorted(map(tuple, io.read_mtx_long(spark, str(tmp_path / "m")).collect())) == [(0, 0, 1.7), (1, 1, 2.0)]


def test_broken_lines_are_errors(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"unit_id": 1, "feature": "x"}\n{"unit_id": 2, broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_events_jsonl(spark, str(tmp_path / "e.json")).collect()
    (tmp_path / "f.tsv").write_text("1\ta\nx\tb\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_feature_tsv(spark, str(tmp_path / "f.tsv"), "n LONG, s STRING").collect()


def test_fingerprints_tell_sets_apart(spark):
    d = lambda *ids: spark.createDataFrame([(i,) for i in ids], "i long")
    fp = lambda *ids: tuple(io.id_set_fingerprint(d(*ids), "i").first())
    assert fp(1, 1) == fp(1) != fp(2, 2) and fp() == fp()
    pair = lambda a, b: tuple(io.pair_set_fingerprint(spark.createDataFrame([(a, b)], "a long, b long"), "a", "b").first())
    assert pair(0, 1000001) != pair(1, 1) and pair(3, 4) == pair(4, 3)


def test_validation_groups_round_halves_to_even(spark):
    u = spark.createDataFrame([(i, f"g{i}", "s") for i in range(10)], "unit_id long, group_id string, site string")
    assert P.donor_site_split(u, ["t"], 0.25, 0).where("split = 'val'").count() == 2


def test_draws_reach_every_slot(spark):
    from strataspark.functions.draws import slot
    x = spark.range(4000).select(slot(10 ** 12, "s", "id").alias("k")).toPandas().k
    assert x.min() >= 1 and x.max() <= 10 ** 12 and (x % 4096).nunique() > 2000


def test_vocabulary_versions_are_declared(spark):
    f = spark.createDataFrame([("a.1",), ("b",)], "feature string")
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r.feature, r.id, r.n_as_is, r.n_stripped) for r in C.map_to_vocab(f, v, False, 1).collect()} == {("b", "b", 1, 2)}
    assert {(r.feature, r.id) for r in C.map_to_vocab(f, v, True, 1).collect()} == {("a.1", "a"), ("b", "b")}
    with pytest.raises(Exception, match="too few features"):
        C.map_to_vocab(f, v, False, 2).collect()


def test_binomial_items_are_compared_as_text_exactly(spark):
    """A key lies below the text of p just when its uniform lies below p, also at the ends."""
    from pyspark.sql import functions as F
    from strataspark.functions import draws
    p = [0.0, -1.0, 2.0 ** -52, 2.0 ** -53, 0.25, 0.3, 0.5, 1 - 2.0 ** -52, 1 - 2.0 ** -53, 1.0, 1.5]
    d = spark.createDataFrame([(x,) for x in p], "p double").crossJoin(spark.range(300).withColumn("key", F.md5(F.col("id").cast("string"))))
    ends = spark.createDataFrame([(x, k, k * 32) for x in p for k in "0f8"], "p double, id string, key string").selectExpr("p", "0L AS id", "repeat(id, 32) AS key")
    d = d.unionByName(ends)
    assert d.where((F.col("key") < draws._edge(F.col("p"))) != (draws._number(F.col("key")) < F.col("p"))).count() == 0

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataspark.operators import ranking as R, selection as S


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def frame(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    # a third of all rows in one group, half of all values tied
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n))
    v = np.where(rng.random(n) < 0.5, 0.25, np.round(rng.normal(size=n), 3))
    p = pd.DataFrame({"unit_id": np.arange(n), "g": g, "v": v, "w": rng.integers(0, 4, n)})
    return p, spark.createDataFrame(p).repartition(7)


def test_value_rank_and_sums_equal_a_plain_sort(spark):
    p, d = frame(spark)
    got = R.value_rank(d, ["g"], "v", 3, ["unit_id"], sums={"cum": "w"}, n_edges=15).toPandas()
    p["h"] = [md5(3, u) for u in p.unit_id]
    p = p.sort_values(["g", "v", "h"], ascending=[True, False, True])
    p["e"], p["c"] = p.groupby("g").cumcount() + 1, p.groupby("g").w.cumsum()
    m = got.merge(p[["unit_id", "e", "c"]], on="unit_id")
    assert (m["rank"] == m.e).all() and (m["cum"] == m.c).all()


def test_missing_scores_rank_last_in_both_directions(spark):
    d = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 0.9)], "unit_id long, v double")
    down = {r.unit_id: r["rank"] for r in R.value_rank(d, [], "v", 0, ["unit_id"]).collect()}
    up = {r.unit_id: r["rank"] for r in R.value_rank(d, [], "v", 0, ["unit_id"], descending=False).collect()}
    assert down[4] == 1 and down[1] == 2 and {down[2], down[3]} == {3, 4}
    assert up[1] == 1 and up[4] == 2 and {up[2], up[3]} == {3, 4}


def test_hash_rank_is_dense_and_does_not_depend_on_partitions(spark):
    p, d = frame(spark)
    a = R.hash_rank(d, ["g"], 1, ["unit_id"]).select("unit_id", "g", "rank").toPandas().sort_values("unit_id")
    b = R.hash_rank(d.repartition(2), ["g"], 1, ["unit_id"]).select("unit_id", "g", "rank").toPandas().sort_values("unit_id")
    assert (a["rank"].values == b["rank"].values).all()
    for _, g in a.groupby("g"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
    top = R.top_n_by_hash(d, ["g"], 1, ["unit_id"], 5).select("unit_id").toPandas().unit_id
    assert set(top) == set(a[a["rank"] <= 5].unit_id)


def test_running_sum_over_many_blocks(spark):
    p, d = frame(spark)
    r = R.value_rank(d, ["g"], "v", 3, ["unit_id"])
    got = R.running_sum(r, ["g"], "rank", {"cum": "w"}, block=50).toPandas().sort_values(["g", "rank"])
    assert (got.groupby("g").w.cumsum() == got["cum"]).all()


def test_percentiles_are_exact_with_narrow_brackets(spark):
    p, d = frame(spark, 20000)
    q = {"a": 0.05, "m": 0.5, "z": 0.95}
    got = R.group_percentile(d, ["g"], "v", q, accuracy=100).toPandas().set_index("g")      # groups are longer than 10 * accuracy
    want = p.groupby("g").v.quantile(list(q.values())).unstack()
    assert np.allclose(got.loc[want.index].values, want.values)


def test_weighted_quantile_equals_materialised_copies(spark):
    p, d = frame(spark, 800)
    r = R.value_rank(d, ["g"], "v", 0, ["unit_id"], descending=False)
    got = R.weighted_quantile(r, ["g"], "rank", "v", "w", 0.5, block=40).toPandas().set_index("g").q
    for g, x in p.groupby("g"):
        assert np.isclose(got[g], np.median(np.repeat(x.v, x.w)))


def test_weighted_select_equals_selection_on_copies(spark):
    p, d = frame(spark, 600)
    p["h"] = [md5(9, u) for u in p.unit_id]
    p["ok"] = (p.unit_id % 3 == 0).astype(int)
    d = d.withColumn("ok", (F.col("unit_id") % 3 == 0).cast("int")).withColumn("one", F.lit(1))
    r = R.value_rank(d, [], "v", 9, ["unit_id"])
    got = S.weighted_selective_accuracy(r.withColumn("b", F.lit(0)), ["b"], "rank", "w", "ok", "one", [0.2, 0.55]).toPandas().set_index("coverage")
    o = p.sort_values(["v", "h"], ascending=[False, True])
    copies = np.repeat(o.ok.values, o.w.values)
    for c in (0.2, 0.55):
        k = int(np.ceil(c * len(copies) - 1e-9))
        assert np.isclose(got.loc[c].accuracy, copies[:k].mean())


def test_selective_accuracy_at_and_aurc(spark):
    rows = [(i, "m", 1 - i / 10, i in (0, 1, 2, 5)) for i in range(10)]
    d = spark.createDataFrame(rows, "unit_id long, g string, conf double, ok boolean")
    c = S.selective_accuracy_at(d, ["g"], "conf", F.col("ok"), F.lit(True), [0.2, 0.5, 1.0], 0)
    got = {r.coverage: r.accuracy for r in c.collect()}
    assert got == {0.2: 1.0, 0.5: 0.6, 1.0: 0.4}
    a = S.aurc(c, ["g"]).first().aurc
    assert np.isclose(a, (0.5 * (1 + 0.6) * 0.3 + 0.5 * (0.6 + 0.4) * 0.5) / 0.8)


def test_usable_folds(spark):
    rows = [(i, f"t{i % 2}", 1) for i in range(20)] + [(100 + i, f"c{i}", 0) for i in range(50)]
    d = spark.createDataFrame(rows, "unit_id long, cl string, a int")
    assert S.usable_folds(d, "cl", "a", 2, 0, 30).first().fold_seed is not None
    one = d.where("a = 0 or cl = 't0'")
    assert S.usable_folds(one, "cl", "a", 2, 0, 6).first().fold_seed is None


def test_percentiles_agree_on_both_sides_of_the_short_group_border(spark):
    rng = np.random.default_rng(7)
    for n in (999, 1000, 1001, 1500):                       # a group of up to 10 * accuracy rows is ordered whole
        v = rng.normal(size=n)
        d = spark.createDataFrame(pd.DataFrame({"g": "a", "v": v})).repartition(5)
        got = R.group_percentile(d, ["g"], "v", {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.95, "hi": 1.0}, accuracy=100).first()
        assert np.allclose([got.lo, got.a, got.m, got.b, got.hi], np.quantile(v, [0, 0.05, 0.5, 0.95, 1]))
        assert np.isclose(R.group_percentile(d, [], "v", {"m": 0.5}, accuracy=100).first().m, np.median(v))


def test_nested_draws_and_the_whole_pool(spark):
    d = spark.range(300).select(F.col("id").alias("unit_id"))
    got = S.nested_draw(d, [5, 40, "all"], 9).toPandas().groupby("size").unit_id.apply(set)
    order = sorted(range(300), key=lambda u: md5(9, u))
    assert got[5] == set(order[:5]) and got[40] == set(order[:40]) and got[300] == set(range(300))


def test_brackets_with_many_values_are_refined(spark, monkeypatch):
    """Geometric values over 600 orders of magnitude, infinities, ties and few different values, in brackets that are cut
    down to a handful of values by histograms."""
    monkeypatch.setattr(R, "CELLS", 8)
    rng = np.random.default_rng(4)
    cases = {"wide": 10.0 ** rng.uniform(-300, 300, 4000) * rng.choice([-1, 1], 4000), "ties": np.round(rng.normal(size=4000), 1), "one": np.full(900, 2.5), "short": rng.normal(size=5),
             "ends": np.r_[rng.normal(size=3000), np.full(40, np.inf), np.full(40, -np.inf)], "two": np.repeat([1.0, 5.0], 300)}
    p = pd.DataFrame([(g, float(x)) for g, v in cases.items() for x in v], columns=["g", "v"])
    probs = {"a": 0.0, "b": 0.05, "m": 0.5, "d": 0.973, "e": 1.0}
    got = R.group_percentile(spark.createDataFrame(p).repartition(5), ["g"], "v", probs, accuracy=100).toPandas().set_index("g")
    for g, v in cases.items():
        v = np.sort(v)
        for n, q in probs.items():
            h = (len(v) - 1) * q
            k, t = int(h), h - int(h)
            want = v[k] if t == 0 or v[k] == v[k + 1] else v[k] + (v[k + 1] - v[k]) * t
            assert got.loc[g, n] == want or np.isclose(got.loc[g, n], want, rtol=1e-12), (g, n)

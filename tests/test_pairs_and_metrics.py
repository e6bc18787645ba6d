import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataspark.operators import joins as J, metrics as M, pairs as K

import pytest


def vectors(spark, n=150, d=6, seed=1):
    rng = np.random.default_rng(seed)
    Z = rng.normal(size=(n, d))
    Z[7] = Z[3]                                              # equal vectors
    g = np.where(np.arange(n) < 90, "hot", np.where(np.arange(n) < 149, "b", "single"))
    p = pd.DataFrame({"unit_id": np.arange(n), "group_id": g, "z": list(Z)})
    return p, Z, spark.createDataFrame(p)


def brute(Z, q, r, k, self_out):
    U = Z / (np.linalg.norm(Z, axis=1, keepdims=True) + 1e-8)
    S = np.round(U[q] @ U[r].T, 9)
    out = {}
    for a, i in enumerate(q):
        c = sorted(((-S[a, b], j) for b, j in enumerate(r) if not (self_out and j == i)))[:k]
        out[int(i)] = [int(j) for _, j in c]
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbours_equal_brute_force_for_any_block_size(spark, block):
    p, Z, d = vectors(spark)
    got = K.knn_within_group(d, "group_id", 5, block=block).toPandas().sort_values(["i", "rank"]).groupby("i").j.apply(list).to_dict()
    want = {}
    for _, x in p.groupby("group_id"):
        want.update({i: v for i, v in brute(Z, x.unit_id.values, x.unit_id.values, 5, True).items() if v})
    assert got == want


def test_cross_neighbours_and_regression(spark):
    p, Z, d = vectors(spark)
    p["y"] = Z[:, 0]
    d = spark.createDataFrame(p)
    tr, va, te = d.where("unit_id % 3 = 0"), d.where("unit_id % 3 = 1"), d.where("unit_id % 3 = 2")
    got = K.knn_regression(tr, va, te, "y", [1, 4, 8]).toPandas().set_index("unit_id")
    ids = p.unit_id.values
    nv, nt = (brute(Z, ids[ids % 3 == m], ids[ids % 3 == 0], 8, False) for m in (1, 2))
    mse = {k: np.mean([(np.mean([p.y[j] for j in nv[i][:k]]) - p.y[i]) ** 2 for i in nv]) for k in (1, 4, 8)}
    k = min(mse, key=mse.get)
    assert (got.k == k).all() and np.allclose([got.pred[i] for i in nt], [np.mean([p.y[j] for j in nt[i][:k]]) for i in nt])


def test_edges_are_unordered_and_pairs_oriented(spark):
    nn = spark.createDataFrame([(1, 2, 0.9, 1), (2, 1, 0.9, 1), (3, 1, 0.5, 1)], "i long, j long, sim double, rank int")
    e = K.undirected_edges(nn)
    assert sorted((r.lo, r.hi) for r in e.collect()) == [(1, 2), (1, 3)]
    rows = spark.createDataFrame([(1, "T"), (2, "NK"), (3, "T")], "unit_id long, key string")
    c = K.cross_class_pairs(e, rows, "key", "NK", "T", 0.8).collect()
    assert [(r.x, r.y, r.flagged) for r in c] == [(2, 1, True)]


def test_auroc_with_ties_and_weights(spark):
    rng = np.random.default_rng(0)
    s, y, w = rng.integers(0, 6, 200), rng.integers(0, 2, 200), rng.integers(1, 4, 200)
    d = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(s, y, w)], "s int, y int, w int")
    got = M.auroc(d, [], "s", "y", "w").first().auroc
    P, N = np.repeat(s[y == 1], w[y == 1]), np.repeat(s[y == 0], w[y == 0])
    want = np.mean((P[:, None] > N[None, :]) + 0.5 * (P[:, None] == N[None, :]))
    assert np.isclose(got, want)
    assert M.auroc(d.where("y = 1"), [], "s", "y").first().auroc is None


def test_kappa_and_report(spark):
    d = spark.createDataFrame([("A", "A", "g"), ("A", "B", "g"), ("B", "B", "h"), ("B", "B", "h")], "a string, b string, g string")
    r = M.cohen_kappa(d, [], "a", "b", ["A", "B"]).first()
    assert np.isclose(r.kappa, (0.75 - 0.5) / 0.5)
    rep = {(x.scope, x.cls): x for x in M.agreement_report(d, "a", "b", ["A", "B"], "g", 0.6).collect()}
    assert rep[("*", "A")].recall == 0.5 and rep[("*", "A")].precision == 1.0 and rep[("*", "B")].decision == "annotation key" and rep[("h", "A")].recall is None
    same = spark.createDataFrame([("A", "A")], "a string, b string")
    assert M.cohen_kappa(same, [], "a", "b", ["A", "B"]).first().kappa is None


def test_gap_ratio_undefined_when_a_measured_gap_is_zero(spark):
    g = spark.createDataFrame([("x", "f1", 1.0, 2.0), ("x", "f2", 1.0, 0.0), ("y", "f1", 1.0, 2.0), ("y", "f2", 3.0, 4.0)], "r string, feature string, d_pred double, d_meas double")
    got = {x.r: x.gap_ratio for x in M.gap_ratio(g, ["r"], ["f1", "f2"]).collect()}
    assert got == {"x": None, "y": 0.625}


def test_spearman(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (3.0, 9.0), (3.0, 4.0), (None, 1.0)]
    d = spark.createDataFrame(rows, "a double, b double")
    p = pd.DataFrame(rows[:4], columns=["a", "b"]).rank().corr().iloc[0, 1]
    r = M.rank_correlation(d, "a", "b").first()
    assert r.n == 4 and np.isclose(r.rho, p)
    assert M.rank_correlation(d.limit(2), "a", "b").first().rho is None


def test_states_must_be_complete(spark):
    u = spark.createDataFrame([(1,), (2,)], "unit_id long")
    s = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "unit_id long, pos int, z double")
    assert J.missing_states(u, s).first().unit_id == 2
    assert J.join_states_by_id(u.where("unit_id = 1"), s, "pos").first().z == 6.0
    with pytest.raises(Exception, match="no state for unit"):
        J.join_states_by_id(u, s, "pos").collect()


def test_symbols_and_clashes(spark):
    f = spark.createDataFrame([(1, "X", "i1"), (2, "X", "i2"), (3, "Y", "i3")], "line int, s string, id string")
    got = {r.alias: r.id for r in J.symbol_to_id_unique(f, "s", "id", "line").collect()}
    assert got == {"X": "i1", "X.1": "i2", "X-1": "i2", "Y": "i3"}
    bad = f.union(spark.createDataFrame([(4, "X.1", "i4")], "line int, s string, id string"))
    with pytest.raises(Exception, match="name clash"):
        J.symbol_to_id_unique(bad, "s", "id", "line").collect()
    with pytest.raises(ValueError):
        J.harmonise_features(f, {"a": ["x"], "b": ["x"]}, f)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_ball_search_with_copies_zeros_and_clusters(spark, metric):
    rng = np.random.default_rng(1)
    n = 420
    Z = (rng.normal(size=(8, 5)) * 3)[rng.integers(0, 8, n)] + rng.normal(size=(n, 5)) * 0.2
    Z[100:240], Z[250:253] = Z[100], 0                        # a third of all rows equal; rows without a direction
    g = np.where(np.arange(n) < 300, "hot", np.where(np.arange(n) < 419, "b", "single"))
    d = spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(n), "group_id": g, "z": list(Z)})).repartition(4)
    ids = np.arange(n)
    q, r = ids[ids % 3 == 0], ids[ids % 3 != 0]
    U = Z / (np.linalg.norm(Z, axis=1, keepdims=True) + 1e-8) if metric == "cosine" else Z

    def want(i, pool):
        pool = [j for j in pool if g[j] == g[i] and j != i]
        s = U[pool] @ U[i] if metric == "cosine" else -((U[pool] - U[i]) ** 2).sum(1)
        return [j for _, j in sorted(zip(-np.round(s, 9), pool))[:5]]
    got = K.nearest(d, d, ["group_id"], 5, exclude_self=True, metric=metric, block=16).toPandas().sort_values(["i", "rank"]).groupby("i").j.apply(list).to_dict()
    assert got == {int(i): want(i, ids) for i in ids if want(i, ids)}
    cross = K.nearest(d.where("unit_id % 3 = 0"), d.where("unit_id % 3 <> 0"), ["group_id"], 5, metric=metric, block=16).toPandas().sort_values(["i", "rank"]).groupby("i").j.apply(list).to_dict()
    assert cross == {int(i): want(i, r) for i in q if want(i, r)}


def test_ball_search_skips_block_pairs(spark):
    rng = np.random.default_rng(2)
    Z = (rng.normal(size=(12, 6)) * 4)[np.arange(600) % 12] + rng.normal(size=(600, 6)) * 0.1
    d = spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(600), "z": list(Z)}))
    r = K.block_pairs(d, d, [], 5, exclude_self=True, metric="euclidean", block=32).first()
    assert r.n_searched < r.n_pairs and r.share_skipped > 0.5


def test_packs_and_stretches_of_any_size_give_the_same_neighbours(spark, monkeypatch):
    from strataspark.operators import balls
    monkeypatch.setattr(balls, "PACK", 40)
    monkeypatch.setattr(balls, "STRETCH", 50)
    monkeypatch.setattr(balls, "BALLS", 3)
    p, Z, d = vectors(spark, n=400)
    d = d.withColumn("group_id", F.lit("one"))
    ids = p.unit_id.values
    got = K.knn_within_group(d, "group_id", 5, block=16).toPandas().sort_values(["i", "rank"]).groupby("i").j.apply(list).to_dict()
    assert got == brute(Z, ids, ids, 5, True)


def test_block_pairs_are_counted_without_a_search(spark, monkeypatch):
    """Only the home blocks are compared; no row is sent to another block for a count."""
    from strataspark.operators import balls
    kept = []
    real = balls.checkpointed

    def cut(df):
        kept.append(set(df.columns))
        return real(df)
    monkeypatch.setattr(balls, "checkpointed", cut)
    p, Z, d = vectors(spark, n=300)
    r = K.block_pairs(d, d, [], 5, exclude_self=True, block=16).first()
    assert 0 < r.n_searched <= r.n_pairs
    assert not [c for c in kept if {"u", "home"} <= c]


def test_regression_searches_once(spark, monkeypatch):
    """Validation and test rows share one search; a row of both tables is in both results."""
    searches = []
    real = K.nearest
    monkeypatch.setattr(K, "nearest", lambda *a, **k: searches.append(1) or real(*a, **k))
    p, Z, d = vectors(spark, n=60)
    d = spark.createDataFrame(p.assign(y=Z[:, 0]))
    got = K.knn_regression(d.where("unit_id % 3 = 0"), d.where("unit_id % 3 = 1"), d.where("unit_id % 3 > 0"), "y", [1, 4]).collect()
    assert len(searches) == 1 and sorted(r.unit_id for r in got) == [i for i in range(60) if i % 3]


def test_neighbouring_blocks_of_queries_share_a_pack(spark, monkeypatch):
    """Reference rows are sent once to each pack: a pack for each block would send them as often as there are blocks."""
    from strataspark.operators import balls
    monkeypatch.setattr(balls, "PACK", 100)
    p, Z, d = vectors(spark, n=400)
    q, r, g = K._sides(d, d, [], "z", "cosine", 1e-8)
    s = balls._Search(q, r, g, 6, "cosine", 16, True)
    packs = s.asking.groupBy("pack", "run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()
    n, blocks = sum(x.n for x in packs), sum(x.blocks for x in packs)
    assert blocks > 12 and len(packs) <= 2 * n / 100 + 1, (n, blocks, len(packs))


def test_the_panel_is_made_once_for_must_pairs(spark, monkeypatch):
    """Gates and panels of the pairs came from two panels, one of them stored."""
    import os
    from strataspark.plans import bindings, pair_queries
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")

    def refuse(df):
        raise AssertionError("a second panel")
    monkeypatch.setattr(bindings, "checkpointed", refuse)
    d = pair_queries.must_rows(bindings.Inputs(spark, sf))
    assert d.columns == ["unit_id", "lineage", "key_cls", "coarse", "m"] and d.count() > 0


def test_gap_draws_keep_a_pair_one_row(spark, monkeypatch):
    """A row for each pair, part type, readout, side of the ratio and draw did not fit the disk at large sizes."""
    import os
    from strataspark.operators import resample
    from strataspark.plans import catalogue
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")

    def refuse(*a, **k):
        raise AssertionError("long form")
    for f in ("drawn_medians", "multiplicities", "value_rank"):
        monkeypatch.setattr(resample, f, refuse)
    assert catalogue.QUERIES["gap_inference"](spark, sf).count() == 5

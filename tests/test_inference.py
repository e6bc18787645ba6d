import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.operators import audit as A, fit as X, ledger as L, resample as R, scope as SC, selection as S
from strataspark.operators import fit as FIT
from strataspark.session import checkpointed


# ---- draws
def test_two_stage_draws_have_the_sizes_of_their_groups(spark):
    p = pd.DataFrame({"unit_id": np.arange(60), "g": np.where(np.arange(60) < 40, "hot", np.where(np.arange(60) < 59, "b", "single"))})
    d = spark.createDataFrame(p)
    w = R.bootstrap_two_stage(d, "g", 12, 3).toPandas().merge(p, on="unit_id")
    n = p.groupby("g").size()
    for _, x in w.groupby("draw"):
        t = x.groupby("g").w.sum()
        assert all(t[g] % n[g] == 0 for g in t.index) and sum(t[g] // n[g] for g in t.index) == len(n)
    again = R.bootstrap_two_stage(d.repartition(5), "g", 12, 3).toPandas()
    assert w[["draw", "unit_id", "w"]].sort_values(["draw", "unit_id"]).values.tolist() == again[["draw", "unit_id", "w"]].sort_values(["draw", "unit_id"]).values.tolist()


def test_drawn_medians_equal_materialised_replicates(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"unit_id": np.arange(80), "g": rng.choice(list("ab"), 80), "v": np.round(rng.normal(size=80), 2), "layer": "x"})
    d = spark.createDataFrame(p)
    dr = checkpointed(R.with_point(R.bootstrap_two_stage(d, "g", 5, 1), d))
    got = R.drawn_medians(d, dr, ["layer"], "v").toPandas().set_index("draw")["median"]
    w = dr.toPandas().merge(p, on="unit_id")
    for b, x in w.groupby("draw"):
        assert np.isclose(got[b], np.median(np.repeat(x.v, x.w)))
    assert np.isclose(got[0], p.v.median())


def test_win_rule_edges(spark):
    rows = [(0.02, 0.001, 0.05, [0.01, 0.02]), (0.02, 0.0, 0.05, [0.01, 0.02]), (0.02, 0.001, 0.05, [0.009, 0.02]), (-0.03, -0.05, -0.01, [-0.02, -0.01]), (0.001, -0.019, 0.019, [0.0]), (None, 0.0, 0.0, [0.0]), (0.02, 0.001, 0.05, [0.01, None])]
    d = spark.createDataFrame(rows, "point double, lo double, hi double, per_group array<double>")
    assert [r[0] for r in d.select(R.win_rule(0.02)).collect()] == ["win", "inconclusive", "inconclusive", "loss", "equivalent", "inconclusive", "inconclusive"]


# ---- fits
def rows_of(spark, n=400, d=3, seed=0):
    rng = np.random.default_rng(seed)
    V = rng.normal(size=(n, d)) * [1, 2, 0.5]
    Y = np.c_[V @ [1, -1, 2] + rng.normal(size=n), V @ [0, 1, 1] + 3]
    p = pd.DataFrame({"unit_id": np.arange(n), "x": list(V), "y1": Y[:, 0], "y2": Y[:, 1], "fold": np.arange(n) % 4, "group_id": [f"d{k % 6}" for k in range(n)]})
    return p, V, Y, spark.createDataFrame(p)


def ridge(V, Y, a):
    m, c = V.mean(0), Y.mean(0)
    W = np.linalg.solve((V - m).T @ (V - m) + a * np.eye(V.shape[1]), (V - m).T @ (Y - c))
    return c - m @ W, W


def test_ridge_from_cross_products(spark):
    p, V, Y, d = rows_of(spark)
    c = X.ridge_solve(X.gram_table(d, [], "x", ["y1", "y2"]), [], 3, [0.0, 5.0]).toPandas()
    for a in (0.0, 5.0):
        b0, W = ridge(V, Y, a)
        for j in (0, 1):
            r = c[(c.alpha == a) & (c.target == j)].iloc[0]
            assert np.isclose(r.intercept, b0[j]) and np.allclose(r.coef, W[:, j])


def test_leave_fold_out_predictions_never_see_their_fold(spark):
    p, V, Y, d = rows_of(spark)
    got = X.crossfit(d, "y1", 4, {"regressor": "gram_ridge", "classifier": "gram_ridge", "alpha": 2.0}, "m").toPandas().set_index("unit_id").pred
    for f in range(4):
        tr = (p.fold != f).values
        b0, W = ridge(V[tr], Y[tr][:, :1], 2.0)
        assert np.allclose(got[p.unit_id[~tr]].values, (b0 + V[~tr] @ W)[:, 0])


def test_leave_one_out_penalty_equals_brute_force(spark):
    p, V, Y, d = rows_of(spark, 60)
    g = X.gram_table(d, ["fold"], "x", ["y1"])
    al = [0.1, 10.0, 200.0]
    got = {r.fold: r.alpha for r in X.ridge_loo_alpha(d, g, "fold", "x", "y1", 3, al).collect()}
    for f in range(4):
        tr = np.where((p.fold != f).values)[0]
        sse = []
        for a in al:
            e = 0.0
            for i in tr:
                k = tr[tr != i]
                # the fold's centring is kept, as in the closed form
                m, c = V[tr].mean(0), Y[tr, 0].mean()
                Vc, yc = V[tr] - m, Y[tr, 0] - c
                H = np.full((len(tr), len(tr)), 1 / len(tr)) + Vc @ np.linalg.solve(Vc.T @ Vc + a * np.eye(3), Vc.T)
                j = np.where(tr == i)[0][0]
                e += ((Y[i, 0] - (H @ Y[tr, 0])[j]) / (1 - H[j, j])) ** 2
            sse.append(e)
        assert got[f] == al[int(np.argmin(sse))]


def test_donor_fits_leave_the_donor_out(spark):
    p, V, Y, d = rows_of(spark)
    d = d.withColumn("site", F.when(F.col("group_id").isin("d0", "d1"), "s0").otherwise("s1")).withColumn("study", F.when(F.col("group_id").isin("d4", "d5"), "b").otherwise("a"))
    got = SC.donor_transfer_fits(d, "x", ["y1"], 3, [0.0], "a", 3, 0).toPandas()
    g = p.group_id.values
    sets = {"T": lambda t: np.isin(g, ["d0", "d1", "d2", "d3"]) & (g != t)}
    for t in ("d0", "d3", "d5"):
        b0, W = ridge(V[sets["T"](t)], Y[sets["T"](t)][:, :1], 0.0)
        x = got[(got.fit == "T") & got.unit_id.isin(p.unit_id[g == t])].set_index("unit_id").pred
        assert np.allclose(x[p.unit_id[g == t]].values, (b0 + V[g == t] @ W)[:, 0])
    # two donors at the other site and one other donor of study b are too few for a fit
    done = got[got.status == "fitted"]
    assert set(done.fit) == {"T", "L", "C"} and set(p.group_id[done[done.fit == "L"].unit_id]) == {"d0", "d1", "d2", "d3"}
    assert len(got) == 4 * len(p) and got[got.status != "fitted"].pred.isna().all()


def test_rows_without_a_donor_stay_without_a_fit(spark):
    p, V, Y, d = rows_of(spark)
    d = d.withColumn("site", F.lit("s0")).withColumn("study", F.lit("a")).withColumn("group_id", F.when(F.col("unit_id") != 3, F.col("group_id")))
    got = SC.donor_transfer_fits(d, "x", ["y1", "y2"], 3, [0.0], "a", 3, 0).toPandas()
    assert len(got) == 8 * len(p) and got[got.unit_id == 3].pred.isna().all() and not got[(got.unit_id != 3) & (got.fit != "S")].pred.isna().any()


def test_row_weights_are_the_draws(spark):
    d = spark.range(150).select(F.col("id").cast("string").alias("unit_id"), F.lit(1).alias("a"))
    want = {(r.unit_id, r.draw): r.w for r in R.bootstrap_rows(d, ["a"], 4, 9).collect()}
    got = {(r.unit_id, k + 1): w for r in R.row_weights(d.select("unit_id"), 4, 9, {"a": F.lit(1)}).collect() for k, w in enumerate(r.ws)}
    assert {k: w for k, w in got.items() if w} == want and sum(want.values()) == 4 * 150


def test_gains_by_row_equal_those_of_the_long_form(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(5, 1, (300, 2))
    out = np.concatenate([y + rng.normal(size=(300, 2)), y + 0.3 * rng.normal(size=(300, 2))], axis=1)
    preds = [[None if i % 7 == 0 and j > 1 else float(x) for j, x in enumerate(r)] for i, r in enumerate(out)]
    d = spark.createDataFrame([(i, float(a), float(b), q) for i, ((a, b), q) in enumerate(zip(y, preds))], "unit_id long, y1 double, y2 double, preds array<double>")
    k = d.select("unit_id", F.posexplode("preds").alias("k", "pred")).where("pred is not null")
    long = k.select(F.when(F.col("k") < 2, "old").otherwise("new").alias("arm"), "unit_id", (F.col("k") % 2).alias("target"), "pred")
    want = SC.arms_gain(long, d, ["y1", "y2"], "old", 6, 3, 0.05).toPandas().set_index("arm").sort_index()
    got = SC.arms_gain_by_row(d, ["y1", "y2"], ["old", "new"], "preds", "old", 6, 3, 0.05).toPandas().set_index("arm").sort_index()
    assert list(got.index) == ["new", "old"] and np.allclose(got[want.columns], want) and got.gain["new"] > 0.1


def test_mixture_threshold_close_to_the_truth(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1, 0.3, 700), rng.normal(4, 0.5, 300), np.zeros(50)]
    d = spark.createDataFrame([("a", float(v)) for v in np.round(x, 2)], "g string, v double")
    r = X.threshold_gmm(d, ["g"], "v").first()
    assert abs(r.ml - 1) < 0.1 and abs(r.mu - 4) < 0.15 and 1.8 < r.threshold < 3.0 and abs(r.background_mu3sd - 1.9) < 0.3


def test_too_few_rows_refused(spark):
    p, V, Y, d = rows_of(spark, 20)
    with pytest.raises(Exception, match="rows left to fit on"):
        X.ridge_solve(X.gram_table(d, [], "x", ["y1"]), [], 3, [1.0], min_rows=50).collect()


# ---- planted chain: the loss must be found at the planted stage
def planted(spark, lose: bool, effect: float = 1.0, seed: int = 0):
    rng = np.random.default_rng(seed)
    nt, nc, d = 12 * 30, 500, 4
    a = np.r_[np.ones(nt), np.zeros(nc)].astype(int)
    V = rng.normal(size=(nt + nc, d))
    V[:, 0] += effect * a
    y = V[:, 0] * 2 + 0.3 * V[:, 1] + 0.2 * rng.normal(size=len(a))
    keep = V @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    final = V[:, 1:] if lose else keep * 2
    cl = [f"t{i % 12}" if i < nt else f"unit:{i}" for i in range(len(a))]
    p = pd.DataFrame({"unit_id": np.arange(len(a)), "a": a, "y": y, "cluster": cl, "input": list(V), "keep": list(keep), "final": list(final)})
    return spark.createDataFrame(p)


def audit(spark, d, stages=("input", "keep", "final"), b=40):
    rows = checkpointed(S.fold_by_cluster(d, "cluster", 4, 0))
    views = {s: d.select("unit_id", F.col(s).alias("x")) for s in stages}
    res = checkpointed(A.crossfit_residuals(rows, views, 4, {"ridge": {"regressor": "gram_ridge", "classifier": "gram_ridge", "alpha": 1.0}}))
    u = checkpointed(A.unexplained_fraction(rows, res, checkpointed(R.bootstrap_cluster(rows, "a", "cluster", b, 1))))
    pos = F.create_map(*[v for k, s in enumerate(stages) for v in (F.lit(s), F.lit(k))])
    q = u.withColumn("run", F.lit("r")).withColumn("stage", F.col("state"))
    v = A.reread_verdicts(q, ["run", "stage"], 0.25, 0.05).withColumn("pos", pos[F.col("stage")])
    dl = u.select("draw", "delta").distinct().where("draw > 0").agg(F.percentile("delta", F.lit(0.025)).alias("delta_lo"), F.percentile("delta", F.lit(0.975)).alias("delta_hi"))
    runs = dl.select(F.lit("r").alias("run"), "delta_lo", "delta_hi", F.lit(None).cast("string").alias("control"))
    steps = S.step_difference(q.select("run", "stage", "draw", F.col("u").alias("value"), pos[F.col("stage")].alias("pos")), ["run"], 0.05)
    steps = steps.select("run", pos[F.col("to_stage")].alias("pos"), "from_stage", "to_stage", "lo")
    return A.localise_loss(runs, v, steps, ["run"], 0.1).first()


def test_planted_loss_is_located(spark):
    r = audit(spark, planted(spark, lose=True))
    assert (r.cause, r.from_stage, r.to_stage) == ("loss_at", "keep", "final")


def test_no_loss_and_no_effect(spark):
    assert audit(spark, planted(spark, lose=False)).cause == "no_deficit"
    assert audit(spark, planted(spark, lose=True, effect=0.0, seed=3)).cause == "no_effect"


def test_unknown_view_fails(spark):
    with pytest.raises(ValueError, match="unknown operation"):
        A.resolve({}, "nothing:1", None)


# ---- planted scopes: what is missing must be named
def scope_case(spark, kind, seed=0):
    rng = np.random.default_rng(seed)
    blocks = ["ev"] * 200 + [f"b{k % 3}" for k in range(450)]
    n = len(blocks)
    Xv = rng.normal(size=(n, 3))
    a = np.array([b == "ev" for b in blocks]).astype(int)
    Xv[:, 0] += 1.5 * a
    y = 2 * Xv[:, 0] + 0.2 * rng.normal(size=n)
    z = Xv.copy()
    if kind == "unreadable":
        y = 2 * a * 1.5 + rng.normal(size=n)
        z = rng.normal(size=(n, 3))
    T = rng.normal(size=(800, 3))
    ty = 2 * T[:, 0] + 0.2 * rng.normal(size=800) if kind != "coverage" else rng.normal(size=800)
    frozen = 2 * z[:, 0] if kind == "none" else rng.normal(size=n)
    st = pd.DataFrame({"unit_id": np.arange(n), "block": blocks, "a": a, "y": y, "z": list(z), "fz": frozen})
    tr = pd.DataFrame({"unit_id": np.arange(800), "y": ty, "z": list(T)})
    s, t = spark.createDataFrame(st), spark.createDataFrame(tr)
    pred = SC.scope_predict(s, ["z"], ["y"], ["frozen", "train", "units", "own"], train=t, frozen=["fz"], event="ev", seed=0)
    m = checkpointed(SC.moment_sums(pred, s, ["y"], ["scope", "stage"]))
    u = SC.u_shift(SC.drawn_moments(m, checkpointed(SC.element_draws(m, 40, 1)), ["scope", "stage"]), ["scope", "stage"])
    v = SC.scope_verdicts(u.withColumn("event", F.lit("e")).withColumn("cls", F.lit("ridge")).drop("slope"), ["event"], 0.2, 0.05, True)
    return SC.scope_reading(v, ["event"], "z", None).first().missing


@pytest.mark.parametrize("kind", ["none", "function", "coverage", "unreadable"])
def test_planted_scope_is_named(spark, kind):
    assert scope_case(spark, kind) == kind


# ---- ledgers
def test_hypothesis_outcomes(spark):
    h = spark.createDataFrame([(x, "own", 0.2, {"c": 0.05}) for x in "abcde"], "id string, own string, at_least double, controls map<string,double>")
    arms = [("a", "own", 0.2, 0.4, True), ("a", "c", -0.1, 0.05, True), ("b", "own", 0.0, 0.19, True), ("b", "c", 0.0, 0.01, True), ("c", "own", 0.1, 0.3, True), ("c", "c", 0.0, 0.01, True),
            ("d", "own", 0.3, 0.4, False), ("d", "c", 0.0, 0.01, True), ("e", "own", 0.3, 0.4, True)]
    t = L.hypothesis_test(h, spark.createDataFrame(arms, "id string, arm string, lo double, hi double, admitted boolean"))
    assert {r.id: r.outcome for r in t.collect()} == {"a": "confirmed", "b": "refuted", "c": "unresolved", "d": "not testable", "e": "not testable"}


def test_chi_square_tail(spark):
    d = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5), (0.0, 0)], "q double, df int")
    p = [r[0] for r in d.select(L.chi2_sf(F.col("q"), F.col("df"))).collect()]
    assert np.allclose(p, [0.05] * 5 + [1.0], atol=1e-6)


def test_identical_and_permuted_draws_are_told_apart(spark):
    rows = [(r, "y", b, float(b if r != "c" else 5 - b)) for r in "abc" for b in range(1, 5)]
    d = spark.createDataFrame(rows, "run string, outcome string, draw int, delta double")
    got = {r.arm: r.paired for r in L.paired_runs(d, spark.createDataFrame([("a", "b"), ("a", "c")], "base string, arm string")).collect()}
    assert got == {"b": True, "c": False}


def test_conflicts_need_both_sides(spark):
    e = spark.createDataFrame([("r1", "z", "support", "s1"), ("r2", "z", "reject", "s2"), ("r3", "z", "unresolved", "s1"), ("r4", "out", "support", "s1")], "run string, stage string, verdict string, source_site string")
    e = e.select("*", F.lit("y").alias("readout"), F.lit("units").alias("scope"), F.lit("shift").alias("target"), F.lit(0.1).alias("u"), F.lit("c").alias("context"))
    got = L.ledger_conflicts(e).collect()
    assert [(r.run_support, r.run_reject, r.differ_in) for r in got] == [("r1", "r2", "source_site")]


def test_counts_of_intervals_and_conflicts_equal_their_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if k < 60 else "b", f"s{k:03d}", float(lo), float(lo + w)) for k, (lo, w) in enumerate(zip(rng.integers(0, 12, 80), rng.integers(0, 4, 80)))] + [("b", "gap", None, 1.0)]
    d = spark.createDataFrame(rows, "channel string, site string, lo double, hi double").repartition(3)
    pairs = {(r.site, r.other) for r in L.distinguishable_sites(d.where("lo IS NOT NULL")).collect()}
    got = L.distinguishable_counts(d).toPandas()
    assert len(got) == 80 and got.n_below.sum() == got.n_above.sum() == len(pairs)
    where = {r.site: r for r in got.itertuples()}
    above = {(a.site, b.site) for a in where.values() for b in where.values() if a.channel == b.channel and b.pos > b.n - a.n_above}
    assert {tuple(sorted(p)) for p in above} == pairs
    e = [("r%d" % (k % 25), ["support", "reject", "unresolved"][k % 7 % 3], ["s1", None][k % 2], "c%d" % (k % 3), "k%d" % (k % 2)) for k in range(70)]
    e = spark.createDataFrame(e, "run string, verdict string, source_site string, context string, readout string").select("*", *[F.lit("x").alias(c) for c in ("stage", "scope", "target")], F.lit(0.1).alias("u"))
    c = L.conflict_classes(e).toPandas()
    n = L.ledger_conflicts(e).count()
    assert n > 0 and all(c[c.verdict == v].n_links.sum() == n for v in ("support", "reject"))


# ---- fits whose queries have no SQL form
def test_score_terms_and_shift_equal_numpy(spark):
    p, V, Y, d = rows_of(spark)
    pr = pd.DataFrame([(f, int(u), t, float(Y[u, t] * w + V[u, 0])) for f, w in (("P", 1.0), ("Q", 0.2)) for u in p.unit_id for t in (0, 1)], columns=["fit", "unit_id", "target", "pred"])
    s = {(r.group_id, r.term): r.point for r in SC.score_terms(spark.createDataFrame(pr), d, ["y1", "y2"], {"gain": ("P", "Q")}, 3, 0, 0.05).collect()}
    w = pr.merge(p[["unit_id", "group_id"]], on="unit_id")
    w["y"] = Y[w.unit_id, w.target]
    r = w.groupby(["group_id", "fit", "target"])[["y", "pred"]].apply(lambda x: np.corrcoef(x.y, x.pred)[0, 1]).groupby(["group_id", "fit"]).mean()
    for g in p.group_id.unique():
        assert np.isclose(s[(g, "P")], r[g, "P"]) and np.isclose(s[(g, "gain")], r[g, "P"] - r[g, "Q"])
    u = {(x.group_id, x.fit): x.u for x in SC.group_shift_u(spark.createDataFrame(pr), d, ["y1", "y2"]).collect()}
    for g in ("d0", "d4"):
        me = (p.group_id == g).values
        sd = Y.std(0)
        P = np.c_[[pr[(pr.fit == "Q") & (pr.target == t)].set_index("unit_id").pred[p.unit_id].values for t in (0, 1)]].T
        dy, dp = (Y[me].mean(0) - Y[~me].mean(0)) / sd, (P[me].mean(0) - P[~me].mean(0)) / sd
        assert np.isclose(u[(g, "Q")], np.linalg.norm(dy - dp) / np.linalg.norm(dy))


def test_svd_scores_equal_numpy(spark):
    rng = np.random.default_rng(0)
    M = rng.poisson(1.0, (60, 7)).astype(float)
    v = spark.createDataFrame([(i, j, float(M[i, j])) for i in range(60) for j in range(7) if M[i, j]], "unit_id long, pos int, value double")
    got = X.svd_components(v, 7, 2).toPandas().set_index("unit_id").x
    U, S_, _ = np.linalg.svd(M, full_matrices=False)
    ids = got.index.values
    assert np.allclose(np.abs(np.stack(got.values)), np.abs(U[ids, :2] * S_[:2]))


def test_random_features_approximate_the_kernel(spark):
    import hashlib
    p, V, Y, d = rows_of(spark, 60)
    f = X.random_fourier_features(d, d, 2000, 3, standardise=False).toPandas().sort_values("unit_id")
    Z = np.stack(f.x.to_numpy())
    assert np.allclose(Z[:, :3], V)
    order = sorted(range(60), key=lambda u: hashlib.md5(f"3|{p.unit_id[u]}".encode()).hexdigest())
    med = np.median([((V[a] - V[b]) ** 2).sum() for a, b in zip(order, order[1:] + order[:1])])
    D = ((V[:, None] - V[None]) ** 2).sum(-1)
    assert np.isclose(X.pair_bandwidth(d, 3), med) and np.abs(Z[:, 3:] @ Z[:, 3:].T - np.exp(-D / med)).max() < 0.15
    part = d.where("unit_id % 2 = 0")
    again = X.random_fourier_features(d.repartition(3), part.repartition(5), 50, 3).toPandas().sort_values("unit_id")
    S = np.stack(again.x.to_numpy())[(again.unit_id % 2 == 0).to_numpy(), 3:]
    assert np.allclose(S.mean(0), 0, atol=1e-9) and np.allclose(S.std(0), 1)
    assert np.allclose(np.stack(X.random_fourier_features(d, part, 50, 3).toPandas().sort_values("unit_id").x.to_numpy()), np.stack(again.x.to_numpy()))


def test_ridge_of_dependent_and_constant_inputs(spark):
    rng = np.random.default_rng(5)
    A = rng.normal(size=(50, 2))
    V, y = np.c_[A, A[:, 0], np.ones(50)], A @ [1.0, 2.0] + 3
    one = np.c_[np.ones(50), V, y]
    for alpha, standardise, relative in ((0.0, False, False), (0.1, True, False), (0.1, True, True), (0.5, False, True)):
        _, b0, W = X._ridge(one.T @ one, 4, [alpha], standardise, relative)[0]
        Vc, yc = V - V.mean(0), y - y.mean()
        s = np.where(Vc.std(0) < 1e-8, 1, Vc.std(0)) if standardise else np.ones(4)
        G = (Vc / s).T @ (Vc / s)
        want = np.linalg.pinv(G + alpha * (np.trace(G) / 4 if relative else 1) * np.eye(4), rcond=1e-10, hermitian=True) @ (Vc / s).T @ yc / s
        assert np.allclose(W[:, 0], want) and np.isclose(b0[0], y.mean() - V.mean(0) @ want)


def test_bounds_that_are_too_small_are_errors(spark):
    p, V, Y, d = rows_of(spark)
    with pytest.raises(RuntimeError, match="converged"):
        X.fit_learner({"classifier": "logistic", "max_iter": 1}, "e", X.with_features(d.withColumn("label", (F.col("y1") > 0).cast("double"))))
    with pytest.raises(RuntimeError, match="converged"):
        X.threshold_gmm(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 9, 10, 11)], "g string, v double"), ["g"], "v", max_iter=1)


def test_logistic_probe_separates_and_falls_back(spark):
    p, V, Y, d = rows_of(spark)
    d = d.withColumn("cls", F.when(F.col("x")[0] > 0, "up").otherwise("down"))
    tr, va, te = (d.where(F.col("fold") == k) for k in (0, 1, 2))
    r = X.logistic_probe(tr, va, te, "cls", [0.01, 100.0]).toPandas()
    assert (r.call == r.label).mean() > 0.93
    one = X.logistic_probe(tr.where("cls = 'up'"), va, te, "cls", [1.0]).toPandas()
    assert (one.call == "up").all() and (one.confidence == 1.0).all()
    c = X.label_cost_curve(tr, te, "cls", [20, 80], [0]).toPandas().set_index("n").accuracy
    assert c[80] >= c[20] - 0.05
    assert X.labels_needed(X.label_cost_curve(tr, te, "cls", [80], [0]), 0.5).first().n_labels == 80


def test_softmax_fits_have_no_gradient_left(spark):
    """Three classes, unequal weights, fits with other rows and a fit without one class: gradient of the penalised loss by hand."""
    rng = np.random.default_rng(3)
    X, y = rng.normal(size=(240, 3)), rng.integers(0, 3, 240)
    X[:, 0] += y
    W = np.column_stack([np.ones(240), rng.random(240), (np.arange(240) < 90) & (y < 2)]).astype(float)
    d = spark.createDataFrame([(X[i].tolist(), int(y[i]), W[i].tolist()) for i in range(240)], "x array<double>, y int, w array<double>").repartition(4)
    pen = [0.5, 10.0, 1.0]
    B, active = FIT.softmax_fits(d, 3, pen)
    assert active.tolist() == [[True] * 3, [True] * 3, [True, True, False]]
    Z = np.column_stack([np.ones(240), X])
    for f in range(3):
        on = active[f]
        z = Z @ B[f][on].T
        P = np.exp(z - z.max(1, keepdims=True))
        P /= P.sum(1, keepdims=True)
        G = ((P - (y[:, None] == np.flatnonzero(on)[None, :])) * W[:, f][:, None]).T @ Z
        G[:, 1:] += pen[f] * B[f][on][:, 1:]
        assert np.abs(G).max() < 1e-5 * W[:, f].sum()


def test_fit_sets_equal_fits_on_rows(spark):
    """Penalty by leaving one member out, by hand on the rows of each set."""
    p, V, Y, d = rows_of(spark, 200)
    p["g"] = ["abcd"[i % 4] for i in range(len(p))]
    d = d.join(spark.createDataFrame(p[["unit_id", "g"]]), "unit_id")
    alphas = [0.0, 0.1, 10.0]
    gram = FIT.gram_table(d, ["g"], "x", ["y1"])
    sets = {"one": "abc", "two": "abcd", "few": "ab"}
    m = spark.createDataFrame([(f, g) for f, gs in sets.items() for g in gs], "fit string, g string")
    got = FIT.fit_sets(gram, "g", m, "fit", V.shape[1], alphas).toPandas().set_index("fit")
    assert sorted(got.index) == ["one", "two"]

    def solve(on, a):
        x, t = V[on] - V[on].mean(0), Y[on, 0] - Y[on, 0].mean()
        w = np.linalg.solve(x.T @ x + a * np.trace(x.T @ x) / V.shape[1] * np.eye(V.shape[1]), x.T @ t)
        return w, Y[on, 0].mean() - V[on].mean(0) @ w
    for f, gs in sets.items():
        if f == "few":
            continue
        on = p.g.isin(list(gs)).to_numpy()
        score = []
        for a in alphas:
            r = []
            for g in gs:
                own = (p.g == g).to_numpy()
                w, b = solve(on & ~own, a)
                r.append(np.corrcoef(V[own] @ w + b, Y[own, 0])[0, 1])
            score.append(np.mean(r))
        best = int(np.argmax(np.round(score, 9)))
        w, b = solve(on, alphas[best])
        assert got.loc[f].alpha == alphas[best] and np.isclose(got.loc[f].score, score[best]) and np.allclose(got.loc[f].coef, w) and np.isclose(got.loc[f].intercept, b)


def test_boosted_residuals_are_out_of_fold(spark):
    p, V, Y, d = rows_of(spark, 200)
    r = X.crossfit(d.withColumn("fold", F.col("fold") % 2), "y1", 2, {"regressor": "boosted", "max_iter": 5}, "m").toPandas()
    assert len(r) == 200 and np.corrcoef(r.y1, r.pred)[0, 1] > 0.5


def test_multinomial_tree_has_the_moments_of_drawing_with_replacement(spark, monkeypatch):
    """Counts of 100 rows over many draws: totals, mean 1, variance 1 - 1/n, covariance -1/n; chunks of a large group too."""
    d = spark.range(100).select(F.col("id").alias("unit_id"), F.lit("a").alias("g"))
    for chunk in (1 << 17, 64):
        monkeypatch.setattr(R, "CHUNK", chunk)
        w = R.bootstrap_rows(d, ["g"], 1500, 5).toPandas().pivot_table(index="draw", columns="unit_id", values="w", fill_value=0)
        w = w.reindex(columns=range(100), fill_value=0).to_numpy(float)
        assert w.shape == (1500, 100) and (w.sum(1) == 100).all()
        assert abs(w.var(0).mean() - 0.99) < 0.02 and np.abs(w.mean(0) - 1).max() < 0.13
        c = np.cov(w.T)
        assert abs(c[np.triu_indices(100, 1)].mean() + 0.01) < 2e-3
        assert abs(c[:32, :32][np.triu_indices(32, 1)].mean() + 0.01) < 5e-3 and abs(c[:32, 64:].mean() + 0.01) < 5e-3
    assert R.bootstrap_rows(d.select("unit_id"), [], 3, 1).groupBy("draw").agg(F.sum("w")).collect()[0][1] == 100
    assert R.bootstrap_rows(d.limit(0), ["g"], 3, 1).count() == 0


def test_draws_do_not_depend_on_how_a_group_is_numbered(spark, monkeypatch):
    """Sizes of stretches and of numbered groups are ways of working: the same seed gives the same counts."""
    d = spark.range(300).select(F.col("id").alias("unit_id"), (F.col("id") % 3 == 0).alias("g"))
    counts = lambda: R.bootstrap_two_stage(d, "g", 4, 7).orderBy("draw", "unit_id").collect()
    want = counts()
    monkeypatch.setattr(R, "CHUNK", 64)
    monkeypatch.setattr(R, "BALLS", 50)
    assert counts() == want


# ---- rows that stay one row through all draws
def test_uniforms_equal_the_md5_of_their_texts():
    from hashlib import md5
    from strataspark.functions.draws import _places, uniforms
    one = lambda t: int(md5(t.encode()).hexdigest()[:13], 16) / 2 ** 52
    a = np.array([0, 9, 10, 99, 12345, 999999999, 2 ** 32, 10 ** 10, 123456789012345])
    for head in ("53|b|712|0|0|", "é|", "x" * 47 + "|", "x" * 60):
        assert uniforms(head, a).tolist() == [one(f"{head}{v}") for v in a]
        assert uniforms(head, a, "|", a[::-1]).tolist() == [one(f"{head}{v}|{w}") for v, w in zip(a, a[::-1])]
    assert _places("7|", 3, 2000, 50).tolist() == [int(one(f"7|{k}") * 50) for k in range(3, 2001)]


def test_row_draws_are_the_multiplicities(spark, monkeypatch):
    """Blocks, stretches and the way in which groups are numbered change no draw; draw 0 is the data."""
    import pyarrow as pa
    d = spark.range(1200).select(F.col("id").cast("string").alias("unit_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"))
    totals = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3)], "draw int, g string, copies long")
    want = {(r.draw, r.unit_id): r.w for r in R.multiplicities(d, ["g"], totals, 4).collect()}

    def counts():
        x = R.RowDraws(d, ["g"], totals, 4, block=8)

        def run(v, each, _):
            out = [(draw, u, int(k)) for draw, w in each() for u, k in zip(v["unit_id"].to_pylist(), w)]
            return pa.table({"draw": pa.array([o[0] for o in out], pa.int32()), "unit_id": pa.array([o[1] for o in out], pa.string()), "w": pa.array([o[2] for o in out], pa.int64())})
        return {(r.draw, r.unit_id): r.w for r in x.over(run, "draw int, unit_id string, w long").where("w > 0").collect()}
    data = {(0, str(k)): 1 for k in range(1200)}
    assert counts() == want | data
    monkeypatch.setattr(R, "CHUNK", 64)
    monkeypatch.setattr(R, "STRETCH", 300)
    assert counts() == want | data


@pytest.mark.parametrize("name", ["arms_gain", "u_shift", "response"])
def test_draws_of_scopes_and_arms_make_no_row_per_unit_and_draw(spark, monkeypatch, name):
    """The long form (a row for each unit, output and draw) did not fit the driver at large sizes."""
    import os
    from strataspark.plans import catalogue
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")

    def refuse(*a, **k):
        raise AssertionError("long form")
    for f in ("moment_sums", "element_draws", "drawn_moments"):
        monkeypatch.setattr(SC, f, refuse)
    monkeypatch.setattr(R, "multiplicities", refuse)
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_moments_by_row_equal_those_of_the_long_form(spark):
    rng = np.random.default_rng(6)
    n = 700
    y = rng.normal(3, 1, (n, 2))
    d = pd.DataFrame({"unit_id": np.arange(n), "a": (np.arange(n) % 5 == 0).astype(int), "y1": y[:, 0], "y2": y[:, 1], "preds": [[float(v) if (i + j) % 9 else None for j, v in enumerate([*(r + 1), *(2 * r)])] for i, r in enumerate(y)]})
    s = spark.createDataFrame(d, "unit_id long, a int, y1 double, y2 double, preds array<double>")
    long = s.select("unit_id", F.posexplode("preds").alias("k", "pred")).where("pred is not null").select(F.when(F.col("k") < 2, "p").otherwise("q").alias("scope"), "unit_id", (F.col("k") % 2).alias("target"), "pred")
    m = checkpointed(SC.moment_sums(long, s, ["y1", "y2"], ["scope"]))
    want = SC.drawn_moments(m, SC.element_draws(m, 5, 8), ["scope"]).toPandas().set_index(["scope", "target", "a", "draw"]).sort_index()
    got = SC.moments_by_row(s, ["y1", "y2"], [{"scope": "p"}, {"scope": "q"}], "preds", 5, 8).toPandas().set_index(["scope", "target", "a", "draw"]).sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got[want.columns], want)


@pytest.mark.parametrize("name, n", [("response", 1000), ("scope_forecast", 1000)])
def test_intervals_have_the_draws_of_the_reference(spark, monkeypatch, name, n):
    """Six draws gave no interval; scope grids of the reference have 1,000."""
    import os
    from strataspark.plans import catalogue
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    seen = []

    def note(rows, y, names, preds, n_boot, *a, **k):
        seen.append(n_boot)
        raise InterruptedError
    monkeypatch.setattr(SC, "moments_by_row", note)
    with pytest.raises(InterruptedError):
        catalogue.QUERIES[name](spark, sf)
    assert seen == [n] and f"range(1, {n + 1})" in catalogue.ORACLES[name]


def test_medians_by_row_equal_those_of_the_long_form(spark):
    """Equal values, missing values and strata without rows in a draw; bootstrap_stat has the draws of the reference."""
    from strataspark.plans import catalogue
    assert "range(1, 2001)" in catalogue.ORACLES["bootstrap_stat"]
    rng = np.random.default_rng(2)
    n = 3000
    g = rng.choice(list("abc"), n)
    p = pd.DataFrame({"unit_id": np.arange(n), "g": g, "s": np.where(g == "c", "z", rng.choice(["x", "y", "z"], n)), "v": np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(7, 5, n), 2))})
    d = spark.createDataFrame(p)
    draws = checkpointed(R.with_point(R.bootstrap_two_stage(d, "g", 40, 3), d))
    want = {r.draw: r.value for r in R.median_difference(d, draws, "s", "x", "z", "v").collect()}
    got = {r.draw: r.value for r in R.median_difference_by_row(d, "g", 40, 3, "s", "x", "z", "v").collect()}
    assert set(got) == set(range(41)) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in got)

"""Fits from sufficient statistics, and Spark ML learners.

A ridge needs only the cross products of (1, x, y). They are summed per member (group, fold, block) in one pass over
the rows; leaving members out, penalties and validation scores are then small matrix work per fit."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import checkpointed, ship_code

TASK_CELLS = 1 << 20
COEF = "alpha double, target int, intercept double, coef array<double>, n double, score double"


# ---- cross products
def gram_table(df: DataFrame, by: list[str], x: str, y: list[str], flush: int = 128) -> DataFrame:
    """(by, pos, val): flattened cross products of v = (1, x, y) per member. Each task sends one partial matrix per
    member it saw (at most ``flush`` are held at a time), Spark adds them up."""
    v = F.concat(F.array(F.lit(1.0)), F.transform(x, lambda e: e.cast("double")), F.array(*[F.col(c).cast("double") for c in y]))
    src = df.select(*by, v.alias("v"))
    schema = T.StructType([*[f for f in src.schema.fields if f.name in by], T.StructField("vals", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}

        def out():
            rows = [(*k, m.ravel()) for k, m in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=[*by, "vals"])

        for b in batches:
            for key, g in (b.groupby(by, sort=False, dropna=False) if by else [((), b)]):
                a = np.stack(g["v"].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                acc[key] = acc.get(key, 0.0) + a.T @ a
                if len(acc) >= flush:
                    yield out()
        if acc:
            yield out()

    ship_code(src.sparkSession)
    parts = src.mapInPandas(partial, schema).select(*by, F.posexplode("vals").alias("pos", "val"))
    return parts.groupBy(*by, "pos").agg(F.sum("val").alias("val"))


def leave_out(gram: DataFrame, member: str, within: list[str] = []) -> DataFrame:
    """For every member the cross products of all other members (of the same ``within``): total minus own."""
    tot = gram.groupBy(*within, "pos").agg(F.sum("val").alias("__t"))
    return gram.join(tot, [*within, "pos"]).select(*within, member, "pos", (F.col("__t") - F.col("val")).alias("val"))


def combine(gram: DataFrame, members: DataFrame, member: str, fit: str) -> DataFrame:
    """Cross products of declared fit sets (fit, member)."""
    return gram.join(members, member).groupBy(fit, "pos").agg(F.sum("val").alias("val"))


def _matrix(pos, val) -> np.ndarray:
    m = int(round(np.sqrt(len(pos))))
    out = np.zeros(m * m)
    out[np.asarray(pos)] = np.asarray(val)
    return out.reshape(m, m)


def _ridge(M: np.ndarray, d: int, alphas: list[float], standardise: bool, relative: bool) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(alpha, intercepts, coefficients d x R) for every penalty, from the penalised normal equations.

    With ``standardise`` the penalty of an input is its variance, as if it had been scaled to one; with ``relative`` it
    is a multiple of the mean variance sum of the (scaled) inputs. Inputs without variance get no scale of their own.
    A singular system (no penalty, dependent inputs) has the solution of least norm."""
    centre = M[0] / M[0, 0]
    cross = M - M[0, 0] * np.outer(centre, centre)
    inputs, outputs = cross[1:d + 1, 1:d + 1], cross[1:d + 1, d + 1:]
    spread = np.diagonal(inputs) / M[0, 0]
    weight = np.where(spread < 1e-16, 1.0, spread) if standardise else np.ones(d)
    base = float(np.sum(np.diagonal(inputs) / weight)) / d if relative else 1.0
    fits = []
    for alpha in map(float, alphas):
        system = inputs + np.diag(alpha * base * weight)
        scaled = system / np.sqrt(np.outer(weight, weight))
        right = outputs / np.sqrt(weight)[:, None]
        regular = alpha * base > 0 or np.linalg.matrix_rank(scaled, hermitian=True) == d
        coef = (np.linalg.solve(scaled, right) if regular else np.linalg.lstsq(scaled, right, rcond=None)[0]) / np.sqrt(weight)[:, None]
        fits.append((alpha, centre[d + 1:] - centre[1:d + 1] @ coef, coef))
    return fits


def _score(M: np.ndarray, d: int, b0: np.ndarray, W: np.ndarray, how: str) -> float:
    """Mean over targets of -MSE, R2 or Pearson of a model on the rows behind the cross products M."""
    n, R = M[0, 0], W.shape[1]
    res = []
    for j in range(R):
        a = np.zeros(M.shape[0])
        a[0], a[1:d + 1], a[d + 1 + j] = -b0[j], -W[:, j], 1.0
        sse = float(a @ M @ a)
        syy = M[d + 1 + j, d + 1 + j] - M[0, d + 1 + j] ** 2 / n
        if how == "mse":
            res.append(-sse / n)
        elif how == "r2":
            res.append(1 - sse / max(syy, 1e-300))
        else:
            w = W[:, j]
            Gx = M[1:d + 1, 1:d + 1] - np.outer(M[0, 1:d + 1], M[0, 1:d + 1]) / n
            cxy = M[1:d + 1, d + 1 + j] - M[0, 1:d + 1] * M[0, d + 1 + j] / n
            den = np.sqrt(max(float(w @ Gx @ w) * syy, 0.0))
            res.append(float(w @ cxy) / den if den > 0 else np.nan)
    return float(np.nanmean(res)) if np.isfinite(res).any() else float("nan")


def _rows(key: tuple, models, n: float, score: float = float("nan")) -> list[tuple]:
    return [(*key, a, j, float(b0[j]), W[:, j].tolist(), float(n), score) for a, b0, W in models for j in range(W.shape[1])]


def _schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by] + [COEF])


def ridge_solve(gram: DataFrame, by: list[str], d: int | None, alphas: list[float], standardise: bool = False, relative: bool = False, min_rows: int = 0, n_targets: int = 1) -> DataFrame:
    """(by, alpha, target, intercept, coef, n): one small solve per fit, in parallel over fits. Without ``d`` the number
    of inputs follows from the size of each matrix and ``n_targets``."""
    keys = by or ["__one"]
    g = gram if by else gram.withColumn("__one", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        M = _matrix(pdf["pos"], pdf["val"])
        if M[0, 0] < min_rows:
            raise ValueError(f"{M[0, 0]:.0f} rows left to fit on")
        key = tuple(pdf[k].iloc[0] for k in keys)
        k_in = d if d is not None else M.shape[0] - 1 - n_targets
        return pd.DataFrame(_rows(key, _ridge(M, k_in, alphas, standardise, relative), M[0, 0]), columns=[*keys, "alpha", "target", "intercept", "coef", "n", "score"])

    ship_code(g.sparkSession)
    out = g.groupBy(*keys).applyInPandas(run, _schema(g, keys)).drop("score")
    return out if by else out.drop("__one")


def ridge_select(train: DataFrame, val: DataFrame, by: list[str], d: int, alphas: list[float], how: str = "mse", standardise: bool = False, decimals: int = 6) -> DataFrame:
    """Ridge with the penalty of the best validation score (smaller penalty on ties), from the two cross products."""
    keys = by or ["__one"]
    a, b = (g if by else g.withColumn("__one", F.lit(1)) for g in (train, val))

    def run(pdf: pd.DataFrame, vdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "alpha", "target", "intercept", "coef", "n", "score"]
        if not len(pdf) or not len(vdf):
            return pd.DataFrame(columns=cols)
        M, Mv = _matrix(pdf["pos"], pdf["val"]), _matrix(vdf["pos"], vdf["val"])
        key = tuple(pdf[k].iloc[0] for k in keys)
        models = _ridge(M, d, sorted(alphas), standardise, False)
        scores = [round(_score(Mv, d, b0, W, how), decimals) for _, b0, W in models]
        k = int(np.argmax(scores))
        return pd.DataFrame(_rows(key, [models[k]], M[0, 0], scores[k]), columns=cols)

    ship_code(a.sparkSession)
    out = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, _schema(a, keys))
    return out if by else out.drop("__one")


def fit_sets(gram: DataFrame, member: str, members: DataFrame, fit: str, d: int, alphas: list[float], how: str = "pearson", relative: bool = True, min_members: int = 3) -> DataFrame:
    """One ridge per declared fit set; its penalty is chosen by leaving one member (donor, fold) of the set out in turn.

    A set's cross products are summed once. The left-out members go to tasks in parts of at most ``TASK_CELLS`` matrix
    cells, each with the set's sum, from which a member's own matrix is subtracted: a task's size doesn't grow with the
    set. Sets with fewer than ``min_members`` members give no fit. On equal scores the first penalty of ``alphas`` is taken."""
    g = checkpointed(gram.join(members, member).select(fit, member, "pos", "val"))
    size = g.groupBy(fit).agg(F.count_distinct(member).alias("__m")).where(F.col("__m") >= min_members)
    tot = checkpointed(g.join(size.select(fit), fit).groupBy(fit, "pos").agg(F.sum("val").alias("val")))
    per = max(1, TASK_CELLS // (d + 2) ** 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, whole = [], None
        for _, one in pdf.groupby(member, sort=False):
            if whole is None:
                whole = _matrix(one["pos"], one["tot"])
            own = _matrix(one["pos"], one["val"])
            out += [(pdf[fit].iloc[0], k, _score(own, d, b0, W, how)) for k, (_, b0, W) in enumerate(_ridge(whole - own, d, alphas, False, relative))]
        return pd.DataFrame(out, columns=[fit, "k", "score"])

    ship_code(g.sparkSession)
    kind = g.schema[fit].dataType.simpleString()
    pairs = g.join(tot.withColumnRenamed("val", "tot"), [fit, "pos"]).join(size.select(fit, F.ceil(F.col("__m") / per).alias("__parts")), fit)
    pairs = pairs.withColumn("__part", F.pmod(F.xxhash64(member), F.col("__parts")).cast("int"))
    scores = pairs.groupBy(fit, "__part").applyInPandas(run, f"{fit} {kind}, k int, score double")
    mean = scores.groupBy(fit, "k").agg(F.avg("score").alias("score"))
    best = mean.groupBy(fit).agg(F.max_by(F.struct("k", "score"), F.struct(F.round("score", 9), -F.col("k"))).alias("b"))
    best = best.select(fit, F.element_at(F.array(*[F.lit(float(x)) for x in alphas]), F.col("b.k") + 1).alias("alpha"), F.col("b.score").alias("score"))
    return ridge_solve(tot, [fit], d, alphas, relative=relative).join(best, [fit, "alpha"]).select(fit, "alpha", "target", "intercept", "coef", "n", "score")


def ridge_loo_alpha(df: DataFrame, gram: DataFrame, fold: str, x: str, y: str, d: int, alphas: list[float]) -> DataFrame:
    """Penalty of every leave-fold-out fit by exact leave-one-out error inside its training rows (fold -> alpha).

    The decompositions (one d x d per fold, folds are declared) go to the tasks; one pass over the rows adds up
    (residual / (1 - leverage))^2 for every fit and penalty."""
    models = {}
    for f, g in leave_out(gram, fold).toPandas().groupby(fold):
        M = _matrix(g["pos"], g["val"])
        n, mx, my = M[0, 0], M[0, 1:d + 1] / M[0, 0], M[0, d + 1] / M[0, 0]
        e, V = np.linalg.eigh(M[1:d + 1, 1:d + 1] - n * np.outer(mx, mx))
        models[int(f)] = (n, mx, my, np.clip(e, 0, None), V, V.T @ (M[1:d + 1, d + 1] - n * mx * my))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {(f, a): 0.0 for f in models for a in alphas}
        for b in batches:
            X, Y, fo = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float), b["f"].to_numpy()
            for f, (n, mx, my, e, V, c) in models.items():
                on = fo != f
                Z, yy = (X[on] - mx) @ V, Y[on]
                for a in alphas:
                    r = yy - my - Z @ (c / (e + a))
                    acc[(f, a)] += float(np.sum((r / (1 - 1 / n - (Z * Z / (e + a)).sum(1))) ** 2))
        yield pd.DataFrame([(f, a, s) for (f, a), s in acc.items()], columns=["fold", "alpha", "sse"])

    ship_code(df.sparkSession)
    parts = df.select(F.col(fold).alias("f"), F.col(x).alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(run, "fold long, alpha double, sse double")
    s = parts.groupBy("fold", "alpha").agg(F.sum("sse").alias("sse"))
    return s.groupBy("fold").agg(F.min_by("alpha", F.struct(F.round("sse", 9), "alpha")).alias("alpha"))


def predict(df: DataFrame, coefs: DataFrame, by: list[str], x: str = "x", out: str = "pred") -> DataFrame:
    """intercept + coef . x for the fit of every row; one row per target when the fits have several. Coefficients are
    one short row per fit, so Spark can broadcast them by their known size."""
    from ..functions.vectors import dot
    c = coefs.select(*by, "target", "intercept", "coef")
    if by:
        j = df.join(c, by)
    else:                                                   # one fit: its few targets are a scalar
        j = df.select("*", F.inline(c.agg(F.collect_list(F.struct("target", "intercept", "coef")).alias("c")).scalar()))
    return j.withColumn(out, F.col("intercept") + dot("coef", x)).drop("intercept", "coef")


# ---- Spark ML learners
def make_learner(spec: dict, kind: str):
    """Estimator of a declared learner. kind 'm' (regression of an outcome) or 'e' (probability of treatment)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    name = spec["regressor" if kind == "m" else "classifier"]
    if name == "ridge":
        return LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0, standardization=False, regParam=float(spec.get("reg", 0.0)))
    if name == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0, standardization=False, regParam=float(spec.get("reg", 0.0)), maxIter=int(spec.get("max_iter", 3000)),
                                  **({"weightCol": spec["weight"]} if spec.get("weight") else {}))
    if name == "boosted":
        cls = GBTRegressor if kind == "m" else GBTClassifier
        return cls(featuresCol="features", labelCol="label", maxIter=int(spec.get("max_iter", 20)), maxDepth=int(spec.get("max_depth", 3)), stepSize=float(spec.get("learning_rate", 0.1)), seed=0)
    raise ValueError(f"unknown learner {spec}")


def fit_learner(spec: dict, kind: str, rows: DataFrame):
    """The fitted model of a declared learner; a logistic fit that stops at its iteration bound is an error."""
    learner = make_learner(spec, kind)
    model = learner.fit(rows)
    if learner.__class__.__name__ == "LogisticRegression" and model.summary.totalIterations >= learner.getMaxIter():
        raise RuntimeError(f"the logistic fit hasn't converged after {learner.getMaxIter()} iterations")
    return model


def with_features(df: DataFrame, x: str = "x") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.transform(x, lambda e: e.cast("double"))))


def _positive(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return df.withColumn("pred", vector_to_array("probability")[1])


def crossfit(df: DataFrame, target: str, k: int, spec: dict, kind: str, x: str = "x") -> DataFrame:
    """Out-of-fold predictions (unit_id, fold, target, pred). Ridge: cross products per fold, one pass, total minus own;
    'ridge_cv' picks each fit's penalty by leave-one-out; other learners fit on fold <> f for each of the k folds."""
    name = spec["regressor" if kind == "m" else "classifier"]
    base = df.select("unit_id", "fold", F.col(target).cast("double").alias(target), x)
    if name in ("gram_ridge", "ridge_cv"):
        d = base.select(F.size(x).alias("d")).first()[0]
        base = checkpointed(base)
        g = checkpointed(gram_table(base, ["fold"], x, [target]))
        alphas = [float(a) for a in spec["alphas"]] if name == "ridge_cv" else [float(spec.get("alpha", 1.0))]
        c = ridge_solve(leave_out(g, "fold"), ["fold"], d, alphas, standardise=bool(spec.get("standardise")))
        if name == "ridge_cv":
            c = c.join(ridge_loo_alpha(base, g, "fold", x, target, d, alphas), ["fold", "alpha"], "left_semi")
        return predict(base, c, ["fold"], x).drop("target", x)
    f = checkpointed(with_features(base, x).withColumnRenamed(target, "label"))
    parts = []
    for fold in range(k):
        m = fit_learner(spec, kind, f.where(F.col("fold") != fold))
        p = m.transform(f.where(F.col("fold") == fold))
        parts.append((p.withColumnRenamed("prediction", "pred") if kind == "m" else _positive(p)).select("unit_id", "fold", F.col("label").alias(target), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _softmax(x: np.ndarray, B: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes (columns) under coefficients B (classes x (1 + inputs)); absent classes have none."""
    z = np.where(active[None, :], x @ B.T, -np.inf)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def softmax_fits(rows: DataFrame, n_classes: int, penalties: list[float], x: str = "x", tol: float = 1e-7, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic fits by iteratively reweighted least squares, all of them in one pass per step.

    rows: x, y (class number), w (array: the row's weight in each fit, 0 where it has no part). Fit f minimises the
    weighted log loss plus penalties[f] / 2 times the squared coefficients; intercepts are free. A task adds up gradient
    and curvature of its rows for every fit, the sums of a fit are solved in a task of its own, and only coefficients
    (fits x classes x inputs, declared numbers) come to the driver. A step that raises a fit's loss is halved. Fits
    that don't reach a gradient of ``tol`` times their weight in ``max_iter`` steps are an error. Returns coefficients (fit,
    class, 1 + inputs) and which classes each fit has."""
    src = checkpointed(rows.select(x, "y", "w"))
    first = src.select(F.size(x).alias("d")).first()
    d, n_fits, m = first.d, len(penalties), n_classes
    held = src.select("y", F.posexplode("w").alias("f", "v")).groupBy("f", "y").agg(F.sum("v").alias("v")).where("v > 0").toPandas()     # fits x classes
    active = np.zeros((n_fits, m), bool)
    active[held["f"], held["y"]] = True
    weight = held.groupby("f")["v"].sum().reindex(range(n_fits), fill_value=0.0).to_numpy()
    p = m * (d + 1)
    old = B = np.zeros((n_fits, m, d + 1))
    step = np.zeros((n_fits, m, d + 1))
    loss = np.full(n_fits, np.inf)
    open_ = weight > 0
    ship_code(src.sparkSession)

    def sums(B: np.ndarray, todo: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = {int(f): [0.0, np.zeros((m, d + 1)), np.zeros((m, d + 1, m, d + 1))] for f in todo}
            for b in batches:
                X = np.column_stack([np.ones(len(b)), np.stack(b[x].to_numpy()).astype(float)])
                y, W = b["y"].to_numpy(int), np.stack(b["w"].to_numpy())
                for f, a in acc.items():
                    on = W[:, f] > 0
                    if not on.any():
                        continue
                    Z, w, yy = X[on], W[on, f], y[on]
                    lp = _softmax(Z, B[f], active[f])
                    P = np.exp(lp)
                    a[0] -= float(w @ lp[np.arange(len(yy)), yy])
                    G = P * w[:, None]
                    G[np.arange(len(yy)), yy] -= w
                    a[1] += G.T @ Z
                    for i in np.flatnonzero(active[f]):
                        for j in np.flatnonzero(active[f]):
                            if j >= i:
                                h = Z.T @ (Z * (w * P[:, i] * ((i == j) - P[:, j]))[:, None])
                                a[2][i, :, j, :] += h
                                if j > i:
                                    a[2][j, :, i, :] += h
            for f, (v, g, h) in acc.items():
                yield pd.DataFrame({"f": f, "pos": np.arange(1 + p + p * p), "val": np.concatenate([[v], g.ravel(), h.ravel()])})
        return src.mapInPandas(run, "f int, pos int, val double").groupBy("f", "pos").agg(F.sum("val").alias("val"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["f"].iloc[0])
        v = np.zeros(1 + p + p * p)
        v[pdf["pos"].to_numpy()] = pdf["val"].to_numpy()
        pull = np.full((m, d + 1), penalties[f])
        pull[:, 0] = 0.0
        now = B[f]
        g = v[1:1 + p].reshape(m, d + 1) + pull * now
        g[~active[f]] = 0.0
        H = v[1 + p:].reshape(p, p) + np.diag(np.where(np.repeat(active[f], d + 1), pull.ravel(), 1.0))
        # the intercepts' common shift changes nothing: the solution of least norm leaves it out
        move = -np.linalg.lstsq(H, g.ravel(), rcond=1e-12)[0]
        return pd.DataFrame({"f": [f], "loss": [v[0] + 0.5 * float((pull * now * now).sum())], "slope": [float(np.abs(g).max())], "move": [move]})

    for _ in range(max_iter):
        todo = np.flatnonzero(open_)
        if not len(todo):
            return B, active
        got = sums(B, todo).groupBy("f").applyInPandas(solve, "f int, loss double, slope double, move array<double>").toPandas()
        new = B.copy()
        for r in got.itertuples():
            f = r.f
            if r.loss > loss[f] + 1e-12 * abs(loss[f]):
                step[f] /= 2
                new[f] = old[f] + step[f]
                continue
            loss[f] = r.loss
            if r.slope <= tol * weight[f]:
                open_[f] = False
                continue
            step[f] = np.asarray(r.move).reshape(m, d + 1)
            old = old.copy()
            old[f] = B[f]
            new[f] = B[f] + step[f]
        B = new
    raise RuntimeError(f"the logistic fit hasn't converged after {max_iter} iterations")


def _numbered_classes(train: DataFrame, label: str) -> tuple[list, dict, Column]:
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col(label).isNotNull()).orderBy(label).collect()         # one row per class
    classes = [r[0] for r in n]
    return classes, {r[0]: r[1] for r in n}, F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)])[F.col(label)].cast("int")


def logistic_probe(train: DataFrame, val: DataFrame, test: DataFrame, label: str, grid: list[float], balanced: bool = False, x: str = "x") -> DataFrame:
    """Class probabilities of the evaluated rows; C chosen by validation log loss (smaller C on ties), all penalties being
    fitted together. With one class in training every row gets that class. labels are strings; columns call, confidence
    and label."""
    classes, n, number = _numbered_classes(train, label)
    if len(classes) == 1:
        return test.select("unit_id", F.col(label).alias("label"), F.lit(classes[0]).alias("call"), F.lit(1.0).alias("confidence"))
    grid, total = sorted(grid), sum(n.values())
    w = F.create_map(*[F.lit(v) for c in classes for v in (c, total / (len(classes) * n[c]))])[F.col(label)] if balanced else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull()).select(F.transform(x, lambda e: e.cast("double")).alias("x"), number.alias("y"), F.array_repeat(w, len(grid)).alias("w"))
    B, active = softmax_fits(rows, len(classes), [1.0 / c for c in grid])

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            X, y = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy()).astype(float)]), b["y"].to_numpy(int)
            yield pd.DataFrame({"f": np.arange(len(grid)), "s": [float(-np.maximum(_softmax(X, B[f], active[f])[np.arange(len(y)), y], np.log(1e-15)).sum()) for f in range(len(grid))], "n": len(y)})
    checked = val.select(F.transform(x, lambda e: e.cast("double")).alias("x"), number.alias("y")).where("y is not null")
    s = checked.mapInPandas(losses, "f int, s double, n long").groupBy("f").agg((F.sum("s") / F.sum("n")).alias("loss"))
    best = s.agg(F.min_by("f", F.struct(F.round("loss", 9), "f"))).first()[0]
    best = 0 if best is None else best
    kind = test.schema["unit_id"].dataType.simpleString()

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pr = np.exp(_softmax(np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy()).astype(float)]), B[best], active[best]))
            yield pd.DataFrame({"unit_id": b["unit_id"], "label": b["label"], "call": [classes[k] for k in pr.argmax(1)], "confidence": pr.max(1), "pr": list(pr)})
    return test.select("unit_id", F.col(label).alias("label"), F.transform(x, lambda e: e.cast("double")).alias("x")).mapInPandas(calls, f"unit_id {kind}, label string, call string, confidence double, pr array<double>")


def probe_scores(pred: DataFrame, positive: str) -> DataFrame:
    """AUC of the positive class, balanced accuracy."""
    from .metrics import auroc
    b = pred.groupBy("label").agg(F.avg((F.col("call") == F.col("label")).cast("double")).alias("r")).agg(F.avg("r").alias("balanced_accuracy"))
    a = auroc(pred, [], F.when(F.col("call") == positive, F.col("confidence")).otherwise(1 - F.col("confidence")), (F.col("label") == positive).cast("int"))
    return a.withColumn("balanced_accuracy", b.scalar())


def label_cost_curve(pool: DataFrame, evaluated: DataFrame, label: str, sizes: list[int], seeds: list[int], grid_reg: float = 1.0, x: str = "x") -> DataFrame:
    """Accuracy on the evaluated rows of a classifier trained on the first n labels of a seeded permutation, for every
    (n, seed). The classifiers of all sizes and seeds are fitted together; only rows of the largest draws take part."""
    from .selection import nested_draw
    classes, _, number = _numbered_classes(pool, label)
    fits = [(n, s) for s in seeds for n in sizes]
    draws = None
    for k, s in enumerate(seeds):
        part = nested_draw(pool.where(F.col(label).isNotNull()), sizes, s).groupBy("unit_id").agg(F.array_sort(F.collect_set("size")).alias("in"))          # at most one entry per size
        part = part.select("unit_id", F.lit(k).alias("k"), "in")
        draws = part if draws is None else draws.unionByName(part)
    member = draws.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "in"))).alias("in"))                                            # one entry per seed
    w = F.array(*[F.coalesce(F.array_contains(F.try_element_at("in", F.lit(seeds.index(s))), F.lit(n).cast("long")), F.lit(False)).cast("double") for n, s in fits])
    rows = pool.join(member, "unit_id").select(F.transform(x, lambda e: e.cast("double")).alias("x"), number.alias("y"), w.alias("w"))
    B, active = softmax_fits(rows, len(classes), [1.0 / grid_reg] * len(fits))

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            X = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy()).astype(float)])
            for f, (n, s) in enumerate(fits):
                call = _softmax(X, B[f], active[f]).argmax(1)
                yield pd.DataFrame({"n": [n], "seed": [s], "hits": [int((call == b["y"].to_numpy()).sum())], "rows": [len(b)]})
    test = evaluated.where(F.col(label).isNotNull()).select(F.transform(x, lambda e: e.cast("double")).alias("x"), F.coalesce(number, F.lit(-1)).alias("y"))
    return test.mapInPandas(right, "n int, seed int, hits long, rows long").groupBy("n", "seed").agg((F.sum("hits") / F.sum("rows")).alias("accuracy")).select("accuracy", "n", "seed")


def labels_needed(curve: DataFrame, target: float) -> DataFrame:
    """Fewest labels whose mean accuracy over seeds reaches the target."""
    return curve.groupBy("n").agg(F.avg("accuracy").alias("accuracy")).where(F.col("accuracy") >= target).agg(F.min("n").alias("n_labels"))


def threshold_boost_grid(evidence: DataFrame, labels: DataFrame, questions: dict[str, object], thresholds: list[float]) -> DataFrame:
    """Accuracy and abstain rate of rule calls over a grid of questions and thresholds: one aggregate per question."""
    from .classify import argmax_class, top_score
    from .decide import weighted_class_scores
    out = None
    for name, q in questions.items():
        s = weighted_class_scores(evidence, q)
        k = list(q.panel)
        s = s.select("unit_id", argmax_class(k).alias("call"), top_score(k).alias("top")).join(labels, "unit_id")
        s = s.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        on = F.col("top") >= F.col("threshold")
        n = F.sum(on.cast("long"))
        g = s.groupBy("threshold").agg(F.avg((~on).cast("double")).alias("abstain_rate"), F.when(n > 0, F.sum((on & (F.col("call") == F.col("label"))).cast("long")) / n).alias("accuracy")).withColumn("question", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


# ---- reduced and random views
def pair_bandwidth(reference: DataFrame, seed: int, x: str = "x") -> float:
    """Median squared distance between each reference row and the next one in seeded order: as many pairs as rows, and
    the exact median of them."""
    from .ranking import group_percentile, hash_rank
    r = checkpointed(hash_rank(reference.select("unit_id", x), [], seed, ["unit_id"], out="r"))
    n = r.count()
    far = r.select((F.col("r") % n + 1).alias("r"), F.col(x).alias("other"))
    d2 = F.aggregate(F.zip_with(x, "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    return float(group_percentile(r.join(far, "r").select(d2.alias("d2")), [], "d2", {"m": 0.5}).first().m)


def _hash_uniform(seed, *parts) -> float:
    """The draw of functions.draws.uniform for constants."""
    import hashlib
    return int(hashlib.md5("|".join(str(v) for v in (seed, *parts)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


def random_fourier_features(df: DataFrame, reference: DataFrame, n_features: int, seed: int, x: str = "x", standardise: bool = True) -> DataFrame:
    """x followed by cosine features of a Gaussian kernel exp(-d2 / bandwidth), scaled to mean 0 and variance 1 over the
    reference rows (a feature without variance is only centred). Frequencies and phases are hash draws of (seed, input,
    feature), so they don't depend on any generator's state; the bandwidth is that of ``pair_bandwidth``."""
    bandwidth = pair_bandwidth(reference, seed, x)
    d = reference.select(F.size(x).alias("d")).first()[0]
    # a normal draw is made of two uniform ones
    normal = np.array([[np.sqrt(-2 * np.log(1 - _hash_uniform(seed, "radius", j, k))) * np.cos(2 * np.pi * _hash_uniform(seed, "angle", j, k)) for k in range(n_features)] for j in range(d)])
    frequency = normal * np.sqrt(2.0 / bandwidth)
    phase = 2 * np.pi * np.array([_hash_uniform(seed, "phase", k) for k in range(n_features)])

    def waves(rows) -> np.ndarray:
        return np.cos(np.stack(rows.to_numpy()).astype(float) @ frequency + phase) * np.sqrt(2.0 / n_features)

    centre, scale = np.zeros(n_features), np.ones(n_features)
    if standardise:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                w = waves(b[x])
                yield pd.DataFrame({"k": np.arange(n_features), "n": len(w), "s": w.sum(0), "q": (w * w).sum(0)})

        m = reference.select(x).mapInPandas(sums, "k int, n long, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").toPandas()
        centre = (m.s / m.n).to_numpy()
        spread = np.sqrt(np.maximum((m.q / m.n).to_numpy() - centre ** 2, 0.0))
        scale = np.where(spread < 1e-8, 1.0, spread)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"unit_id": b["unit_id"], x: [np.concatenate([v, w]) for v, w in zip(b[x], (waves(b[x]) - centre) / scale)]})

    ship_code(df.sparkSession)
    return df.select("unit_id", x).mapInPandas(run, f"unit_id long, {x} array<double>")


def svd_components(values: DataFrame, n_features: int, k: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """Scores of a truncated SVD of sparse rows (unit_id, pos, value), one unit per row. Signs are arbitrary.

    The cross products are those of the entries that a unit has, summed before the shuffle; no row is made dense. One
    features x features matrix is decomposed, and the scores are sums over the entries again. Several entries of a unit
    at one position add up; the components must be fewer than the features."""
    e = checkpointed(values.select("unit_id", F.col(pos).cast("int").alias("pos"), F.col(value).cast("double").alias("v")).where("v <> 0").groupBy("unit_id", "pos").agg(F.sum("v").alias("v")))
    rows = e.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("e"))                       # at most n_features entries
    pairs = rows.select(F.explode("e").alias("a"), "e").select("a", F.explode(F.filter("e", lambda x: x["pos"] >= F.col("a.pos"))).alias("b"))
    gram = pairs.groupBy(F.col("a.pos").alias("i"), F.col("b.pos").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("s")).toPandas()
    m = np.zeros((n_features, n_features))
    m[gram["i"], gram["j"]] = m[gram["j"], gram["i"]] = gram["s"]
    top = np.linalg.eigh(m)[1][:, ::-1][:, :k]
    weights = values.sparkSession.createDataFrame([(j, [float(x) for x in top[j]]) for j in range(n_features)], "pos int, c array<double>")
    terms = e.join(F.broadcast(weights), "pos")                                                                         # n_features rows
    sums = terms.groupBy("unit_id").agg(*[F.sum(F.col("v") * F.col("c")[j]).alias(f"s{j}") for j in range(k)])
    none = values.select("unit_id").distinct().join(sums, "unit_id", "left")
    return none.select("unit_id", F.array(*[F.coalesce(F.col(f"s{j}"), F.lit(0.0)) for j in range(k)]).alias("x"))



# ---- mixture thresholds
def threshold_gmm(df: DataFrame, by: list[str], value: str, positive_only: bool = True, max_iter: int = 1000, tol: float = 1e-4, grid: int = 4001) -> DataFrame:
    """Two-component normal mixture per group by EM; threshold = first of ``grid`` points between the means where the
    upper component's posterior reaches one half (the mean of the means when none does); also mean + 3 sd of the lower
    component. Values are first reduced to distinct values with counts; all groups advance together, one grouped
    aggregate per step, and the parameter table (one row per group) is cut from its lineage each time. Steps go on until
    the mean log likelihood of every group moves by at most ``tol``; where ``max_iter`` steps don't get there, that is
    an error."""
    v = df.where(F.col(value) > 0) if positive_only else df
    h = checkpointed(v.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")))
    m0 = h.groupBy(*by).agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"), F.sum("c").alias("n"), F.sum(F.col("x") * F.col("x") * F.col("c")).alias("q"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("m") * F.col("m"), F.lit(1e-12)))
    par = m0.select(*by, (F.col("m") - 0.75 * sd).alias("m1"), (F.col("m") + 0.75 * sd).alias("m2"), (sd * sd).alias("v1"), (sd * sd).alias("v2"), F.lit(0.5).alias("p2"), F.lit(None).cast("double").alias("ll"))
    ld = lambda k: -0.5 * F.log(F.col(f"v{k}")) - (F.col("x") - F.col(f"m{k}")) ** 2 / (2 * F.col(f"v{k}"))
    par = checkpointed(par)
    for _ in range(max_iter):
        e = h.join(par.withColumnRenamed("ll", "ll0"), by)
        a, b = F.log(1 - F.col("p2")) + ld(1), F.log("p2") + ld(2)
        e = e.withColumn("a", a).withColumn("b", b).withColumn("r", 1 / (1 + F.exp(F.least(F.col("a") - F.col("b"), F.lit(700.0)))))
        lse = F.greatest("a", "b") + F.log1p(F.exp(-F.abs(F.col("a") - F.col("b"))))
        w2, w1 = F.col("c") * F.col("r"), F.col("c") * (1 - F.col("r"))
        g = e.groupBy(*by).agg(F.sum(w1).alias("n1"), F.sum(w2).alias("n2"), F.sum(w1 * F.col("x")).alias("s1"), F.sum(w2 * F.col("x")).alias("s2"), F.sum(w1 * F.col("x") ** 2).alias("q1"), F.sum(w2 * F.col("x") ** 2).alias("q2"),
                               (F.sum(F.col("c") * lse) / F.sum("c")).alias("ll"), F.first("ll0").alias("ll0"))
        t1, t2 = F.greatest("n1", F.lit(1e-9)), F.greatest("n2", F.lit(1e-9))
        nxt = g.select(*by, (F.col("s1") / t1).alias("m1"), (F.col("s2") / t2).alias("m2"), F.greatest(F.col("q1") / t1 - (F.col("s1") / t1) ** 2, F.lit(1e-6)).alias("v1"),
                       F.greatest(F.col("q2") / t2 - (F.col("s2") / t2) ** 2, F.lit(1e-6)).alias("v2"), F.least(F.greatest(F.col("n2") / (F.col("n1") + F.col("n2")), F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p2"), "ll", "ll0")
        par = checkpointed(nxt)
        moved = par.where(F.col("ll0").isNull() | (F.abs(F.col("ll") - F.col("ll0")) > tol)).limit(1).count()
        par = par.drop("ll0")
        if not moved:
            break
    else:
        raise RuntimeError(f"the mixture hasn't converged after {max_iter} steps")
    swap = F.col("m1") > F.col("m2")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    q = par.select(*by, pick("m1", "m2").alias("ml"), pick("m2", "m1").alias("mu"), pick("v1", "v2").alias("vl"), pick("v2", "v1").alias("vu"), F.when(swap, 1 - F.col("p2")).otherwise(F.col("p2")).alias("pu"))
    at = lambda k: F.col("ml") + (F.col("mu") - F.col("ml")) * k / (grid - 1)
    up = lambda x: F.log("pu") - 0.5 * F.log("vu") - (x - F.col("mu")) ** 2 / (2 * F.col("vu")) >= F.log(1 - F.col("pu")) - 0.5 * F.log("vl") - (x - F.col("ml")) ** 2 / (2 * F.col("vl"))
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: up(at(k))))
    return q.select(*by, F.coalesce(at(first), (F.col("ml") + F.col("mu")) / 2).alias("threshold"), (F.col("ml") + 3 * F.sqrt("vl")).alias("background_mu3sd"), "ml", "mu")

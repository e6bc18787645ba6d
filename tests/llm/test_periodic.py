"""Runs of repeated words against all pairs of places, and the grammar's extensions against single steps."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_llm import frame, odd_rows, words
from strataspark.llm import periodic
from strataspark.llm.queries import op13


def brute(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(text, doc_id=None):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def sequence(rng):
    alphabet = rng.choice([1, 2, 3, 50])
    w = [rng.randrange(alphabet) for _ in range(rng.choice([0, 5, 23, 24, 25, 60, 120, 400]))]
    for _ in range(rng.randint(0, 4) if w else 0):
        a, m = rng.randrange(len(w)), rng.randint(1, 200)
        base = w[a:a + rng.randint(1, 30)]
        w[a:a] = (base * (m // len(base) + 1))[:m]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.randrange(alphabet)
    return w


def test_runs_equal_all_pairs(rng):
    for _ in range(150):
        texts = [sequence(rng) for _ in range(rng.randint(1, 8))]
        assert periodic.runs_of(texts) == [brute(w) for w in texts]


@pytest.mark.parametrize("seed", range(4))
def test_extensions_equal_single_steps(seed):
    rng = random.Random(seed)
    for _ in range(40):
        n, k = rng.randint(2, 300), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        w = (w[:rng.randint(1, 9)] * n)[:n] if rng.random() < 0.5 else w
        x = np.array([100, *w, 101])
        grammar = periodic.Grammar(x)
        i, j = (np.array([rng.randint(1, n) for _ in range(40)]) for _ in range(2))
        i, j = i[i != j], j[i != j]
        for a, b, ahead, behind in zip(i, j, grammar.extend(i, j), grammar.extend(i, j, back=True)):
            assert ahead == next(c for c in range(n + 2) if x[a + c] != x[b + c]) and behind == next(c for c in range(n + 2) if x[a - c] != x[b - c])


def rows_of(rng):
    base = words(rng, 7)
    return [*((i, t and t[:20_000]) for i, t in odd_rows(rng)), (20, " ".join([base] * 9)), (21, "x " + " ".join(["Ab ab"] * 20) + " y"), (22, "a " * 5000), (23, "a a " * 30 + "\x0b\x0c b"), (24, " ".join([base] * 3)), (24, " ".join([base] * 4)), (25, "q" * 3_000_000 + " z" * 40)]


def test_periodic_runs(spark, rng):
    rows = rows_of(rng)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((str(r.doc_id), *(str(r[n]) for n in names)) for r in periodic.periodic_runs(frame(spark, rows)).collect())
    assert got == sorted((str(i), *(str(v) for v in brute_row(t))) for i, t in rows)
    assert periodic.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_collapsed_documents(spark, rng):
    docs = frame(spark, rows_of(rng))
    got = {r.doc_id: r for r in periodic.collapse_runs(docs).collect()}
    assert got[21].text == "x Ab ab y" and got[1].text is None and got[3].text == " \n\t " and got[22].n_chars == 1
    assert periodic.collapse_runs(docs).columns == docs.columns


def test_query_on_planted_rows(spark, rng, tmp_path):
    rows = [(i, words(rng, rng.choice([0, 1, 30, 90, 300]))) for i in range(120)] + [(500, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[n] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in op13(spark, str(tmp_path)).collect()}
    assert got == {i: brute_row(t, i) for i, t in rows}
    assert sum(v[0] > 0 for v in got.values()) > 5

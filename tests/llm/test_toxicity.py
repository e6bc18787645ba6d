"""The channel's decoder against all readings, and scores on labelled rows that training doesn't see."""
import itertools
import zlib

import numpy as np
import pytest
from conftest_llm import frame, odd_rows, words
from strataspark.llm import toxicity as tox


def readings(token, spaced):
    """All readings of a token with their channel costs, and their symbols."""
    ways = []
    for ch in token:
        low = ch.lower()
        if spaced and not ch.isalpha() and ch not in tox.SIGNS:
            ways.append([("drop", "", tox.DROP_GAP), ("end", " ", tox.END_AT_GAP)])
        elif ch in tox.SIGNS:
            ways.append([("put", ch, tox.KEEP_SIGN)] + [("put", x, tox.READ_SIGN) for x in tox.SIGNS[ch]] + [("again", x, tox.DROP_REPEAT + tox.READ_SIGN) for x in tox.SIGNS[ch]])
        else:
            ways.append([("put", low, 0.0), ("again", low, tox.DROP_REPEAT)])
    for way in itertools.product(*ways):
        out, symbols, cost = "", [], 0.0
        for kind, x, c in way:
            cost += c
            if kind == "again" and not out.endswith(x) or kind == "end" and (not symbols or symbols[-1] == tox.END):
                break
            if kind == "put":
                out += x
                symbols.append(tox.OTHER if x in tox.SIGNS else tox.symbol(x))
            elif kind == "end":
                out += " "
                symbols.append(tox.END)
        else:
            yield out, symbols, cost


def test_decoder_equals_enumeration(rng):
    gen = np.random.default_rng(3)
    cost = tox.character_model(gen.integers(0, 4, tox.SYMBOLS ** 4) * (gen.random(tox.SYMBOLS ** 4) < 0.1))
    for _ in range(150):
        spaced = rng.random() < 0.4
        token = "".join(rng.choices("aaabeil" + "0134$!" + (" .-" if spaced else ""), k=rng.randint(1, 7)))

        def total(symbols):
            line = [tox.END] * 3 + symbols + [tox.END]
            return sum(float(cost[((line[i - 3] * 28 + line[i - 2]) * 28 + line[i - 1]) * 28 + line[i]]) for i in range(3, len(line)))
        best = min(c + total(s) for _, s, c in readings(token, spaced))
        got = tox.decode(token, cost, spaced)
        assert any(out == got and abs(c + total(s) - best) < 1e-4 for out, s, c in readings(token, spaced))


def test_character_counts_over_all_documents(spark, rng):
    rows = [*odd_rows(rng), (30, "Éa-ß 漢x"), (31, "x" * 3_000_000)]
    got = {r.gram: r.n for r in tox.character_counts(frame(spark, rows)).collect()}
    want = {}
    for _, t in rows:
        s = []
        for c in [*"   ", *(t or ""), *"   "]:
            x = tox.symbol(c) if ord(c) < 0x3000 else tox.OTHER
            if x != tox.END or s[-3:] != [tox.END] * 3:  # a gap counts as three ends at most
                s.append(x)
        for i in range(3, len(s)):
            g = ((s[i - 3] * 28 + s[i - 2]) * 28 + s[i - 1]) * 28 + s[i]
            want[g] = want.get(g, 0) + 1
    assert got == want
    cost = tox.character_model(np.zeros(tox.SYMBOLS ** 4))
    assert np.allclose(np.exp(-cost).reshape(-1, tox.SYMBOLS).sum(1), 1, atol=1e-4)


BAD = ["moronic", "grumpfel", "bakstred"]


def corpus(rng):
    """Documents with a label; a third of the toxic ones write their word in a disguise."""
    rows, labels, hidden = [], [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = words(rng, 40).split()
        if toxic:
            bad = rng.choice(BAD)
            if i % 3 == 0:
                bad = rng.choice([bad.replace("o", "0").replace("e", "3").replace("a", "4"), " ".join(bad), bad[:2] + bad[2] * 4 + bad[3:], "-".join(bad)])
                hidden.append(i)
            w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(toxic)))
    return rows, labels, hidden


def test_held_out_scores(spark, rng):
    rows, labels, hidden = corpus(rng)
    extra = [(10_000 + (i or 0), t) for i, t in odd_rows(rng)]
    docs, lab = frame(spark, rows + extra + [(None, "moronic")]), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int").repartition(2)
    model = tox.train(docs, lab)
    got = {r.doc_id: r for r in tox.toxicity(docs, model).collect()}
    out = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 150 and all(got[i].predicted == t for i, t in out)
    assert sum(i in hidden for i, _ in out) > 5 and got[None].predicted == 1
    assert got[10_001].score == got[10_002].score == got[10_003].score < 0.3 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == 0 for i, _ in extra)
    hit = next(i for i, _ in out if i in hidden)
    assert any(b in got[hit].restored for b in BAD)
    few = tox.train(docs, lab, rows=300)
    assert np.mean([r.predicted == dict(out).get(r.doc_id) for r in tox.toxicity(docs, few).collect() if r.doc_id in dict(out)]) > 0.95


@pytest.mark.parametrize("kind", ["none", "no_toxic"])
def test_without_toxic_labels(spark, rng, kind):
    docs = frame(spark, odd_rows(rng))
    lab = spark.createDataFrame([(i, 0) for i in range(12)] if kind == "no_toxic" else [], "doc_id long, toxic int")
    got = tox.toxicity(docs, tox.train(docs, lab)).collect()
    assert len(got) == len(odd_rows(rng)) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert tox.toxicity(docs.limit(0), tox.train(docs.limit(0), lab)).count() == 0

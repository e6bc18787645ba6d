"""Toxicity of texts, scored after a noisy channel is undone.

Tokens that look obfuscated (digits and signs for letters, letters three times or more, single letters with separators)
become character lattices: a sign may be one of the letters it stands for, a repeated letter or a separator may be
dropped, a separator may end a word. A Viterbi pass under a character model, counted over all documents, picks the
reading. Words and word beginnings, as written and as restored, carry the evidence: how many toxic and other labelled
documents hold them. A document's evidence is its strongest, and a monotone fit on held-apart thirds of the labelled
rows turns it into a probability.

Labels come from ``labels`` rows whose crc32(doc_id) mod 4 isn't 2; of more than ``TRAIN_ROWS`` such rows a sample of
about that many is taken by a hash of the id (so they can be broadcast). Features that fewer than ``SHARE`` of the toxic
rows hold are left out, so their number is at most 1 / SHARE times the mean number in a document. A row labelled twice
is toxic if one label says so. Null and empty texts have no evidence and the score of such documents; without a toxic
label every score is 0. Repeated rows get equal results each. An empty table gives no rows. Only the id and text columns
and the labels' doc_id and toxic are read."""
from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed, ship_code
from .common import blocks, documents, map_documents, schema_of

TRAIN_ROWS = 1 << 17
SHARE = 0.005
LEAST_ROWS = 3
FOLDS = (0, 1, 3)
THRESHOLD = 0.3
BINS = 128
SMOOTH = 4.0
PREFIXES = (3, 4, 5, 6)
BLOCK = 2 << 20
CACHE = 1 << 18
#: Symbols of the character model: a to z, a word's end, any other letter or sign.
END, OTHER, SYMBOLS = 26, 27, 28
#: Signs and the letters they stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y"}
#: Costs of the channel, in nats.
READ_SIGN, KEEP_SIGN, DROP_REPEAT, DROP_GAP, END_AT_GAP = 1.0, 2.0, 0.7, 0.3, 1.5
_SIGN = "[0-9@$!|+€£¥]"
_LETTER = r"[^\W\d_]"
_GAPS = " .*_-"
WORDS = re.compile(_LETTER + "+")
MIXED = re.compile(rf"(?:{_LETTER}|{_SIGN})+")
SPACED = re.compile(rf"{_LETTER}(?:[{_GAPS}]{{1,2}}(?:{_LETTER}|[0-9@$!|+]))+(?![\w@$])")
REPEATED = re.compile(rf"({_LETTER})\1\1")
#: Runs of signs at a token's ends are no letters, nor is punctuation there.
EDGES = re.compile(r"^[!|+]+|[!|+]+$|^([@$€£¥])\1\1+|([@$€£¥])\2\2+$")
SIGNED = re.compile(rf"{_LETTER}.*{_SIGN}|{_SIGN}.*{_LETTER}")
_FOLD: dict[str, int] = {}
_TABLES: list[np.ndarray] = []


def symbol(ch: str) -> int:
    """A character's symbol: accents are taken off, whatever isn't a letter ends a word."""
    got = _FOLD.get(ch)
    if got is None:
        base = unicodedata.normalize("NFKD", ch.lower())[:1]
        got = ord(base) - 97 if "a" <= base <= "z" else OTHER if ch.isalpha() else END
        _FOLD[ch] = got
    return got


def _table() -> np.ndarray:
    if not _TABLES:
        _TABLES.append(np.array([symbol(chr(c)) for c in range(0x3000)] + [OTHER], np.int64))
    return _TABLES[0]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): counts of four symbols in a row over all documents; a task sums its own first."""
    arrow = to_arrow_schema(schema_of("gram int, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _table(), np.zeros(SYMBOLS ** 4, np.int64)
        for block in blocks(batches, 0, BLOCK):
            whole = "   " + "   ".join(t for t in block.column(0).to_pylist() if t) + "   "
            s = table[np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), len(table) - 1)]
            s = s[np.r_[True, True, True, ~((s[3:] == END) & (s[2:-1] == END) & (s[1:-2] == END) & (s[:-3] == END))]]
            total += np.bincount(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], schema=arrow)
    ship_code(docs.sparkSession)
    return documents(docs, text).mapInArrow(run, schema_of("gram int, n long")).groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Cost (nats) of a symbol after three others, each order smoothed by the next lower one."""
    c = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    lower = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = c.sum(axis=axes) if axes else c
        lower = (n + weight * lower) / (n.sum(-1, keepdims=True) + weight)
    return (-np.log(lower)).astype(np.float32).reshape(-1)


def decode(token: str, cost: np.ndarray, spaced: bool = False) -> str:
    """The best reading of a token; ``spaced`` tokens have separators that may go or end a word."""
    start = (END * SYMBOLS + END) * SYMBOLS + END
    states: dict[int, tuple[float, str]] = {start: (0.0, "")}
    wrap = SYMBOLS ** 3
    for ch in token:
        low = ch.lower()
        new: dict[int, tuple[float, str]] = {}
        gap = spaced and not ch.isalpha() and ch not in SIGNS

        def put(state: int, value: float, out: str) -> None:
            have = new.get(state)
            if have is None or value < have[0]:
                new[state] = (value, out)
        for state, (value, out) in states.items():
            if gap:
                put(state, value + DROP_GAP, out)
                at = state * SYMBOLS + END
                if state % SYMBOLS != END:
                    put(at % wrap, value + END_AT_GAP + float(cost[at]), out + " ")
                continue
            if ch in SIGNS:
                at = state * SYMBOLS + OTHER
                put(at % wrap, value + KEEP_SIGN + float(cost[at]), out + ch)
                for letter in SIGNS[ch]:
                    at = state * SYMBOLS + ord(letter) - 97
                    put(at % wrap, value + READ_SIGN + float(cost[at]), out + letter)
                    if out.endswith(letter):
                        put(state, value + DROP_REPEAT + READ_SIGN, out)
                continue
            at = state * SYMBOLS + symbol(low)
            put(at % wrap, value + float(cost[at]), out + low)
            if out.endswith(low):
                put(state, value + DROP_REPEAT, out)
        states = new
    return min((value + float(cost[state * SYMBOLS + END]), out) for state, (value, out) in states.items())[1]


class Restorer:
    """Readings of obfuscated tokens, kept while the task lives (up to ``CACHE`` of them)."""

    def __init__(self, cost: np.ndarray, known: dict | None = None):
        self.cost, self.known = cost, {} if known is None else known

    def read(self, token: str, spaced: bool) -> str:
        got = self.known.get((token, spaced))
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[token, spaced] = decode(token, self.cost, spaced)
        return got

    def restored(self, texts: list) -> list[list[tuple[int, int, str]]]:
        """(start, end, reading) of each text's tokens that read otherwise than they are written."""
        out: list[list] = [[] for _ in texts]
        spaced, mixed = suspicious(texts)
        for hits, is_spaced in ((spaced, True), (mixed, False)):
            last, end = -1, 0
            for k, at in hits:
                text = texts[k]
                if k != last:
                    last, end = k, 0
                if at < end:
                    continue
                if is_spaced:
                    m = SPACED.match(text, at)
                    if m is None or sum(c not in _GAPS for c in m[0]) < 3:
                        continue
                    token, at, end = m[0], m.start(), m.end()
                else:
                    while at > end and (text[at - 1].isalpha() or text[at - 1] in SIGNS):
                        at -= 1
                    m = MIXED.match(text, at)
                    if m is None:
                        continue
                    end = m.end()
                    token = EDGES.sub("", m[0])
                    if not token or not (SIGNED.search(token) or REPEATED.search(token.lower())):
                        continue
                    at += m[0].index(token)
                got = self.read(token, is_spaced)
                if got != token.lower():
                    out[k].append((at, at + len(token), got))
        return [sorted(x) for x in out]

    def words(self, texts: list) -> tuple[list[set[str]], list[list[tuple[int, int, str]]]]:
        """All words of each text, as written and as restored, in lower case; and the restored tokens."""
        restored = self.restored(texts)
        found = [set(WORDS.findall(t.lower())) if t else set() for t in texts]
        for words, tokens in zip(found, restored):
            for _, _, reading in tokens:
                words.update(WORDS.findall(reading))
        return found, restored


def suspicious(texts: list) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places (text, code point) at which a row of single letters begins, and of signs beside letters and letters three
    times in a row, in order."""
    whole = "\n" + "\n\n\n".join(t or "" for t in texts) + "\n\n\n"
    starts = np.cumsum([1] + [len(t or "") + 3 for t in texts])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, low = _kinds()
    c = kind[np.minimum(points, len(kind) - 1)]
    for at in np.flatnonzero(points >= len(kind)):
        c[at] = LETTER if whole[at].isalpha() else 0
    letter, gap = c == LETTER, (c == GAP) | (c == BAR)
    dark = letter | (c == SIGN) | (c == WEAK)
    x = low[np.minimum(points, len(low) - 1)]
    triple = letter[2:] & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & (points[2:] < len(low))
    # punctuation stands for a letter only between letters and signs
    near = (c[1:-1] == SIGN) & (letter[:-2] | letter[2:]) | (c[1:-1] == WEAK) & dark[:-2] & dark[2:] & (letter[:-2] | letter[2:])
    mixed = np.union1d(np.flatnonzero(near) + 1, np.flatnonzero(triple) + 2)
    # a single letter with a gap behind it, and a single letter or sign with a gap or an end behind that
    single = letter[1:-4] & ~dark[:-5] & (c[:-5] != WORDY) & gap[2:-3]
    first = single & (dark[3:-2] & ~dark[4:-1] | gap[3:-2] & dark[4:-1] & ~dark[5:])
    spaced = np.flatnonzero(first) + 1
    out = []
    for hits in (spaced, mixed):
        k = np.searchsorted(starts, hits, side="right") - 1
        out.append(list(zip(k.tolist(), (hits - starts[k]).tolist())))
    return out[0], out[1]


LETTER, SIGN, GAP, BAR, WORDY, WEAK = 1, 2, 3, 4, 5, 6
_KINDS: list[np.ndarray] = []


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case form of the code points below 0x3000."""
    if not _KINDS:
        chars = [chr(k) for k in range(0x3000)]
        _KINDS.append(np.array([WEAK if c in "!|+" else SIGN if c in SIGNS else LETTER if c.isalpha() else BAR if c == "_" else GAP if c in _GAPS else WORDY if c.isalnum() else 0 for c in chars], np.uint8))
        _KINDS.append(np.array([ord(c.lower()) if len(c.lower()) == 1 else k for k, c in enumerate(chars)], np.uint32))
    return _KINDS[0], _KINDS[1]


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Evidence by feature, the probability of each evidence bin, and the character model."""
    evidence: dict[str, float]
    chance: list[float]
    cost: np.ndarray
    known: dict = field(default_factory=dict, repr=False)
    readings: dict = field(default_factory=dict, repr=False)

    def strongest(self, words: set[str]) -> float:
        known, evidence = self.known, self.evidence
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        for w in new:
            known[w] = max(evidence.get(f, 0.0) for f in features(w))
        return max(map(known.__getitem__, words), default=0.0)


def _weight(toxic: np.ndarray, other: np.ndarray, prior: float) -> np.ndarray:
    return (toxic + SMOOTH * prior / 2) / (toxic + other + SMOOTH)


def _monotone(toxic: np.ndarray, other: np.ndarray, prior: float) -> list[float]:
    """Rising probabilities of the bins: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for t, o in zip(toxic.tolist(), other.tolist()):
        pools.append([t, t + o, 1])
        while len(pools) > 1 and pools[-2][0] * max(pools[-1][1], 1e-9) >= pools[-1][0] * max(pools[-2][1], 1e-9):
            t2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2] + k2]
    out: list[float] = []
    for t, n, k in pools:
        out += [(t + prior) / (n + 1)] * int(k)
    return np.maximum.accumulate(np.array(out)).tolist()


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model from all documents' characters and the labelled documents outside the held-out quarter."""
    spark = docs.sparkSession
    grams = np.zeros(SYMBOLS ** 4, np.int64)
    got = character_counts(docs, text).toPandas()  # at most 28^4 rows
    grams[got["gram"].to_numpy(np.int64)] = got["n"]
    cost = character_model(grams)
    known = (labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where(F.col("__id").isNotNull() & F.col("__toxic").isNotNull() & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.max("__toxic").alias("__toxic")))
    known = checkpointed(known)
    share = min(1.0, rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("__id", F.lit(12)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    picked = documents(docs, doc_id, text).join(F.broadcast(picked), F.col(doc_id) == F.col("__id")).select(F.col(text).alias("text"), (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4).cast("int").alias("fold"), (F.col("__toxic") > 0).alias("toxic"))
    picked = checkpointed(_with_words(picked, spark.sparkContext.broadcast(cost)))
    n = {(r.fold, r.toxic): r.n for r in picked.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic = sum(v for (_, toxic), v in n.items() if toxic)
    if not n_toxic:
        return Model({}, [0.0] * (BINS + 1), cost)
    prior = n_toxic / sum(n.values())
    least = max(LEAST_ROWS, math.ceil(SHARE * n_toxic))
    names = [r.f for r in _feature_counts(picked.where("toxic"), None).groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("f").collect()]
    place = {f: k for k, f in enumerate(sorted(names))}
    counts = np.zeros((4, 2, len(place)))
    for r in _feature_counts(picked, place).groupBy("fold", "toxic", "f").agg(F.sum("n").alias("n")).collect():
        counts[r.fold, int(r.toxic), place[r.f]] = r.n
    total = counts.sum(0)
    apart = [dict(zip(place, _weight(total[1] - counts[k, 1], total[0] - counts[k, 0], prior).tolist())) for k in range(4)]
    bins = np.zeros((2, BINS + 1), np.int64)
    for r in _evidence_bins(picked, apart, cost).groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect():
        bins[int(r.toxic), r.bin] = r.n
    return Model(dict(zip(place, _weight(total[1], total[0], prior).tolist())), _monotone(bins[1], bins[0], prior), cost)


def _with_words(rows: DataFrame, cost) -> DataFrame:
    out = "fold int, toxic boolean, words array<string>"

    def run(block: pa.RecordBatch) -> dict:
        restorer = Restorer(cost.value)
        return {"fold": block.column(1), "toxic": block.column(2), "words": [list(w) for w in restorer.words(block.column(0).to_pylist())[0]]}
    return map_documents(rows, "text", out, run, BLOCK)


def _feature_counts(rows: DataFrame, wanted: dict | None) -> DataFrame:
    """(fold, toxic, f, n): documents that hold each feature, of the wanted ones or of all; a task sums its own first."""
    arrow = to_arrow_schema(schema_of("fold int, toxic boolean, f string, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        totals: dict[tuple, Counter] = {}

        def given() -> pa.RecordBatch:
            cols = list(zip(*((*k, f, n) for k, total in totals.items() for f, n in total.items()))) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)
        for batch in batches:
            for fold, toxic, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = [w for w in words if w not in known]
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = words
                for w in new:
                    known[w] = tuple(f for f in features(w) if wanted is None or f in wanted)
                found: set[str] = set()
                found.update(*map(known.__getitem__, words))
                totals.setdefault((fold, toxic), Counter()).update(found)
                if sum(map(len, totals.values())) >= CACHE:
                    yield given()
                    totals.clear()
        yield given()
    return rows.mapInArrow(run, schema_of("fold int, toxic boolean, f string, n long"))


def _evidence_bins(rows: DataFrame, apart: list[dict], cost: np.ndarray) -> DataFrame:
    """(toxic, bin, n): labelled documents by their strongest evidence from the other folds."""
    arrow = to_arrow_schema(schema_of("toxic boolean, bin int, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(e, [], cost) for e in apart]
        total: Counter = Counter()
        for batch in batches:
            for fold, toxic, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[toxic, int(models[fold].strongest(words) * BINS)] += 1
        cols = list(zip(*((*k, v) for k, v in total.items()))) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return rows.mapInArrow(run, schema_of("toxic boolean, bin int, n long"))


def score_texts(texts: list, model: Model) -> tuple[list[float], list[str]]:
    """Score of each text, and its restored tokens as ``start:end:reading`` in code points, semicolon-joined."""
    restorer = Restorer(model.cost, model.readings)
    words, restored = restorer.words(texts)
    return [model.chance[int(model.strongest(w) * BINS)] for w in words], [";".join(f"{a}:{b}:{r}" for a, b, r in x) for x in restored]


def toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted, restored)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(block: pa.RecordBatch) -> dict:
        scores, spans = score_texts(block.column(1).to_pylist(), shared.value)
        return {doc_id: block.column(0), "score": scores, "predicted": [int(s >= threshold) for s in scores], "restored": spans}
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, score double, predicted int, restored string", run, BLOCK)

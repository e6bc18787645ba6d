"""Language identification: script ranges narrow the candidates of a word, letter trigrams score it, and a Viterbi
pass with a switching penalty labels the words of mixed-language texts.

Texts: null and texts without a letter are ``und`` with score 0 and no spans. Copies get equal results. An empty
table gives an empty result; a table without labelled rows gives a model without languages, which answers ``und``.
Only the id, text and language columns are read."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import documents, map_documents

SLOTS = 1 << 15
MAX_LANGUAGES = 512
#: First code point and script of each range; what lies between belongs to the range before it.
SCRIPT_RANGES = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
                 (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
                 (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
SEGMENT = 256
#: Bytes of text in hand at a time; a task needs some forty times as much.
BLOCK = 2 << 20
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each letter (0 for what is no letter), and its script."""
    if not _TABLES:
        low = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                x = ch.lower()
                low[c] = ord(x) if len(x) == 1 else c
        at = np.searchsorted([a for a, _ in SCRIPT_RANGES], np.arange(0x110000), side="right") - 1
        _TABLES["low"], _TABLES["script"] = low, np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)[at]
    return _TABLES["low"], _TABLES["script"]


def _letters(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a gap after each, their lower-case letters (else 0), and each text's start."""
    low, _ = _tables()
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    whole = np.concatenate([gap, *(x for p in points for x in (p, gap))])
    starts = np.cumsum([1] + [len(p) + 1 for p in points])
    return whole, low[whole], starts


def _slots(lower: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slot of the trigram around each letter; a word's ends count as spaces."""
    with np.errstate(over="ignore"):
        x = lower[at - 1] * np.uint32(0x9E3779B1) + lower[at] * np.uint32(0x85EBCA77) + lower[at + 1] * np.uint32(0xC2B2AE3D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(17)).astype(np.int32)


@dataclass
class Model:
    """Log scores by trigram slot and language, and which languages each script allows."""
    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    penalty: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", penalty: float = 12.0) -> Model:
    """Trigram and script counts over every labelled document whose crc32(doc_id) mod 5 isn't 0.

    The tasks sum their counts before the shuffle; what reaches the driver has at most 2^15 slots and the scripts for
    each language, and more than 512 languages are refused."""
    rows = documents(docs, doc_id, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(text, lang)

    def count(block: pa.RecordBatch) -> dict:
        _, script = _tables()
        names, which = np.unique(np.array(block.column(1).to_pylist(), dtype=object), return_inverse=True)
        _, lower, starts = _letters(block.column(0).to_pylist())
        at = np.flatnonzero(lower)
        owner = which[np.searchsorted(starts, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
        width = SLOTS + len(SCRIPTS)
        n = np.bincount(owner * width + _slots(lower, at), minlength=len(names) * width) + np.bincount(owner * width + SLOTS + script[lower[at]], minlength=len(names) * width)
        full = np.flatnonzero(n)
        return {"lang": names[full // width].tolist(), "slot": full % width, "n": n[full]}

    counts = checkpointed(map_documents(rows, text, "lang string, slot int, n long", count, BLOCK).groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    if counts.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the label column isn't a language")
    got = counts.toPandas()
    languages = sorted(got["lang"].unique())
    n = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    n[got["slot"].to_numpy(np.int64), np.searchsorted(languages, got["lang"].to_numpy(str))] = got["n"]
    seen = np.log((n[:SLOTS] + 0.5) / (n[:SLOTS].sum(0) + 0.5 * SLOTS)) if languages else np.zeros((SLOTS, 0))
    weights = np.maximum(seen - seen.max(1, keepdims=True), -4.0) if languages else seen
    share = n[SLOTS:] / np.maximum(n[SLOTS:].sum(0), 1) if languages else n[SLOTS:]
    allowed = share >= 0.01
    allowed[~allowed.any(1)] = True
    return Model(languages, weights.astype(np.float32), allowed, penalty)


def _viterbi(scores: np.ndarray, firsts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: the words of text k are scores[firsts[k]: firsts[k] + counts[k]].

    Texts are cut into segments of equal length, all of which advance together: first from every possible label, then
    the segments of a text are chained, then each runs again from its true start and is traced back from its end."""
    n_lab = scores.shape[1]
    if n_lab < 2 or not len(scores):
        return np.zeros(len(scores), np.int32)
    per = -(-counts // SEGMENT)
    text_of = np.repeat(np.arange(len(counts)), per)
    first_seg = np.cumsum(per) - per
    nth = np.arange(len(text_of)) - first_seg[text_of]
    begin = firsts[text_of] + nth * SEGMENT
    size = np.minimum(SEGMENT, counts[text_of] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    active = len(size_o) - np.searchsorted(size_o[::-1], np.arange(SEGMENT), side="right")
    steps = int(size_o[0])

    grid = np.full((len(order), n_lab, n_lab), -1e30, np.float32)
    grid[:, np.arange(n_lab), np.arange(n_lab)] = 0
    for t in range(steps):
        a = active[t]
        g = grid[:a]
        np.maximum(g, g.max(2, keepdims=True) - penalty, out=g)
        g += scores[begin_o[:a] + t][:, None, :]
    whole = np.empty_like(grid)
    whole[order] = grid
    enter = np.zeros((len(order), n_lab), np.float32)
    came = np.zeros((len(order), n_lab), np.int32)
    value = np.zeros((len(counts), n_lab), np.float32)
    for k in range(int(per.max())):
        texts = np.flatnonzero(per > k)
        seg = first_seg[texts] + k
        enter[seg] = value[texts]
        both = value[texts][:, :, None] + whole[seg]
        came[seg] = both.argmax(1)
        value[texts] = both.max(1)
        value[texts] -= value[texts].max(1, keepdims=True)
    end = np.zeros(len(order), np.int32)
    label = value.argmax(1).astype(np.int32)
    for k in range(int(per.max()) - 1, -1, -1):
        texts = np.flatnonzero(per > k)
        seg = first_seg[texts] + k
        end[seg] = label[texts]
        label[texts] = came[seg, label[texts]]
    # Each segment again from its true start; jump[w, l]: the best label before word w if its own label l is reached by a switch.
    alpha = enter[order]
    stay = np.zeros((len(scores), n_lab), bool)
    best = np.zeros(len(scores), np.int32)
    for t in range(steps):
        a = active[t]
        x, w = alpha[:a], begin_o[:a] + t
        top = x.max(1)
        best[w] = x.argmax(1)
        switched = top[:, None] - penalty
        stay[w] = x >= switched
        np.maximum(x, switched, out=x)
        x += scores[w]
    out = np.zeros(len(scores), np.int32)
    now = end[order]
    for t in range(steps - 1, -1, -1):
        a = active[t]
        w = begin_o[:a] + t
        out[w] = now[:a]
        now[:a] = np.where(stay[w, now[:a]], now[:a], best[w])
    return out


def label_words(texts: list, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, label) of every word, start and end in code points of its text."""
    _, script = _tables()
    _, lower, starts = _letters(texts)
    at = np.flatnonzero(lower)
    if not len(at) or not model.languages:
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    scores = np.empty((len(new), len(model.languages)), np.float32)
    step = max(1, (1 << 20) // len(model.languages))  # letters scored at a time
    cuts = [0]
    while cuts[-1] < len(new):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(new, new[cuts[-1]] + step))))
    for a, b in zip(cuts, cuts[1:]):
        i, j = new[a], new[b] if b < len(new) else len(at)
        scores[a:b] = np.add.reduceat(model.weights[_slots(lower, at[i:j])], new[a:b] - i, axis=0)
    scores[~model.allowed[script[lower[at[new]]]]] -= 1e4
    begin, end = at[new], np.r_[at[new[1:] - 1], at[-1]] + 1
    text_of = np.searchsorted(starts, begin, side="right") - 1
    owners, firsts, counts = np.unique(text_of, return_index=True, return_counts=True)
    labels = _viterbi(scores, firsts, counts, model.penalty)
    return text_of, begin - starts[text_of], end - starts[text_of], labels


def predict(texts: list, model: Model) -> tuple[list, list, list]:
    """Language, its share of the letters, and the labelled spans of each text."""
    text_of, begin, end, label = label_words(texts, model)
    n_lab = max(1, len(model.languages))
    held = np.bincount(text_of * n_lab + label, weights=end - begin, minlength=len(texts) * n_lab).reshape(len(texts), n_lab)
    top, total = held.argmax(1), held.sum(1)
    langs = [model.languages[k] if n else "und" for k, n in zip(top, total)]
    score = [float(held[i, k] / n) if n else 0.0 for i, (k, n) in enumerate(zip(top, total))]
    first = np.flatnonzero(np.r_[True, (np.diff(text_of) != 0) | (np.diff(label) != 0)]) if len(label) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(label)] - 1
    spans: list[list[str]] = [[] for _ in texts]
    for a, b in zip(first, last):
        spans[text_of[a]].append(f"{model.languages[label[a]]}:{begin[a]}:{end[b]}")
    return langs, score, [",".join(x) for x in spans]


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, spans): spans are ``language:start:end`` in code points."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        langs, score, spans = predict(block.column(1).to_pylist(), model)
        return {doc_id: block.column(0), "lang_pred": langs, "score": score, "spans": spans}
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, lang_pred string, score double, spans string", run, BLOCK)


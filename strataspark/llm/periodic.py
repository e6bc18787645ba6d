"""Runs of repeated words in documents, found with a run-length grammar made by recompression.

The words of a block of documents are numbered and compressed level by level: maximal blocks of an equal symbol become
one symbol (symbol, length), then pairs of a left and a right symbol become one symbol, and so on until no symbol of
a level occurs twice. Equal stretches are compressed alike but for a symbol at either end of each level, so a longest
common extension (LCE) climbs the levels while both sides agree and comes down again where they part: a few steps a level.

A run of period q and length 3q or more holds three neighbours of the grid 0, q, 2q, ...; over all q that grid has
n ln n points. Those whose words agree are the candidates; forward and backward LCE queries give the exact run around
each. Only documents with a candidate enter the grammar.

Null texts have no words and no runs; so have texts of under 24 words. Repeated rows get equal results each. An empty
table gives no rows. Only the id and text columns are read. A task holds one block of text (2 MB, or one longer
document) and its grammar, some forty times as much; nothing is shuffled."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_documents, replace_texts

LEAST = 24
REPEATS = 3
BLOCK = 2 << 20


@dataclass
class Level:
    """Symbols of a level; ``first[k]`` is the place of symbol k's first child below and ``parent`` the reverse."""
    symbols: np.ndarray
    first: np.ndarray
    parent: np.ndarray
    blocks: bool


def _named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each different pair (a, b), and how many there are."""
    width = int(b.max()) + 1
    if int(a.max()) >= (1 << 62) // width:
        a = np.unique(a, return_inverse=True)[1]
    got, names = np.unique(a.astype(np.int64) * width + b, return_inverse=True)
    return names.astype(np.int64), len(got)


def _sides(n: int, level: int) -> np.ndarray:
    """A left or a right side for each symbol of a level."""
    with np.errstate(over="ignore"):
        h = (np.arange(n, dtype=np.uint64) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) & np.uint64(1) == 1


def _level(below: np.ndarray, first: np.ndarray, second: np.ndarray, blocks: bool) -> tuple[Level, int]:
    symbols, n = _named(below[first], second)
    ends = np.r_[first, len(below)]
    return Level(symbols, ends, np.repeat(np.arange(len(first)), np.diff(ends)), blocks), n


class Grammar:
    """A run-length grammar of a sequence of symbols whose first and last symbols occur nowhere else in it."""

    def __init__(self, symbols: np.ndarray):
        self.bottom = symbols
        self.levels: list[Level] = []
        now, distinct = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 0
        distinct = int(now.max()) + 1 if len(now) else 0
        turn = 0
        while distinct < len(now):
            starts = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            if len(starts) < len(now):
                level, distinct = _level(now, starts, np.diff(np.r_[starts, len(now)]), True)
                self.levels.append(level)
                now = level.symbols
                if distinct == len(now):
                    break
            best = None
            for k in range(2):
                right = _sides(distinct, 2 * turn + k)[now]
                for flip in (False, True):
                    joins = (right[:-1] == flip) & (right[1:] != flip)
                    if best is None or joins.sum() > best.sum():
                        best = joins
            turn += 1
            if not best.any():
                continue
            single = np.r_[True, ~best]  # a symbol that isn't the right one of a pair
            starts = np.flatnonzero(single)
            second = np.where(np.r_[best, False][starts], now[np.minimum(starts + 1, len(now) - 1)] + 1, 0)
            level, distinct = _level(now, starts, second, False)
            self.levels.append(level)
            now = level.symbols

    def _symbols(self, level: int) -> np.ndarray:
        return self.levels[level - 1].symbols if level else self.bottom

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from places i and j on (backwards: up to and with them) agree."""
        i, j = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        start = i.copy()
        turned = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        sign = -1 if back else 1

        def room(up: Level, at: np.ndarray) -> np.ndarray:
            """Symbols left to the edge of the parent."""
            p = up.parent[at]
            return at - up.first[p] + 1 if back else up.first[p + 1] - at

        def at_edge(up: Level, at: np.ndarray) -> np.ndarray:
            p = up.parent[at]
            return at == (up.first[p + 1] - 1 if back else up.first[p])

        def step(level: int, which: np.ndarray) -> None:
            """Over what agrees on this level: one symbol, or the shorter rest of two blocks."""
            symbols = self._symbols(level)
            up = self.levels[level] if level < len(self.levels) else None
            todo = which[symbols[i[which]] == symbols[j[which]]]
            while len(todo):
                n = np.minimum(room(up, i[todo]), room(up, j[todo])) if up is not None and up.blocks else 1
                i[todo] += sign * n
                j[todo] += sign * n
                todo = todo[symbols[i[todo]] == symbols[j[todo]]]

        for level in range(len(self.levels)):
            if not len(live):
                break
            up, symbols = self.levels[level], self._symbols(level)
            aligned = at_edge(up, i[live]) & at_edge(up, j[live])
            off = live[~aligned]
            same = symbols[i[off]] == symbols[j[off]]
            move = off[same]
            n = np.minimum(room(up, i[move]), room(up, j[move])) if up.blocks else 1
            i[move] += sign * n
            j[move] += sign * n
            good = np.r_[live[aligned], move]
            good = good[at_edge(up, i[good]) & at_edge(up, j[good])]
            a, b = up.parent[i[good]], up.parent[j[good]]
            agree = up.symbols[a] == up.symbols[b]
            rise = good[agree]
            stays = np.ones(len(turned), bool)
            stays[rise] = False
            turned[live[stays[live]]] = level
            i[rise], j[rise] = a[agree], b[agree]
            live = rise
        turned[live] = len(self.levels)
        for level in range(len(self.levels), -1, -1):
            here = np.flatnonzero(turned >= level)
            step(level, here)
            if level:
                first = self.levels[level - 1].first
                i[here], j[here] = (first[i[here] + 1] - 1, first[j[here] + 1] - 1) if back else (first[i[here]], first[j[here]])
        return (i - start) * sign


def _grid(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate stretches of the grid: (period, first point, last point), where each point and the next one could lie
    in a run. The documents stand in ``symbols`` by falling size, each behind a mark of its own."""
    ends = np.cumsum(sizes + 1)
    periods, firsts, lasts = [], [], []
    for q in range(1, int(sizes[0]) // REPEATS + 1):
        least = max(LEAST, REPEATS * q)
        k = int(np.searchsorted(-sizes, -least, side="right"))
        if not k:
            break
        x = symbols[:ends[k - 1]]
        points = x[::q]
        same = points[1:] == points[:-1]
        need = least // q - 1  # neighbours that agree in any stretch of that length
        hit = same[need - 1:].copy()
        for m in range(1, need):
            hit &= same[need - 1 - m:len(same) - m]
        at = np.flatnonzero(hit)
        for o in {1, q // 2, q - 1} - {0}:
            if len(at) and o < q:
                at = at[x[at * q + o] == x[at * q + q + o]]
        if len(at):  # all three points in one document
            at = at[np.searchsorted(ends, at * q, side="right") == np.searchsorted(ends, (at + 2) * q, side="right")]
        if len(at):
            new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            periods.append(np.full(len(new), q))
            firsts.append(at[new])
            lasts.append(at[np.r_[new[1:], len(at)] - 1])
    if not periods:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(periods), np.concatenate(firsts), np.concatenate(lasts)


def _exact(grammar: Grammar, period: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end, period) around the grid points at, at + period, ... last; several of one stretch are found one
    after another."""
    out = []
    while len(period):
        ahead = grammar.extend(at, at + period)
        behind = grammar.extend(at - 1, at - 1 + period, back=True)
        start, end = at - behind, at + period + ahead
        ok = end - start >= np.maximum(LEAST, REPEATS * period)
        out.append((start[ok], end[ok], period[ok]))
        # no run of this period goes across the word in which the two sides part
        at = at + np.maximum(1, -(-(ahead + 1) // period)) * period
        more = at <= last
        period, at, last = period[more], at[more], last[more]
    start, end, period = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # of the periods of one stretch the smallest counts: the others are its multiples
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    return start[new], end[new], period[new]


def _joined(parts: list[np.ndarray], n_names: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts with a mark of its own before each and after the last, and where each part starts."""
    marks = n_names + np.arange(len(parts) + 1)
    whole = np.concatenate([y for k, p in enumerate(parts) for y in (marks[k:k + 1], p)] + [marks[-1:]])
    return whole, np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each sequence of hashable words, by start, then period."""
    out: list[list] = [[] for _ in texts]
    long = sorted((k for k, t in enumerate(texts) if len(t) >= LEAST), key=lambda k: -len(texts[k]))
    if not long:
        return out
    names: dict = {}
    give = names.setdefault
    numbered = [np.fromiter((give(w, len(names)) for w in texts[k]), np.int64, len(texts[k])) for k in long]
    symbols, starts = _joined(numbered, len(names))
    period, first, last = _grid(symbols, np.array([len(p) for p in numbered]))
    if not len(period):
        return out
    owner = np.searchsorted(starts, first * period, side="right") - 1
    used, place = np.unique(owner, return_inverse=True)
    part, part_starts = _joined([numbered[k] for k in used], len(names))
    shift = part_starts[place] - starts[owner]
    start, end, period = _exact(Grammar(part), period, first * period + shift, last * period + shift)
    owner = np.searchsorted(part_starts, start, side="right") - 1
    for s, e, q, k in zip((start - part_starts[owner]).tolist(), (end - part_starts[owner]).tolist(), period.tolist(), owner.tolist()):
        out[long[used[k]]].append((s, e - s, q))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: the smallest start, then the smallest period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [words[k] for k in np.flatnonzero(keep)]


def planted(words: list, doc_id: int) -> list:
    """Words of the query's test rows (crc32 of the id divisible by ten): a periodic rest from a place that the id decides."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[list, object], list] | None = None) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs) of the words
    between ASCII white space; ``runs`` lists every run as (start, length, period). ``prepare`` may change a
    document's words first."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        ids = block.column(0).to_pylist()
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in block.column(1).to_pylist()]
        if prepare is not None:
            words = [prepare(w, i) for w, i in zip(words, ids)]
        found = runs_of(words)
        best = [best_run(r) for r in found]
        return {doc_id: block.column(0), "n_runs": [len(r) for r in found], "start": [b and b[0] for b in best], "length": [b and b[1] for b in best], "period": [b and b[2] for b in best],
                "exponent_milli": [b and 1000 * b[1] // b[2] for b in best],
                "runs_sha256": [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in found],
                "collapsed_sha256": [hashlib.sha256(b" ".join(collapse(w, r))).hexdigest() for w, r in zip(words, found)],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]}
    out = f"`{doc_id}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return map_documents(documents(docs, doc_id, text), text, out, run, BLOCK)


def collapse_runs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the words of each run after its first period removed and single spaces between the others; texts
    without a run stay as they are, null included."""
    def change(texts: list) -> list:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        return [t if not r else b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for t, w, r in zip(texts, words, runs_of(words))]
    return replace_texts(docs, text, change, n_chars="n_chars", limit=BLOCK)

"""Best-fit packing by minimum bin slack.

Token counts are reduced to a histogram of piece lengths, which has no more entries than a sequence has tokens. On it
the bins are chosen one after another: the longest piece left opens a bin, and a subset sum over the available lengths
(a dynamic programme on the bits of an integer) finds the fullest combination that still fits. A combination is used
for as many bins as its pieces last, so the number of different combinations doesn't grow with the number of pieces.
Pieces get a number within their length in parallel, which says their bin and place.

Null texts count as empty; an empty text is the end token alone. Repeated rows are packed each for itself. An empty
table gives no rows. Only the id and text columns are read."""
from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .common import documents, map_documents, numbered

#: White space other than space and line feed; next to any white space a text isn't cut at its spaces.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters of the Latin ranges and printable ASCII: what both libraries split alike.
_PLAIN = re.compile("[\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\n]+").fullmatch
KNOWN_PIECES = 300_000


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer's own splitting begins a new token at every single space between two visible characters, so what
    lies between such spaces is encoded once and remembered; other texts are encoded whole. With ``ranks`` (the same
    vocabulary as a rank file) new pieces of plain Latin characters are merged by rank, which costs less a call."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_rank = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not self.by_rank:
            return self._encode(pieces)
        plain = [bool(_PLAIN(p)) for p in pieces]
        rest = iter(self._encode([p for p, ok in zip(pieces, plain) if not ok]))
        return [array("I", self.by_rank(p)).tobytes() if ok else next(rest) for p, ok in zip(pieces, plain)]

    def __call__(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """``known`` keeps the ids of words after a space from call to call; grown to ``KNOWN_PIECES`` it is emptied."""
        parts: list[list[str] | None] = []
        missing: set[str] = set()
        if len(known) > KNOWN_PIECES:
            known.clear()
        for t in texts:
            if not t or "  " in t or " \n" in t or "\n " in t or t[0] == " " or t[-1] == " " or _ODD.search(t):
                parts.append(None)
                continue
            words = t.split(" ")
            parts.append(words)
            missing.update(set(words).difference(known))
        new = list(missing)
        known.update(zip(new, self._encode_pieces([" " + w for w in new])))
        whole = self._encode([t for t, p in zip(texts, parts) if p is None])
        heads = self._encode_pieces([p[0] for p in parts if p is not None])
        rest, first = iter(whole), iter(heads)
        return [next(first) + b"".join(map(known.__getitem__, p[1:])) if p is not None else next(rest) for p in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path, ranks)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): a longer document is cut, and its first piece takes what is over."""
    kind = docs.schema[doc_id].dataType.simpleString()
    tail = np.array([end_id], "<u4").tobytes()
    known: dict[str, bytes] = {}  # each task unpickles one of its own, which goes with it

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for i, ids in enumerate(encoder(tokenizer, ranks)([t or "" for t in block.column(1).to_pylist()], known)):
            ids += tail
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for name, value in zip(out, (i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))):
                    out[name].append(value)
        return {doc_id: block.column(0).take(pa.array(out.pop("row"), pa.int64())), **out}
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long", run, 2 << 20)


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations of lengths (with how often each) and the number of bins of each, until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        room = capacity - seed
        reach, full, steps = 1, (1 << (room + 1)) - 1, []
        for n in sorted((n for n in left if n <= room), reverse=True):
            for _ in range(min(left[n], room // n)):
                more = reach | reach << n & full
                if more == reach:
                    break
                steps.append((n, reach))
                reach = more
            if reach >> room:
                break
        left[seed] += 1
        sum_, chosen = reach.bit_length() - 1, Counter([seed])
        for n, before in reversed(steps):
            if not before >> sum_ & 1:
                chosen[n] += 1
                sum_ -= n
        bins = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((sorted(chosen.items(), reverse=True), bins))
    return out


def _places(plan: list) -> dict[int, np.ndarray]:
    """For each length its stretches of piece numbers: (first number, first bin, pieces in a bin, first offset)."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    first_bin = 0
    for chosen, bins in plan:
        offset = 0
        for n, k in chosen:
            out.setdefault(n, []).append((taken[n], first_bin, k, offset))
            taken[n] += bins * k
            offset += n * k
        first_bin += bins
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pack(found: DataFrame, *, doc_id: str = "doc_id", capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    places = _places(minimum_slack(counts, capacity))
    order = [F.col(doc_id), F.col("piece"), F.col("ids_crc32")]
    ranked = numbered(found, ["length"], order, "nth", F.struct(F.col(doc_id), F.col("piece")))

    def run(batches):
        for batch in batches:
            length, nth = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                at = places[n][np.searchsorted(places[n][:, 0], nth[rows], side="right") - 1]
                over = nth[rows] - at[:, 0]
                sequence[rows], offset[rows] = at[:, 1] + over // at[:, 2], at[:, 3] + over % at[:, 2] * n
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])
    kind = found.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(checkpointed(pieces(docs, tokenizer, ranks=ranks, doc_id=doc_id, text=text, end_id=end_id, capacity=capacity)), doc_id=doc_id, capacity=capacity)

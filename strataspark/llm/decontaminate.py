"""Benchmark decontamination by suffix arrays of the training documents.

A shard is a block of documents of bounded size. Its words are numbered by the benchmark's vocabulary; a suffix array
is built over the stretches of known words that are long enough to hold a match (no other suffix can share a window
with the benchmark), and every benchmark suffix is searched in it by bisection. That gives the longest verbatim match
and its place in each shard, and the range of suffixes that begin with a window.

The benchmark goes to the tasks in blocks of bounded size; with more than one block the documents pass through one
after another. Null and empty texts have no words and aren't contaminated; an item without words has no window; an
empty benchmark contaminates nothing. Repeated rows are judged each for itself. Other columns play no part."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .common import documents, filter_documents, map_documents
from .hashing import span_hashes

BENCHMARK_BYTES = 4 << 20
#: Lower-case letters, digits and all bytes of other characters stay; A-Z become lower case; the rest are spaces.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES) for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    letter = data != 32
    edge = np.diff(letter.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    first = 1 + np.cumsum([0] + [len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(start, first))
    return span_hashes(data, start, end), counts


@dataclass
class Tests:
    """A block of the benchmark: its vocabulary, the word numbers of all items with a 0 after each, and its windows."""
    vocabulary: np.ndarray
    words: np.ndarray
    at: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]


def prepare(names: list, texts: list, width: int) -> Tests:
    hashes, counts = word_hashes(texts)
    vocabulary = np.unique(hashes)
    ends = np.cumsum(counts)
    words = np.zeros(len(hashes) + len(counts) + 1, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    words[np.arange(len(hashes)) + owner] = np.searchsorted(vocabulary, hashes) + 1
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(counts)), n)
    at = (ends - counts + np.arange(len(counts)))[item] + np.arange(len(item)) - (np.cumsum(n) - n)[item]
    return Tests(vocabulary, words, at, np.minimum(counts, width)[item], item, [str(x) for x in names])


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``words`` by prefix doubling, as far as the longest stretch without a 0."""
    zero = np.flatnonzero(np.r_[0, words, 0] == 0)
    longest = int(np.diff(zero).max())
    rank, order, k = words, np.argsort(words, kind="stable"), 1
    while k < longest:
        low = np.zeros_like(rank)
        low[:-k] = rank[k:]
        order = np.lexsort((low, rank))
        change = (rank[order[1:]] != rank[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        if change.all():
            break
        rank = np.empty_like(rank)
        rank[order] = np.r_[0, np.cumsum(change)]
        k *= 2
    return order


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, at: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
    """For each test suffix, cut to its limit, the place in ``order`` before (or after) the suffixes that begin with it."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        sign = compare(words, order[np.minimum(middle, len(order) - 1)], tests, at, limit)[0]
        up = open_ & ((sign < 0) | (right & (sign == 0)))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


def compare(words: np.ndarray, place: np.ndarray, tests: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (training suffix - test suffix) within the limit, and the number of equal words before they differ or end."""
    sign, same = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    k = 0
    while len(live):
        a = words[np.minimum(place[live] + k, len(words) - 1)]
        b = tests[np.minimum(at[live] + k, len(tests) - 1)]
        sign[live] = np.sign(a - b)
        more = (a == b) & (b > 0)
        live = live[more]
        same[live] = k + 1
        k += 1
        live = live[limit[live] > k]
    return sign, same


@dataclass
class Shard:
    """Stretches of known words of a block of documents, with the text and word that each place stands for."""
    words: np.ndarray
    text: np.ndarray
    word: np.ndarray
    order: np.ndarray


def index(hashes: np.ndarray, counts: np.ndarray, tests: Tests) -> Shard | None:
    """The suffix array of the stretches of benchmark words that are as long as the shortest window, or None without any."""
    if not len(tests.at) or not len(hashes):
        return None
    place = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    number = np.where(tests.vocabulary[place] == hashes, place + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    known = number > 0
    new = known & ~(np.r_[False, known[:-1]] & np.r_[False, text[1:] == text[:-1]])
    stretch = np.cumsum(new)[known] - 1
    if not len(stretch):
        return None
    long = np.bincount(stretch) >= tests.length.min()
    keep = np.flatnonzero(known)[long[stretch]]
    if not len(keep):
        return None
    nth = np.cumsum(np.r_[True, np.diff(stretch[long[stretch]]) > 0]) - 1
    to = np.arange(len(keep)) + nth
    words, texts, at = (np.zeros(to[-1] + 2, np.int64) for _ in range(3))
    words[to], texts[to], at[to] = number[keep], text[keep], keep - (np.cumsum(counts) - counts)[text[keep]]
    return Shard(words, texts, at, suffix_array(words))


def hits(texts: list, tests: Tests) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Number of words, hit words (as booleans) and items of each text."""
    hashes, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    hit = np.zeros(len(hashes), bool)
    items: list[list[str]] = [[] for _ in texts]
    shard = index(hashes, counts, tests)
    if shard is not None:
        low = search(shard.words, shard.order, tests.words, tests.at, tests.length, False)
        high = search(shard.words, shard.order, tests.words, tests.at, tests.length, True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        place = shard.order[low[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]]
        step = np.zeros(len(hashes) + 1, np.int64)
        first = starts[shard.text[place]] + shard.word[place]
        np.add.at(step, first, 1)
        np.add.at(step, first + tests.length[which], -1)
        hit = np.cumsum(step)[:-1] > 0
        for t, i in np.unique(np.stack([shard.text[place], tests.item[which]]), axis=1).T if len(place) else ():
            items[t].append(tests.names[i])
    return counts, [hit[s:s + c] for s, c in zip(starts, counts)], items


def test_blocks(benchmark: DataFrame, item_id: str, text: str, width: int) -> Iterator[Tests]:
    """The benchmark in blocks of about ``BENCHMARK_BYTES`` of text, read one after another."""
    names: list = []
    texts: list = []
    size = 0
    for r in documents(benchmark, item_id, text).where(F.col(f"`{text}`").isNotNull()).toLocalIterator():
        if names and size + len(r[1]) > BENCHMARK_BYTES:
            yield prepare(names, texts, width)
            names, texts, size = [], [], 0
        names.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    yield prepare(names, texts, width)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    state = documents(docs, doc_id, text).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    spec = f"id {kind}, text string, n_words bigint, n_hit bigint, hit binary, items array<string>"

    def step(tests: Tests, last: bool):
        def run(block: pa.RecordBatch) -> dict:
            counts, hit, items = hits(block.column(1).to_pylist(), tests)
            bits = []
            for before, now in zip(block.column(4).to_pylist(), hit):
                bits.append(before if not now.any() else (np.packbits(now) | (np.frombuffer(before, np.uint8) if before else np.uint8(0))).tobytes())
            found = [a + b for a, b in zip(block.column(5).to_pylist(), items)]
            return {"id": block.column(0), "text": block.column(1) if not last else pa.nulls(block.num_rows, pa.string()), "n_words": counts, "n_hit": [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in bits], "hit": bits, "items": found}
        return run
    tests = list_ahead(test_blocks(benchmark, item_id, item_text, width))
    for block, last in tests:
        state = map_documents(state, "text", spec, step(block, last))
        if not last:
            state = checkpointed(state)

    names = F.array_sort(F.array_distinct("items"))
    return state.select(F.col("id").alias(doc_id), "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))


def list_ahead(items: Iterator) -> Iterator[tuple]:
    """(item, whether it is the last) for each item."""
    held = next(items)
    for x in items:
        yield held, False
        held = x
    yield held, True


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    for tests, last in list_ahead(test_blocks(benchmark, item_id, item_text, width)):
        docs = filter_documents(docs, text, lambda texts, t=tests: [not x.any() for x in hits(texts, t)[1]])
        if not last:
            docs = checkpointed(docs)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """For each benchmark suffix (item_id, at: its first word) that some document shares at least a window with: the
    longest verbatim match over all shards, in words, and its place; of equally long ones the smallest doc_id and word."""
    found = None
    for tests, last in list_ahead(test_blocks(benchmark, item_id, item_text, width)):
        def run(block: pa.RecordBatch, t=tests) -> dict:
            hashes, counts = word_hashes(block.column(1).to_pylist())
            shard = index(hashes, counts, t)
            none = {"item_id": [], "at": [], "length": [], "doc_id": [], "word": []}
            if shard is None:
                return none
            ids = np.asarray(block.column(0).cast(pa.int64()))
            whole = np.full(len(t.at), len(t.words))
            place = search(shard.words, shard.order, t.words, t.at, whole, False)
            lengths = [compare(shard.words, shard.order[np.clip(place + d, 0, len(shard.order) - 1)], t.words, t.at, whole)[1] for d in (-1, 0)]
            length = np.maximum(*lengths)
            ok = np.flatnonzero(length >= t.length)
            low = search(shard.words, shard.order, t.words, t.at[ok], length[ok], False)
            high = search(shard.words, shard.order, t.words, t.at[ok], length[ok], True)
            best = []
            for a, b in zip(low, high):
                p = shard.order[a:b]
                best.append(min(zip(ids[shard.text[p]].tolist(), shard.word[p].tolist())))
            item_start = np.searchsorted(t.item, t.item[ok])
            return {"item_id": [t.names[i] for i in t.item[ok]], "at": t.at[ok] - t.at[item_start], "length": length[ok], "doc_id": [x for x, _ in best], "word": [y for _, y in best]}
        part = map_documents(documents(docs, doc_id, text).where(F.col(f"`{doc_id}`").isNotNull()), text, "item_id string, at long, length long, doc_id long, word long", run)
        part = part if last and found is None else checkpointed(part)
        found = part if found is None else found.unionByName(part)
    top = found.groupBy("item_id", "at").agg(F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("word")).alias("w"))).alias("m"))
    return top.select("item_id", "at", F.col("m.length").alias("length"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.w")).alias("word"))


"""Exact-substring deduplication with blockwise, difference-cover suffix sorting.

Every byte covered by a ``width``-byte string that also starts earlier (smaller id, or earlier in the same document) is
removed. All windows of ``width`` bytes are put into suffix buckets by the least hash of the k-grams inside them, so
equal windows share a bucket; consecutive windows of one bucket form a run. Only buckets that hold more than one run
can hold a repeated window.

1. One pass over the documents makes the runs (bucket, hash of the run's bytes, place). Runs that are equal as a whole
   are settled by their hashes: within a block of documents before anything is shuffled, then over all blocks.
2. Of buckets in which different runs are left, the bytes are fetched, and the suffixes of one set of buckets after
   another are sorted: by bucket and first bytes, and ties by the ranks of a precomputed difference-cover sample.
   Neighbours that agree in ``width`` bytes are equal windows; all but the first place are marked.
3. A bucket with very many different runs is split by the hash of its windows, whose first places are plain minima.

Memory in a task follows the block size, not the bucket or the document. Null texts count as empty; texts shorter than
``width`` bytes lose nothing. Rows with the same id are taken as one document, and rows
without an id neither lose bytes nor count as earlier. Only the id and text columns are read."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed, drop_folder, scratch_dir, ship_code
from .common import documents, map_documents, schema_of
from .hashing import BASE, TABLE, mix, powers
from .minhash import FILTER_BITS, _bit_filter

GRAM, MAX_RUN, PIECE, HOT_RUNS, SORT_BYTES = 24, 256, 1 << 20, 4096, 1 << 20
RUN_COST = 100
PERIOD = 16
#: A difference cover modulo 16.
COVER = (0, 1, 2, 5, 8)
PRIME = np.uint64(BASE)


def _shift_table() -> np.ndarray:
    """For each pair of residues the least shift that takes both into the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


SHIFT = _shift_table()


def _slide(x: np.ndarray, w: int, fn) -> np.ndarray:
    """fn over x[i:i + w] for every i, by doubling."""
    have, out = 1, x
    while 2 * have <= w:
        out = fn(out[:-have], out[have:])
        have *= 2
    return fn(out[:len(x) - w + 1], out[w - have:]) if have < w else out


def runs(ids: np.ndarray, texts: list[bytes], width: int) -> dict[str, np.ndarray]:
    """Runs of windows (bucket, print, id, start, size, twice): ``twice`` tells that the run may repeat inside itself."""
    out: list[tuple] = []
    pieces = [(i, a, min(len(t) - width + 1 - a, PIECE)) for i, t in enumerate(texts) for a in range(0, len(t) - width + 1, PIECE)]
    k = 0
    while k < len(pieces):
        held, size = [], 0
        while k < len(pieces) and (not held or size + pieces[k][2] <= PIECE):
            held.append(pieces[k])
            size += pieces[k][2] + width - 1
            k += 1
        out.append(_runs(ids, texts, held, width))
    names = ("bucket", "print", "id", "start", "size", "twice")
    return {n: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i, n in enumerate(names)}


def _runs(ids: np.ndarray, texts: list[bytes], held: list[tuple[int, int, int]], width: int) -> tuple:
    data = np.frombuffer(b"".join(texts[i][a:a + n + width - 1] for i, a, n in held), np.uint8)
    w = width - GRAM + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * powers(len(data), BASE), out=sums[1:])
        inverse = powers(len(data) + 1, pow(BASE, -1, 1 << 64))
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(data) - GRAM + 1])
        least = _slide(grams, w, np.minimum)
        sizes = np.array([n for _, _, n in held], np.int64)
        firsts = np.cumsum(sizes + width - 1) - (sizes + width - 1)
        valid = np.zeros(len(least) + 1, bool)
        for a, n in zip(firsts, sizes):
            valid[a:a + n] = True
        valid = valid[:-1]
        new = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
        start = np.flatnonzero(new)
        close = np.flatnonzero(valid & ~np.r_[valid[1:] & (least[1:] == least[:-1]), False]) + 1
        long = close - start > MAX_RUN
        if long.any():
            parts = -(-(close - start) // MAX_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, close = np.repeat(start, parts) + nth * MAX_RUN, np.minimum(np.repeat(start, parts) + (nth + 1) * MAX_RUN, np.repeat(close, parts))
        end = close + width - 1
        prints = mix((sums[end] - sums[start]) * inverse[start] + (close - start).astype(np.uint64))
        # places of least k-grams; two of one value near each other may make a run repeat inside itself
        padded = np.r_[np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]
        place = np.flatnonzero(grams == _slide(padded, w, np.maximum))
        value = grams[place]
        pair = np.flatnonzero(value[1:] == value[:-1])
        twice = np.zeros(len(start), bool)
        if len(pair):
            # runs whose bytes hold both places: those that begin at or before the first and end after the second
            last = np.searchsorted(start, place[pair], side="right") - 1
            for back in range(3):
                r = np.maximum(last - back, 0)
                ok = (start[r] <= place[pair]) & (place[pair + 1] <= close[r] - 1 + w - 1) & (least[start[r]] == value[pair])
                twice[r[ok]] = True
    which = np.searchsorted(firsts, start, side="right") - 1
    doc = np.array([i for i, _, _ in held], np.int64)[which]
    at = start - firsts[which] + np.array([a for _, a, _ in held], np.int64)[which]
    return least[start].astype(np.int64), prints.astype(np.int64), ids[doc], at, close - start, twice


def suffix_order(data: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``data`` at ``at`` by bucket and then by at least 128 bytes.

    The cover sample is ranked first (16 bytes, then 32, 64 and 128 by doubling, as a place and the place 16 further on
    are both in it). Suffixes are sorted by their first 16 bytes; those that tie are split around a middle one of
    their group, all groups at once, by the ranks at the shift that takes both into the sample."""
    wide = np.r_[data, np.zeros(8 * PERIOD + PERIOD + 16, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(wide, 8).copy().view(">u8").ravel().astype(np.uint64)
    n = len(data) + 8 * PERIOD + PERIOD
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 8 * PERIOD, np.int64)

    def ranked(high, low):
        order = np.lexsort((low, high))
        change = np.r_[False, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        got = np.empty(len(order), np.int64)
        got[order] = np.cumsum(change) + 1
        return got
    last = len(word) - 9
    rank[sample] = ranked(word[np.minimum(sample, last)], word[np.minimum(sample + 8, last)])
    for step in (PERIOD, 2 * PERIOD, 4 * PERIOD):
        rank[sample] = ranked(rank[sample], rank[sample + step])
    order = np.lexsort((word[at + 8], word[at], bucket))
    a = at[order]
    same = np.r_[False, (bucket[order][1:] == bucket[order][:-1]) & (word[a][1:] == word[a][:-1]) & (word[a + 8][1:] == word[a + 8][:-1])]
    group = np.cumsum(~same) - 1
    live = np.flatnonzero(same | np.r_[same[1:], False])
    while len(live):
        # live: places in order, in runs of one group each
        g = group[live]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[head, len(live)])
        pivot = order[live[np.repeat(head + size // 2, size)]]
        mine = order[live]
        d = SHIFT[at[mine] % PERIOD, at[pivot] % PERIOD]
        sign = np.sign(rank[at[mine] + d] - rank[at[pivot] + d])
        to = np.lexsort((sign, g))
        order[live] = mine[to]
        sign, g = sign[to], g[to]
        new = np.r_[True, (g[1:] != g[:-1]) | (sign[1:] != sign[:-1])]
        fresh = np.cumsum(new) - 1
        count = np.bincount(fresh)
        more = (count[fresh] > 1) & (sign != 0)
        group = group.copy()
        group[live] = fresh
        live = live[more]
    return order


def repeated(bucket: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (id, start, end) of bytes covered by windows of these runs that aren't the first of their kind."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw], np.int64)
    offset = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(raw)), size)
    nth = np.arange(len(run)) - (np.cumsum(size) - size)[run]
    at = offset[run] + nth
    order = suffix_order(data, at, bucket[run])
    word = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8).copy().view(np.uint64).ravel()
    a = at[order]
    equal = np.r_[False, bucket[run[order]][1:] == bucket[run[order]][:-1]]
    for off in [*range(0, width - 7, 8), width - 8]:
        x = word[a + off]
        equal[1:] &= x[1:] == x[:-1]
    _, doc = np.unique(ids, return_inverse=True)
    place = (doc[run] << 40) + start[run] + nth
    kind = np.cumsum(~equal) - 1
    first = np.minimum.reduceat(place[order], np.flatnonzero(~equal))
    marked = np.zeros(len(run), bool)
    marked[order] = place[order] != first[kind]
    where = np.flatnonzero(marked)
    if not len(where):
        return ids[:0], start[:0], start[:0]
    cut = np.r_[True, (np.diff(where) != 1) | (run[where][1:] != run[where][:-1])]
    head, tail = where[cut], where[np.r_[cut[1:], True]]
    return ids[run[head]], start[run[head]] + nth[head], start[run[tail]] + nth[tail] + width


RUNS = "kind int, bucket long, print long, id long, start long, size long"
MARK, RUN, TWICE = 0, 1, 2


def _first_pass(docs: DataFrame, width: int) -> DataFrame:
    """Runs of all documents, less those equal to an earlier run of the same block, which are marks (start, size in bytes)."""
    def run(block: pa.RecordBatch) -> dict:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in block.column(1).to_pylist()]
        r = runs(np.asarray(block.column(0)), texts, width)
        order = np.lexsort((r["start"], r["id"], r["print"], r["bucket"]))
        r = {n: x[order] for n, x in r.items()}
        again = np.r_[False, (r["bucket"][1:] == r["bucket"][:-1]) & (r["print"][1:] == r["print"][:-1])] if len(order) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again)))) if len(again) else np.zeros(0, np.int64)
        echo = again & (r["id"] == r["id"][head]) & (r["start"] == r["start"][head])
        keep = ~again | ~echo
        kind = np.where(again, MARK, np.where(r["twice"], TWICE, RUN))
        # marks of neighbouring runs of a document become one
        m = np.flatnonzero(again & ~echo)
        ids, a, b = _merged(r["id"][m], r["start"][m], r["start"][m] + r["size"][m] + width - 1)
        k = np.flatnonzero(keep & ~again)
        spread = mix(ids.astype(np.uint64) + np.uint64(1)).astype(np.int64)
        return {"kind": np.r_[kind[k], np.full(len(ids), MARK)], "bucket": np.r_[r["bucket"][k], spread], "print": np.r_[r["print"][k], np.zeros(len(ids), np.int64)],
                "id": np.r_[r["id"][k], ids], "start": np.r_[r["start"][k], a], "size": np.r_[r["size"][k], b - a]}
    return map_documents(docs, "text", RUNS, run, 4 << 20)


def _merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each id without overlap."""
    if not len(ids):
        return ids.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    _, doc = np.unique(ids, return_inverse=True)
    far = np.maximum.accumulate((doc << 40) + end)
    cut = np.r_[True, (doc[1:] << 40) + start[1:] > far[:-1]]
    head = np.flatnonzero(cut)
    return ids[head], start[head], far[np.r_[head[1:], len(ids)] - 1] & ((1 << 40) - 1)


def _settle(found: DataFrame, width: int) -> DataFrame:
    """Marks, and of each bucket with several different runs (or a run that may repeat inside) the first of each kind."""
    schema = schema_of(RUNS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first run of the (bucket, print) that was read last, as a row
        pending = None  # the last run kept, until it is known whether its bucket has another
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(6)]
            if last is not None:
                cols = [np.r_[x, y] for x, y in zip(last, cols)]
            kind, bucket, print_, ids, start, size = cols
            new = np.r_[True, (kind[1:] == MARK) | (kind[:-1] == MARK) | (bucket[1:] != bucket[:-1]) | (print_[1:] != print_[:-1])]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ((ids != ids[head]) | (start != start[head]))
            mark = (kind == MARK) | again
            first = np.flatnonzero(new & (kind != MARK))
            if last is not None and len(first) and first[0] == 0 and kind[0] != MARK:
                first = first[1:]  # it is the pending one
            rows = np.flatnonzero(mark)
            if last is not None and len(rows) and rows[0] == 0:
                rows = rows[1:]  # a mark that has been passed on
            out = [[np.full(len(rows), MARK), bucket[rows], print_[rows], ids[rows], start[rows], np.where(kind[rows] == MARK, size[rows], size[rows] + width - 1)]]
            kept = [np.r_[p, x[first]] for p, x in zip(pending, cols)] if pending is not None else [x[first] for x in cols]
            if len(kept[0]):
                shared = np.zeros(len(kept[0]), bool)
                same = kept[1][1:] == kept[1][:-1]
                shared[1:] |= same
                shared[:-1] |= same
                shared |= kept[0] == TWICE
                if pending is not None and pending_shared:
                    shared[0] = True
                pending, pending_shared = [x[-1:] for x in kept], bool(shared[-1])
                out.append([x[:-1][shared[:-1]] for x in kept])
            last = [x[head[-1]:head[-1] + 1] for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if pending is not None and pending_shared:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(pending, arrow)], schema=arrow)
    ship_code(found.sparkSession)
    return found.repartition("bucket").sortWithinPartitions("bucket", "print", "id", "start").mapInArrow(run, schema)


def _fetch(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the runs that are left; of hot buckets one row for each window, with two hashes of it."""
    spec = "hot boolean, bucket long, print long, id long, start long, size long, raw binary"
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("hot", "bucket", "start", "size")).alias("runs"))
    rows = _passing(docs, wanted.select("id")).join(lists, "id").select("id", "text", "runs")

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {n: [] for n in ("hot", "bucket", "print", "id", "start", "size", "raw")}

        def add(*values):
            for n, v in zip(out, values):
                out[n].append(v)
        for i, text, wants in zip(*(c.to_pylist() for c in block.columns)):
            text = text.encode("utf-8", "surrogatepass")
            for r in wants:
                a, n = r["start"], r["size"]
                raw = text[a:a + n + width - 1]
                if not r["hot"]:
                    add(False, r["bucket"], 0, i, a, n, raw)
                    continue
                for k in range(n):
                    d = hashlib.blake2b(raw[k:k + width], digest_size=16).digest()
                    add(True, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i, a + k, 1, None)
        return out
    return map_documents(rows, "text", spec, run, 2 << 20)


def _passing(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Documents whose id passes (or fails) a filter of fixed size that lets all of ``ids`` through."""
    bits = _bit_filter(ids)
    rows = docs.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))

    def run(batches):
        for b in batches:
            h = np.asarray(b.column(2))
            hit = (bits[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)
            yield b.filter(pa.array(hit if inside else ~hit)).select([0, 1])
    ship_code(docs.sparkSession)
    return rows.mapInArrow(run, docs.schema)


def _sorted_marks(rows: DataFrame, width: int) -> DataFrame:
    """Marks (id, start, end) from runs with their bytes; a task holds one set of whole buckets at a time."""
    schema = schema_of("id long, start long, end long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(parts):
            t = pa.Table.from_batches(parts)
            ids, a, b = repeated(*(np.asarray(t[n]) for n in ("bucket", "id", "start", "size")), t["raw"].to_pylist(), width)
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (ids, a, b)], names=["id", "start", "end"])
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.r_[not held or bucket[0] != held[-1].column(0)[-1].as_py(), bucket[1:] != bucket[:-1]])
            at = 0
            # suffix array of the windows, and the bytes with what each run costs besides them
            reach = np.cumsum(np.asarray(batch.column(3)) * 4 + np.asarray(pc.binary_length(batch.column(4)), np.int64) + RUN_COST)
            base = 0
            for e in edge:
                if size + (reach[e - 1] if e else 0) - base >= SORT_BYTES:
                    if e > at:
                        held.append(batch.slice(at, e - at))
                    if held:
                        yield done(held)
                    held, size, at, base = [], 0, e, reach[e - 1] if e else 0
            held.append(batch.slice(at))
            size += int(reach[-1] - base)
        if held:
            yield done(held)
    ship_code(rows.sparkSession)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def repeated_stretches(docs: DataFrame, width: int = 100, scratch: list | None = None) -> DataFrame:
    """Marks (id, start, end) over documents (id, text): every removed byte lies in one at least. The marks are read from
    two folders, which are added to ``scratch`` and may be dropped once the marks are stored."""
    spark, docs = docs.sparkSession, docs.where("id is not null")
    folder = f"{scratch_dir(spark)}/runs"
    _settle(_first_pass(docs, width), width).write.parquet(folder)
    settled = spark.read.parquet(folder)
    whole = settled.where(F.col("kind") == MARK).select("id", "start", (F.col("start") + F.col("size")).alias("end"))
    left = settled.where(F.col("kind") != MARK)
    hot = left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT_RUNS).select("bucket", F.lit(True).alias("h"))
    wanted = left.join(hot, "bucket", "left").select(F.coalesce("h", F.lit(False)).alias("hot"), "bucket", "id", "start", "size")
    bytes_ = f"{scratch_dir(spark)}/bytes"
    _fetch(docs, wanted, width).write.parquet(bytes_)
    fetched = spark.read.parquet(bytes_)
    if scratch is not None:
        scratch += [folder, bytes_]
    sorted_ = _sorted_marks(fetched.where("not hot").select("bucket", "id", "start", "size", "raw"), width)
    windows = fetched.where("hot").select("bucket", "print", "id", "start").distinct()
    first = windows.groupBy("bucket", "print").agg(F.min(F.struct("id", "start")).alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    split = windows.join(first, ["bucket", "print"]).where("struct(id, start) != m").select("id", "start", (F.col("start") + width).alias("end"))
    return whole.unionByName(sorted_).unionByName(split)


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    plain = documents(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    scratch: list[str] = []
    marks = checkpointed(repeated_stretches(plain, width, scratch).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("marks")))
    for folder in scratch:
        drop_folder(docs.sparkSession, folder)
    spec = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {"id": block.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        found = block.column(2)
        edges, places = np.asarray(found.offsets), (np.asarray(found.values.field(0)), np.asarray(found.values.field(1)))
        for k, text in enumerate(block.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            stretches = merged(*(x[edges[k]:edges[k + 1]] for x in places))
            at, rest = 0, []
            for a, b in stretches:
                rest.append(raw[at:a])
                at = b
            rest.append(raw[at:])
            kept = b"".join(rest)
            for n, v in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), (len(raw), len(raw) - len(kept), len(stretches), hashlib.sha256(kept).hexdigest())):
                out[n].append(v)
        return out
    ids = marks.select("id")
    touched = _passing(plain, ids).join(marks, "id", "left").select("id", "text", "marks")
    others = _passing(plain, ids, inside=False).select("id", "text", F.lit(None).cast("array<struct<start: bigint, end: bigint>>").alias("marks"))
    return map_documents(touched, "text", spec, run, 2 << 20).unionByName(map_documents(others, "text", spec, run, 2 << 20)).withColumnRenamed("id", doc_id)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of marks."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.r_[new[1:], len(start)] - 1].tolist()))

"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents are posted under each (coordinate, value) of their signature. Two sets with a Jaccard similarity of at least
the threshold collide in at least ``need`` of the coordinates, but for a chance below 1e-7. So, with a document's
coordinates in the order of the length of their posting lists, both documents have a common coordinate among their
first ``n - need + 1`` (the prefix), and the long lists, which come last, are skipped unless almost all coordinates of
a document are in long lists. Documents that meet in a list are candidates; inside tasks, in blocks of bounded size,
the collisions of each pair are counted over all coordinates, pairs with ``need`` or more are retained, and these are
confirmed on full shingle sets. Only spanning links leave a task.

Empty and null texts have no shingles and are linked with nothing. Documents with equal sets are one class from the
start, however many there are. Repeated ids are taken as rows of one document. Only id and text columns are read."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .common import components, documents, map_documents, schema_of
from .hashing import BASE, mix, shingles_of

COORDINATES = 64
MISS = 1e-7
BLOCK = 512
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 22


def needed_collisions(n: int, percent: int, miss: float = MISS) -> int:
    """The most collisions that sets of similarity ``percent`` / 100 have but for a chance of ``miss``."""
    p, tail, k = percent / 100, 0.0, 0
    while True:
        tail += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if tail > miss:
            return max(1, k)
        k += 1


def _signatures(value: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Coordinate-value pairs as integers, a row for each text; rows of texts without shingles are undefined."""
    out = np.zeros((len(counts), n), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = (np.cumsum(counts) - counts)[full]
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[full, k] = (np.minimum.reduceat((value ^ factors[k]) * factors[k], first) + np.uint64(k) * np.uint64(BASE)).view(np.int64)
    return out


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, n: int = COORDINATES) -> DataFrame:
    """Rows (id, n_shingles, print1, print2, tokens): two fingerprints of the set, and its coordinate-value pairs."""
    def run(block: pa.RecordBatch) -> dict:
        value, counts = shingles_of(block.column(1).to_pylist(), width)
        first = np.cumsum(counts) - counts
        sums = np.zeros(len(value) + 1, np.uint64)
        other = sums.copy()
        with np.errstate(over="ignore"):
            np.cumsum(value, out=sums[1:])
            np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=other[1:])
            prints = [(s[first + counts] - s[first]).astype(np.int64) for s in (sums, other)]
        tokens = _signatures(value, counts, n)
        rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(counts > 0, n, 0))].astype(np.int32)), pa.array(tokens[counts > 0].ravel()))
        return {"id": block.column(0).cast(pa.int64()), "n_shingles": counts, "print1": prints[0], "print2": prints[1], "tokens": rows}
    return map_documents(documents(docs, doc_id, text), text, "id long, n_shingles long, print1 long, print2 long, tokens array<bigint>", run, 2 << 20)


def prefix_postings(classes: DataFrame, n: int, need: int) -> DataFrame:
    """Postings (id, token) of each class's prefix, from classes (id, tokens): pairs with at least ``need`` collisions share one."""
    posts = classes.select("id", F.explode("tokens").alias("token"))
    lengths = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = posts.join(lengths, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posts"))
    # values that no one else has fill the prefix first
    room = F.size("posts") - (need - 1)
    return common.where(room > 0).select("id", F.explode(F.slice("posts", F.lit(1), room)).alias("p")).select("id", F.col("p.token").alias("token"))


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size (2^22 bits) that lets all ``ids`` through and, while it isn't full, few others."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(h.alias("h")).groupBy(F.shiftright("h", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 32 as int)))").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in rows:
        out[r.w] = r.bits
    return out


def _sets(docs: DataFrame, wanted: np.ndarray, doc_id: str, text: str, width: int) -> DataFrame:
    """Full shingle sets (id, set) of the documents that pass the filter."""
    rows = documents(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))

    def run(block: pa.RecordBatch) -> dict:
        h = np.asarray(block.column(2))
        block = block.filter(pa.array((wanted[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
        value, counts = shingles_of(block.column(1).to_pylist(), width)
        ends = np.cumsum(counts)
        return {"id": block.column(0), "set": [value[e - c:e].tobytes() for e, c in zip(ends, counts)]}
    return map_documents(rows, "text", "id long, set binary", run, 2 << 20)


def by_group(df: DataFrame, keys: list[str], out: str, fn: Callable[[pa.Table], dict]) -> DataFrame:
    """``fn`` on all rows of each group; groups must be bounded. Rows arrive in order of their keys."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema_of(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            got = fn(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            rows = list(zip(*cols))
            start = 0
            for i, key in enumerate(rows):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield done()
                    held, start, last = [], i, key
            if start < len(rows):
                held.append(batch.slice(start))
        if held:
            yield done()
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema_of(out))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    out = np.zeros((len(left), len(right)), np.float64)
    if len(left) * len(right) <= 64:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for value, owner in sides:
        at = np.searchsorted(shared, value)
        ok = np.zeros(len(value), bool) if not len(shared) else shared[np.minimum(at, len(shared) - 1)] == value
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], owner[ok][order]))
    for lo in range(0, len(shared), 4096):
        part = []
        for (at, owner), size in zip(places, out.shape):
            a, b = np.searchsorted(at, (lo, lo + 4096))
            m = np.zeros((size, min(4096, len(shared) - lo)), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 x intersection reaches ``percent`` x union, for each pair of sets."""
    both = _overlaps(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return (100 * both >= percent * union) & (both > 0)


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph in which a[i] and b[j] (places in ids) are joined where links[i, j]."""
    lab = np.arange(len(ids))
    while True:
        low = np.where(links, lab[b][None, :], len(ids)).min(1, initial=len(ids))
        new = lab.copy()
        np.minimum.at(new, a, low)
        high = np.where(links, new[a][:, None], len(ids)).min(0, initial=len(ids))
        np.minimum.at(new, b, high)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    move = lab != np.arange(len(ids))
    return ids[move], ids[lab[move]]


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Coordinates in which each signature on the left has the value of each on the right."""
    out = np.zeros((len(left), len(right)), np.int16)
    for k in range(left.shape[1]):
        out += left[:, k][:, None] == right[:, k][None, :]
    return out


def _compare(rows: DataFrame, percent: int, need: int) -> DataFrame:
    """Spanning links (a, b) of groups of rows (k1, k2, k3, side, id, set, tokens); side 0 is compared with side 1, side 2
    with all. Pairs with fewer than ``need`` collisions are dropped before their sets are compared."""
    def run(group: pa.Table) -> dict:
        side = np.asarray(group["side"])
        ids = np.asarray(group["id"])
        sets = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        tokens = group["tokens"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = (collisions(tokens[a], tokens[b]) >= need) & (ids[a][:, None] != ids[b][None, :])
        rows_, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        if len(rows_):
            links[np.ix_(rows_, cols)] &= linked([sets[i] for i in a[rows_]], [sets[i] for i in b[cols]], percent)
        x, y = _forest(ids, a, b, links)
        return {"a": x, "b": y}
    return by_group(rows, ["k1", "k2", "k3"], "a long, b long", run)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, n: int = COORDINATES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): documents linked by a similarity of ``percent`` / 100 or more."""
    need = needed_collisions(n, percent)
    signed = checkpointed(signatures(docs, doc_id=doc_id, text=text, width=width, n=n))
    prints = ["n_shingles", "print1", "print2"]
    classes = signed.where("n_shingles > 0").groupBy(*prints).agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    posts = checkpointed(prefix_postings(classes, n, need))
    hubs = posts.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("df")).where("df > 1")
    coarse = components(posts.join(hubs, "token").select(F.col("id").alias("a"), F.col("hub").alias("b")), checkpointed)
    found = coarse.withColumnRenamed("node", "id").join(classes.select("id", "n_shingles", "tokens"), "id")
    sizes = found.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = found.join(sizes, "label").select("id", F.col("label").alias("cluster"), "blocks", "tokens").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    links = _cluster_links(docs, checkpointed(members), posts, percent, need, doc_id, text, width)
    joined = components(links, checkpointed)
    found = classes.select(*prints, F.col("id").alias("class")).join(joined.withColumnRenamed("node", "class"), "class", "left").select(*prints, F.coalesce("label", "class").alias("component"))
    full = signed.where("n_shingles > 0").select("id", *prints).join(found, prints).select("id", "n_shingles", F.col("component").alias("component_id"))
    none = signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.unionByName(none).select(F.col("id").alias(doc_id), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _cluster_links(docs: DataFrame, members: DataFrame, posts: DataFrame, percent: int, need: int, doc_id: str, text: str, width: int) -> DataFrame:
    """Links inside candidate clusters. A cluster of one block is compared in one task. A larger one is first compared
    with its hubs (up to ``BLOCK / 4`` members with many postings), block by block; only members that this leaves
    outside the component of the first hub are then compared with the whole cluster, again block by block."""
    sets = checkpointed(_sets(docs, _bit_filter(members.select("id")), doc_id, text, width).dropDuplicates(["id"]).join(members, "id"))
    small = sets.where("blocks = 1").select(F.col("cluster").alias("k1"), F.lit(-1).alias("k2"), F.lit(0).alias("k3"), F.lit(2).alias("side"), "id", "set", "tokens")
    large = sets.where("blocks > 1")
    if not large.take(1):
        return checkpointed(_compare(small, percent, need))
    hubs = checkpointed(_top_hubs(_weights(members.where("blocks > 1"), posts)))          # read three times
    hub_sets = large.join(hubs, "id").select("cluster", "blocks", "id", "set", "tokens", "first")
    ends = (hub_sets.select(F.col("cluster").alias("k1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k2"), F.lit(0).alias("k3"), F.lit(0).alias("side"), "id", "set", "tokens")
            .unionByName(large.select(F.col("cluster").alias("k1"), F.col("block").alias("k2"), F.lit(0).alias("k3"), F.lit(1).alias("side"), "id", "set", "tokens")))
    first = checkpointed(_compare(small.unionByName(ends), percent, need))
    label = components(first, checkpointed)
    state = members.where("blocks > 1").join(label, F.col("id") == F.col("node"), "left").select("id", "cluster", F.coalesce("label", "id").alias("label"))
    main = state.join(hubs.where("first").select("id"), "id").select("cluster", F.col("label").alias("main"))
    rest = state.join(main, "cluster").where("label != main").select("id", "cluster")
    count = rest.join(sets.select("id", F.octet_length("set").alias("bytes")), "id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("rest_blocks"))
    todo = checkpointed(large.join(count, "cluster").join(rest.select("id", F.lit(True).alias("out")), "id", "left").withColumn("rest_block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("rest_blocks")).cast("int")))
    left = todo.where("out").select(F.col("cluster").alias("k1"), F.col("rest_block").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k3"), F.lit(0).alias("side"), "id", "set", "tokens")
    right = todo.select(F.col("cluster").alias("k1"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("k2"), F.col("block").alias("k3"), F.lit(1).alias("side"), "id", "set", "tokens")
    return checkpointed(first.unionByName(_compare(left.unionByName(right), percent, need)))


def _weights(members: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, cluster, w): postings are counted before they meet the members, so that the join has a row for each member."""
    return members.join(posts.groupBy("id").agg(F.count("*").alias("w")), "id").select("id", "cluster", "w")


def _top_hubs(weight: DataFrame) -> DataFrame:
    """The heaviest members of each cluster (id, first): of each of ``BLOCK / 4`` slots by hash, the one with the most postings."""
    slot = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(BLOCK // 4))
    best = weight.groupBy("cluster", slot.alias("slot")).agg(F.max(F.struct("w", "id")).alias("b"))
    top = best.groupBy("cluster").agg(F.max("b").alias("t"))
    return best.join(top, "cluster").select(F.col("b.id").alias("id"), (F.col("b") == F.col("t")).alias("first"))

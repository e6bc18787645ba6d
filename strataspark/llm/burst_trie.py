"""A prefix trie of conversations, built as burst tries.

A turn is the digest of its role and text; a conversation is the sequence of its turns. Sequences are cut into pieces
of at most ``PIECE`` turns, and equal pieces behind equal beginnings are one row from then on, with the number and the
smallest id of their conversations. A container holds the suffixes below one trie head. Containers of more than
``LIMIT`` turns burst: the stretch that all their suffixes share becomes a chain of nodes, and each suffix goes on to the
container of its next turn. What remains is sorted by container and suffix and swept once, with the open path as the only
state; a container's sums are added to the heads above it. The longest piece and the fullest container are bounded, so no
conversation, shared beginning or group of copies lies in one task; a conversation of very many turns costs one
round of small jobs for each ``PIECE`` of them.

Turns are ordered by ``turn`` (null first), equal turns by their digests; those of one conversation within 4,096 numbers
are ordered in one task. A null role or text is empty. Rows without a conversation id belong to no conversation.
Repeated rows are turns of their own. An empty table gives no node. Only conv_id, turn, role and text are read."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed, ship_code
from .common import documents, schema_of

PIECE = 1 << 14
LIMIT = 1 << 15
#: Hex digits of a turn's digest.
WIDE = 32
RANGE_BITS = 12
CHUNK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
ROOT = ""
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, tail string"
SWEPT = f"cid string, path array<string>, top boolean, {NODE}"
ROWS = 1 << 15


def turns(table: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, tid, words): each conversation's turns in order, numbered from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = documents(table, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("tid"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = checkpointed(rows.withColumn("part", F.coalesce(F.shiftright(F.col("turn").cast("long"), RANGE_BITS), F.lit(-(1 << 62)))))
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("pos", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "tid")) - 1)
    return inside.join(sizes.select("conv_id", "part", before.alias("before")), ["conv_id", "part"]).select("conv_id", (F.col("pos") + F.col("before")).cast("long").alias("pos"), "tid", "words")


def shared_starts(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The query's test conversations (turns, members): each takes its first h = crc32(id) mod ``most`` turns from the
    conversation at the ``every`` below it, and the rest from itself."""
    rows = checkpointed(rows)
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("size")).withColumn("base", F.expr(f"conv_id - conv_id % {every}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    ids = checkpointed(ids.alias("a").join(ids.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("p")))
    own = rows.join(ids, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "tid", "words")
    first = rows.where(f"conv_id % {every} = 0 AND pos < {most - 1}").withColumnRenamed("conv_id", "base").join(ids, "base").where("pos < h").select("conv_id", "pos", "tid", "words")
    return own.unionByName(first), ids.select("conv_id")


def prefix_trie(rows: DataFrame, members: DataFrame, piece: int = PIECE, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ``rows``: (conv_id, pos, tid, words), gapless from 0; ``members``: every conversation's id, once."""
    ship_code(rows.sparkSession)
    cut = rows.groupBy("conv_id", F.expr(f"pos div {piece}").alias("layer")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("t"))
    cut = cut.select("conv_id", "layer", F.array_join(F.transform("t", lambda x: x["tid"]), "").alias("seq"), F.transform("t", lambda x: x["words"]).alias("words"))
    cut = checkpointed(cut)
    deepest = cut.agg(F.max("layer")).first()[0]
    last = F.lit(True) if not deepest else F.col("layer") == F.max("layer").over(W.partitionBy("conv_id"))
    cut = cut.withColumn("last", last)
    layers, ends, open_ = [], [members.join(cut.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(ROOT).alias("tail"), "conv_id")], None
    for k in range(0 if deepest is None else deepest + 1):
        here = cut.where(F.col("layer") == k)
        here = here.withColumn("head", F.lit(ROOT)) if open_ is None else here.join(open_, "conv_id")
        here = checkpointed(here.withColumn("tail", F.md5(F.concat("head", "seq"))))
        same = here.groupBy("head", "tail").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.min("conv_id").alias("m"), F.count("*").alias("n"), F.max("last").alias("ended"))
        layers.append(checkpointed(same))
        ends.append(here.where("last").select("tail", "conv_id"))
        open_ = here.where("NOT last").select("conv_id", F.col("tail").alias("head"))
    nodes, below = [], None
    lowest = members.agg(F.min("conv_id")).first()[0]
    for k in reversed(range(len(layers))):
        state = layers[k].withColumn("key", F.col("tail")).withColumn("tail", F.expr("if(ended, tail, null)"))
        state = state.join(layers[k - 1].select(F.col("tail").alias("head"), F.col("m").alias("pm")), "head") if k else state.withColumn("pm", F.lit(lowest).cast("long"))
        if below is not None:
            state = state.join(below.select(F.col("cid").alias("key"), F.col("n_children").alias("xc"), F.col("n_leaves").alias("xl"), F.col("saved_tokens").alias("xs")), "key", "left")
        else:
            state = state.select("*", *(F.lit(0).cast("long").alias(c) for c in ("xc", "xl", "xs")))
        state = state.select(F.col("head").alias("cid"), F.array().cast("array<string>").alias("path"), "pm", F.lit(k * piece).cast("long").alias("d0"), F.lit(None).cast("int").alias("hw"), "m", "n", "seq", "words", "tail",
                             *(F.coalesce(c, F.lit(0)).alias(c) for c in ("xc", "xl", "xs")))
        found, below = _layer(state, limit)
        nodes.append(found)
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    totals = below if below is not None else top.select(F.lit(ROOT).alias("cid"), *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    top = top.withColumn("cid", F.lit(ROOT)).join(totals.select("cid", "n_children", "n_leaves", "saved_tokens"), "cid", "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(ROOT).alias("tail"))
    whole = top
    for x in nodes:
        whole = whole.unionByName(x)
    listed = ends[0]
    for x in ends[1:]:
        listed = listed.unionByName(x)
    named = whole.where("tail IS NOT NULL").join(_ends(listed), "tail", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))).drop("tail")
    return named.unionByName(whole.where("tail IS NULL").drop("tail").withColumn("ends_sha256", F.lit(NONE)))


def _ends(listed: DataFrame) -> DataFrame:
    """(tail, ends_sha256): the digest of the ids that end at a node, ascending and comma-joined. Ids are joined in ranges
    first; a task digests the ranges of a node as they come."""
    ranges = listed.groupBy("tail", F.shiftright("conv_id", CHUNK_BITS).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    arrow = to_arrow_schema(schema_of("tail string, ends_sha256 string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, ([], [])
        for batch in batches:
            for tail, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tail == now:
                    digest.update(b",")
                else:
                    if digest is not None:
                        out[0].append(now)
                        out[1].append(digest.hexdigest())
                    now, digest = tail, hashlib.sha256()
                digest.update(ids.encode())
            if len(out[0]) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=arrow)
                out = ([], [])
        if digest is not None:
            out[0].append(now)
            out[1].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=arrow)
    return ranges.repartition("tail").sortWithinPartitions("tail", "part").select("tail", "ids").mapInArrow(run, schema_of("tail string, ends_sha256 string"))


def _layer(state: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the heads of one layer, and each head's totals (cid, n_children, n_leaves, saved_tokens)."""
    ready, burst = [], []
    while True:
        state = checkpointed(state)
        full = state.groupBy("cid").agg(F.count("*").alias("rows"), F.sum(F.greatest(F.size("words"), F.lit(1))).alias("turns")).where((F.col("turns") > limit) & (F.col("rows") > 1)).select("cid")
        full = checkpointed(full)
        if not full.take(1):
            ready.append(state)
            break
        ready.append(state.join(full, "cid", "left_anti"))
        heavy = state.join(full, "cid")
        facts = checkpointed(_shared(heavy.groupBy("cid").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min_by("words", "seq").alias("words"), F.min("m").alias("low"), F.sum("n").alias("total"), F.first("path").alias("path"), F.min("pm").alias("pm"),
                                                               F.first("d0").alias("d0"), F.first("hw").alias("hw"))))
        moved = heavy.join(facts.select("cid", F.size("chain").alias("k"), F.expr("if(hw IS NULL AND size(chain) = 0, pm, low)").alias("low")), "cid")
        at_end = F.length("seq") == F.col("k") * WIDE
        burst.append(facts.join(moved.where(at_end).select("cid", "tail"), "cid", "left"))
        step = (F.col("k") + 1) * WIDE
        state = moved.where(~at_end).select(F.md5(F.concat("cid", F.substring("seq", F.lit(1), step))).alias("cid"), F.array_append("path", F.col("cid")).alias("path"), F.col("low").alias("pm"), (F.col("d0") + F.col("k") + 1).alias("d0"),
                                            F.expr("words[k]").alias("hw"), "m", "n", F.substring("seq", step + 1, F.length("seq")).alias("seq"), F.expr("slice(words, k + 2, size(words))").alias("words"), "tail", "xc", "xl", "xs")
    whole = ready[0]
    for x in ready[1:]:
        whole = whole.unionByName(x)
    swept = checkpointed(_sweep(whole))
    heads, nodes = swept.where("cid IS NOT NULL"), swept.where("NOT top").drop("cid", "path", "top")
    totals = heads.where("top").select("cid", "n_children", "n_leaves", "saved_tokens")
    if not burst:
        return nodes, totals
    grown = burst[0]
    for x in burst[1:]:
        grown = grown.unionByName(x)
    grown = checkpointed(grown)
    # what each container adds to the heads on its path
    own = grown.select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("total") - 1) * (F.coalesce("hw", F.lit(0)) + F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x))).alias("saved_tokens"))
    parts = heads.where("NOT top").select("path", "n_leaves", "saved_tokens").unionByName(own).where(F.size("path") > 0)
    sums = parts.select(F.explode("path").alias("cid"), "n_leaves", "saved_tokens").groupBy("cid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    kids = parts.groupBy(F.element_at("path", -1).alias("cid")).agg(F.count("*").alias("kids"))
    known = checkpointed(grown.join(sums, "cid").join(kids, "cid"))
    at_top = F.col("hw").isNull()
    more = known.where(at_top).select("cid", F.when(F.size("chain") > 0, 1).otherwise(F.col("kids")).cast("long").alias("n_children"), "n_leaves",
                                      (F.col("saved_tokens") + (F.col("total") - 1) * F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x)).alias("saved_tokens"))
    return nodes.unionByName(_chains(known)), totals.unionByName(more)


def _shared(facts: DataFrame) -> DataFrame:
    """``chain``: the words of the turns that all suffixes of a container share, from its first and last suffix in order."""
    out = "cid string, chain array<int>, low long, total long, path array<string>, pm long, d0 long, hw int"
    arrow = to_arrow_schema(schema_of(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["chain"] = r["words"][:_agree(r["lo"], r["hi"])]
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in arrow} for r in rows], schema=arrow)
    return facts.mapInArrow(run, schema_of(out))


def _agree(a: str, b: str) -> int:
    """Turns that both sequences share from their start on."""
    most = min(len(a), len(b)) // WIDE
    if a[:most * WIDE] == b[:most * WIDE]:
        return most
    low, high = 0, most  # they agree over low turns, but not over high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * WIDE] == b[:mid * WIDE] else (low, mid)
    return low


def _chains(known: DataFrame) -> DataFrame:
    """The nodes of burst containers: their head, where it isn't the head of a layer, and their chain."""
    arrow = to_arrow_schema(schema_of(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chain, n, out = r["chain"], r["total"], []
                words = ([] if r["hw"] is None else [r["hw"]]) + chain
                depth, parent = (r["d0"] + 1 if r["hw"] is None else r["d0"]), r["pm"]
                saved = r["saved_tokens"] + (n - 1) * sum(words)
                for k, w in enumerate(words):
                    at_end = k == len(words) - 1
                    out.append((r["low"], depth + k, parent, n, r["kids"] if at_end else 1, r["n_leaves"], saved, r["tail"] if at_end else None))
                    saved -= (n - 1) * w
                    parent = r["low"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
    return known.mapInArrow(run, schema_of(NODE))


def _sweep(ready: DataFrame) -> DataFrame:
    """Sorted containers swept into nodes. A container's head is given last, with its cid and path (``top`` for the head of
    a layer, whose node lies in the layer above)."""
    arrow = to_arrow_schema(schema_of(SWEPT))
    cols = ["cid", "path", "pm", "d0", "hw", "m", "n", "seq", "words", "tail", "xc", "xl", "xs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        path: list[list] = []  # open nodes: [m, n, children, leaves, saved, tail, words, closed children]
        now = before = head = None

        def close() -> None:
            """The deepest open node is complete: its children learn its smallest member, its parent takes its sums."""
            node = path.pop()
            depth = head[3] + len(path)
            m, n, children, leaves, saved, tail, words, closed = node
            leaves = leaves if children else 1
            saved += (n - 1) * words
            for row in closed:
                out.append((None, None, False, row[0], depth + 1, m, *row[1:]))
            up = path[-1]
            up[0] = m if up[0] is None or m < up[0] else up[0]
            up[1] += n
            up[2] += 1
            up[3] += leaves
            up[4] += saved
            up[7].append((m, n, children, leaves, saved, tail))

        def finish() -> None:
            while len(path) > 1:
                close()
            m, n, children, leaves, saved, tail, words, closed = path.pop()
            cid, trail, pm, d0, hw = head[:5]
            top = hw is None
            for row in closed:
                out.append((None, None, False, row[0], d0 + 1, pm if top else m, *row[1:]))
            leaves = leaves if children else 1
            out.append((cid, trail, top, m, d0, pm, n, children, leaves, saved + (0 if top else (n - 1) * hw), tail))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(cols)))):
                cid, _, _, _, _, m, n, seq, words, tail, xc, xl, xs = row
                if cid != now:
                    if head is not None:
                        finish()
                    now, head, before = cid, row, ""
                    path.append([None, 0, 0, 0, 0, None, 0, []])
                shared = _agree(before, seq)
                while len(path) > shared + 1:
                    close()
                for w in words[shared:]:
                    path.append([None, 0, 0, 0, 0, None, w, []])
                node = path[-1]
                node[0] = m if node[0] is None or m < node[0] else node[0]
                node[1] += n
                node[2] += xc
                node[3] += xl
                node[4] += xs
                node[5] = tail
                before = seq
                if len(out) >= ROWS:
                    yield given()
                    out.clear()
        if head is not None:
            finish()
        yield given()
    return ready.select(*cols).repartition("cid").sortWithinPartitions("cid", "seq").mapInArrow(run, schema_of(SWEPT))

"""Operators on whole corpora against brute-force versions: decontamination, packing, suffixes, near duplicates, shards."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import frame, odd_rows, words
from pyspark.sql import functions as F
from strataspark.llm import decontaminate, minhash, packing, sharding, suffix_dedup
from strataspark.llm.queries import ranks_path, tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, names = set(), set()
        for name, t in items:
            x = WORD.findall((t or "").translate(LOW))
            k = min(10, len(x))
            wins = {tuple(x[a:a + k]) for a in range(len(x) - k + 1)} if k else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a:a + k]) in wins:
                    hit.update(range(a, a + k))
                    names.add(str(name))
        out.setdefault(i, []).append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination(spark, rng, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", block)
    long = words(rng, 40)
    items = [(1, long), (2, "Bala, KALU!"), (10, None), (3, ""), (4, words(rng, 12)), (5, words(rng, 10)), (5, long)]
    rows = [*odd_rows(rng), (20, f"x {long} y"), (21, " ".join(long.split()[3:13]).upper()), (22, " ".join(long.split()[3:12])), (23, "É bala kalu ü bala-kalu"), (24, f"{items[4][1]} {items[5][1]}"), (25, (long + " ") * 3)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    got = {}
    for r in decontaminate.contamination(docs, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    assert got == want
    kept = Counter(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect())
    assert kept == Counter(i for i, t in rows if not brute_contamination([(i, t)], items)[i][0][4])
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns


def test_decontamination_of_empty_tables(spark, rng):
    docs, none = frame(spark, odd_rows(rng)), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0 and decontaminate.longest_matches(docs, none).count() == 0


def test_longest_matches(spark, rng):
    item = words(rng, 30).split()
    docs = frame(spark, [(1, " ".join(item[:14])), (2, "x " + " ".join(item[2:20]) + " y"), (3, "z z " + " ".join(item[2:20])), (4, None)])
    got = {r.at: (r.length, r.doc_id, r.word) for r in decontaminate.longest_matches(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got[0] == (14, 1, 0) and got[2] == (18, 2, 1) and got[10] == (10, 2, 9) and 11 not in got


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    words_ = rng.integers(1, 4, 300)
    words_[rng.integers(0, 300, 20)] = 0
    order = decontaminate.suffix_array(words_)
    longest = np.diff(np.flatnonzero(np.r_[0, words_, 0] == 0)).max()
    keys = [tuple(words_[i:i + longest]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))


def brute_near(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
        label = new


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1) + str(rng.randrange(10 ** 6))
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, rng, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = words(rng, 160)
    rows = [r for r in odd_rows(rng) if r[0] is not None] + [(20, base), (21, base.upper()), (22, base + " tail"), (30, "One Two"), (31, "one two"), (32, "one  two three")]
    rows += [(100 + i, changed(rng, base, rng.randint(1, 6))) for i in range(60)]
    rows += [(200 + i, words(rng, 100) + " " + " ".join(base.split()[:40])) for i in range(20)]
    for i in range(6):  # a chain: each near the one before
        rows.append((300 + i, changed(rng, rows[-1][1] if i else words(rng, 200), 3)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_near(dict(rows).items())


def test_near_duplicates_of_odd_tables(spark, rng):
    assert minhash.near_duplicates(frame(spark, odd_rows(rng))).count() == len(odd_rows(rng))
    assert minhash.near_duplicates(frame(spark, odd_rows(rng)).limit(0)).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_needed_collisions():
    k = minhash.needed_collisions(64, 85)
    rng = np.random.default_rng(1)
    assert rng.binomial(64, 0.85, 2_000_000).min() >= k > 30


def brute_suffixes(docs, width=100):
    first, out = {}, {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p:p + width], (i, p))
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] != (i, p):
                gone[p:p + width] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "piece"), [(4096, 1 << 20), (3, 150)])
def test_suffix_dedup(spark, rng, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    base = "".join(rng.choices("abcdefgh ", k=600))
    texts = ["a" * 150, "ab" * 400, base, base[:300] + "x" + base[300:], "zz" + base[50:260] + "y" * 120 + base[50:260], base[:99], base[:100], "q" * 99 + "r", "é" * 120 + base[10:140], "abcde" * 60 + base[:120] + "abcde" * 30, *[base[100:220] + "".join(rng.choices("xyz", k=60)) for _ in range(12)]]
    rows = [(1, None), (2, ""), (3, "short")] + [(10 + i, t) for i, t in enumerate(texts)] + [(40, words(rng, 1500)), (41, words(rng, 200))]
    rows.append((42, rows[-1][1]))
    if piece < 1 << 20:
        found = suffix_dedup.runs
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        r = found(np.array([1]), [base.encode()], 100)
        assert r["size"].sum() == len(base) - 99 and sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(r["start"], r["size"])])) == list(range(len(base) - 99))
    want = brute_suffixes(rows)
    again = rows + [(42, rows[-1][1])]  # a row that is there twice is one document
    got = suffix_dedup.deduplicate(frame(spark, again)).collect()
    assert len(got) == len(again) and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_of_odd_tables(spark, rng):
    assert suffix_dedup.deduplicate(frame(spark, odd_rows(rng))).count() == len(odd_rows(rng))
    assert suffix_dedup.deduplicate(frame(spark, odd_rows(rng)).limit(0)).count() == 0
    assert suffix_dedup.deduplicate(frame(spark, [(1, None), (2, "")])).agg({"n_removed": "sum"}).first()[0] == 0


def test_suffix_order():
    rng = np.random.default_rng(4)
    part = rng.integers(97, 99, 400, dtype=np.uint8)
    data = np.concatenate([part, part[:300], part[50:], rng.integers(97, 123, 500, dtype=np.uint8)])
    at = np.arange(len(data) - 128)
    bucket = at // 700
    order = suffix_dedup.suffix_order(data, at, bucket)
    raw = data.tobytes()
    keys = [(bucket[i], raw[i:i + 128]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(at)


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("ranked", [False, True])
def test_encoder_equals_tokenizer(rng, ranked):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    parts = ["word", "don't", " ", "  ", "\n", " \n", "\t", "é", "漢字", "123", "...", "_", "\xa0", " ", "\x1c", "\x85", "A", "'s", "<|endoftext|>", "\U0001f600", "Schön", "ñandú", "x²", "ð×þ", "Ğı"]
    texts = ["", " ", "a b", " a", "a "] + ["".join(rng.choices(parts, k=12)) for _ in range(3000)] + [words(rng, 50) for _ in range(50)]
    got = packing.Encoder(tokenizer_path(), ranks_path() if ranked else None)(texts, {})
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, rng):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rows = [*odd_rows(rng), *[(100 + i, words(rng, rng.randint(1, 900))) for i in range(150)]]
    got = packing.best_fit(frame(spark, rows), tokenizer_path(), ranks=ranks_path()).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i != 8 and i is not None}
    per_doc, per_seq = {}, {}
    for r in got:
        per_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id in ids:
            per_doc.setdefault(r.doc_id, []).append(r)
    for i, own in per_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert all(r.length == 1024 for r in own[1:]) and (len(ids[i]) > 1024 or len(own) == 1)
        for r in own:
            assert zlib.crc32(np.array(ids[i][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert set(per_doc) == set(ids) and sum(r.doc_id == 8 for r in got) == 2
    total = 0
    for places in per_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
        total += end
    assert len(per_seq) <= -(-total // 1024) + 1
    assert packing.best_fit(frame(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_minimum_slack():
    rng = random.Random(1)
    for counts, capacity in (({5: 3, 4: 2, 3: 7}, 10), ({n: rng.randint(1, 10 ** 9) for n in range(1, 1025)}, 1024), ({600: 10, 500: 3}, 1024), ({}, 8), ({1024: 5}, 1024)):
        plan = packing.minimum_slack(counts, capacity)
        used = Counter()
        for chosen, bins in plan:
            assert sum(n * k for n, k in chosen) <= capacity and bins > 0
            for n, k in chosen:
                used[n] += k * bins
        assert used == Counter(counts) and len(plan) < 7200
    bins = sum(b for _, b in packing.minimum_slack({n: 1000 for n in range(1, 1025)}, 1024))
    assert bins <= 1.01 * sum(1000 * n for n in range(1, 1025)) / 1024


def test_shards(spark, rng):
    rows = [*(r for r in odd_rows(rng) if r[0] != 5), *[(100 + i, words(rng, rng.randint(1, 60))) for i in range(1500)], *[(3000 + i, "the same text") for i in range(800)]]
    got = sharding.kd_shards(frame(spark, rows), 7).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all((r["size"], r.text_crc32) == want[r.doc_id] for r in got)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    rest = [n for n in sizes.values()]
    assert max(rest) <= sum(rest) / 7 + largest


def test_shards_follow_named_dimensions(spark, rng):
    docs = frame(spark, [(i, "x" * (i % 50)) for i in range(600)])
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, 4, dims=("n_chars",)).collect()}
    assert len({got[i] for i in range(0, 600, 50)}) <= 2 and len(set(got.values())) == 4
    assert sharding.kd_shards(docs.limit(0), 4).count() == 0 and sharding.kd_shards(docs, 1).select("shard").distinct().count() == 1


def test_shards_cut_along_metadata(spark, rng):
    """Ordered codes keep the order of strings, and rows of one source stay together while sizes stay near."""
    names = ["", "a", "ab", "b", "src1", "src10", "src2", "é"]
    codes = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(sharding.ordered_code(F.col("n")).alias("c"), "n").orderBy("n").collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)
    docs = spark.createDataFrame([(i, words(rng, 20), f"src{i % 8}") for i in range(800)], "doc_id long, text string, source string").withColumn("order", sharding.ordered_code(F.col("source")))
    placed = sharding.kd_shards(docs, 8, dims=("order",)).join(docs.select("doc_id", "source"), "doc_id")
    per = placed.groupBy("shard").agg(F.count_distinct("source").alias("n"), F.sum("size").alias("bytes")).collect()
    assert sum(r.n for r in per) <= 16 and max(r.bytes for r in per) < 1.1 * min(r.bytes for r in per)


def test_postings_are_counted_before_they_meet_the_members(spark):
    """A row of the join for each member, however many postings it has."""
    from strataspark.llm.minhash import _weights
    members = spark.range(50).select("id", F.lit(0).alias("cluster"))
    posts = spark.range(2000).select((F.col("id") % 100).alias("id"), F.col("id").alias("token"))
    got = _weights(members, posts)
    assert {tuple(r) for r in got.collect()} == {(k, 0, 20) for k in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")

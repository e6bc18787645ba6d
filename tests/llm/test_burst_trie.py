"""The trie of conversations against sets of prefixes, over every way to cut and burst it."""
import hashlib
import os
import re
import sys
import zlib

import pytest
from strataspark.llm import burst_trie
from strataspark.llm.queries import ORACLES, op11

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import compare, connect  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth string, path string, head string, cid string"


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}


def brute(seqs):
    nodes = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    saved, leaves, kids = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * words
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(seqs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(seqs):
    out = {}
    for c, turns in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = seqs.get(int(c / 20) * 20, [])[:h] + turns[h:]
    return out


def found(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, *("x" if i % 2 else None for i in range(5))) for r in rows], SCHEMA).repartition(3)


def conversations(rng):
    texts = ["hi there", "a  b\tc", "", "é 漢", "x" * 50]
    rows = []
    for c in [*range(0, 60), 200, 219, 1000, -5]:
        shared = rng.random() < 0.4
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, k, rng.choice(["user", "assistant", None]) if not shared else "user", (rng.choice(texts) if not shared else texts[k % 2])))
    rows += [(c, k, "user", "same" if k < 8 else None) for c in range(300, 330) for k in range(9)]  # copies
    rows += [(400, None, "user", "first"), (400, None, None, None), (400, 5000, "user", "x"), (400, 9, "user", "y y"), (None, 1, "user", "nobody"), (401, 0, "u", "t"), (401, 0, "u", "t"), (401, 0, "u", "s")]
    return rows


@pytest.mark.parametrize("piece,limit", [(1 << 14, 3), (4, 12)])
def test_trie_equals_sets_of_prefixes(spark, rng, piece, limit):
    rows = conversations(rng)
    turns = burst_trie.turns(table(spark, rows))
    got = burst_trie.prefix_trie(*burst_trie.shared_starts(turns), piece=piece, limit=limit)
    assert found(got) == brute(rebuilt(sequences(rows)))


def test_trie_of_plain_conversations(spark, rng):
    rows = conversations(rng)
    turns = burst_trie.turns(table(spark, rows))
    assert found(burst_trie.prefix_trie(turns, turns.select("conv_id").distinct())) == brute(sequences(rows))


def test_odd_tables(spark):
    def trie(rows):
        return found(burst_trie.prefix_trie(*burst_trie.shared_starts(burst_trie.turns(table(spark, rows)))))
    assert trie([]) == [] and trie([(None, 0, "user", "x")]) == []
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert trie([(c, 0, "user", "x")]) == brute({c: []})  # all its turns were its base's, which is absent


def test_query_equals_sql(spark, rng, tmp_path):
    table(spark, conversations(rng)).coalesce(1).write.parquet(f"{tmp_path}/x")
    part = next(f for f in os.listdir(f"{tmp_path}/x") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/x/{part}", f"{tmp_path}/conversations.parquet")
    got, want = op11(spark, str(tmp_path)).toPandas(), connect(str(tmp_path)).execute(ORACLES["op11_burst_trie"]).df()
    for df in (got, want):
        df["parent_conv_id"] = df["parent_conv_id"].fillna(-1).astype("int64")
    assert compare(got, want) == ""

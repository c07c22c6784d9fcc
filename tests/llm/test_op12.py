import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradeframe.llm import prefix_trie as M

from .helpers import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """{conv_id: [(role, text), ...]} as the contract says."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Nodes of {conv_id: turns} by looking at every beginning of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ms in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(node))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, convs, **sizes):
    rows = [(c, d, role, text) for c, turns in convs.items() for d, (role, text) in enumerate(turns)]
    turns = M.turn_ids(spark.createDataFrame(rows, SCHEMA)) if rows else M.turn_ids(spark.createDataFrame([], SCHEMA))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    return sorted(map(tuple, M.prefix_trie(turns, ids, **sizes).collect()), key=str)


def some(seed, n, longest):
    rng = random.Random(seed)
    convs = {}
    for c in range(n):
        if convs and rng.random() < 0.6:      # goes on from a beginning of another
            one = rng.choice(list(convs.values()))
            turns = one[:rng.randrange(len(one) + 1)]
        else:
            turns = []
        convs[rng.randrange(10 ** 9)] = turns + [(rng.choice("su"), rng.choice(["", "é", "abc", "日本"])) for _ in range(rng.randrange(longest))]
    return convs


@pytest.mark.parametrize("segment,limit", [(1024, 3), (2, 50_000), (3, 4)])
def test_segments_and_bursts_change_nothing(spark, segment, limit):
    convs = some(segment + limit, 40, 7)
    assert got(spark, convs, segment=segment, limit=limit) == brute(convs)


def test_copies_and_turnless(spark):
    same = [("u", "hello"), ("a", "yes"), ("u", "x")]
    convs = {k: same for k in range(300)} | {1000: same[:2], 1001: [], 1002: [], 7: same[:1]}
    for sizes in ({}, {"segment": 2, "limit": 1}):
        assert got(spark, convs, **sizes) == brute(convs)
    assert got(spark, {5: []}) == brute({5: []})
    assert got(spark, {}) == []


def test_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 8)
    long = [("u", str(k % 7)) for k in range(1500)]
    convs = {1: long, 2: long[:700], 3: long[:700] + [("a", "b")], 4: long, 12: long[:1499]}
    rows = got(spark, convs, segment=500)
    assert len(rows) == 1502
    assert max(r[1] for r in rows) == 1500 and [r[4:7] for r in rows if r[1] == 0] == [(1, 2, sum(
        {k + 1: (5 if k < 700 else 3 if k < 1499 else 2) - 1 for k in range(1500)}[k + 1] for k in range(1500)))]
    by_depth = {r[1]: r for r in rows if r[0] != 3}
    assert by_depth[700][7] == hashlib.sha256(b"2").hexdigest() and by_depth[1500][7] == hashlib.sha256(b"1,4").hexdigest()


def cases():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", None, "", "b b", "é" * 9])) for c in (0, 1, 2, 3, 100, 101, 205, 7, 99) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(4)]
    rows += [(411, None, "system", "first"), (411, 3, "u", "x"), (411, 3, "u", "x"), (411, 3, "a", "y"), (None, 1, "u", "lost"), (400, 0, "u", "z" * 100_000)]
    return rows + rows[:3]


def test_rebuilt_and_cases(spark):
    rows = cases()
    df = (spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("old")).withColumn("unit", F.lit(1)).withColumn("key", F.lit(1))
          .withColumn("h", F.lit(1)))
    nodes = M.prefix_trie(*M.rebuilt(M.turn_ids(df)), limit=20)
    assert nodes.columns == M.NODES
    assert sorted(map(tuple, nodes.collect()), key=str) == brute(rebuild(rows))
    assert M.prefix_trie(*M.rebuilt(M.turn_ids(df.limit(0)))).collect() == []


def test_query(spark):
    same_as_sql(spark, M, "op12_prefix_trie")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, M.op12_prefix_trie(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rebuild(rows))

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeframe.llm import simhash_trie as S


def brute_fp(text, k=4):
    import re
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            best[r] = min(best.get(r, d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def test_fingerprint_matches_definition():
    for t in [None, "", " \t\x0b", "One", "A b C d", "É à Straße\x1cx y z\n w q", "a " * 70000]:
        assert S.fingerprint(t, 4) == brute_fp(t)


@pytest.mark.parametrize("limit,agree", [(50_000, None), (20, 1), (50_000, 2), (20, 3)])
def test_trie_links_against_brute_force(spark, limit, agree):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = {0}
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in S.components(S.trie_links(df, 4, subtrie_rows=limit, buffer_rows=100, agree=agree)).collect()}
    want = brute_groups(signed, fps)
    assert [got.get(f, f) for f in signed] == want


def test_keys_hold_all_pairs_within_the_distance():
    """Of max_bits + k blocks k are untouched by max_bits changed bits; more fingerprints get longer keys."""
    rnd = random.Random(3)
    for agree in (1, 2, 3):
        tries = S.keys(4, agree)
        assert len(tries) == (5, 15, 35)[agree - 1] and all(sum(w for _, w in (*c, *r)) == 64 for c, r in tries)
        for _ in range(50):
            a = rnd.getrandbits(64)
            b = a
            for _ in range(4):
                b ^= 1 << rnd.randrange(64)
            both = np.array([a, b], np.uint64)
            firsts = [S.key_first(both, np.full(2, k), tries) >> np.uint64(64 - sum(w for _, w in c)) for k, (c, _) in enumerate(tries)]
            assert any(x == y for x, y in firsts)
    assert [S.agreeing(n, 4, 50_000) for n in (0, 250_000, 10 ** 8, 10 ** 10, 10 ** 11)] == [1, 1, 2, 2, 3]


def test_groups_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d e"), (3, "A b C d e"), (3, "A b C d e"), (9, None), (8, ""), (None, "x y z"), (7, long),
            (2, long + " tail"), (None, "zz top"), (None, "zz top"), (11, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = S.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(((d, format(f, "016x"), c) for (d, _), f, c in
                   zip(rows, fps, brute_groups([d for d, _ in rows], fps))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    kept = S.one_per_group(df).collect()
    groups = {(c, None if c is not None else f) for _, f, c in want}
    assert len(kept) == len(groups)
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c, _ in groups if c is not None}
    assert S.simhash_groups(df.limit(0)).count() == 0 and S.one_per_group(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in docs]
    want = set(zip((r.doc_id for r in docs), (format(f, "016x") for f in fps),
                   brute_groups([r.doc_id for r in docs], fps)))
    assert {tuple(r) for r in S.op8_simhash(spark, d).collect()} == want

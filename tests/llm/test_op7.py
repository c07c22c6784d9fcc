import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeframe.llm import mixing as M

from .helpers import same_as_sql


def h60(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, target, seed=M.SEED):
    """Counter of (doc_id, source, epoch) by plain loops and plain bisection."""
    size = lambda t: len((t or "").encode().split())
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += size(t)
    total = sum(tokens.values())
    if not total:
        return Counter((d, s, 0) for d, s, _ in rows)
    budget = target.budget or total
    p = [v / total for v in tokens.values() if v]

    def ok(a):
        z = sum(x ** a for x in p)
        w = [x ** a / z for x in p]
        entropy = -sum(x * math.log(x) for x in w)
        return ((target.max_epochs is None or max(x * budget / (q * total) for x, q in zip(w, p)) <= target.max_epochs)
                and (target.target_entropy is None or entropy <= target.target_entropy * math.log(len(p)) + 1e-9))

    low, high = -1, 2 ** 24
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid / 2 ** 24) else (mid, high)
    a = high / 2 ** 24
    z = sum(x ** a for x in p)
    out = Counter()
    for s, n in tokens.items():
        mine = sorted((h60(seed, d, s), d, size(t)) for d, s2, t in rows if s2 == s)
        share = math.floor((n / total) ** a / z * budget + 0.5) if n else 0
        passes, rest = (divmod(share, n)) if n else (1, -1)
        for h, d, _ in mine:
            taken = passes + (sum(k for g, _, k in mine if g <= h) <= rest)
            for e in range(taken):
                out[(d, s, e)] += 1
    return out


@pytest.mark.parametrize("target", [M.Target(), M.Target(0.8, None), M.Target(None, 3.0), M.Target(None, 1.5, 90),
                                    M.Target(0.99, 4.0, 5000), M.Target(None, 0.1), M.Target(None, None)])
def test_against_brute_force(spark, target):
    rows = [(i, f"s{min(i % 40, 9)}", "w " * (i * 7 % 13)) for i in range(400)]
    rows += [(1000 + i, None, "a b") for i in range(9)] + [(i, "empty", "") for i in range(5)] + [(7, "s7", "dup dup")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = Counter((r.doc_id, r.source, r._epoch) for r in M.mix(df, target).collect())
    assert got == brute(rows, target)


def test_weights_meet_the_limit(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 30}", "w " * 10) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    n = {r.source: r["count"] for r in M.mix(df).groupBy("source").count().collect()}
    whole = Counter(s for _, s, _ in rows)
    assert max(n[s] / whole[s] for s in whole) <= M.MAX_EPOCHS + 1e-9
    assert abs(sum(n.values()) - len(rows)) <= 2 * len(whole)


def test_cases(spark):
    rows = [(None, "a", "x y"), (None, "a", "x y"), (1, None, None), (2, "", ""), (3, "b", "long " * 100_000), (3, "b", "z")]
    df = (spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_epoch", F.lit("x"))
          .withColumn("_block", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(1)))
    out = M.mix(df)
    assert sorted(out.columns) == sorted(df.columns) and out.count() >= 1
    assert M.mixed(df.drop("_epoch", "_block")).columns == ["doc_id", "source", "text", "key", "h"]
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df.filter("text = ''")).count() == 1


def test_sql(spark):
    same_as_sql(spark, M, "op7_mixing")
    same_as_sql(spark, M, "op7_mixing", "/root/testdata/sf0.01")


def test_rows_of_one_hash_are_summed_before_they_meet(spark):
    """A third of the rows without an id: they are one row of the last window, and taken or left together."""
    rows = [(None if i % 3 == 0 else i, "a" if i % 2 else "b", "w " * (i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(df).groupBy("doc_id", "source", "_epoch").count().collect()
    for source in "ab":
        n = [r["count"] for r in got if r.doc_id is None and r.source == source]
        assert set(n) <= {sum(1 for d, s, _ in rows if d is None and s == source)}

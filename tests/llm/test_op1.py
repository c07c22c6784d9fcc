import numpy as np
from pyspark.sql import functions as F

from gradeframe.llm import embed_graph as E


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    usable = [lab is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
              for _, v, lab in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if u else None for (_, v, _), u in zip(rows, usable)]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    best = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    out = []
    for i, (d, _, _) in enumerate(rows):
        c = best.get(find(i)) if usable[i] else d
        out.append((d, n[i], c, d is not None and d == c))
    return sorted(out, key=repr)


def data(seed, groups, plain, dim=16):
    rnd = np.random.default_rng(seed)
    rows, k = [], 0
    for g in groups:
        c = rnd.normal(size=dim)
        for _ in range(g):
            v = c + rnd.normal(size=dim) * rnd.choice([0.0, 0.05, 0.2])
            rows.append((k, [float(x) for x in np.float32(v)], int(g % 2)))
            k += 1
    for _ in range(plain):
        rows.append((k, [float(x) for x in np.float32(rnd.normal(size=dim))], int(rnd.integers(2))))
        k += 1
    return rows


def test_graph_reaches_everything_and_search_finds_all():
    rnd = np.random.default_rng(2)
    x = E.unit(np.concatenate([rnd.normal(size=(400, 32)), rnd.normal(size=32) + 0.05 * rnd.normal(size=(150, 32)),
                               np.repeat(rnd.normal(size=(100, 32)), 2, 0) + 0.1 * rnd.normal(size=(200, 32))]))
    s = E.Setting()
    edges = E.build(x, s)
    seen, todo = {E.medoid(x)}, [E.medoid(x)]
    while todo:
        for j in edges[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == len(x)
    fq, fx = E.search(x, edges, x, s, 32)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= s.threshold))}
    got = set(zip(fq.tolist(), fx.tolist()))
    assert len(got) == len(fq) and got <= want and len(got) >= 0.99 * len(want)


def test_shards_and_hash_parts(spark):
    rows = data(1, [60, 31, 12, 7, 3, 2, 2], 300)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for s in (E.Setting(), E.Setting(shard_rows=30, sample_rows=320, probes=3, audit=60, query_rows=50),
              E.Setting(shard_rows=8, sample_rows=32, probes=2, audit=60)):
        got = sorted(map(tuple, E.near_duplicates(df, s).collect()), key=repr)
        assert got == brute(rows)


def test_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (4, [2.0, 4.0, 6.0], 1), (6, v, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (9, [], 1),
            (10, [1.0, None, 3.0], 1), (11, [1.0, float("nan"), 3.0], 1), (12, [float("inf"), 2.0, 3.0], 1), (13, v, 2), (14, [1.0, 2.0], 1),
            (None, v, 1), (None, v, 7), (15, [-1.0, -2.0, -3.0], 1), (15, [9.0, 0.0, 0.0], 1), (16, [1e-30, 2e-30, 3e-30], 1),
            (17, [1e38, 2e38, 3e38], 1)]
    df = (spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
          .withColumn("n", F.lit(1)).withColumn("shard", F.lit(1)))
    got = sorted(map(tuple, E.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = E.op1_embed_graph(spark, d)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_the_audit_looks_for_queries_with_links_and_a_low_recall_is_refused(spark, monkeypatch):
    """One pair among lone vectors: a sample of a few queries holds none of it, a grown one does."""
    import pytest
    rnd = np.random.default_rng(6)
    vecs = [rnd.normal(size=24).tolist() for _ in range(300)]
    vecs += [[x + 1e-3 * (k + 1) for x in v] for k, v in enumerate(vecs[:20])]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    s = E.Setting(audit=8)
    classes = E.classes_of(df.select("vec_id", F.col("embedding").alias("vec"), "label"))
    truth = E.audit_truth(classes, s)
    assert truth.filter("want > 0").count() >= 2 and truth.count() > 8
    lost = lambda *a, **k: spark.createDataFrame([], "u long, v long, hits long")
    monkeypatch.setattr(E, "found_in_shards", lost)
    with pytest.raises(RuntimeError, match="recall"):
        E.near_duplicates(df, s)

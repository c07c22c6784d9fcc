import zlib

import numpy as np
from pyspark.sql import functions as F

from gradeframe.llm import quality_fm as Q

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_is_the_pairwise_sum():
    rnd = np.random.default_rng(1)
    cache = {}
    d = [Q.describe(t, cache) for t in ("a b c a", "", None, "X! x | 3\n\nX! x | 3", "é " * 50)]
    n = Q.n_features()
    m = Q.Model(rnd.normal(0, 1, (len(Q.STATS), Q.BINS - 1)).astype(np.float32), 0.3,
                rnd.normal(0, 1, n).astype(np.float32), rnd.normal(0, 1, (n, Q.FACTORS)).astype(np.float32))
    m.edges.sort(axis=1)
    rows = Q.Rows(d, m.edges)
    got, _ = Q.raw_scores(m, rows.ids, rows.values, rows.start[:-1])
    for r in range(len(d)):
        ids, x, _ = rows.part(np.array([r]))
        want = m.bias + sum(float(m.linear[i]) * float(v) for i, v in zip(ids, x))
        for a in range(len(ids)):
            for b in range(a):
                want += float(m.factors[ids[a]] @ m.factors[ids[b]]) * float(x[a] * x[b])
        assert abs(want - got[r]) < 1e-2


def test_held_out_accuracy_and_contract(spark):
    out = Q.op3_quality_fm(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9


def test_cases(spark):
    rows = [(1, "good words here and there"), (1, "good words here and there"), (2, None), (3, ""), (None, "BAD!! BAD!!"),
            (4, "x " * 200_000)]
    df = (spark.createDataFrame(rows, "doc_id long, text string")
          .withColumn("score", F.lit("old")).withColumn("row", F.lit(1)).withColumn("label", F.lit(5)).withColumn("a.b", F.lit(2)))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    m = Q.train(df.select("doc_id", "text", "row"), labels)
    out = Q.score(df, m)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows)
    assert all(0 <= r.score <= 1 and r["a.b"] == 2 for r in out.collect())
    assert Q.score(df.limit(0), m).count() == 0
    assert Q.train(df, labels.limit(0)).linear.any() == np.False_
    kept = Q.good(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() <= len(rows)


def test_one_row_of_an_id_reaches_the_fit(spark, monkeypatch):
    """A third of all rows with one id: the model is that of the row with the smallest hash of its text."""
    from pyspark.sql import functions as F
    docs = [(i, f"plain words of text {i} " * 5) for i in range(40)] + [(1, f"other words {k}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    least = [r.text for r in df.filter("doc_id = 1").orderBy(F.xxhash64("text")).limit(1).collect()][0]
    plain = spark.createDataFrame([d for d in docs[:40] if d[0] != 1] + [(1, least)], df.schema)
    a, b = Q.train(df.repartition(7), labels), Q.train(plain, labels)
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.edges == b.edges).all()

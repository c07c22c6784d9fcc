import hashlib
import json
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from gradeframe.llm import bpe_words as B
from gradeframe.llm import mixing as M
from gradeframe.llm import pii_boost as P
from gradeframe.llm import quality_fm as Q

from .test_op7 import brute as brute_mix
from .test_op8 import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    for name, stage in C.STAGES:
        out = stage(spark, now, SF).checkpoint()
        before, after = now.collect(), out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "quality classifier":
            m = Q.train(now, labels)
            d = [Q.describe(r.text, {}) for r in before]
            rows = Q.Rows(d, m.edges)
            s = Q.chance(Q.raw_scores(m, rows.ids, rows.values, rows.start[:-1])[0])
            assert {r.doc_id for r in after} == {r.doc_id for r, x in zip(before, s) if x >= 0.3}
        elif name == "simhash near-dedup":
            groups = brute_groups([r.doc_id for r in before], [brute_fp(r.text) for r in before])
            assert sorted(after) == sorted(r for r, g in zip(before, groups) if r.doc_id == g)
        elif name == "pii":
            trees = P.train(now)
            want = {r.doc_id: P.redacted(r.text, P.find(r.text, trees)[1]) for r in before}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing sources":
            want = brute_mix([(r.doc_id, r.source, r.text) for r in before], M.Target())
            assert Counter(r.doc_id for r in after) == Counter(k[0] for k in want.elements())
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        else:
            t = B.load(B.public_vocabulary())
            ids = {r.doc_id: np.array(t.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes() for r in before}
            assert Counter((r.doc_id, bytes(r.ids)) for r in after) == Counter((r.doc_id, ids[r.doc_id]) for r in before)
        now = out
    ran = C.run(spark, SF)
    digest = lambda rows: Counter((r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in rows)
    assert digest(ran.collect()) == digest(after)


def test_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, d, lab in (("empty", docs.limit(0), labels.limit(0)),
                         ("odd", docs.limit(40).union(docs.limit(3)).withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.col("text")))
                          .withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.col("source"))), labels)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        n = C.run(spark, f"{tmp_path}/{name}").count()
        assert (n == 0) == (name == "empty"), json.dumps([name, n])


def test_last_stage_encodes_and_decodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é😀 \r\n\x00 <|endoftext|> Ünï 日本")], docs.schema)).checkpoint()
    out = dict(C.STAGES)["bpe"](spark, docs, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in out.collect()) == want

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import fim_fenwick as M

from .helpers import same_as_sql

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", " a", "a ", "\t\n", "one two  three\n", "a <P> b", "x<S", "<M>", "é ü　ß   日本語 😀👍🏽 z", "x" * 20_000,
         "word " * 30_000, " " * 9_000, "\x00 \x1c a\x85b", "<P <S <M> >", "ends <", "a <S b <P c"]


def brute(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k:8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in M.MARKS) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, t, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", t)
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", t)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cuts_at_every_unit(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice("ab é日😀 \n\t") for _ in range(rng.randrange(60)))
        data = np.frombuffer(text.encode(), np.uint8)
        tree, units = M.fenwick(data, block), UNIT.findall(text)
        assert tuple(M.total(tree)) == (len(units), len(text))
        assert [M.cut(data, tree, k, block) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_tree_nodes_are_sums_of_their_blocks():
    data = np.frombuffer(b"a b " * 40, np.uint8)
    tree = M.fenwick(data, 4)
    assert [int(x) for x in tree[1:9, 0]] == [2, 4, 2, 8, 2, 4, 2, 16]       # i & -i blocks of two units each
    assert M.descend(tree, 1) == (0, 0, 0) and M.descend(tree, 3) == (1, 2, 4) and M.descend(tree, 80) == (39, 78, 156)


def test_cases(spark):
    rows = [(i if i != 3 else None, t) for i in range(60) for t in TEXTS[:12]] + [(1000 + i, t) for i, t in enumerate(TEXTS * 6)]
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("old")).withColumn("n", F.lit(1))
          .withColumn("form", F.lit(0)).withColumn("h1", F.lit(0)).withColumn("cut", F.lit(0)))
    done = M.fill_in_middle(df).withColumn("again", M.restored(F.col("form"), F.col("output")))
    got = sorted(map(tuple, done.collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(df.limit(0)).collect() == []


def test_all_rearranged(spark):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in TEXTS], "doc_id long, text string")
    done = M.fill_in_middle(df, fim_percent=100, spm_percent=50).withColumn("again", M.restored(F.col("form"), F.col("output")))
    got = done.collect()
    assert {r.form for r in got if r.again and not any(m in r.again for m in M.MARKS)} == {"psm", "spm"}
    assert sorted(r.again for r in got) == sorted(t or "" for _ in range(40) for t in TEXTS)


def test_one_python_step_and_no_shuffle(spark):
    plan = M.op11_fim_fenwick(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("cuts(") <= 2 and "Exchange" not in plan


def test_query(spark):
    same_as_sql(spark, M, "op11_fim_fenwick")

import hashlib
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeframe.llm import bpe_words as B

PATH = B.public_vocabulary()
TEXTS = [None, "", " ", "\n\n  \t x", "it's I'LL we'd  they've a b", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext",
         "日本語 テキスト😀👍🏽 é é ß\x85\x1c", "x" * 5000, "word " * 20_000, "1234567 12.5 %$#@!  \r\n\r\n end ",
         "͸՘ ꟎\U00011db0 \U0003d000x"]


@cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def want(text):
    t = tokenizer()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def digests(df):
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2(F.col("text").cast("binary"), 256).alias("b"))


def test_words_are_those_of_the_tokeniser():
    split = B.splitter(PATH)
    own = Tokenizer.from_file(PATH).pre_tokenizer
    for start in [*range(0, 0x3400, 97), *range(0xA600, 0x20000, 97 * 5), *range(0x20000, 0x110000, 97 * 101)]:
        s = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(start, min(start + 97, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert split(s) == [s[a:b] for _, (a, b) in own.pre_tokenize_str(s)]
    # the fast pattern alone agrees on every character it is used for
    import regex
    fast, known = regex.compile(B.PATTERN), regex.compile(f"[{B.LONG_KNOWN}]")
    for c in map(chr, [*range(0x3400), *range(0x4D00, 0x5100), *range(0x9F00, 0xAC10), *range(0xD700, 0xD800), *range(0xF900, 0x10000), *range(0x1F000, 0x1FB00)]):
        if known.match(c):
            s = f"a{c}1{c} {c}a"
            assert fast.findall(s) == [s[a:b] for _, (a, b) in own.pre_tokenize_str(s)], hex(ord(c))


def test_pack_round_trip():
    for x in ([], [0], [1, 2 ** 32 - 1, 70_000, 3]):
        assert B.unpack(B.pack(np.array(x, np.int64))).tolist() == x


def test_words_round_trip():
    for ws in ([], ["a"], ["", "é", "x" * 70_000, "\n", "日本"]):
        assert [w.decode() for w in B.unpack_words(B.pack_words(ws))] == ws


def test_texts_are_not_shuffled(spark):
    plan = B.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH)._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert left.count("Exchange hashpartitioning") == 2      # by part and by batch, both of the word lists


def test_cases(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] * 2
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("old")).withColumn("words", F.lit(1))
          .withColumn("batch", F.lit(2)).withColumn("code", F.lit(2)))
    for limit in (B.BATCH_WORDS, 50):
        got = digests(B.decode(B.encode(df, PATH, batch_words=limit), PATH)).collect()
        assert Counter(map(tuple, got)) == Counter((d, *want(t)) for d, t in rows)
    assert B.decode(B.encode(df.limit(0), PATH), PATH).count() == 0
    only_empty = B.encode(df.filter("text = ''"), PATH).collect()
    assert len(only_empty) == 2 and all(r.n_tokens == 0 and bytes(r.ids) == b"" for r in only_empty)
    nulls = spark.createDataFrame([(1, None)], "a int, ids binary")
    assert B.decode(nulls, PATH).first().text is None


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = B.op2_bpe_words(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == {(r.doc_id, *want(r.text)) for r in docs}

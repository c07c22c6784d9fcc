import random
from collections import Counter
from functools import cache, reduce

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeframe.llm import token_machine as M

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "\n\n  \t x", "it's I'LL we'd  they'VE a'b 'r 'rex ''s '", "a <|endoftext|> b<|endoftext|><|startoftext|>", "<|endoftext",
         "日本語 テキスト😀👍🏽 é é ß\x85\x1c", "x" * 500, "word " * 2000, "1234567 12.5 %$#@!!!  \r\n\r\n end ", "ΑΣ İstanbul ﬁ Ǆ",
         "͸՘ ꟎\U00011db0 \U0003d000x", "a" + "́" * 700, "日本語" * 400, "\x00\x00", "ᄀ" + "ᅡ" * 300, "don't" * 200]


@cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def want(text):
    return len(tokenizer().encode(text or "", add_special_tokens=False).ids)


def some_text(rng):
    bits = ["a", "the", "ing", "'", "s", "re", "R", " ", "\n", "1", "é", "́", "ß", "日", "!", "...", "가", "ᆨ", "<|endoftext|>", "<|", "|>", "Σ", "😀", "zq"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(40)))


def test_classes_are_those_of_the_library():
    m, own = M.machine(PATH), tokenizer()
    for start in [*range(1, 0x3400, 61), *range(0xA600, 0x20000, 61 * 7)]:
        s = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(start, start + 61) if not 0xD800 <= c < 0xE000)
        assert m.count(m.stream(s)) == len(own.encode(s, add_special_tokens=False).ids)


def test_counts_of_random_texts():
    m, rng = M.machine(PATH), random.Random(1)
    for _ in range(1500):
        t = some_text(rng)
        assert m.count(m.stream(t)) == want(t), t
    for _ in range(500):            # words without any sense
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randrange(1, 30)))
        assert m.count(m.stream(t)) == want(t), t


def test_a_pair_fits_if_its_merges_give_it():
    m, rng = M.machine(PATH), random.Random(2)
    inner, final = sorted(m.inner.values()), sorted(m.final.values())
    for _ in range(3000):
        a, b = rng.choice(inner[:3000]), rng.choice(rng.choice([inner, final])[:3000])
        if m.alone(a) and m.alone(b):
            assert m.fits(a, b) == (m.merge(m.symbols(a) + m.symbols(b)) == [a, b])


def test_a_machine_that_starts_anew_counts_alike(monkeypatch):
    monkeypatch.setattr(M, "STATES", 20)
    monkeypatch.setattr(M, "PIECES", 3)
    m, rng = M.Machine(PATH), random.Random(3)
    for _ in range(100):
        t = some_text(rng)
        assert m.count(m.stream(t)) == want(t)


@pytest.mark.parametrize("chunk", [1, 3, 8, 50])
def test_maps_of_chunks_compose(chunk):
    m, rng = M.machine(PATH), random.Random(chunk)
    for t in [*(some_text(rng) for _ in range(300)), *(x for x in TEXTS if x and len(x) < 600)]:
        pieces = list(M.cut_up(t, chunk, m.added))
        assert "".join(pieces) == t
        maps = [m.chunk_map(m.stream(p)) for p in pieces] or [("", False, 0, "")]
        assert m.applied(reduce(m.compose, maps)) == want(t), (t, pieces)
        while len(maps) > 1:      # in pairs, as a scan composes them
            maps = [reduce(m.compose, maps[k:k + 2]) for k in range(0, len(maps), 2)]
        assert m.applied(maps[0]) == want(t)


def test_cases(spark, monkeypatch):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] * 2
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("old")).withColumn("rid", F.lit(1))
          .withColumn("n_bytes", F.lit(2)).withColumn("part", F.lit(2)))
    expected = Counter((d, len((t or "").encode()), want(t)) for d, t in rows)
    for chunk in (M.CHUNK, 40):
        got = M.count_tokens(df, PATH, chunk=chunk)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
        assert Counter(map(tuple, got.collect())) == expected
    monkeypatch.setattr(M, "FAN", 2)
    assert Counter(map(tuple, M.count_tokens(df.filter("length(text) < 100"), PATH, chunk=30).collect())) == Counter(
        (d, len(t.encode()), want(t)) for d, t in rows if t is not None and len(t) < 100)
    assert M.count_tokens(df.limit(0), PATH).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = M.op13_token_machine(spark, d)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == {(r.doc_id, len((r.text or "").encode()), want(r.text), want(r.text) > 2048) for r in docs}

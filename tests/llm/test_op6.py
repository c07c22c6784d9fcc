import math
import random
import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

from gradeframe.llm import fertility as R

SF = "/root/testdata/sf0.01"


def brute_base(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    hit = {j for i, x in enumerate(wins) if c[x] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_base_and_figures(spark):
    texts = [None, "", " \n\t", "a b", "x y z u v " * 4, "One two\nthree\nOne two\n\n\n #|<> é€😀\x85q\x1c w k", "word " * 50_000,
             "a b c d e f a b c d e q r s t u v w x y", "日本語 テキスト です", "\r\nx\r\nx\r\n"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] * 2
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
          .withColumn("script", F.lit(1)).withColumn("step", F.lit(1)))
    out = R.quality_rules(df, R.public_model()).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((d, *brute_base(t)) for d, t in rows)
    assert not any(r.kept for r in out if r.base_failed)
    assert R.quality_rules(df.limit(0), R.public_model()).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=R.public_model())
    tell = R.Fertility(R.public_model())
    for t in texts[3:]:
        words, chars, *_ = R.base_counts(t)
        script, cpt, share, entropy, n = tell(words, chars)
        ids = sp.encode(" ".join(words))
        p = [k / len(ids) for k in Counter(ids).values()]
        assert n == len(ids) and abs(cpt - chars / len(ids)) < 1e-9
        assert abs(entropy + sum(x * math.log2(x) for x in p)) < 1e-9
        assert abs(share - sum(map(sp.is_byte, ids)) / len(ids)) < 1e-9
    assert R.script_of("abc") == "latin" and R.script_of("123") == "other" and R.script_of("日本") == "cjk"
    assert R.script_of("Привет a") == "cyrillic"


def test_corpus_bands_are_median_distances(spark):
    rows = [("latin", 4, False, 2.0 + 0.01 * i, 0.0, 6.0 + 0.1 * (i % 7)) for i in range(101)]
    rows += [("latin", 4, True, 9.0, 0.9, 0.0)] * 300 + [("greek", 4, False, 1.0, 0.0, 1.0)] * 10
    df = spark.createDataFrame(rows, "script string, step int, base_failed boolean, chars_per_token double, "
                                     "byte_share double, token_entropy double")
    got = {r.script: r for r in R.corpus_bands(df).collect()}
    assert set(got) == {"latin", "greek"}
    r = got["latin"]
    assert abs(r.low_chars_per_token - (2.5 - 5 * 0.25)) < 1e-9 and abs(r.high_chars_per_token - (2.5 + 5 * 0.25)) < 1e-9
    assert abs(r.low_token_entropy - (6.3 - 5 * 0.2)) < 1e-9 and r.high_token_entropy == float("inf")


def test_query(spark):
    out = R.op6_fertility(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = out.collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(docs[r.doc_id])
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in got if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)


def median(pairs):
    """The least value up to which half of the weight lies."""
    total, upto = sum(w for _, w in pairs), 0
    for x, w in sorted(pairs):
        upto += w
        if w and 2 * upto >= total:
            return x


def brute_bands(rows):
    """{(script, step): {figure: (low, high)}} of (script, step, base_failed, cpt, share, entropy) rows."""
    ok = [r for r in rows if not r[2]]
    size, out = Counter(r[:2] for r in ok), {}

    def weight(script, step, near):
        far = abs(near - step)
        closer = sum(n for (s, k), n in size.items() if s == script and abs(k - step) < far)
        ring = sum(n for (s, k), n in size.items() if s == script and abs(k - step) == far)
        return R.WEIGHT if not far else math.floor(R.WEIGHT * min(1.0, max(0, R.NEAREST - closer) / ring))

    for script, step in {r[:2] for r in ok}:
        out[script, step] = {}
        for k, (c, digits) in enumerate((("chars_per_token", 2), ("byte_share", 3), ("token_entropy", 2))):
            xs = []
            for r in ok:
                if r[0] == script:
                    less = max(r[1] - step, 0) / R.STEPS if c == "token_entropy" else 0
                    xs.append((round(round(r[3 + k] + 1e-12, digits) - less, digits), weight(script, step, r[1])))
            mid = median(xs)
            off = max(median([(round(abs(x - mid), digits), w) for x, w in xs]), R.LEAST_SPREAD[c])
            out[script, step][c] = (mid - 5 * off, math.inf if c == "token_entropy" else mid + 5 * off)
    return out


ROW = "script string, step int, base_failed boolean, chars_per_token double, byte_share double, token_entropy double"


def test_bands_are_weighted_medians(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["latin", "greek"]), rnd.randrange(4, 12), rnd.random() < 0.1, rnd.randrange(100, 500) / 100, rnd.randrange(300) / 1000,
             rnd.randrange(300, 900) / 100) for _ in range(400)] + [("cjk", 3, False, 1.0, 0.5, 2.0), ("latin", 30, False, 4.0, 0.0, 9.0)]
    got = {(r.script, r.step): r for r in R.corpus_bands(spark.createDataFrame(rows, ROW)).collect()}
    want = brute_bands(rows)
    assert set(got) == set(want)
    for k, figures in want.items():
        for c, (low, high) in figures.items():
            assert abs(got[k][f"low_{c}"] - low) < 1e-9 and (high == got[k][f"high_{c}"] or abs(got[k][f"high_{c}"] - high) < 1e-9)


def test_no_number_of_texts_switches_the_band(spark):
    """With each more text of a step its neighbours weigh less, down to nothing, without a jump at any number."""
    lows = []
    for n in (1, 10, 49, 50, 51, 200):
        rows = [("latin", 10, False, 3.0 + i / 100, 0.0, 6.0) for i in range(100)] + [("latin", 12, False, 4.0 + (i % 7) / 100, 0.0, 7.0) for i in range(n)]
        lows.append({r.step: r.low_chars_per_token for r in R.corpus_bands(spark.createDataFrame(rows, ROW)).collect()}[12])
    assert abs(lows[3] - lows[2]) < 0.2 and abs(lows[4] - lows[3]) < 0.2 and lows[0] < lows[-1]
    least = [R.BANDS["latin"].least_entropy(n) for n in (1, 2, 16, 63, 64, 65, 1000)]
    assert least[0] == 0 and least == sorted(least) and least[3] > 2.98 and least[4] == least[-1] == 3.0


def test_kept_against_brute_force(spark):
    model = R.public_model()
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, "Ελληνικά λόγια " + " ".join(f"λέξη{i}" for i in range(40)), None), (-2, " ".join("qzjo"[i % 4:] * 3 for i in range(200)), "en")]
    tell, rows = R.Fertility(model), {}
    for d, t, lang in docs:
        words, chars, *_ = R.base_counts(t or "")
        script, cpt, share, entropy, n = tell(words, chars)
        failed = brute_base(t)[5]
        band = R.BANDS.get(f"lang:{lang}") or R.BANDS[script]
        fits = bool(n) and band.chars_per_token[0] <= cpt <= band.chars_per_token[1] and band.byte_share[0] <= share <= band.byte_share[1] \
            and band.entropy[0] * min(1, math.log2(max(n, 1)) / 6) <= entropy <= band.entropy[1]
        rows[d] = (script, math.floor(2 * math.log2(max(n, 1))), failed, cpt, share, entropy, fits)
    bands = brute_bands([r[:6] for r in rows.values()])
    want, edge = {}, set()
    for d, r in rows.items():
        inside = not r[2] and r[6]
        if not r[2]:
            for c, x in zip(R.LEAST_SPREAD, r[3:6], strict=True):
                low, high = bands[r[:2]][c]
                inside = inside and low <= x <= high
                edge |= {d} if min(abs(x - low), abs(x - high)) < 1e-6 else set()
        want[d] = inside
    got = {r.doc_id: r.kept for r in R.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()}
    assert {d: k for d, k in got.items() if d not in edge} == {d: k for d, k in want.items() if d not in edge} and len(edge) < 5
    assert sum(want.values()) > 100


def test_rare_lengths_and_small_tables_are_judged(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").collect()]
    tell, model = R.Fertility(R.public_model()), R.public_model()
    good = [t for t in docs if not brute_base(t)[5]][:300]
    rnd = random.Random(1)
    junk = " ".join("".join(rnd.choice("aqzjo") for _ in range(5)) for _ in range(3000))
    words, chars, *_ = R.base_counts(junk)
    script, cpt, share, entropy, n = tell(words, chars)
    assert not brute_base(junk)[5] and R.in_bands(R.BANDS, None, script, cpt, share, entropy, n)     # only a corpus band can tell
    for some in (good, good[:30]):
        df = spark.createDataFrame([*enumerate(some), (-1, junk)], "doc_id long, text string")
        got = {r.doc_id: r.kept for r in R.quality_rules(df, model).collect()}
        assert not got[-1] and sum(got.values()) >= 0.9 * len(some)

import re

from pyspark.sql import functions as F

from gradeframe.llm import license_index as L

SF = "/root/testdata/sf0.01"


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for p, lab in L.PHRASES:
        p = p.split()
        s = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += s
        labels |= {lab} if s else set()
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def check(rows, texts):
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr) == \
        sorted(((d, *brute(t)) for d, t in texts), key=repr)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_cases(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = [(1, None), (2, ""), (3, " .,- "), (4, "Released UNDER the MIT License. under-the/mit(license) x"),
             (5, gpl), (6, "x " * 30_000 + gpl + " y" * 30_000), (7, "the license of the mit under apache version 2 cc nc by"),
             (8, "CC BY-NC 4.0 cc byK nc cc by nc nc"), (None, "Apache License, Version 2.0"), (9, "apache license version 20"),
             (10, "under the mit license " * 3000), (10, "É apache license version 2 İ"),
             (11, "THE SOFTWARE. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
             (12, "Redistribution and use in source and binary, with modification permitted"),
             (13, "mit License der under lIcense K")] * 2
    df = (spark.createDataFrame(texts, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("rid", F.lit("a"))
          .withColumn("w", F.lit(1)))
    rows = L.scan(df).collect()
    check(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert by[5].labels == "gpl-3" and by[6].labels == "gpl-3" and by[5].score == 1.0
    assert by[11].labels == "mit" and by[12].labels == "" and by[7].labels == ""
    assert by[1].score == 0.0 and by[4].score == 1.0
    assert L.scan(df.limit(0)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = L.op9_license_index(spark, SF)
    rows = out.collect()
    check(rows, docs)
    text = dict(docs)
    for r in rows:
        assert ("gpl-3" in r.labels) == ("GNU General Public License, version 3" in text[r.doc_id])


def brute_labels(text):
    w = re.findall("[a-z0-9]+", text.lower())
    labels = set(filter(None, brute(text)[4].split(",")))
    for t in L.TEMPLATES:
        words, key = t.words.split(), t.key.split()
        place = L._key_place(t)
        for i in range(len(w)):
            off = i - place
            agree = sum(0 <= off + j < len(w) and w[off + j] == x for j, x in enumerate(words))
            if w[i:i + len(key)] == key and agree >= L.LEAST_SHARE * len(words):
                labels.add(t.label)
    return ",".join(sorted(labels))


def test_several_licences_in_one_file(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    bsd = next(t.words for t in L.TEMPLATES if t.label == "bsd")
    mit = next(t.words for t in L.TEMPLATES if t.words.startswith("permission"))
    texts = [bsd + " or " + gpl, mit + ". " + gpl, bsd + " " + mit + " " + gpl, gpl + " x " + gpl.replace("3", "2") + " " + bsd,
             "all " + " and ".join(t.words for t in L.TEMPLATES)] + [gpl] * 60       # GPL words are common, of low IDF
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute_labels(t) for i, t in enumerate(texts)}
    assert want[0] == "bsd,gpl-3" and want[1] == "gpl-3,mit" and want[2] == "bsd,gpl-3,mit"
    for top in (L.TOP_WORDS, 1, 1000):
        assert {r.doc_id: r.labels for r in L.scan(df, top_words=top).collect()} == want


def brute_score(text):
    """1 with a phrase, else the best share of agreeing words, half of it where the key does not stand."""
    if brute(text)[1]:
        return 1.0
    w = re.findall("[a-z0-9]+", text.lower())
    if not any(set(p.split()) <= set(w) for p in [p for p, _ in L.PHRASES] + [t.key for t in L.TEMPLATES]):
        return 0.0
    best = 0.0
    for t in L.TEMPLATES:
        words, key, place = t.words.split(), t.key.split(), L._key_place(t)
        for off in range(-len(words), len(w)):
            agree = sum(0 <= off + j < len(w) and w[off + j] == x for j, x in enumerate(words))
            if agree > 1:
                held = off + place >= 0 and w[off + place:off + place + len(key)] == key
                best = max(best, agree / len(words) * (1 if held else 0.5))
    return best


def test_score_against_brute_force_whatever_is_looked_up(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    bsd = next(t.words for t in L.TEMPLATES if t.label == "bsd")
    cut = " ".join(bsd.split()[6:]) + " forms source in use and redistribution"
    texts = [cut, cut + " the license of the public gnu general version 3", "the mit x license", "mit the license under", gpl[20:], "gnu license x general public lesser",
             "under the mit license", "nothing at all", "", bsd.replace("source", "sauce"), "in " + gpl.replace("General", "generic general")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: round(brute_score(t), 9) for i, t in enumerate(texts)}
    assert 0 < want[0] < 1 and want[7] == 0
    more = df.union(spark.createDataFrame([(100 + i, gpl) for i in range(50)] + [(200 + i, cut) for i in range(50)], df.schema))
    for some, top in ((df, L.TOP_WORDS), (df, 1), (more, L.TOP_WORDS), (more, 1)):
        got = {r.doc_id: round(r.score, 9) for r in L.scan(some, top_words=top).collect() if r.doc_id < 100}
        assert got == want

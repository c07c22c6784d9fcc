"""Licence scan by a positional index of rare words.

One pass splits every whole text into words and keeps, for texts that hold all
words of at least one key phrase, the positions of licence words; of other
texts only the word count and which licence words occur. From these come the
document frequencies of the licence words over the whole corpus.

The index holds a posting (template, position) per licence word. A file looks
up its highest-IDF licence words; every hit proposes a template at an offset
(position in the file minus position in the template). The rarest word of a
template's key phrase proposes it too, in every file and whatever the ranks, so
labels do not depend on how many words are looked up. All licence words then
vote for (template, offset) pairs, which intersects the postings by relative
position. A proposed template counts when enough of its words agree on one
offset and its mandatory key phrase stands whole at that offset. Phrases are
looked up by their own rarest word and must stand whole. The score takes the
best of all pairs, proposed or not, so neither the number of words looked up
nor the frequencies of words in other files touch it.

Positions are rows: a text full of licence words only makes more rows, summed
up map-side first. The templates are a parameter, so their tables are bounded
by it. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, local_rows, table


@dataclass(frozen=True)
class Template:
    """A licence text (words), with a phrase of it that must stand whole."""
    label: str
    words: str
    key: str


#: Phrases that are reported with all their places.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening words of public licence texts and notices.
TEMPLATES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance "
             "with the license", "the apache license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3",
             "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             "creative commons attribution"),
)
#: Licence words a file looks up, and the share of a template's words that must agree.
TOP_WORDS, LEAST_SHARE = 16, 0.6
#: What is no word after lower-casing A-Z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text. ``lower`` also changes letters beyond ASCII; that moves no
    word border and yields no phrase word but through the Kelvin sign, put aside first."""
    plain = F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ"))), BREAKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _units(phrases, templates) -> list[tuple[int, str, str, str]]:
    """(number, kind, label, words): reported phrases, templates and their keys."""
    rows = [("phrase", label, words) for words, label in phrases]
    rows += [("template", t.label, t.words) for t in templates] + [("key", t.label, t.key) for t in templates]
    return [(i, *r) for i, r in enumerate(rows)]


def word_positions(docs: DataFrame, units: Sequence[tuple], id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, n_words, present, hits): the one pass over the texts, checkpointed.

    ``rid`` numbers the rows; as the table is checkpointed the numbers stay.
    """
    vocabulary = sorted({w for *_, words in units for w in words.split()})
    split = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    known = split.select("doc_id", "words", F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("present"))
    whole = None
    for _, kind, _, words in units:
        if kind != "template":
            need = F.array(*map(F.lit, sorted(set(words.split()))))
            one = F.size(F.array_except(need, F.col("present"))) == 0
            whole = one if whole is None else whole | one
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    return checkpoint(known.select("doc_id", F.size("words").cast("long").alias("n_words"), "present",
                                   F.when(whole, hits).alias("hits"))
                      .withColumn("rid", F.monotonically_increasing_id()))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES,
         top_words: int = TOP_WORDS, least_share: float = LEAST_SHARE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Null and empty texts have no words, no labels ("") and score 0; a phrase
    that overlaps itself counts at every start; repeated rows and null ids are
    scanned like any other; other columns are not read; an empty table gives an
    empty result. ``score`` is 1 with a phrase, else the best share of agreeing
    words of a template whose key stands, else half the best share without it (at
    least two words that agree); 0 for a file that holds the words of no key or
    phrase. It depends on the file and the templates alone.
    """
    spark = docs.sparkSession
    units = _units(phrases, templates)
    rows = word_positions(docs, units, id_col, text_col)
    postings = local_rows(spark, [("unit", "int"), ("j", "int"), ("w", "string")],
                          [(n, j, w) for n, *_, words in units for j, w in enumerate(words.split())])
    info = local_rows(spark, [("unit", "int"), ("kind", "string"), ("label", "string"), ("size", "int")],
                      [(n, kind, label, len(words.split())) for n, kind, label, words in units])

    # document frequencies: a row per licence word
    df = rows.select(F.explode("present").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = (postings.select("w").distinct().join(df, "w", "left")
              .select("w", F.coalesce("df", F.lit(0)).alias("df")))
    ranked = checkpoint(ranked)
    anchors = (postings.join(ranked, "w").join(info.filter("kind <> 'template'"), "unit")
               .groupBy("unit").agg(F.min(F.struct("df", "w", "j")).alias("a"))
               .select("unit", F.col("a.w").alias("w"), F.col("a.j").alias("j")))
    n_phrases, n_templates = len(phrases), len(templates)
    places = {i: _key_place(t) for i, t in enumerate(templates)}
    # wherever a key can stand its template is proposed, beside the looked-up words
    of_key = local_rows(spark, [("unit", "int"), ("template", "int"), ("place", "int")],
                        [(n_phrases + n_templates + i, n_phrases + i, place) for i, place in places.items()])
    anchors = anchors.union(anchors.join(of_key, "unit").select("template", "w", F.col("j") + F.col("place")))

    hits = rows.filter(F.col("hits").isNotNull()).select("rid", F.inline("hits"))
    per_file = Window.partitionBy("rid").orderBy("df", "w")             # at most one row per licence word
    top = (rows.filter(F.col("hits").isNotNull()).select("rid", F.explode("present").alias("w")).join(ranked, "w")
           .withColumn("k", F.row_number().over(per_file)).filter(F.col("k") <= top_words).select("rid", "w"))
    wide = postings.join(info.filter("kind = 'template'").select("unit"), "unit")
    offset = (F.col("i") - F.col("j")).alias("off")
    proposed = (hits.join(top, ["rid", "w"]).join(wide, "w").select("rid", "unit", offset)
                .union(hits.join(anchors, "w").select("rid", "unit", offset)).distinct())
    agreed = (hits.join(postings, "w").groupBy("rid", "unit", offset).agg(F.count(F.lit(1)).alias("n")).join(info, "unit")
              .filter((F.col("n") > 1) | (F.col("size") == 1)))
    agreed = checkpoint(agreed.join(proposed.withColumn("proposed", F.lit(True)), ["rid", "unit", "off"], "left")
                        .withColumn("share", F.col("n") / F.col("size")))

    base = (agreed.filter("kind = 'phrase' AND n = size").groupBy("rid")
            .agg(F.count(F.lit(1)).alias("n_base"), F.min("off").alias("first_word"), F.max("off").alias("last_word"),
                 F.collect_set("label").alias("base")))
    at = F.element_at(F.array(*[F.lit(places[i]) for i in range(n_templates)]), F.col("unit") - n_phrases + 1) \
        if n_templates else F.lit(0)
    keys = (agreed.filter("kind = 'key' AND n = size")
            .select("rid", (F.col("unit") - n_templates).alias("unit"), F.col("off").alias("key_at"), F.lit(True).alias("held")))
    found = (agreed.filter("kind = 'template'").withColumn("key_at", F.col("off") + at)
             .join(keys, ["rid", "unit", "key_at"], "left")
             .groupBy("rid").agg(
                 F.collect_set(F.when(F.col("held") & F.col("proposed") & (F.col("share") >= least_share), F.col("label"))).alias("more"),
                 F.max(F.when(F.col("held"), F.col("share")).otherwise(F.col("share") / 2)).alias("best")))
    joined = rows.join(base, "rid", "left").join(found, "rid", "left")
    none = F.array().cast("array<string>")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        text(F.coalesce("base", none)).alias("base_labels"),
        text(F.concat(F.coalesce("base", none), F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _key_place(t: Template) -> int:
    """Where a template's key phrase starts in it."""
    words, key = t.words.split(), t.key.split()
    return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_index": op9_license_index}
ORACLES: dict[str, str] = {}

"""Quality rules from tokeniser fertility, beside word and repetition rules.

A public vocabulary (SentencePiece BPE with byte fallback; the path is a
parameter) says how well a text is covered by ordinary language: characters per
token, the share of byte-fallback tokens, and the entropy of its tokens. A text
is rejected outside the fixed band of its language or script, and outside the
band that the corpus itself shows for its script and length: a robust distance
from the median of all texts of that script and length step that pass the base
rules (entropy grows with length, so one number cannot serve all lengths). A
band rests on the ``NEAREST`` texts that are nearest in length: those of its own
step, all of them, and of the script's other steps, ring by ring, as much as is
still missing, the last ring in part. So a neighbour's weight fades out as a
step fills, and no number of texts switches anything.

The whole texts are read in one Arrow pass without a shuffle; a row of figures
per text is kept. Medians come from counts of rounded figures, so they are
exact, the same on every run, and gathered by map-side sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rules: fewest words, most words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED = 10, 20


#: Corpus bands: distance from the median in median deviations, least deviation of each figure, and steps per
#: doubling of the length.
SPREAD, LEAST_SPREAD = 5.0, {"chars_per_token": 0.2, "byte_share": 0.05, "token_entropy": 0.06}
STEPS = 2
#: Texts a band rests on (own steps with more: all of theirs), and the weight of a text that counts in full: parts are
#: whole numbers, so that sums do not depend on their order.
NEAREST, WEIGHT = 50, 1 << 30


@dataclass(frozen=True)
class Band:
    """Accepted values. The least entropy holds from ``entropy_full`` tokens on; below, it falls with the
    logarithm of their number, as the entropy of so few tokens is bounded by it."""
    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]
    entropy_full: int = 64

    def least_entropy(self, tokens: int) -> float:
        return self.entropy[0] * min(1.0, math.log2(max(tokens, 1)) / math.log2(self.entropy_full))


#: By script, or by "lang:" and a language code, which goes first.
BANDS: Mapping[str, Band] = {
    "latin": Band((1.15, 9.0), (0.0, 0.35), (3.0, 14.0)),
    "cyrillic": Band((1.0, 9.0), (0.0, 0.35), (3.0, 14.0)),
    "greek": Band((0.7, 9.0), (0.0, 0.6), (3.0, 14.0)),
    "cjk": Band((0.3, 4.0), (0.0, 0.9), (3.0, 14.0)),
    "other": Band((0.25, 9.0), (0.0, 1.0), (2.0, 14.0)),
}
#: Code point ranges of the letters that tell a script.
_SCRIPTS = {"latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)), "cyrillic": ((0x400, 0x530),), "greek": ((0x370, 0x400),),
            "cjk": ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4))}
_BREAKS = re.compile(r"[\x20\x09-\x0D]+")


def script_of(text: str) -> str:
    """The script most letters of a text belong to."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    votes = {name: sum(int(((points >= a) & (points < b)).sum()) for a, b in spans) for name, spans in _SCRIPTS.items()}
    best = max(votes, key=lambda s: (votes[s], s))
    return best if votes[best] else "other"


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = [w for w in _BREAKS.split(text) if w]
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    again = 0
    if len(words) > WINDOW:
        wins = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(wins)) < len(wins):
            times = Counter(wins)
            hit = np.fromiter((times[w] > 1 for w in wins), np.int64, len(wins))
            step = np.zeros(len(words) + 1, np.int64)
            step[:len(wins)] += hit
            step[WINDOW:] -= hit
            again = int((np.cumsum(step[:-1]) > 0).sum())
    return words, chars, symbols, len(lines) - len(set(lines)), again


class Fertility:
    """Token statistics of a text's words under one vocabulary."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def __call__(self, words: list[str], chars: int) -> tuple[str, float, float, float, int]:
        """(script, chars per token, byte share, entropy in bits, tokens)."""
        text = " ".join(words)
        ids = np.array(self.model.encode(text), np.int64)
        if not len(ids):
            return "other", 0.0, 0.0, 0.0, 0
        n = np.sort(np.unique(ids, return_counts=True)[1])      # sorted: the same sum for the same counts
        p = n / len(ids)
        return (script_of(text), chars / len(ids), float(self.byte[ids].mean()), float(-(p * np.log2(p)).sum()), len(ids))


def in_bands(bands: Mapping[str, Band], lang: str | None, script: str, cpt: float, share: float, entropy: float,
             tokens: int) -> bool:
    band = bands.get(f"lang:{lang}") or bands.get(script) or bands["other"]
    if not (tokens and band.chars_per_token[0] <= cpt <= band.chars_per_token[1]
            and band.byte_share[0] <= share <= band.byte_share[1]):
        return False
    return band.least_entropy(tokens) <= entropy <= band.entropy[1]


COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
           ("n_repeat_words", "long"), ("base_failed", "boolean"), ("in_band", "boolean"), ("script", "string"),
           ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("n_tokens", "long"))


def figures(docs: DataFrame, model_path: str, bands: Mapping[str, Band] = BANDS, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id and COLUMNS of each row: base counts, token figures, fixed bands."""
    bands = dict(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Fertility(model_path)
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
        for b in batches:
            out = []
            for text, lang in zip(b.column(1), b.column(2), strict=True):
                words, chars, symbols, dup, again = base_counts(text.as_py() or "")
                n = len(words)
                failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
                script, cpt, share, entropy, tokens = tell(words, chars)
                good = in_bands(bands, lang.as_py(), script, cpt, share, entropy, tokens)
                out.append((n, chars, symbols, dup, again, failed, good, script, cpt, share, entropy, tokens))
            cols = zip(*out, strict=True) if out else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, COLUMNS, strict=True))],
                ["doc_id", *(c for c, _ in COLUMNS)])

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    return map_arrow(src, run, "doc_id long, " + ", ".join(f"{c} {k}" for c, k in COLUMNS))


def weighted_median(rows: DataFrame, keys: list[str], x: str, weight: str, out: str) -> DataFrame:
    """(keys, out): the least ``x`` up to which half of the weight of its keys lies.

    Equal values are summed first, so the window of a key has as many rows as it
    has rounded values.
    """
    sums = rows.groupBy(*keys, F.col(x).alias(out)).agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy(out)
    return (sums.select(*keys, out, F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(Window.partitionBy(*keys)).alias("_all"))
            .filter(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys).agg(F.min(out).alias(out)))


def reach(rows: DataFrame) -> DataFrame:
    """(script, step, near, weight): what a text of each step ``near`` weighs for the band of a step.

    The step's own texts weigh WEIGHT. Steps of the script at one distance, on
    both sides, are a ring; the rings are taken from the nearest on until they
    hold NEAREST texts, the last one with the part of its weight that is missing.
    """
    size = rows.filter(~F.col("base_failed")).groupBy("script", "step").agg(F.count(F.lit(1)).alias("texts"))
    pairs = (size.select("script", "step").join(size.withColumnRenamed("step", "near"), "script")
             .withColumn("far", F.abs(F.col("near") - F.col("step"))))
    ring = Window.partitionBy("script", "step").orderBy("far")
    missing = NEAREST - F.coalesce(F.sum("texts").over(ring.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings = pairs.select("script", "step", "near", "far", missing.alias("missing"), F.sum("texts").over(ring.rangeBetween(0, 0)).alias("ring"))
    part = F.when(F.col("far") == 0, F.lit(WEIGHT)).otherwise(F.floor(WEIGHT * F.least(F.lit(1.0), F.col("missing") / F.col("ring"))))
    return (rings.filter((F.col("far") == 0) | (F.col("missing") > 0))
            .select("script", "step", "near", part.cast("decimal(12,0)").alias("weight")).filter("weight > 0"))


def corpus_bands(rows: DataFrame) -> DataFrame:
    """(script, step, low and high of each figure) from the rows that pass the base rules.

    Every step of a script that has such rows gets a band, from the rounded
    figures of the texts that ``reach`` gives it; scripts do not mix, their
    figures differ by nature. A text of a longer step counts with half a bit less
    entropy a step, the most that so much more text can add. At most scripts x
    length steps rows: five scripts and two steps a doubling.
    """
    ok = rows.filter(~F.col("base_failed"))
    pairs = checkpoint(reach(rows))
    out = None
    for c, digits in (("chars_per_token", 2), ("byte_share", 3), ("token_entropy", 2)):
        times = (ok.groupBy("script", F.col("step").alias("near"), F.round(c, digits).alias("x")).agg(F.count(F.lit(1)).alias("n"))
                 .join(F.broadcast(pairs), ["script", "near"])           # at most scripts x steps x steps rows
                 .withColumn("weight", F.col("n").cast("decimal(20,0)") * F.col("weight")))
        if c == "token_entropy":
            times = times.withColumn("x", F.round(F.col("x") - F.greatest(F.col("near") - F.col("step"), F.lit(0)) / STEPS, digits))
        mid = weighted_median(times, ["script", "step"], "x", "weight", "mid")
        far = (times.join(F.broadcast(mid), ["script", "step"])          # at most scripts x steps rows
               .withColumn("far", F.round(F.abs(F.col("x") - F.col("mid")), digits)))
        off = weighted_median(far, ["script", "step"], "far", "weight", "off")
        width = SPREAD * F.greatest("off", F.lit(LEAST_SPREAD[c]))
        one = mid.join(off, ["script", "step"]).select(
            "script", "step", (F.col("mid") - width).alias(f"low_{c}"),
            # unusual but varied words are no fault: entropy has no upper corpus band
            (F.lit(float("inf")) if c == "token_entropy" else F.col("mid") + width).alias(f"high_{c}"))
        out = one if out is None else out.join(one, ["script", "step"])
    return out


def quality_rules(docs: DataFrame, model_path: str, bands: Mapping[str, Band] = BANDS, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, COLUMNS, kept.

    ``kept`` is false where the base rules fail (fewer than 10 words, or over
    20 % of the words in repeated 5-word windows) and else says whether the
    text lies in the fixed and the corpus bands of its script (or language).
    Lengths with few texts are judged with the nearest ones of their script. A null text has no words; a text
    without words fails; repeated rows and null ids are judged like any other;
    other columns are not read; an empty table gives an empty result.
    """
    step = F.floor(STEPS * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")
    rows = checkpoint(figures(docs, model_path, bands, id_col, text_col, lang_col).withColumn("step", step))
    learned = corpus_bands(rows)
    inside = F.col("in_band")
    for c in LEAST_SPREAD:                   # only rows that fail the base rules can be without a band
        inside = inside & F.coalesce(F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")), F.lit(True))
    return (rows.join(F.broadcast(learned), ["script", "step"], "left")      # bounded, see corpus_bands
            .select("doc_id", *(c for c, _ in COLUMNS), (~F.col("base_failed") & inside).alias("kept")))


def public_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), public_model())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_fertility": op6_fertility}
ORACLES: dict[str, str] = {}

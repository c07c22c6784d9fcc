"""Quality classifier: a factorisation machine over words, structure and length.

A text becomes a sparse vector: hashed words (square roots of counts, unit
length) and one indicator per structure or length statistic, by quantile bins
of the training rows. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]

in time linear in the non-zero entries. It is fitted by Adagrad on a bounded
sample of labelled rows (``max_rows``, the smallest hashes of doc_id) in one
task; the model has a fixed size (2^14 words x 9 numbers) and travels with the
scoring pass, which reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

WORD_BITS = 14
BINS = 8
THRESHOLD = 0.3
#: Bound of the training sample, and what is fitted on it.
MAX_ROWS = 10_000
FACTORS, EPOCHS, BATCH, RATE, L2, LEAST_STEPS = 8, 4, 128, 0.08, 1e-5, 300

STATS = ("words", "chars", "upper", "exclaim", "symbol", "bar", "digit", "punct", "word_length", "distinct",
         "top_word", "adjacent", "repeated_lines", "line_words")
#: Classes of bytes: 1 upper, 2 lower or beyond ASCII, 3 digit, 4 "!", 5 symbols, 6 "|", 7 other punctuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 7
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[33], _CLASS[list(b"#*$%&<>~^_=+\\{}[]")], _CLASS[124] = 4, 5, 6


@dataclass
class Model:
    edges: np.ndarray      # (statistics, BINS - 1) bin borders
    bias: float
    linear: np.ndarray     # (features,)
    factors: np.ndarray    # (features, FACTORS)


def n_features() -> int:
    return (1 << WORD_BITS) + len(STATS) * BINS


def describe(text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word features, their values, statistics) of one text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    letters, shown = kinds[1] + kinds[2], max(1, int(kinds[1:].sum()))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = np.array([
        np.log2(1 + n), np.log2(1 + len(raw)), kinds[1] / max(1, letters), kinds[4] / shown, kinds[5] / shown,
        kinds[6] / shown, kinds[3] / shown, kinds[7] / shown, shown / max(1, n), len(counts) / max(1, n),
        max(counts.values(), default=0) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)), np.log2(1 + n / max(1, len(lines)))], np.float32)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), stats
    if len(cache) > 500_000:
        cache.clear()
    ids = np.empty(len(counts), np.int32)
    for k, w in enumerate(counts):
        h = cache.get(w)
        if h is None:
            h = cache[w] = zlib.crc32(w) & ((1 << WORD_BITS) - 1)
        ids[k] = h
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    return ids, values / np.sqrt((values ** 2).sum()), stats


class Rows:
    """A batch of sparse rows: ids and values end to end, ``start`` of each row."""

    def __init__(self, described: list[tuple], edges: np.ndarray):
        stats = np.stack([s for _, _, s in described])
        bins = (stats[:, :, None] > edges[None]).sum(2) + np.arange(len(STATS)) * BINS + (1 << WORD_BITS)
        self.ids = np.concatenate([x for (i, _, _), b in zip(described, bins, strict=True) for x in (i, b)]).astype(np.int64)
        one = np.full(len(STATS), 0.5, np.float32)
        self.values = np.concatenate([x for _, v, _ in described for x in (v, one)])
        sizes = np.array([len(i) + len(STATS) for i, _, _ in described])
        self.start = np.concatenate(([0], np.cumsum(sizes)))

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, values, starts) of some of the rows."""
        sizes = self.start[rows + 1] - self.start[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(sizes.sum()) + np.repeat(self.start[rows] - starts, sizes)
        return self.ids[at], self.values[at], starts


def raw_scores(model: Model, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores before the logistic function, sums v_if x_i per row and factor)."""
    vx = model.factors[ids] * values[:, None]
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat(vx * vx, starts)
    flat = model.bias + np.add.reduceat(model.linear[ids] * values, starts)
    return flat + 0.5 * (sums * sums - squares).sum(1), sums


def chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(described: list[tuple], label: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on log loss; without rows of both labels a constant score."""
    n = n_features()
    rnd = np.random.default_rng(seed)
    if not len(label):
        return Model(np.zeros((len(STATS), BINS - 1), np.float32), 0.0, np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32))
    stats = np.stack([s for _, _, s in described])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    # rare but telling values (a share of "!" that most texts lack) need a border of their own
    top = stats.max(0)
    edges[:, -1] = np.where(edges[:, -1] <= stats.min(0), stats.min(0) + 0.02 * (top - stats.min(0)), edges[:, -1])
    edges.sort(axis=1)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(n, np.float32),
                  rnd.normal(0, 0.05, (n, FACTORS)).astype(np.float32))
    if label.min() == label.max():
        model.factors[:] = 0
        return model
    rows = Rows(described, edges)
    lin_sq, fac_sq = np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32)
    epochs = max(EPOCHS, min(60, -(-LEAST_STEPS * BATCH // len(label))))     # small tables need more passes
    for epoch in range(epochs):
        rate = RATE / (1 + EPOCHS * 0.3 * epoch / epochs)
        order = rnd.permutation(len(label))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            ids, values, starts = rows.part(some)
            raw, sums = raw_scores(model, ids, values, starts)
            slope = (chance(raw) - label[some]).astype(np.float32)
            row = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(ids))))
            gx = slope[row] * values
            model.bias -= 0.1 * rate * float(slope.mean())
            used, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, gx, len(used)).astype(np.float32) + L2 * model.linear[used]
            lin_sq[used] += g * g
            model.linear[used] -= rate * g / np.sqrt(lin_sq[used])
            inner = gx[:, None] * (sums[row] - model.factors[ids] * values[:, None])
            sort = np.argsort(back, kind="stable")
            g2 = np.add.reduceat(inner[sort], np.searchsorted(back[sort], np.arange(len(used)))) + L2 * model.factors[used]
            fac_sq[used] += g2 * g2
            model.factors[used] -= 0.5 * rate * g2 / np.sqrt(fac_sq[used])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    Rows are taken by the smallest hashes of doc_id, so the sample is the same
    however the tables are dealt out; an id with several different labels
    counts as labelled 1 if any is. Ids are bounded by ``max_rows``, so they
    are broadcast to find their texts. Of an id's rows the one with the smallest
    hash of its text counts: each task keeps one per id, an aggregate the least of
    these, so at most ``max_rows`` rows reach the one task that fits the model,
    however often an id is repeated.
    """
    known = (labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(sample), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        best: dict[int, tuple] = {}                            # at most ``max_rows`` ids
        for b in batches:
            for doc, text, h, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if doc not in best or h < best[doc][0]:
                    best[doc] = (h, label, describe(text.as_py(), cache))
        out = list(best.items())
        for k in range(0, len(out), 1000):
            some = out[k:k + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in some], pa.int64()), pa.array([x[0] for _, x in some], pa.int64()), pa.array([x[1] for _, x in some], pa.int32()),
                 *(pa.array([x[2][j] for _, x in some], pa.list_(kind)) for j, kind in enumerate((pa.int32(), pa.float32(), pa.float32())))],
                ["doc_id", "h", "label", "ids", "vals", "stats"])

    def one_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            doc, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            cols = [b.column(k) for k in (2, 3, 4)]
            rows += [(int(doc[i]), int(label[i]), *(c[i].values.to_numpy(zero_copy_only=False) for c in cols))
                     for i in range(b.num_rows)]
        rows.sort(key=lambda r: (r[0], r[1], r[4].tolist(), r[2].tolist()))
        m = fit([r[2:] for r in rows], np.array([r[1] for r in rows], np.float32))
        parts = [m.edges, np.array([m.bias], np.float32), m.linear, m.factors]
        yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["part"])

    found = map_arrow(texts, vectors, "doc_id long, h long, label int, ids array<int>, vals array<float>, stats array<float>")
    rows = (found.groupBy("doc_id").agg(F.min(F.struct("h", "label", "ids", "vals", "stats")).alias("r"))
            .select("doc_id", "r.label", "r.ids", "r.vals", "r.stats"))
    got = [np.frombuffer(r.part, np.float32) for r in map_arrow(rows.repartition(1), one_model, "part binary").collect()]
    return Model(got[0].reshape(len(STATS), BINS - 1), float(got[1][0]), got[2], got[3].reshape(-1, FACTORS))


def score(docs: DataFrame, model: Model, out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) plus ``out``, the chance that the text is of good quality.

    Null texts count as empty; an empty text has the score of its (zero)
    statistics; repeated rows score alike; other columns pass through untouched
    (a column named ``out`` is replaced); an empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    src = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep if c != "text"],
                                                                         F.lit(0).alias("_")).alias("row"))
    with_text = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = Rows([describe(t.as_py(), cache) for t in part.column(0)], model.edges)
                raw, _ = raw_scores(model, rows.ids, rows.values, rows.start[:-1])
                chances = pa.array(chance(raw).astype(np.float64))
                cols = [part.column(1), chances] + [part.column(0)] * with_text
                yield pa.RecordBatch.from_arrays(cols, ["row", out] + ["text"] * with_text)

    schema = T.StructType([src.schema["row"], T.StructField(out, T.DoubleType())]
                          + [T.StructField("text", T.StringType())] * with_text)
    scored = map_arrow(src, run, schema)
    return scored.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep], F.col(f"`{out}`"))


def good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` does not reject."""
    scored = score(docs, train(docs, labels, max_rows), "_score")
    return scored.filter(F.col("_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (score(docs, model, keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


QUERIES = {"op3_quality_fm": op3_quality_fm}
ORACLES: dict[str, str] = {}

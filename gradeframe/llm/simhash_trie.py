"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

1. One Python pass per text turns it into a 64-bit fingerprint (lower-cased
   A-Z, words, ``shingle``-word windows, XXH64 with seed 42, bit majority).
2. Equal fingerprints collapse to one row (map-side aggregate), so thousands
   of exact copies cost one trie leaf.
3. Of ``max_bits + k`` bit blocks, two fingerprints that differ in at most
   ``max_bits`` bits agree in at least ``k``. For each choice of k blocks these
   come first: the top levels of the trie are then an equality key, by which
   Spark deals out the subtries. Only subtries meet here, never whole tables. k
   (1 to 3: keys of 12, 20 or 27 bits, 5, 15 or 35 tries) follows from the number
   of fingerprints so that subtries stay small; the links are the same.
4. Inside a subtrie, pairs of trie nodes are walked together from the root: a
   pair splits into its children's pairs, differing bits add up and a pair over
   the budget is dropped. Small pairs are compared leaf by leaf. All subtries
   of a batch are walked at once, level by level, in numpy.
5. A task reports each linked leaf once, with the first leaf of its local
   group, so its output grows with its leaves and not with their pairs.
   ``graph.components`` joins the groups of all blocks.

A subtrie with more than ``subtrie_rows`` leaves all the same (many different texts
sharing the blocks) is divided by its next bits; pairs of parts whose bits differ within
the budget meet in one task each, so no link is lost and no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, table
from .graph import components

BITS = 64
SEED = 42
#: Node pairs held at once while walking a trie, and leaf pairs below which a pair is compared directly.
WALK_PAIRS, LEAF_PAIRS = 1 << 19, 64


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of one text; 0 for a text without words."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "doc_id long, fp long")


Block = tuple[int, int]


def blocks(max_bits: int, agree: int = 1) -> list[Block]:
    """(first bit from the top, width) of each of the ``max_bits + agree`` blocks."""
    n = max_bits + agree
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def keys(max_bits: int, agree: int = 1) -> list[tuple[list[Block], list[Block]]]:
    """(blocks that make the key, the other blocks) of each trie."""
    every = blocks(max_bits, agree)
    return [(list(c), [b for b in every if b not in c]) for c in combinations(every, agree)]


def key_bits(max_bits: int, agree: int) -> int:
    return min(sum(w for _, w in c) for c, _ in keys(max_bits, agree))


def agreeing(fingerprints_: int, max_bits: int, subtrie_rows: int) -> int:
    """Blocks of a key: the fewest for which an even subtrie has at most a quarter of ``subtrie_rows``."""
    return next((k for k in (1, 2) if fingerprints_ <= (subtrie_rows << key_bits(max_bits, k)) // 4), 3)


def key_first(fp: np.ndarray, trie: np.ndarray, tries: list[tuple[list[Block], list[Block]]]) -> np.ndarray:
    """The bits of each fingerprint with the key of its trie before the others."""
    out = np.zeros_like(fp)
    for k, (chosen, rest) in enumerate(tries):
        mine = trie == k
        x, y = fp[mine], np.zeros(int(mine.sum()), np.uint64)
        for first, width in (*chosen, *rest):
            y = (y << np.uint64(width)) | ((x >> np.uint64(BITS - first - width)) & np.uint64((1 << width) - 1))
        out[mine] = y
    return out


def merge_groups(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the groups of ``i`` and ``j``; a label is the smallest index of its group."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def walk(rot: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray,
         top: int, max_bits: int) -> np.ndarray:
    """Group labels of the leaves ``rot`` after walking the given node pairs.

    A node is a range of ``rot`` that shares its leading bits; ranges are
    sorted. A pair of a node with itself stands for the pairs inside it.
    """
    m = len(rot)
    label = np.arange(m)
    stack = [(top, a0, a1, b0, b1, np.zeros(len(a0), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        t, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > WALK_PAIRS:
            h = len(a0) // 2
            stack += [(t, a0[h:], a1[h:], b0[h:], b1[h:], d[h:]), (t, a0[:h], a1[:h], b0[:h], b1[:h], d[:h])]
            continue
        na, nb = a1 - a0, b1 - b0
        small = (na * nb <= LEAF_PAIRS) | (t >= BITS)
        if small.any():
            sa, sb, sn, w = a0[small], b0[small], (na * nb)[small], nb[small]
            of = np.repeat(np.arange(len(sa)), sn)
            off = np.arange(len(of)) - np.repeat(np.cumsum(sn) - sn, sn)
            i, j = sa[of] + off // w[of], sb[of] + off % w[of]
            near = (i < j) & (np.bitwise_count(rot[i] ^ rot[j]) <= max_bits)
            label = merge_groups(label, i[near], j[near])
            a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        if t not in ones:
            ones[t] = np.concatenate(([0], np.cumsum((rot >> np.uint64(BITS - 1 - t)) & np.uint64(1)))).astype(np.int64)
        c = ones[t]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        kids = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        other = ~((a0 == b0) & (a1 == b1))      # inside one node the two mixed pairs are the same
        kids.append((am[other], a1[other], b0[other], bm[other], d[other] + 1))
        parts = []
        for x0, x1, y0, y1, e in kids:
            keep = (x1 > x0) & (y1 > y0) & (e <= max_bits)
            keep &= ~((x1 - x0 == 1) & (x0 == y0) & (x1 == y1))
            parts.append([v[keep] for v in (x0, x1, y0, y1, e)])
        joined = [np.concatenate(v) for v in zip(*parts, strict=True)]
        if len(joined[0]):
            stack.append((t + 1, *joined))
    return label


def _subtries(max_bits: int, agree: int, buffer_rows: int):
    """Arrow function: rows (blk, val, p, q, side, fp) sorted by all of them -> (u, v); blk is the number of the trie."""
    tries, top = keys(max_bits, agree), key_bits(max_bits, agree)

    def solve(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        blk, val, p, q, side, fp = cols
        rot = key_first(fp.view(np.uint64), blk, tries)
        order = np.lexsort((rot, side, q, p, val, blk))
        blk, val, p, q, side, fp, rot = (x[order] for x in (blk, val, p, q, side, fp, rot))
        n = len(rot)
        new_sub = np.ones(n, bool)
        new_sub[1:] = (blk[1:] != blk[:-1]) | (val[1:] != val[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        new_side = new_sub.copy()
        new_side[1:] |= side[1:] != side[:-1]
        sub = np.cumsum(new_sub) - 1
        at = np.flatnonzero(new_side)
        end = np.append(at[1:], n)
        own = p[at] == q[at]
        two = np.flatnonzero(~own[:-1] & ~own[1:] & (sub[at[:-1]] == sub[at[1:]])) if len(at) > 1 else np.array([], int)
        a0 = np.concatenate((at[own], at[two]))
        a1 = np.concatenate((end[own], end[two]))
        b0 = np.concatenate((at[own], at[two + 1]))
        b1 = np.concatenate((end[own], end[two + 1]))
        label = walk(rot, a0, a1, b0, b1, top, max_bits)
        led = np.flatnonzero(label != np.arange(n))
        return fp[led], fp[label[led]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out(cols):
            u, v = solve(cols)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            size += b.num_rows
            if size < buffer_rows:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.ones(size, bool)           # the last subtrie may go on in the next batch
            for c in cols[:4]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield out([c[:cut] for c in cols])
            held, size = [[c[cut:] for c in cols]], size - cut
        if size:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _near_prefixes(bits: int, max_bits: int) -> list[int]:
    """All bit patterns of ``bits`` bits with at most ``max_bits`` ones."""
    return [sum(1 << i for i in c) for k in range(min(bits, max_bits) + 1) for c in combinations(range(bits), k)]


def _bits(block: Block, width: int | None = None) -> Column:
    """The first ``width`` bits of a block (all of them if None)."""
    first, own = block
    width = own if width is None else width
    return F.shiftrightunsigned("fp", BITS - first - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _divided(rows: DataFrame, max_bits: int, agree: int, subtrie_rows: int) -> DataFrame:
    """Add (p, q, side): 0 for small subtries, pairs of parts for large ones."""
    large = checkpoint(rows.groupBy("blk", "val").count().filter(F.col("count") > subtrie_rows))
    plain = [F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side")]
    if large.isEmpty():
        return rows.select("blk", "val", *plain, "fp")
    small = rows.join(large, ["blk", "val"], "left_anti").select("blk", "val", *plain, "fp")
    depth = 6                                    # the bits after the key, at the head of the first other block
    own = F.element_at(F.array(*[_bits(rest[0], depth) for _, rest in keys(max_bits, agree)]), F.col("blk") + 1)
    near = F.array(*[F.lit(x) for x in _near_prefixes(depth, max_bits)])
    big = (rows.join(large.drop("count"), ["blk", "val"]).withColumn("own", own.cast("int"))
           .select("blk", "val", "own", "fp", F.explode(near).alias("flip"))
           .withColumn("other", F.col("own").bitwiseXOR(F.col("flip")))
           .select("blk", "val", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                   F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp"))
    return small.union(big)


def trie_links(fps: DataFrame, max_bits: int, subtrie_rows: int = 50_000, buffer_rows: int = 200_000,
               agree: int | None = None) -> DataFrame:
    """(u, v) links that join exactly the fingerprints reachable at ``max_bits`` or fewer bits.

    ``fps`` holds one row per fingerprint (column ``fp``, long); without
    ``agree`` the number of blocks in a key follows from their number.
    """
    agree = agree or agreeing(fps.count(), max_bits, subtrie_rows)
    parts = []
    for k, (chosen, _) in enumerate(keys(max_bits, agree)):
        value = F.lit(0).cast("long")
        for block in chosen:
            value = F.shiftleft(value, block[1]).bitwiseOR(_bits(block))
        parts.append(F.struct(F.lit(k).alias("blk"), value.cast("int").alias("val")))
    rows = fps.select("fp", F.inline(F.array(*parts)))
    by = ["blk", "val", "p", "q"]
    dealt = _divided(rows, max_bits, agree, subtrie_rows).repartition(*by).sortWithinPartitions(*by)
    return map_arrow(dealt, _subtries(max_bits, agree, buffer_rows), "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id among all rows whose fingerprints
    are reachable over links of at most ``max_bits`` bits. Null and empty texts
    have fingerprint zero and link like any other; rows with a null doc_id take
    part but never name a group that has another id (a group of such rows alone
    has a null component_id); repeated rows each get a row; other columns are
    not read; an empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(trie_links(classes.select("fp"), max_bits))
    rooted = checkpoint(classes.join(roots, classes["fp"] == roots["node"], "left")
                        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    # both sides of the next join are tables, so Spark can split a large group's rows
    smallest = checkpoint(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_fp = checkpoint(rooted.join(smallest, "root").select("fp", "component_id"))
    return (rows.join(by_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document kept per group: the smallest doc_id.

    Of repeated rows with that doc_id one is kept; nulls in doc_id come last.
    """
    ids = simhash_groups(docs, shingle, max_bits)
    keep = ids.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    nameless = ids.filter(F.col("component_id").isNull()).select("fingerprint").distinct()
    from pyspark.sql import Window
    named = (docs.filter(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi")
             .withColumn("_row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))))
             .filter("_row = 1").select(*docs.columns))
    lone = _nameless(docs, nameless, shingle)
    return named if lone is None else named.unionByName(lone)


def _nameless(docs: DataFrame, fingerprints_left: DataFrame, shingle: int) -> DataFrame | None:
    """One row for each group that has no doc_id at all (None if there is no such group)."""
    if fingerprints_left.isEmpty():
        return None
    from pyspark.sql import Window
    fps = map_arrow(docs.filter(F.col("doc_id").isNull()).select("text").distinct(), _text_fps(shingle),
                    "text string, fingerprint string")
    w = Window.partitionBy("fingerprint").orderBy(F.xxhash64(*docs.columns))
    rows = (docs.filter(F.col("doc_id").isNull()).join(fps, docs["text"].eqNullSafe(fps["text"]))
            .drop(fps["text"]).join(fingerprints_left, "fingerprint", "left_semi"))
    return rows.withColumn("_row", F.row_number().over(w)).filter("_row = 1").select(*docs.columns)


def _text_fps(shingle: int):
    def run(batches):
        for b in batches:
            hexes = [format(fingerprint(t.as_py(), shingle), "016x") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexes, pa.string())], ["text", "fingerprint"])
    return run


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}

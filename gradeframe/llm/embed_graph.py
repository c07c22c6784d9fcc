"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors of a label collapse to one class (map-side aggregate).
2. Spherical k-means on a bounded sample of each label's classes gives centres;
   labels of up to ``shard_rows`` classes are one shard. Every class joins the
   shards of its ``overlap`` nearest centres; shards over the size are divided
   by a hash. A task builds one shard's graph: near and far neighbours and
   reverse edges, pruned so that a kept neighbour hides those it is closer to.
3. The adjacency lists of a class from all its shards are united.
4. Every class queries its ``probes`` nearest shards: greedy search from the
   shard's medoid with a beam, then range expansion, which follows every vector
   found within the threshold until no new one turns up. Cosines that count are
   computed in double precision.
5. A sample of queries is compared with all rows by brute force; below
   ``least_recall`` the search is repeated with twice the probes and beam.

A link is counted by the first of its vector's shards that the query probes, so
counts need no table of pairs; for components a task reports each linked vector
once, as in ``simhash_trie``. Output and shuffles grow with the vectors, not
with the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, python_ready, table
from .graph import components
from .simhash_trie import merge_groups


@dataclass(frozen=True)
class Setting:
    threshold: float = 0.93
    shard_rows: int = 600        # classes a shard aims at; hash parts above twice as many
    sample_rows: int = 8192      # of each label, for its centres
    most_centres: int = 65_536   # of all labels together: bounds what is broadcast
    overlap: int = 2
    probes: int = 6
    beam: int = 16
    near: int = 16               # neighbours kept of the nearest, of farther rings, and with reverse edges
    far: int = 8
    degree: int = 32
    alpha: float = 1.2
    audit: int = 128             # queries compared with all rows
    least_recall: float = 0.99
    refused_recall: float = 0.9  # below it, after the widest search, there is an error instead of a result
    query_rows: int = 20_000     # queries of one search task


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length (double precision)."""
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


# ---- one shard ---------------------------------------------------------------

def prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, most: int, alpha: float) -> np.ndarray:
    """Robust pruning of a row of candidates (-1 for none) for each node: nearest first; a
    kept neighbour hides those ``alpha`` times closer to it than to the node."""
    rows = np.arange(len(nodes))
    sims = np.einsum("nld,nd->nl", x[pool], x[nodes])
    sims[(pool < 0) | (pool == nodes[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
    open_, dist = np.isfinite(sims), 1 - sims
    vectors = x[pool]
    between = 1 - vectors @ vectors.transpose(0, 2, 1)
    kept = np.full((len(nodes), min(most, pool.shape[1])), -1)
    for k in range(kept.shape[1]):
        best = open_.argmax(1)
        has = open_[rows, best]
        if not has.any():
            break
        kept[has, k] = pool[rows, best][has]
        open_ &= alpha * between[rows, best] > dist
        open_[rows, best] = False
    return kept


def build(x: np.ndarray, s: Setting) -> list[list[int]]:
    """Out-neighbours of every row of ``x`` (unit rows)."""
    m = len(x)
    if m <= s.degree + 1:
        return [[j for j in range(m) if j != i] for i in range(m)]
    x32 = x.astype(np.float32)
    close = min(m - 1, 3 * s.near)
    rings = np.unique(np.minimum(m - 1, (close * 1.3 ** np.arange(1, 32)).astype(int)))
    out: list[list[int]] = []
    for a in range(0, m, 256):
        nodes = np.arange(a, min(a + 256, m))
        order = np.argsort(-(x32[nodes] @ x32.T), axis=1, kind="stable")
        both = np.concatenate((prune(x32, nodes, order[:, :close + 1], s.near, s.alpha),
                               prune(x32, nodes, order[:, rings], s.far, s.alpha)), 1)
        out += [[j for j in row if j >= 0] for row in both.tolist()]
    back: list[list[int]] = [[] for _ in range(m)]
    for i, some in enumerate(out):
        for j in some:
            back[j].append(i)
    by_size = sorted((i for i in range(m) if back[i]), key=lambda i: len(back[i]))
    while by_size:                       # nodes with as many reverse edges together, largest tables bounded
        width = len(back[by_size[-1]])
        n = max(1, (1 << 20) // (width * width))
        some, by_size = by_size[-n:], by_size[:-n]
        pool = np.array([back[i] + [-1] * (width - len(back[i])) for i in some])
        for i, row in zip(some, prune(x32, np.array(some), pool, s.degree - s.near, s.alpha).tolist(), strict=True):
            out[i] = sorted({*out[i], *(j for j in row if j >= 0)})
    return spanned(x32, linked_both_ways(x32, out, s.threshold), medoid(x))


def linked_both_ways(x: np.ndarray, out: list[list[int]], threshold: float) -> list[list[int]]:
    """Edges within the threshold in both directions, and more of them until rows that
    links join are joined by edges, so that range expansion gets everywhere from any of them."""
    m = len(x)
    i = np.repeat(np.arange(m), [len(o) for o in out])
    j = np.concatenate([np.array(o, int) for o in out])
    near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    pairs = [(i[near], j[near])]
    label = merge_groups(np.arange(m), *pairs[0])
    for a in range(0, m, 512):
        r, c = np.nonzero(x[a:a + 512] @ x.T >= threshold)
        r = r + a
        while (apart := label[r] != label[c]).any():
            r, c = r[apart], c[apart]
            some = np.unique(label[r] * m + label[c], return_index=True)[1]     # one pair for two groups
            pairs.append((r[some], c[some]))
            label = merge_groups(label, r[some], c[some])
    sets = [set(o) for o in out]
    for r, c in pairs:
        for u, v in zip(r.tolist(), c.tolist(), strict=True):
            sets[u].add(v)
            sets[v].add(u)
    return [sorted(o) for o in sets]


def spanned(x: np.ndarray, out: list[list[int]], start: int) -> list[list[int]]:
    """Edges added until every row can be reached from ``start``: the row nearest to
    what is reached hangs on its nearest reached row, and so on."""
    m = len(x)
    best, via, reached = np.full(m, -2.0, np.float32), np.zeros(m, int), np.zeros(m, bool)
    front = [start]
    while True:
        while front:
            reached[front] = True
            new = np.array(front)
            sims = x[new] @ x.T
            top = sims.argmax(0)
            high = sims[top, np.arange(m)]
            better = high > best
            best[better], via[better] = high[better], new[top[better]]
            front = sorted({j for i in front for j in out[i] if not reached[j]})
        if reached.all():
            return out
        u = int(np.where(reached, -3, best).argmax())
        out[int(via[u])].append(u)
        front = [u]


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def search(x: np.ndarray, edges: list[list[int]], q: np.ndarray, s: Setting, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with a cosine of at least the threshold, found over the graph.

    All queries take a step at a time. Range expansion goes on while an
    unexpanded row within the threshold is known.
    """
    size = np.array([len(e) for e in edges])
    first = np.cumsum(size) - size
    flat = np.concatenate([np.array(e, int) for e in edges])
    m, n = len(x), len(q)
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    start = medoid(x)
    seen, todo = np.zeros((n, m), bool), np.zeros((n, m), bool)       # todo: within the range, not expanded
    ids = np.full((n, beam), -1)
    sims = np.full((n, beam), -2.0, np.float32)
    fresh = np.zeros((n, beam), bool)                                 # in the beam, not expanded
    ids[:, 0], sims[:, 0], fresh[:, 0] = start, q32 @ x32[start], True
    seen[:, start] = True
    found_q, found_x = [], []
    edge = np.float32(s.threshold - 1e-4)

    def note(rows, nodes, got):
        hit = got >= edge
        todo[rows[hit], nodes[hit]] = True
        found_q.append(rows[hit])
        found_x.append(nodes[hit])

    note(np.arange(n), np.full(n, start), sims[:, 0])
    live = np.arange(n)
    while len(live):
        best = np.where(fresh[live], sims[live], -3).argmax(1)
        has = fresh[live, best]
        node = np.where(has, ids[live, best], -1)
        fresh[live, best] = False
        rest = np.flatnonzero(~has)
        if len(rest):                          # the beam is done: follow rows within the range
            at = live[rest]
            some = todo[at].argmax(1)
            node[rest] = np.where(todo[at, some], some, -1)
        go = node >= 0
        live, node = live[go], node[go]
        if not len(live):
            break
        todo[live, node] = False
        row = np.repeat(np.arange(len(live)), size[node])
        nxt = flat[np.arange(len(row)) + np.repeat(first[node] - (np.cumsum(size[node]) - size[node]), size[node])]
        new = ~seen[live[row], nxt]
        row, nxt = row[new], nxt[new]
        if not len(row):
            continue
        seen[live[row], nxt] = True
        got = np.einsum("ij,ij->i", q32[live[row]], x32[nxt])
        note(live[row], nxt, got)
        order = np.lexsort((-got, row))                                # each query's best new rows
        row, nxt, got = row[order], nxt[order], got[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, nxt, got, nth = (v[nth < beam] for v in (row, nxt, got, nth))
        new_ids, new_sims = np.full((len(live), beam), -1), np.full((len(live), beam), -2.0, np.float32)
        new_ids[row, nth], new_sims[row, nth] = nxt, got
        every = np.concatenate((sims[live], new_sims), 1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(every, top, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], new_ids), 1), top, 1)
        fresh[live] = np.take_along_axis(np.concatenate((fresh[live], new_ids >= 0), 1), top, 1)
    fq, fx = np.concatenate(found_q), np.concatenate(found_x)
    exact = np.einsum("ij,ij->i", q[fq], x[fx])
    return fq[exact >= s.threshold], fx[exact >= s.threshold]


# ---- tables ------------------------------------------------------------------

def valid(v: str) -> Column:
    """Neither null nor zero nor with null, NaN or infinite components."""
    usable = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & usable & F.exists(v, lambda e: e != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """(cid, label, dim, vec, n, first_id): one row per label and vector."""
    one = (rows.filter(F.col("label").isNotNull() & valid("vec")).groupBy("label", "vec")
           .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")))
    return checkpoint(one.withColumn("dim", F.size("vec")).withColumn("cid", F.monotonically_increasing_id()))


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from spread rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(8):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def centres_of(classes: DataFrame, s: Setting) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (label, dim), for those that need more than one shard.

    The number of centres is bounded by ``most_centres`` over all labels and by a
    sixteenth of ``sample_rows`` per label, so the result fits the driver and a
    broadcast at any size of the table.
    """
    groups = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("m"))
    total = classes.count()
    k = F.least(F.ceil(F.col("m") / s.shard_rows), F.floor(F.col("m") * F.lit(s.most_centres) / F.lit(max(1, total))),
                F.lit(s.sample_rows // 16))
    large = groups.withColumn("k", k.cast("int")).filter("k > 1")
    w = Window.partitionBy("label", "dim").orderBy(F.xxhash64("vec"), "cid")
    sample = (classes.join(large, ["label", "dim"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= s.sample_rows)
              .select("label", "dim", "k", "r", "vec"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        c = _means(unit(matrix(pdf["vec"])), int(pdf["k"].iloc[0]))
        return pd.DataFrame({"label": key[0], "dim": key[1], "centres": [c.astype(np.float32).tobytes()]})

    python_ready(classes.sparkSession)
    made = sample.groupBy("label", "dim").applyInPandas(fit, "label int, dim int, centres binary").collect()
    return {(r.label, r.dim): np.frombuffer(r.centres, np.float32).reshape(-1, r.dim).astype(np.float64) for r in made}


def assign(classes: DataFrame, centres: dict, most: int) -> DataFrame:
    """(cid, label, dim, vec, n, shards): the ``most`` nearest shards, nearest first."""
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            shards = np.empty(len(pdf), object)
            for (label, dim), at in pdf.groupby(["label", "dim"]).indices.items():
                c = held.value.get((label, dim))
                if c is None:
                    near = np.zeros((len(at), 1), np.int32)
                else:
                    near = np.argsort(-(unit(matrix(pdf["vec"].iloc[at])) @ c.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                for i, row in zip(at, near, strict=True):
                    shards[i] = row
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(shards, pa.list_(pa.int32()))],
                                             ["cid", "label", "dim", "vec", "n", "shards"])

    return map_arrow(classes.select("cid", "label", "dim", "vec", "n"), run,
                     "cid long, label int, dim int, vec array<float>, n long, shards array<int>")


KEY = ["label", "dim", "shard", "part"]


def shard_graphs(members: DataFrame, s: Setting) -> DataFrame:
    """(cid, near): each member's neighbours (cids) in the graph of its shard."""
    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        cid = pdf["cid"].to_numpy()
        edges = build(unit(matrix(pdf["vec"])), s)
        return pd.DataFrame({"cid": cid, "near": [cid[e] for e in edges]})

    python_ready(members.sparkSession)
    return members.select(*KEY, "cid", "vec").groupBy(*KEY).applyInPandas(graph, "cid long, near array<long>")


def united(lists: DataFrame) -> DataFrame:
    """(cid, near): all neighbours from a class's shards (at most ``overlap`` lists of bounded length)."""
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def found_in_shards(index: DataFrame, queries: DataFrame, s: Setting, beam: int) -> DataFrame:
    """(u, v, hits): per query u its links counted in this shard (v null), and links
    (hits null) that join the linked vectors of the shard."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["u", "v", "hits"], [pa.int64(), pa.int64(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        idx, qs = left.to_pandas().sort_values("cid"), right.to_pandas().sort_values("cid")
        cid, qid = idx["cid"].to_numpy(), qs["cid"].to_numpy()
        x, q = unit(matrix(idx["vec"])), unit(matrix(qs["vec"]))
        place = {c: i for i, c in enumerate(cid.tolist())}
        lists = [[place[c] for c in near if c in place] for near in idx["near"]]
        n, first = idx["n"].to_numpy(), idx["first"].to_numpy()
        shard = int(idx["shard"].iloc[0])
        probes = qs["shards"].tolist()
        label = np.arange(len(cid) + len(qid))
        counts = np.zeros(len(qid), np.int64)
        step = max(16, min(1024, (1 << 22) // len(cid)))
        for a in range(0, len(qid), step):
            fq, fx = search(x, lists, q[a:a + step], s, beam)
            fq = fq + a
            other = cid[fx] != qid[fq]
            fq, fx = fq[other], fx[other]
            label = merge_groups(label, fx, len(cid) + fq)
            # a vector that is here by its second shard counts only where the query misses its first
            mine = np.array([first[v] == shard or first[v] not in probes[u] for u, v in zip(fq, fx, strict=True)], bool)
            np.add.at(counts, fq[mine], n[fx[mine]])
        both = np.concatenate((cid, qid))
        led = np.flatnonzero(both != both[label])
        some = np.flatnonzero(counts)
        return pa.Table.from_arrays(
            [pa.array(np.concatenate((qid[some], both[led]))),
             pa.array([None] * len(some) + both[label[led]].tolist(), pa.int64()),
             pa.array(counts[some].tolist() + [None] * len(led), pa.int64())], names)

    python_ready(index.sparkSession)
    parts = [*KEY, "chunk"]
    return index.groupBy(*parts).cogroup(queries.groupBy(*parts)).applyInArrow(run, "u long, v long, hits long")


def links_of(classes: DataFrame, s: Setting) -> tuple[DataFrame, DataFrame, float]:
    """((cid, hits), (u, v) links that give the components, recall on the audited queries)."""
    truth = audit_truth(classes, s)
    centres = centres_of(classes, s)
    most_shards = max([len(c) for c in centres.values()], default=1)
    probes, beam = s.probes, s.beam
    while True:
        near = checkpoint(assign(classes, centres, max(probes, s.overlap)))
        first = F.col("shards")[0].alias("first")
        member = (near.select("label", "dim", "cid", "vec", "n", first, F.explode(F.slice("shards", 1, s.overlap)).alias("shard")))
        sizes = member.groupBy("label", "dim", "shard").agg(F.count(F.lit(1)).alias("size"))
        parts = checkpoint(sizes.select("label", "dim", "shard", F.when(F.col("size") > 4 * s.shard_rows,
                           F.ceil(F.col("size") / (2 * s.shard_rows))).otherwise(1).cast("int").alias("parts")))
        # hash parts of a large shard: a member lives in one, a query visits all
        member = checkpoint(member.join(parts, ["label", "dim", "shard"])
                            .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts"))
        adjacency = united(shard_graphs(member, s))
        asked = (near.select("label", "dim", "cid", "vec", "shards", F.explode(F.slice("shards", 1, probes)).alias("shard"))
                 .join(parts, ["label", "dim", "shard"]))
        loads = checkpoint(asked.groupBy("label", "dim", "shard").agg(
            F.ceil(F.count(F.lit(1)) / s.query_rows).cast("int").alias("chunks")))
        asked = (asked.join(loads, ["label", "dim", "shard"])
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("chunks")).cast("int")))
        index = (member.join(adjacency, "cid").join(loads, ["label", "dim", "shard"])
                 .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
        out = checkpoint(found_in_shards(index.select(*KEY, "chunk", "cid", "vec", "n", "first", "near"),
                                         asked.select(*[F.col(c).alias(c) for c in (*KEY, "chunk", "cid", "vec", "shards")]), s, beam))
        hits = checkpoint(out.filter("v is null").groupBy("u").agg(F.sum("hits").alias("hits")).withColumnRenamed("u", "cid"))
        # each query counts alike, whether its group is small or large
        share = F.least("want", F.coalesce("hits", F.lit(0))) / F.col("want")
        recall = truth.filter("want > 0").join(hits, "cid", "left").agg(F.avg(share)).first()[0]
        recall = 1.0 if recall is None else recall
        exhausted = probes >= most_shards and beam >= 16 * s.beam
        if exhausted and recall < s.refused_recall:
            raise RuntimeError(f"recall {recall:.3f} of the audited queries after the widest search; raise shard_rows, probes or beam")
        if recall >= s.least_recall or exhausted:
            return hits, out.filter("v is not null").select("u", "v"), recall
        probes, beam = 2 * probes, 2 * beam


def audit_truth(classes: DataFrame, s: Setting) -> DataFrame:
    """(cid, want): links of a sample of classes, by comparison with all classes.

    Where links are rare a first sample may hold none: the sample grows fourfold
    until ``audit`` / 4 of its queries have links, it holds all classes, or it has
    grown three times (a bounded 64 x ``audit`` queries).
    """
    n = s.audit
    while True:
        truth, held = _links_of_sample(classes, s, n)
        if held < n or n >= 64 * s.audit or truth.filter("want > 0").limit(s.audit // 4).count() >= s.audit // 4:
            return truth
        n *= 4


def _links_of_sample(classes: DataFrame, s: Setting, n: int) -> tuple[DataFrame, int]:
    picked = classes.orderBy(F.xxhash64("vec"), "cid").limit(n).collect()
    held = classes.sparkSession.sparkContext.broadcast([(r.cid, r.label, r.dim, list(r.vec)) for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for cid, label, dim, vec in held.value:
            by.setdefault((label, dim), []).append((cid, vec))
        for b in batches:
            pdf = b.to_pandas()
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                if key in by:
                    ids = np.array([c for c, _ in by[key]])
                    sims = unit(matrix([v for _, v in by[key]])) @ unit(matrix(pdf["vec"].iloc[at])).T
                    near = (sims >= s.threshold) & (ids[:, None] != pdf["cid"].to_numpy()[at])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ pdf["n"].to_numpy()[at])], ["cid", "want"])

    return checkpoint(map_arrow(classes.select("cid", "label", "dim", "vec", "n"), run, "cid long, want long")
                      .groupBy("cid").agg(F.sum("want").alias("want"))), len(picked)


def near_duplicates(vectors: DataFrame, s: Setting = Setting(), id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are compared within equal, non-null labels and equal dimensions. Null
    or zero vectors and vectors with null or non-finite components link with
    nothing; equal vectors link with each other; rows that share a vec_id are
    separate vectors; a null vec_id takes part but names no component that has
    another id (``kept`` is false for it); other columns are not read; an empty
    table gives an empty result.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<float>").alias("vec"),
                          col(label_col).cast("int").alias("label"))
    classes = classes_of(rows)
    hits, links, _ = links_of(classes, s)
    roots = components(links)
    rooted = classes.select("cid", "label", "vec", "n", "first_id").join(roots, F.col("cid") == F.col("node"), "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpoint(rooted.join(names, "root").join(hits, "cid", "left")
                       .select(F.xxhash64("label", "vec").alias("_h"), F.col("label").alias("_label"), F.col("vec").alias("_vec"),
                               (F.coalesce("hits", F.lit(0)) + F.col("n") - 1).alias("_links"), "component_id"))
    usable = F.col("label").isNotNull() & valid("vec")
    keyed = rows.withColumn("h", F.when(usable, F.xxhash64("label", "vec")))
    met = keyed.join(named, (F.col("h") == F.col("_h")) & (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.when(F.col("_h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return met.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embed_graph": op1_embed_graph}
ORACLES: dict[str, str] = {}

"""Conversation prefix trie by burst tries.

1. Turns get ids (a digest of role and text, and the text's code points) and
   positions; texts are never shuffled. Conversations become sequences of turn
   ids in segments of at most ``segment`` turns, so no row grows with a
   conversation. Equal sequences under equal heads collapse to one row with a
   map-side aggregate, so thousands of copies are one entry of the trie.
2. A trie head is a node by the digest of the turns on the way to it; below it
   hangs a container of suffixes, on the shard of the head's digest. The root is
   the first head, the end of a whole segment a further one.
3. A container of more than ``limit`` turns bursts: each suffix moves by its
   next turn id to a container of its own under a new head. The nodes of the
   next turns come from an aggregate, so a head may have any number of them.
   Bursting is repeated until all containers are within the limit.
4. The other containers are sorted and swept: neighbours share the nodes of
   their common beginning, the rest are new ones; counts are added up from the
   last node to the first. A task holds one container at a time.
5. Totals of containers rise to the heads above them, round by round and
   segment by segment, with aggregates and joins by the head.

Members that end at a node are hashed in order without being gathered: range
partitions write their ids in pieces of bounded length, and one pass over the
sorted pieces of a node feeds the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import group_positions, range_partitions
from .common import checkpoint, map_arrow, table

#: Turns of a segment, turns (and suffixes) of a container that is swept at once.
SEGMENT, LIMIT = 1024, 50_000
#: Characters of a turn id: 32 of a digest, 8 of the number of code points.
UNIT = 40
#: Characters of member ids in one row.
PIECE = 1 << 16
ROOT = "root"
NO_ENDS = hashlib.sha256(b"").hexdigest()

TOTALS = ["n_children", "n_leaves", "saved"]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, unit) of every turn: position from 0 by ``turn`` (null first) and turn id.

    Null roles and texts are empty; turns with one number are ordered by their
    ids, so repeated rows stay apart as equal neighbours; rows without a
    conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, UNIT - 8)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.concat(digest, F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0")).alias("unit"))
    rows = rows.filter(F.col("conv_id").isNotNull())
    return group_positions(rows, ["conv_id"], ["turn", "unit"], out="pos", keep=["unit"])


def rebuilt(turns: DataFrame, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids) of the conversations that begin like the first of their block.

    Conversation c gets the first h turns of c - c % ``block`` (what there is of
    them) before its own turns after its first h, h = crc32(c in decimal) %
    (``most`` + 1). It may have no turn left.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    first = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", first)
    convs = checkpoint(convs)
    bases = turns.filter((first == F.col("conv_id")) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "unit")
    lent = convs.filter("h > 0").join(bases, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "unit")
    sizes = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    gaps = (convs.join(sizes, "base", "left").select("conv_id", F.greatest(F.lit(0), F.col("h") - F.coalesce("base_n", F.lit(0))).alias("gap"))
            .filter("gap > 0"))
    own = (turns.filter(F.col("pos") >= h).join(gaps, "conv_id", "left")
           .select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).cast("int").alias("pos"), "unit"))
    return lent.unionByName(own), convs.select("conv_id")


def _segments(turns: DataFrame, conv_ids: DataFrame, segment: int) -> DataFrame:
    """(conv_id, layer, ids): the turn ids of a conversation in segments; layer 0 of all conversations."""
    parts = (turns.withColumn("layer", F.floor(F.col("pos") / segment).cast("int")).groupBy("conv_id", "layer")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("turns"))
             .select("conv_id", "layer", F.array_join(F.transform("turns", lambda x: x["unit"]), "").alias("ids")))
    none = conv_ids.join(parts.filter("layer = 0"), "conv_id", "left_anti")
    return parts.unionByName(none.select("conv_id", F.lit(0).alias("layer"), F.lit("").alias("ids")))


def _ends(members: DataFrame) -> DataFrame:
    """(end, conv_id) -> (end, ends_sha256): digest of the sorted decimal ids, comma-joined."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, text, n = None, None, [], 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                                               pa.array([r[2] for r in out], pa.string())], ["end", "first", "piece"])
            out.clear()
            return made

        for b in batches:
            for e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if e != end or n > PIECE:
                    if text:
                        out.append((end, first, ",".join(text)))
                    end, first, text, n = e, c, [], 0
                text.append(str(c))
                n += len(text[-1]) + 1
            if out:
                yield batch()
        if text:
            out.append((end, first, ",".join(text)))
            yield batch()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, None
        for b in batches:
            out = []
            for e, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if e == end:
                    state.update(b"," + p.encode())
                    continue
                if state is not None:
                    out.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256(p.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())],
                                             ["end", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([state.hexdigest()])], ["end", "ends_sha256"])

    spread = range_partitions(members)
    in_order = members.select("end", "conv_id").repartitionByRange(spread, "end", "conv_id").sortWithinPartitions("end", "conv_id")
    made = map_arrow(in_order, pieces, "end string, first long, piece string")
    return map_arrow(made.repartition(spread, "end").sortWithinPartitions("end", "first"), folded, "end string, ends_sha256 string")


#: Rows of a container; totals of what hangs below a row's end where a further head stands there.
ROWS = ["key", "depth", "ids", "n", "least", "ends_sha256", *TOTALS]
SWEPT = ("key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
         "ends_sha256 string")


def sweep(rows: list[tuple]) -> list[tuple]:
    """The nodes below one head from its container's rows (ROWS) in the order of their ids.

    The first tuple stands for the head itself: its key and the totals below it.
    """
    key, top = rows[0][0], rows[0][1]
    up, level, points, n, least, ends, below = [-1], [0], [0], [0], [None], [None], [(0, 0, 0)]
    path, before = [0], ""
    for _, _, ids, count, smallest, digest, *total in rows:
        shared = 0
        while shared + UNIT <= min(len(ids), len(before)) and ids[shared:shared + UNIT] == before[shared:shared + UNIT]:
            shared += UNIT
        del path[shared // UNIT + 1:]
        for a in range(shared, len(ids), UNIT):
            up.append(path[-1])
            level.append(len(path))
            points.append(int(ids[a + UNIT - 8:a + UNIT], 16))
            n.append(0)
            least.append(None)
            ends.append(None)
            below.append((0, 0, 0))
            path.append(len(up) - 1)
        at, before = path[-1], ids
        n[at] += count
        least[at] = smallest if least[at] is None else min(least[at], smallest)
        ends[at] = digest or ends[at]
        if total[0] is not None:
            below[at] = tuple(total)
    children, leaves, saved = [b[0] for b in below], [b[1] for b in below], [b[2] for b in below]
    for i in range(len(up) - 1, -1, -1):      # a node comes before all below it
        if children[i] == 0:
            leaves[i] = 1
        if i == 0:
            break
        saved[i] += (n[i] - 1) * points[i]
        p = up[i]
        n[p] += n[i]
        least[p] = least[i] if least[p] is None else min(least[p], least[i])
        children[p] += 1
        leaves[p] += leaves[i]
        saved[p] += saved[i]
    nodes = [(None, least[i], top + level[i], least[up[i]], n[i], children[i], leaves[i], saved[i], ends[i] or NO_ENDS) for i in range(1, len(up))]
    return [(key, None, None, None, None, children[0], leaves[0], saved[0], None), *nodes]


def _swept(rows: DataFrame) -> DataFrame:
    """SWEPT: the nodes of all containers, and a row with a key for each head."""
    kinds = [pa.string(), *[pa.int64()] * 7, pa.string()]
    names = [f.split()[0] for f in SWEPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(kinds))], names)
            out.clear()
            return made

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[0] != held[0][0]:
                    out += sweep(held)
                    held = []
                    if len(out) > 10_000:
                        yield batch()
                held.append(row)
        if held:
            out += sweep(held)
            yield batch()

    return map_arrow(rows.select(*ROWS).repartition("key").sortWithinPartitions("key", "ids"), run, SWEPT)


def _layer(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes below the heads of one layer, and (key, TOTALS) of these heads."""
    done, rounds, todo = [], [], rows
    while True:
        weight = F.sum(F.length("ids") / UNIT + 1)
        large = checkpoint(todo.groupBy("key").agg(weight.alias("weight")).filter(F.col("weight") > limit).select("key"))
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, "key", "left_anti"))
        burst = checkpoint(todo.join(large, "key", "left_semi"))
        next_unit = F.substring("ids", 1, UNIT)
        moved = burst.filter("ids != ''").withColumn("unit", next_unit).withColumn("child", F.sha2(F.concat("key", next_unit), 256))
        here = F.length("ids") == UNIT
        heads = moved.groupBy("key", "child", "unit", "depth").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(here, F.col("ends_sha256"))).alias("ends_sha256"),
            *[F.max(F.when(here, F.col(c))).alias(c) for c in TOTALS])
        tops = burst.groupBy("key").agg(F.min("least").alias("top"))
        rounds.append(checkpoint(heads.join(tops, "key")))
        # what ends at a child stays there as an empty suffix, for the child's smallest member; below a linked end is nothing else
        todo = moved.filter(~here | F.col("n_leaves").isNull()).select(
            F.col("child").alias("key"), (F.col("depth") + 1).alias("depth"), F.expr(f"substring(ids, {UNIT + 1})").alias("ids"), "n", "least",
            *[F.when(~here, F.col(c)).alias(c) for c in ("ends_sha256", *TOTALS)])
        todo = checkpoint(todo)
    swept = checkpoint(_swept(reduce(DataFrame.unionByName, [d.select(*ROWS) for d in done])))
    nodes = [swept.filter("key IS NULL").withColumnRenamed("saved", "saved_tokens").select(*NODES)]
    totals = swept.filter("key IS NOT NULL").select("key", *TOTALS)
    for heads in reversed(rounds):
        found = totals.select(F.col("key").alias("child"), *[F.col(c).alias(f"{c}_below") for c in TOTALS])
        full = heads.join(found, "child", "left")
        for c, least in zip(TOTALS, (0, 1, 0), strict=True):
            full = full.withColumn(c, F.coalesce(c, f"{c}_below", F.lit(least)))
        points = F.conv(F.substring("unit", UNIT - 7, 8), 16, 10).cast("long")
        full = checkpoint(full.withColumn("saved", F.col("saved") + (F.col("n") - 1) * points))
        nodes.append(full.select(F.col("least").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent_conv_id"),
                                 F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                                 F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
        totals = totals.unionByName(full.groupBy("key").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                                                            F.sum("saved").alias("saved")))
    return nodes, totals


def prefix_trie(turns: DataFrame, conv_ids: DataFrame, segment: int = SEGMENT, limit: int = LIMIT) -> DataFrame:
    """The nodes (NODES) of the trie of all conversations, one row per distinct beginning.

    ``turns``: (conv_id, pos, unit), positions of a conversation from 0 without
    gaps, units as ``turn_ids`` makes them. ``conv_ids``: every conversation
    once, those without turns too. A node's ``conv_id`` is its smallest member;
    with ``depth`` it names the node, with ``parent_conv_id`` (null for the
    root) and ``depth - 1`` its parent. ``saved_tokens`` adds up the code points
    that members after the first share. Conversations may have any length and
    any number of copies; no conversation gives no node.
    """
    turns, conv_ids = turns.select("conv_id", "pos", "unit"), conv_ids.select("conv_id")
    parts = checkpoint(_segments(turns, conv_ids, segment))
    last = parts.agg(F.max("layer")).first()[0]
    root = parts.filter("layer = 0").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    if not root["n_convs"]:
        kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODES)
        return turns.sparkSession.createDataFrame([], kinds)
    # from the root down: the key of a segment's head, and the key of its end
    rows = parts.filter("layer = 0").select("conv_id", F.lit(ROOT).alias("key"), "ids")
    layers, members, stubs = [], [], None
    for k in range(last + 1):
        end = F.when(F.col("ids") == "", F.col("key")).otherwise(F.sha2(F.concat("key", "ids"), 256))
        rows = rows.withColumn("end", end)
        if k < last:
            further = parts.filter(F.col("layer") == k + 1).select("conv_id", F.col("ids").alias("further"))
            rows = rows.join(further, "conv_id", "left")
        else:
            rows = rows.withColumn("further", F.lit(None).cast("string"))
        rows = checkpoint(rows)
        stays = F.col("further").isNull()
        found = rows.groupBy("key", "end").agg(F.max("ids").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
        layers.append((found, stubs))
        members.append(rows.filter(stays).select("end", "conv_id"))
        # members that end where a further head stands count for that head's smallest member
        stubs = (rows.filter(stays & (F.length("ids") == UNIT * segment)).groupBy(F.col("end").alias("key"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
        rows = rows.filter(~stays).select("conv_id", F.col("end").alias("key"), F.col("further").alias("ids"))
    ends = checkpoint(_ends(reduce(DataFrame.unionByName, members)))
    nodes, totals = [], None
    for k in range(last, -1, -1):
        found, stubs = layers[k]
        found = found.join(ends, "end", "left")
        if totals is None:
            found = found.select("*", *[F.lit(None).cast("long").alias(c) for c in TOTALS])
        else:
            found = found.join(totals.withColumnRenamed("key", "end"), "end", "left")
        found = found.withColumn("depth", F.lit(k * segment).cast("long"))
        if stubs is not None:
            empty = {"ids": F.lit(""), "depth": F.lit(k * segment).cast("long"), "ends_sha256": F.lit(None).cast("string"),
                     **{c: F.lit(None).cast("long") for c in TOTALS}}
            heads = found.select("key").distinct()
            found = found.select(*ROWS).unionByName(stubs.join(heads, "key", "left_semi").withColumns(empty).select(*ROWS))
        made, totals = _layer(checkpoint(found.select(*ROWS)), limit)
        nodes += made
        totals = checkpoint(totals)
    top = (totals.filter(F.col("key") == ROOT).join(ends.filter(F.col("end") == ROOT).select(F.col("end").alias("key"), "ends_sha256"), "key", "left")
           .select(F.lit(root["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
                   F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n_convs"]).cast("long").alias("n_convs"), "n_children",
                   "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    return reduce(DataFrame.unionByName, [top, *nodes])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turn_ids(table(spark, sf_dir, "conversations"))))


#: Independent of the trie: every beginning as text, ancestors by a join with the smallest member's beginnings.
ORACLE = """
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) - 1 AS p FROM src),
v AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM src)),
r AS (
  SELECT v.conv_id, t.p AS q, t.role, t.text FROM v JOIN t ON t.conv_id = v.base AND t.p < v.h
  UNION ALL SELECT v.conv_id, t.p + 10, t.role, t.text FROM v JOIN t ON t.conv_id = v.conv_id AND t.p >= v.h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY q) AS d, length(text) AS points,
         sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS u FROM r),
pre AS (
  SELECT conv_id, d, points, string_agg(u, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM v),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(points) AS points FROM pre GROUP BY k, d),
kids AS (SELECT left(k, length(k) - 64) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sums AS (
  SELECT p.k, sum((b.n - 1) * b.points) AS saved, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM node b JOIN pre p ON p.conv_id = b.conv_id AND p.d <= b.d LEFT JOIN kids c ON c.k = b.k GROUP BY p.k),
ends AS (
  SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS x
  FROM (SELECT conv_id, arg_max(k, d) AS k FROM pre GROUP BY conv_id) GROUP BY k)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs,
       CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.x, sha256('')) AS ends_sha256
FROM node JOIN sums ON sums.k = node.k LEFT JOIN kids ON kids.k = node.k LEFT JOIN ends ON ends.k = node.k
LEFT JOIN node up ON node.d > 0 AND up.k = left(node.k, greatest(length(node.k) - 64, 0))
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": ORACLE}

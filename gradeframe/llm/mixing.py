"""Temperature mixing of sources, realised as budgeted block permutations.

Weights are source token shares raised to an exponent a and normalised. A
smaller a flattens the mixture; the exponent is the smallest one, by bisection
on a grid of 2^-24, at which no source repeats more often than ``max_epochs``
and the entropy has come down to ``target_entropy`` (a share of the entropy of
equal weights). Each round of the bisection evaluates 15 inner points in one
aggregate over the source table, so six rounds settle it.

A source's budget is its weight times the token budget: whole passes over the
source, and a rest. For the rest, documents stand in the order of a hash (a
permutation) cut into blocks; sums of wide blocks, then of the blocks in one of
them, find where the budget runs out, and only that block's documents are summed
one by one. So a source that holds a third of all rows costs block sums and
three small windows. The
outcome is a cut per source, applied to each document where it stands. Copies
are dealt into ``block`` numbers of the output stream by another hash.

DataFrame functions only; sources may be many: their table is broadcast up to a
checked number of rows and joined by key beyond it, and only totals and the
exponent's sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Parameters of the query and the pipeline.
TARGET_ENTROPY, MAX_EPOCHS, BLOCK_TOKENS, SEED = 0.97, 1.25, 1 << 20, 7
GRID_BITS, ROUND_BITS = 24, 4
HASH_BITS, BLOCK_BITS = 60, 14
#: Sources (a key and two numbers each) up to which their table is broadcast.
MOST_BROADCAST = 100_000


def words(text: Column) -> Column:
    """Tokens of a text: words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def hash60(*parts: Column | str) -> Column:
    """60 bits of a hash of the parts (null and empty alike)."""
    texts = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Target:
    """What the exponent has to reach; ``budget`` None: as many tokens as there are."""
    target_entropy: float | None = TARGET_ENTROPY
    max_epochs: float | None = MAX_EPOCHS
    budget: int | None = None


def exponent(sources: DataFrame, total: int, target: Target) -> float:
    """The smallest grid exponent that meets the target; 1 if none does.

    ``sources`` has a row per source with its ``tokens``; sources without
    tokens have no share.
    """
    shares = checkpoint(sources.filter("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p")))
    budget = total if target.budget is None else target.budget

    def meets(points: list[int]) -> list[bool]:
        a = F.col("k") / F.lit(float(1 << GRID_BITS))
        power = F.pow("p", a)
        sums = (shares.select("p", F.explode(F.array(*[F.lit(k) for k in points])).alias("k"))
                .groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * a * F.log("p")).alias("e"),
                                  F.max(power / F.col("p")).alias("most"), F.count(F.lit(1)).alias("n"))
                .select("k", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"),
                        (F.col("most") / F.col("z") * (budget / total)).alias("epochs"), F.log(F.col("n")).alias("even")))
        ok = {r.k: ((target.max_epochs is None or r.epochs <= target.max_epochs)
                    and (target.target_entropy is None or r.entropy <= target.target_entropy * r.even + 1e-9))
              for r in sums.collect()}
        return [ok[k] for k in points]

    low, high = -1, 1 << GRID_BITS                  # low does not meet the target, high does (or is the last resort)
    step = 1 << ROUND_BITS
    while high - low > 1:
        points = sorted({low + max(1, (high - low) * i // step) for i in range(1, step)} - {low, high})
        for k, ok in zip(points, meets(points), strict=True):
            if ok:
                high = k
                break
            low = k
    return high / (1 << GRID_BITS)


def _runs_out(sums: DataFrame, room: DataFrame) -> DataFrame:
    """(key, slot, rest): where a source's running token sum passes its ``rest``, and what is left there."""
    w = Window.partitionBy("key").orderBy("slot")
    return (sums.join(room, "key").withColumn("sum", F.sum("tokens").over(w))
            .filter((F.col("rest") < F.col("sum")) & (F.col("sum") - F.col("tokens") <= F.col("rest")) & (F.col("tokens") > 0))
            .select("key", "slot", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("rest")))


def plan(docs: DataFrame, target: Target = Target(), seed: int = SEED, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, int]:
    """((key, passes, cut) of each source, tokens of the mixture)."""
    doc, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    rows = checkpoint(docs.select(source_key(source).alias("key"), words(F.col(f"`{text_col}`")).alias("tokens"),
                                  hash60(str(seed), doc, source).alias("h")))
    shift = HASH_BITS - BLOCK_BITS
    blocks = checkpoint(rows.groupBy("key", F.shiftright("h", shift).alias("block")).agg(F.sum("tokens").alias("tokens")))
    sources = checkpoint(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    none = F.lit(-1).cast("long")
    if not total:                                   # nothing to weigh: every document once
        return sources.select("key", F.lit(1).cast("long").alias("passes"), none.alias("cut")), 0
    budget = total if target.budget is None else target.budget
    a = exponent(sources, total, target)
    z = sources.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(total), F.lit(a)))).first()[0]
    # to the nearest token: an exponent of 1 must give each source its own tokens back
    share = F.floor(F.pow(F.col("tokens") / F.lit(total), F.lit(a)) / F.lit(z) * F.lit(budget) + 0.5).cast("long")
    given = (sources.withColumn("share", F.when(F.col("tokens") > 0, share))
             .select("key", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(1).alias("passes"),
                     F.when(F.col("tokens") > 0, F.col("share") % F.col("tokens")).alias("rest")))
    # three steps down, each a window over at most 2^7 sums of a source
    half = BLOCK_BITS // 2
    wide = blocks.groupBy("key", F.shiftright("block", half).alias("slot")).agg(F.sum("tokens").alias("tokens"))
    upto = checkpoint(_runs_out(wide, given.select("key", "rest")))
    fine = (blocks.withColumn("wide", F.shiftright("block", half)).join(upto.select("key", F.col("slot").alias("wide")), ["key", "wide"])
            .select("key", F.col("block").alias("slot"), "tokens"))
    upto = checkpoint(_runs_out(fine, upto.select("key", "rest")).withColumnRenamed("slot", "block"))
    in_block = Window.partitionBy("key").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of one hash (without an id, or of one id) are one sum before they move
    fits = (rows.withColumn("block", F.shiftright("h", shift)).join(upto, ["key", "block"])
            .groupBy("key", "block", "rest", "h").agg(F.sum("tokens").alias("tokens"))
            .withColumn("sum", F.sum("tokens").over(in_block)).filter("sum <= rest").groupBy("key").agg(F.max("h").alias("last")))
    cuts = upto.join(fits, "key", "left").select(
        "key", F.coalesce("last", F.shiftleft("block", shift) - 1).alias("cut"))
    return checkpoint(given.join(cuts, "key", "left").select("key", "passes", F.coalesce("cut", none).alias("cut"))), budget


def mix(docs: DataFrame, target: Target = Target(), seed: int = SEED, block_tokens: int = BLOCK_TOKENS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The chosen copies of the rows of ``docs``: all columns, ``_epoch`` (from 0) and ``_block``.

    Null sources are one source; null and empty texts have no tokens and move
    with their hash; a source without any token passes once; rows with equal
    (doc_id, source) share their place in the permutation, so they are taken or
    left together (as are rows without an id within a source); an empty table
    gives an empty result; columns with the names of the new ones are replaced.
    """
    chosen, budget = plan(docs, target, seed, id_col, text_col, source_col)
    doc, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("_epoch", "_block")]
    renamed = chosen.select(F.col("key").alias("_key"), F.col("passes").alias("_passes"), F.col("cut").alias("_cut"))
    if chosen.count() <= MOST_BROADCAST:      # then no document has to move; beyond it Spark joins by key, splitting hot ones
        renamed = F.broadcast(renamed)
    copies = F.col("_passes") + F.when(hash60(str(seed), doc, source) <= F.col("_cut"), 1).otherwise(0)
    blocks = max(1, -(-budget // block_tokens))
    return (docs.select(*keep).join(renamed, source_key(source) == F.col("_key")).withColumn("_copies", copies)
            .filter("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
            .withColumn("_block", hash60(f"{seed} block", F.col("_epoch"), doc, source) % F.lit(blocks))
            .drop("_key", "_passes", "_cut", "_copies"))


def mixed(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The mixture with the columns of ``docs`` alone."""
    return mix(docs, target).drop("_epoch", "_block")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"))


ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT key, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY key),
tot AS (SELECT sum(tokens)::BIGINT AS total FROM src),
ps AS (SELECT list(tokens / total ORDER BY key) AS p, ln(count(*)) AS even FROM src, tot WHERE tokens > 0),
search AS (
  SELECT -1::BIGINT AS low, (1::BIGINT << {GRID_BITS}) AS high
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT low, high, mid,
           list_max(list_transform(p, lambda x: pow(x, a) / x)) / list_sum(list_transform(p, lambda x: pow(x, a))) <= {MAX_EPOCHS}
           AND ln(list_sum(list_transform(p, lambda x: pow(x, a))))
               - list_sum(list_transform(p, lambda x: pow(x, a) * a * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, a)))
               <= {TARGET_ENTROPY} * even + 1e-9 AS ok
    FROM (SELECT low, high, (low + high) // 2 AS mid, ((low + high) // 2) / (1::BIGINT << {GRID_BITS})::DOUBLE AS a FROM search
          WHERE high - low > 1), ps)),
expo AS (SELECT min(high) / (1::BIGINT << {GRID_BITS})::DOUBLE AS a FROM search),
given AS (
  SELECT key, CASE WHEN tokens > 0 THEN share // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN share % tokens END AS rest
  FROM (SELECT key, tokens, floor(pow(tokens / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) * total + 0.5)::BIGINT AS share
        FROM src, tot, ps, expo)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows_),
copies AS (
  SELECT doc_id, source, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM summed JOIN given USING (key))
SELECT doc_id, source, epoch,
       ('0x' || substr(md5('{SEED} block:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')), 1, 15))::BIGINT
         % greatest(1, -(-total // {BLOCK_TOKENS}))::BIGINT AS block
FROM (SELECT doc_id, source, unnest(range(n::BIGINT)) AS epoch FROM copies), tot
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": ORACLE}

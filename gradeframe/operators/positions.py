"""Skew-safe position of each row inside its group (a ``row_number`` without a hot task).

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task; if one group holds a third of the data, that task holds a third of the
data. Here instead:

1. ``repartitionByRange(g, o)`` + ``sortWithinPartitions``: range boundaries
   are sampled from the keys, so a hot group is spread over many partitions;
   each partition holds a contiguous slice of the (g, o) order.
2. ``mapInPandas``: within a partition, the position of each row inside its
   group's slice (pandas ``cumcount``, carried across Arrow batches).
3. The numbered rows are materialised once (``checkpoint()`` in the shared
   checkpoint folder) and read by both of the following steps.
4. Only the first and the last group of a partition can continue into another
   partition, so at most ``2 x partitions`` (group, partition) slices need an
   offset. Slice sizes come from one aggregate; the offsets of the groups that
   span partitions form a table whose size is bounded by the partition count,
   so broadcasting it is safe; everything else has offset 0.

Requirement (as for ``row_number``): the order columns must be a total order
inside each group, so the positions are the same on every recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Input bytes a range partition should hold; rows in memory for the sort take about ten times as many as in columnar files.
PARTITION_BYTES = 32 << 20


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle of ``df``: the session's count, more where its planned size asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if planned >= 1 << 60 else max(least, min(1 << 20, planned // PARTITION_BYTES))   # 2^60 and more: unknown


def group_cumsum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str | None, out: str,
                 num_partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Running sum of ``value`` (inclusive) in each group ordered by ``order``;
    ``value=None`` counts rows (so ``out - 1`` is the row number). ``keep``
    limits the other columns carried through the Python step (the order
    columns are only needed for the sort, which happens in the JVM).

    Same plan as described in the module docstring: range partitioning splits
    hot groups, ``mapInPandas`` sums inside each partition's slice, and the
    totals of earlier slices are added for groups that span partitions.
    """
    spark = df.sparkSession
    from ..session import ship_package
    ship_package(spark)
    group, order = list(group), list(order)
    n = num_partitions or range_partitions(df)
    if value is None:
        df, value = df.withColumn("_one", F.lit(1).cast("long")), "_one"
    s = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    if keep is not None:   # a projection keeps the sorted order inside each partition
        s = s.select(*dict.fromkeys([*group, value, *keep]))
    schema = T.StructType(s.schema.fields + [T.StructField("_pid", T.IntegerType(), False),
                                             T.StructField("_local", T.LongType(), False)])

    def local_sums(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        prev_key, prev_total = None, 0       # last group seen and its running total so far
        for pdf in batches:
            if pdf.empty:
                continue
            g = pdf[group]
            before = g.shift()
            changed = ((g != before) & ~(g.isna() & before.isna())).any(axis=1)     # null keys are equal to each other
            changed.iloc[0] = True
            run = changed.cumsum()
            vals = pdf[value].fillna(0).astype("int64")
            local = vals.groupby(run).cumsum().astype("int64")
            first_key = tuple(None if pd.isna(x) else x for x in g.iloc[0])
            if first_key == prev_key:          # the group continues from the previous batch
                local = local + (run == 1).astype("int64") * prev_total
            prev_key, prev_total = tuple(None if pd.isna(x) else x for x in g.iloc[-1]), int(local.iloc[-1])
            yield pdf.assign(_pid=pid, _local=local)

    # One Python pass, materialised with a reliable checkpoint (shared
    # spark.checkpoint.dir): the slice sizes and the final join read the same
    # rows, so partition ids agree however the shuffle reads were coalesced.
    from ..session import cut_lineage
    idx = cut_lineage(s.mapInPandas(local_sums, schema))
    sizes = idx.groupBy(*group, "_pid").agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_pid")
    spans = (sizes.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*group)))
             .filter(F.col("_parts") > 1)
             .withColumn("_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)))
             .select(*group, "_pid", "_off"))
    # bounded by 2 x partitions rows (only boundary groups span partitions)
    renamed = spans.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.col("_pid").alias("_p"), "_off")
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    res = idx.join(F.broadcast(renamed), same, "left").drop("_p", *[f"_k{i}" for i in range(len(group))])
    res = res.withColumn(out, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0)))
    return res.drop("_pid", "_local", "_off", "_one")


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "pos",
                    num_partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in its group ordered by ``order``."""
    r = group_cumsum(df, group, order, None, "_cnt", num_partitions, keep)
    return r.withColumn(out, (F.col("_cnt") - 1).cast("int")).drop("_cnt")

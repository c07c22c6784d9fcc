"""Connected components of a link table by contraction, all in Spark.

Each round every node points to its smallest neighbour (or itself), pointers
are followed once more, the links are rewritten to the new representatives and
links inside one representative vanish. The image of a connected graph under
such a map stays connected, and the smallest node always represents itself, so
when no link is left every node carries the smallest node of its component.
The link table shrinks every round; nothing is gathered on the driver but a
count, and a hub's links are only ever aggregated (with partial aggregates) or
joined with a table that has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _ordered(links: DataFrame) -> DataFrame:
    return (links.filter(F.col("u") != F.col("v"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root): one row per node that has a link to another
    node; ``root`` is the smallest node reachable from it.

    Null ends are ignored, as are links of a node with itself; repeated links
    change nothing; an empty table gives an empty result.
    """
    links = checkpoint(_ordered(links.select("u", "v").dropna()))
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select(F.col("u").alias("node"), F.least("u", "m").alias("parent")))
        step = parent.select(F.col("node").alias("parent"), F.col("parent").alias("to"))
        parent = checkpoint(parent.join(step, "parent").select("node", F.col("to").alias("parent")))
        if labels is None:
            labels = parent.withColumnRenamed("parent", "root")
        else:
            to = parent.select(F.col("node").alias("root"), F.col("parent").alias("to"))
            labels = checkpoint(labels.join(to, "root", "left")
                                .select("node", F.coalesce("to", "root").alias("root")))
        pu = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        links = checkpoint(_ordered(links.join(pu, "u").join(pv, "v")
                                    .select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: whole texts are large, and both sides of the pipe hold a batch.
BATCH_ROWS = 1000


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and bound their Arrow
    batches (a session setting; a smaller one of the user's stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with this package importable in the Python workers."""
    python_ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's ``spark.checkpoint.dir``."""
    return cut_lineage(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, in any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(col: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def local_rows(spark: SparkSession, schema: Sequence[tuple[str, str]], rows: Sequence[Sequence]) -> DataFrame:
    """A small table of parameters as a local relation (its size is known to the planner)."""
    names = ", ".join(n for n, _ in schema)
    kinds = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in schema)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in schema)
        return spark.sql(f"SELECT {nulls} WHERE false")
    args, lines = {}, []
    for i, row in enumerate(rows):
        cells = []
        for j, v in enumerate(row):
            if v is None:
                cells.append("NULL")
                continue
            args[f"p{i}_{j}"] = v
            cells.append(f":p{i}_{j}")
        lines.append("(" + ", ".join(cells) + ")")
    return spark.sql(f"SELECT {kinds} FROM VALUES {', '.join(lines)} AS t({names})", args=args)

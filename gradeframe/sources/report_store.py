"""A stored report that is updated in place (U6): keyed upserts with snapshots.

The rows of a report are dealt into a fixed number of buckets by a hash of
their key. A snapshot is a list of the folders that hold the buckets; the file
``current`` names the snapshot that counts. An update

1. reads only the buckets its keys fall into, merges them with its rows in one
   aggregate (a value that the update has replaces the stored one, a null keeps
   it, a new key is added) and writes them to a folder of its own;
2. writes the list of the new snapshot, in which all other buckets stay where
   they are;
3. replaces ``current`` by renaming a file onto it, the one step that readers see.

A reader resolves ``current`` once and then reads folders that no update
changes, so it sees the whole old or the whole new report. An update that
breaks leaves folders that no snapshot names (``vacuum`` removes them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    """A small file of the store (a name, or a list of at most ``buckets`` folders)."""
    if not _fs(spark, path).exists(_path(spark, path)):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _write(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def snapshot(spark: SparkSession, root: str) -> dict | None:
    """The snapshot that counts: {"name", "keys", "buckets", "folders": {bucket: folder}}, None before the first."""
    name = _read(spark, f"{root}/current")
    return None if name is None else json.loads(_read(spark, f"{root}/snapshots/{name.strip()}.json"))


def read_report(spark: SparkSession, root: str, at: dict | None = None) -> DataFrame:
    """The report as of a snapshot (the current one unless given)."""
    at = at or snapshot(spark, root)
    if at is None:
        raise ValueError(f"{root} holds no report")
    if not at["folders"]:
        return spark.createDataFrame([], at["schema"])
    return spark.read.schema(at["schema"]).parquet(*[f"{root}/{f}" for f in at["folders"].values()])


def upsert(updates: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> dict:
    """Merge ``updates`` into the report below ``root`` (made if it is not there); returns the new snapshot.

    Keys may be null; of equal keys in the updates one is taken for every column
    (the largest value, so the result does not depend on the order). Columns that
    only one side has are null on the other. One writer at a time: if another
    update was committed meanwhile, nothing is changed and an error says so.
    """
    spark, root = updates.sparkSession, root.rstrip("/")
    old = snapshot(spark, root)
    if old is not None and list(keys) != old["keys"]:
        raise ValueError(f"the report is keyed by {old['keys']}, not {list(keys)}")
    count = old["buckets"] if old else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int").alias("_bucket")
    rows = updates.select("*", bucket, F.lit(1).alias("_version"))
    if old is not None:
        touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]          # at most ``buckets``
        held = [f"{root}/{old['folders'][b]}" for b in touched if b in old["folders"]]
        if held:
            stored = spark.read.schema(old["schema"]).parquet(*held).select("*", bucket, F.lit(0).alias("_version"))
            rows = stored.unionByName(rows, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in (*keys, "_bucket", "_version")]
    newest = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_version"), F.col(c).alias("v"))))["v"].alias(c) for c in values]
    merged = rows.groupBy("_bucket", *keys).agg(*newest)
    name = uuid.uuid4().hex
    merged.write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    schema = {f.name: f for f in merged.drop("_bucket").schema.fields}
    if old is not None:                       # columns that only untouched buckets have
        schema = {f.name: f for f in StructType.fromDDL(old["schema"]).fields} | schema
    new = {"name": name, "keys": list(keys), "buckets": count,
           "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.values()),
           "folders": (old or {"folders": {}})["folders"] | {
               s.getPath().getName().split("=")[1]: f"data/{name}/{s.getPath().getName()}"
               for s in _fs(spark, root).listStatus(_path(spark, f"{root}/data/{name}")) if s.isDirectory()}}
    _write(spark, f"{root}/snapshots/{name}.json", json.dumps(new))
    _commit(spark, root, old, name)
    return new


def _commit(spark: SparkSession, root: str, old: dict | None, name: str) -> None:
    now = snapshot(spark, root)
    if (now or {}).get("name") != (old or {}).get("name"):
        raise RuntimeError(f"{root} was updated meanwhile; run the update again")
    _write(spark, f"{root}/.current-{name}", name)
    fc = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(_path(spark, f"{root}/.current-{name}"), _path(spark, f"{root}/current"), options)


def vacuum(spark: SparkSession, root: str, keep: Sequence[dict] = ()) -> int:
    """Remove the folders that neither the current snapshot nor one of ``keep`` names; returns how many."""
    fs, at = _fs(spark, root), snapshot(spark, root)
    used = {f for s in (at, *keep) if s for f in s["folders"].values()}
    removed = 0
    for job in fs.listStatus(_path(spark, f"{root}/data")):
        for part in fs.listStatus(job.getPath()):
            name = f"data/{job.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in used:
                fs.delete(part.getPath(), True)
                removed += 1
    return removed

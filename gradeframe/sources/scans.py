"""Scans of the evaluation file trees (S1-S10, S22) into long tables.

All scans take explicit schemas (never inferred: result keys such as "0".."4"
would become struct fields) and recover key columns from the file path via
``_metadata.file_path``. JSON documents are parsed once into typed columns;
data-dependent keys are handled with ``MAP`` types plus ``explode``.

Directory layouts read (fixed by the reference tool):
  <dataset>/[<difficulty>/]<split>/input/<transformation>/<qid>.json           problems
  raw_output/<qid>/generation_data/sample_<s>/iter_refinement_data.json       rollouts
  raw_output/<qid>/test_case_results.json                                      verdicts
  <setting>/pass_at_k_result.json                                              reports
A ``<name>=<value>`` directory (as written by ``partitionBy``) is accepted in
place of a bare ``<value>`` directory. Keys are taken from the parts of the path
below the scan root, decoded, so roots and keys may hold blanks, ``%``, ``+``,
``=`` and letters of any script, in any file system.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_solutions
from ..functions.verdict import normalize_verdict

def _path() -> Column:
    """The source file of each row; Spark gives its path percent-encoded (a plus sign stands for itself)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


PROBLEM_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("orig_input", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("test_cases", T.StringType()),      # raw JSON: APPS struct or LCB array
    T.StructField("priv_test", T.StringType()),
    T.StructField("solutions", T.StringType()),       # JSON list text, plain code or list
    T.StructField("task", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("transformation_type", T.StringType()),
    T.StructField("starter", T.StringType()),
    T.StructField("import_statement", T.StringType()),
    T.StructField("test_classes", T.StringType()),
])


def relative_path(root: str, path: Column | None = None) -> Column:
    """The source file's path below ``root``."""
    base = re.sub(r"^[A-Za-z0-9]+:/*", "/", root).rstrip("/") + "/"
    path = _path() if path is None else path
    return F.substring(path, F.locate(base, path) + len(base), F.length(path))


def path_key(part: Column, name: str) -> Column:
    """The key that a part of a path stands for: as it is, or escaped behind ``name=``."""
    value = F.replace(F.substring(part, F.lit(len(name) + 2), F.length(part)), F.lit("+"), F.lit("%2B"))
    return F.when(part.startswith(f"{name}="), F.try_url_decode(value)).otherwise(part)


def keys_below(root: str, **places: int) -> list[Column]:
    """Keys by the place of their folder or file below ``root`` (from 0, or from the end: -1 is the file);
    a file's key is its name without ``.json``."""
    parts = F.split(relative_path(root), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))
    return [path_key(F.regexp_replace(at(i), r"\.json$", "") if i == -1 else at(i), name).alias(name) for name, i in places.items()]


# ------------------------------------------------------------------ S1 S2 S7 S8 S9
def _tree(spark: SparkSession, root: str, kind: str, variant: str, lines: bool) -> DataFrame:
    """``<dataset>/[<difficulty>/]<split>/<kind>/<variant>/<file>.json`` with the folders as columns.

    Columns are counted from the scan root: six parts have a difficulty folder,
    five have none (null). Only ``.json`` files under ``kind`` are read, so a
    ``template.json`` at the root is no problem file.
    """
    r = root.rstrip("/")
    df = (spark.read.schema(PROBLEM_SCHEMA).option("multiLine", not lines).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.json").json(f"{r}/{{*/*,*/*/*}}/{kind}/{variant}"))
    parts = F.split(relative_path(r), "/")
    p = F.col("_p")
    return df.select("*", parts.alias("_p")).select(
        *df.columns, path_key(p[0], "dataset").alias("dataset"), F.when(F.size(p) == 6, path_key(p[1], "difficulty")).alias("difficulty_dir"),
        path_key(F.element_at(p, -2), "transformation").alias("transformation"),
        F.regexp_extract(F.element_at(p, -1), r"^(.*)\.json$", 1).alias("file_qid"))


def problem_scan(spark: SparkSession, root: str, transformation: str = "*",
                 layout: str = "reference", lines: bool = False) -> DataFrame:
    """Every problem file, one row per record, with dataset / difficulty /
    transformation columns from the path.

    ``layout="reference"``: the tree of :func:`_tree` under ``input``, one
    document per file, or JSON lines (``lines=True``).
    ``layout="partitioned"``: directories ``dataset=/difficulty=/transformation=``
    as written by ``partitionBy``.
    """
    if layout == "reference":
        return _tree(spark, root, "input", transformation, lines)
    df = (spark.read.schema(PROBLEM_SCHEMA).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.json").json(root.rstrip("/")))
    parts = F.split(relative_path(root.rstrip("/")), "/")
    named = lambda name: path_key(F.try_element_at(F.filter(parts, lambda x: x.startswith(f"{name}=")), F.lit(1)), name)
    return df.select("*", named("dataset").alias("dataset"), named("difficulty").alias("difficulty_dir"),
                     named("transformation").alias("transformation"))


def solution_scan(spark: SparkSession, root: str, solution_type: str = "*", lines: bool = False) -> DataFrame:
    """S1 for the solutions tree: (dataset, difficulty_dir, solution_type, qid, solutions), the list parsed."""
    t = _tree(spark, root, "solutions", solution_type, lines)
    return t.select("dataset", "difficulty_dir", F.col("transformation").alias("solution_type"), "qid",
                    parse_solutions("solutions").alias("solutions"))


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema."""
    return spark.read.schema(schema).json(path)


def table_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A benchmark table or a saved dataset; filters applied by the caller are
    pushed into the parquet scan."""
    return spark.read.format(fmt).load(path)


def first_matches(df: DataFrame, condition: Column, n: int, order: Sequence[str]) -> DataFrame:
    """S8 + O4: the first n rows by ``order`` that meet the condition (a distributed top-n)."""
    return df.filter(condition).orderBy(*order).limit(n)


#: Files of the first round of :func:`first_of_files`, and how many times more each next round takes.
FIRST_FILES, MORE_FILES = 4, 4


def first_of_files(spark: SparkSession, path: str, condition: Column, n: int, pattern: str = "*.parquet") -> DataFrame:
    """S8 with the early stop of a stream: the first ``n`` rows that meet the condition, in the order of
    the files' paths and of the rows in a file.

    The parquet files below ``path`` are listed without being opened. They are
    taken in growing rounds, each one job that reads its files in parallel with
    the filter pushed into the scan and keeps at most the rows still missing;
    once ``n`` are found, no further file is opened. The rounds grow, so a rare
    condition costs few of them. The result has ``_file`` and ``_row`` besides
    the files' columns; fewer matches than ``n`` give all there are, no file or
    ``n`` below 1 an empty result (without a schema of its own if no file is there).
    """
    from ..session import cut_lineage
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
              .load(path).select(_path().alias("path")).orderBy("path"))
    files, size, found, rounds = listed.toLocalIterator(), FIRST_FILES, 0, []
    while found < n or not rounds:
        some = [re.sub(r"([\\*?{}\[\]])", r"\\\1", r["path"]) for r in islice(files, size)]
        if not some:
            break
        rows = (spark.read.parquet(*some).select("*", _path().alias("_file"), F.col("_metadata.row_index").alias("_row"))
                .filter(condition).orderBy("_file", "_row").limit(max(0, n - found)))
        rounds.append(cut_lineage(rows))
        found += rounds[-1].count()
        size *= MORE_FILES
    if not rounds:
        return spark.createDataFrame([], "_file string, _row long")
    return reduce(DataFrame.unionByName, rounds).orderBy("_file", "_row")


# ------------------------------------------------------------------ S3
def rollout_scan(spark: SparkSession, root: str,
                 name: str = "generation_data/*/iter_refinement_data.json") -> DataFrame:
    """S3: rollout files -> rollout_steps(qid, sample, step, final_code, asst_query, user_answer).

    Step keys are data dependent ("0".."n"): the top level is read as a
    ``map<string,string>`` (nested objects stay JSON text), exploded, and only
    numeric keys are kept; the per-step feedback comes from the
    ``iter_refinement_data`` object read as a typed map.
    """
    glob = f"{root.rstrip('/')}/raw_output/*/{name}"
    raw = spark.read.text(glob, wholetext=True).select(
        "value", *keys_below(root, qid=1), _number(root, "sample", "/"))
    return _rollout_steps(raw)


def _number(root: str, name: str, end: str) -> Column:
    """The number of ``/<name>_<number>`` below the root."""
    return F.regexp_extract(relative_path(root), rf"/{name}[_=]([0-9]+){end}", 1).cast("int").alias(name)


def rollout_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """S3 for JSON lines ``{"qid", "sample", "doc"}``: many rollouts per file."""
    return _rollout_steps(spark.read.schema("qid string, sample int, doc string").json(path).withColumnRenamed("doc", "value"))


def _rollout_steps(raw: DataFrame) -> DataFrame:
    ir_type = "map<string,struct<asst_ir_query:string,user_ir_answer:string>>"
    top = raw.select("qid", "sample",
                     F.from_json(F.get_json_object("value", "$.iter_refinement_data"), ir_type).alias("ir"),
                     F.explode(F.from_json("value", "map<string,string>")).alias("key", "val"))
    steps = top.filter(F.col("key").rlike(r"^[0-9]+$"))
    ir = F.try_element_at(F.col("ir"), F.col("key"))
    return steps.select(
        "qid", "sample", F.col("key").cast("long").alias("step"),
        F.get_json_object("val", "$.final_code").alias("final_code"),
        ir["asst_ir_query"].alias("asst_query"), ir["user_ir_answer"].alias("user_answer"))


# The fields of a round record.
ROUND_FIELDS = "asst_code string, asst_mg_query string, user_mg_answer string, is_finished boolean"


def round_scan(spark: SparkSession, root: str) -> DataFrame:
    """S12 read side: ``raw_output/<qid>/generation_data/sample_<s>/iter_<i>/round_<r>.json`` ->
    (qid, sample, iter, round, the fields of a round record)."""
    raw = spark.read.text(f"{root.rstrip('/')}/raw_output/*/generation_data/*/iter_*/round_*.json", wholetext=True)
    return _rounds(raw.select(*keys_below(root, qid=1), _number(root, "sample", "/"), _number(root, "iter", "/"),
                              _number(root, "round", r"\.json$"), F.col("value").alias("doc")))


def round_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """S12 read side for JSON lines with the key as fields and the record as ``doc``."""
    return _rounds(spark.read.schema("qid string, sample int, iter int, round int, doc string").json(path))


def _rounds(raw: DataFrame) -> DataFrame:
    return raw.select("qid", "sample", "iter", "round", F.from_json("doc", ROUND_FIELDS).alias("_r")) \
        .select("qid", "sample", "iter", "round", "_r.*")


# ------------------------------------------------------------------ S4 S22
VERDICT_FILE_TYPE = "map<string,array<array<string>>>"


def _explode_verdict_map(df: DataFrame, keys: list[str]) -> DataFrame:
    m = df.select(*keys, F.explode(F.from_json("value", VERDICT_FILE_TYPE)).alias("step", "samples"))
    s = m.select(*keys, "step", F.posexplode("samples").alias("sample", "tests"))
    t = s.select(*keys, "step", "sample", F.posexplode("tests").alias("test_idx", "raw"))
    return t.select(*keys, F.col("step").cast("long").alias("step"), F.col("sample").cast("int").alias("sample"),
                    F.col("test_idx").cast("int").alias("test_idx"), normalize_verdict("raw").alias("verdict"))


def verdict_scan(spark: SparkSession, root: str, name: str = "test_case_results.json") -> DataFrame:
    """S4 + X1: ``raw_output/<qid>/test_case_results.json`` -> verdicts(qid, step, sample, test_idx, verdict).

    Missing files simply produce no rows; mixed true/false/-1/-2 values are
    read as text and normalised to the four codes.
    """
    glob = f"{root.rstrip('/')}/raw_output/*/{name}"
    raw = spark.read.text(glob, wholetext=True).select("value", *keys_below(root, qid=1))
    return _explode_verdict_map(raw, ["qid"])


VERDICT_LINE = "qid string, step long, sample int, first_test int, results string"


def verdict_lines(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """VERDICT_LINE rows (a stretch of one rollout's results each) -> the long verdict table;
    with ``keep``, also the stretch's first test and the columns kept."""
    own = ["first_test", *keep] if keep else []
    t = lines.select("qid", "step", "sample", "first_test", *keep,
                     F.posexplode(F.from_json("results", "array<string>")).alias("pos", "raw"))
    return t.select("qid", "step", "sample", (F.col("first_test") + F.col("pos")).cast("int").alias("test_idx"),
                    normalize_verdict("raw").alias("verdict"), *own)


def verdict_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """S4 for JSON-lines deliveries of VERDICT_LINE records: many problems per file, and
    a rollout of any length in records of bounded length."""
    return verdict_lines(spark.read.schema(VERDICT_LINE).json(path))


def setting_verdict_scan(spark: SparkSession, root: str) -> DataFrame:
    """``test_cases_results/<setting>/<index>.json``: one entry per partial solution."""
    glob = f"{root.rstrip('/')}/test_cases_results/*/*.json"
    raw = spark.read.text(glob, wholetext=True).select("value", *keys_below(root, setting=1, qid=-1))
    out = _explode_verdict_map(raw, ["setting", "qid"])
    return out.withColumnRenamed("step", "part")


LABEL_FILE_TYPE = "map<string,struct<labels:array<string>,full_outputs:array<string>>>"


def label_scan(spark: SparkSession, root: str, name: str = "*.json") -> DataFrame:
    """S18 read side: per-problem label documents -> (qid, sample, labels, full_outputs)."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/{name}", wholetext=True).select("value", *keys_below(root, qid=0))
    return _labels(raw)


def label_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """S18 read side for JSON lines ``{"qid", "doc"}``."""
    return _labels(spark.read.schema("qid string, doc string").json(path).withColumnRenamed("doc", "value"))


def _labels(raw: DataFrame) -> DataFrame:
    e = raw.select("qid", F.explode(F.from_json("value", LABEL_FILE_TYPE)).alias("sample", "v"))
    return e.select("qid", F.col("sample").cast("int").alias("sample"), "v.labels", "v.full_outputs")


# ------------------------------------------------------------------ S5
CLASS_FILE_TYPE = ("map<string,map<string,map<string,struct<errors:int,failures:int,testsRun:int>>>>")


def class_count_scan(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """``{task: {task_i: {TestClass: {errors, failures, testsRun}}}}`` -> class_counts.

    ``task_i`` is ``<task>_<sample>``; three explodes flatten the maps. With
    ``wholetext=False`` every line is one such document (JSON lines).
    """
    raw = spark.read.text(path, wholetext=wholetext)
    a = raw.select(F.explode(F.from_json("value", CLASS_FILE_TYPE)).alias("task", "runs"))
    b = a.select("task", F.explode("runs").alias("task_i", "classes"))
    c = b.select("task", "task_i", F.explode("classes").alias("test_class", "r"))
    return c.select("task", F.regexp_extract("task_i", r"_([0-9]+)$", 1).cast("int").alias("sample"),
                    "test_class", F.col("r.errors").alias("errors"), F.col("r.failures").alias("failures"),
                    F.col("r.testsRun").alias("tests_run"))


# ------------------------------------------------------------------ S6
REPORT_SCHEMA = "pass_k int, fun_success double, class_success double, fun_partial_success double, " \
                "class_partial_success double"


def report_scan(spark: SparkSession, root: str, name: str = "pass_at_k_result.json") -> DataFrame:
    """Every ``pass_at_k_result.json`` below ``root``; setting = parent directory."""
    df = (spark.read.schema(REPORT_SCHEMA).option("recursiveFileLookup", True)
          .option("pathGlobFilter", name).json(root))
    return df.select(path_key(F.element_at(F.split(_path(), "/"), -2), "setting").alias("setting"), "*")


# ------------------------------------------------------------------ S10
def source_tree_scan(spark: SparkSession, root: str, pattern: str = "*.py", lines: bool = False) -> DataFrame:
    """Every ``*.py`` file below ``root`` as (path, repo, content), whole text per file.

    With ``lines`` a row is a stretch of a file's lines, for files of any length: (path, repo, lines, size,
    start, id). ``lines`` is the text between two ``\\n``, ``size`` the file's bytes; (start, id) order the
    stretches of a file, whose splits are read by several tasks. A byte order mark is not in them, an empty
    file has none.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    df = reader.option("lineSep", "\n").text(root) if lines else reader.text(root, wholetext=True)
    keys = [_path().alias("path"), F.element_at(F.split(_path(), "/"), -2).alias("repo")]
    if not lines:
        return df.select(*keys, F.col("value").alias("content"))
    from ..session import ship_package
    ship_package(spark)
    rows = df.select(*keys, F.col("value").alias("lines"), F.col("_metadata.file_size").alias("size"),
                     F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return rows.mapInArrow(_stretches, "path string, repo string, lines string, size long, start long, id long")


#: Bytes of a stretch of lines: small, so that a batch of ten thousand is bounded as well.
STRETCH_BYTES = 1 << 14


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch that are neighbours in a file's split as rows of about ``STRETCH_BYTES`` (or one line)."""
    for b in batches:
        if not b.num_rows:
            continue
        path, start = b.column("path"), b.column("start")
        part = pc.divide(pc.cumulative_sum(pc.cast(pc.binary_length(b.column("lines")), pa.int64())), STRETCH_BYTES)
        same = pc.and_(pc.and_(pc.equal(path[1:], path[:-1]), pc.equal(start[1:], start[:-1])), pc.equal(part[1:], part[:-1]))
        first = [0, *(k + 1 for k, x in enumerate(same.to_pylist()) if not x)]
        texts = ["\n".join(b.column("lines")[i:j].to_pylist()) for i, j in zip(first, [*first[1:], b.num_rows], strict=True)]
        heads = b.take(pa.array(first))
        yield heads.set_column(2, "lines", pa.array(texts, pa.string()))

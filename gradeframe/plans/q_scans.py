"""Round trips through the evaluation file layouts.

Each query derives records from the driver tables, writes them with the sinks
in the file layout the scans read, and returns the scan of what was written.
The files go to a fresh folder under the session's ``spark.checkpoint.dir``
(a shared location on a cluster), so the check covers both directions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import classeval as CE
from ..operators import history as H
from ..session import ensure_checkpoint_dir
from ..sources import scans as SC
from ..sources import sinks as SK
from ..sources.documents import whole, write_documents
from . import views as V
from .catalogue import register
from .q_passk import CLASS_PASS_K, REPORT_CTES, _class_report_sql, _reports


def scratch(spark, name: str) -> str:
    """A folder of this query's run. The folder an earlier run of the session left for the
    same query is removed first: its result has been read by now or is read no more."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gf-roundtrip"
    key = (spark.sparkContext.applicationId, name)
    if key in _LEFT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_LEFT[key])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _LEFT[key] = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    return _LEFT[key]


_LEFT: dict[tuple[str, str], str] = {}

# Fixed fixture: a root and keys with what paths must escape.
ODD_ROOT = "my tree +%41 ü"
ODD_KEY = " 100% a+b=c ü"


def _odd(name: str, key):
    return F.concat(F.lit(name), F.col(key).cast("string"), F.lit(ODD_KEY))


@register("scan_verdicts", V.with_views(["verdicts"], """
SELECT qid, step, sample, test_idx, verdict FROM verdicts"""))
def q_scan_verdicts(spark, sf_dir):
    """S13 -> S4 + X1: result records (mixed true/false/-1/-2) as JSON lines, written and
    scanned back into the long verdict table. (The one-file-per-problem tree is
    read by ``verdict_scan``; see the tests.)"""
    root = scratch(spark, "verdicts")
    SK.verdict_lines(V.verdicts(spark, sf_dir, positions=True)).write.json(root)
    return SC.verdict_lines_scan(spark, root)


@register("scan_rollouts", V.with_views(["turns"], """
SELECT qid, sample, step, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS final_code,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS asst_query,
       arg_max(text, turn) FILTER (WHERE role = 'user') AS user_answer
FROM turns GROUP BY 1, 2, 3"""))
def q_scan_rollouts(spark, sf_dir):
    """S12 -> S3: one rollout document per (problem, sample) with data-dependent
    step keys, as JSON lines, scanned back through maps."""
    root = scratch(spark, "rollouts")
    SK.rollout_documents(H.step_feedback(V.turns(spark, sf_dir))).write.json(root)
    return SC.rollout_lines_scan(spark, root)


@register("scan_round_records", V.with_views(["turns"], """
SELECT t.qid, t.sample, CAST(t.step AS INTEGER) AS iter, CAST(t.turn - f.first_turn AS INTEGER) AS round,
       CASE WHEN t.role = 'assistant' THEN t.text END AS asst_code, CASE WHEN t.role = 'user' THEN t.text END AS user_mg_answer,
       contains(t.text, '```') AS is_finished
FROM turns t JOIN (SELECT qid, sample, step, min(turn) AS first_turn FROM turns GROUP BY 1, 2, 3) f
  ON t.qid = f.qid AND t.sample = f.sample AND t.step = f.step"""))
def q_scan_round_records(spark, sf_dir):
    """A record per round, written as JSON lines and read back."""
    root = scratch(spark, "rounds")
    r = H.number_rounds(V.turns(spark, sf_dir))
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    doc = F.to_json(F.struct(of("assistant").alias("asst_code"), F.lit(None).cast("string").alias("asst_mg_query"),
                             of("user").alias("user_mg_answer"), H.finished(F.col("text")).alias("is_finished")))
    r.select("qid", "sample", F.col("step").cast("int").alias("iter"), F.col("round_idx").alias("round"), doc.alias("doc")).write.json(root)
    return SC.round_lines_scan(spark, root).drop("asst_mg_query")


PROBLEM_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS qid, text AS orig_input,
       CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Summary: ' || lang END AS input,
       CASE WHEN doc_id % 2 = 0 THEN 'apps' ELSE 'code_generation_lite' END AS dataset,
       CASE WHEN doc_id % 2 = 0 THEN 'introductory' ELSE 'easy' END AS difficulty_dir,
       CASE WHEN doc_id % 3 = 0 THEN 'vanilla' ELSE 'plain_summary' END AS transformation,
       source AS solutions
FROM documents"""


@register("scan_problems", PROBLEM_SQL)
def q_scan_problems(spark, sf_dir):
    """S11 -> S1 + P3: problem records written partitioned by dataset / difficulty /
    transformation and scanned back with the path columns."""
    root = scratch(spark, "problems")
    d = V.table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    rec = d.select(F.col("doc_id").cast("string").alias("qid"), F.col("text").alias("orig_input"),
                   F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Summary: "), F.col("lang")))
                   .alias("input"), F.col("source").alias("solutions"),
                   F.when(even, F.lit("apps")).otherwise(F.lit("code_generation_lite")).alias("dataset"),
                   F.when(even, F.lit("introductory")).otherwise(F.lit("easy")).alias("difficulty"),
                   F.when(F.col("doc_id") % 3 == 0, F.lit("vanilla")).otherwise(F.lit("plain_summary"))
                   .alias("transformation"))
    SK.write_partitioned(rec, root, ["dataset", "difficulty", "transformation"], fmt="json")
    p = SC.problem_scan(spark, root, layout="partitioned")
    return p.select("qid", "orig_input", "input", "dataset", "difficulty_dir", "transformation", "solutions")


@register("scan_problem_tree", """
SELECT CAST(doc_id AS VARCHAR) AS qid, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Summary: ' || lang END AS input,
       CASE WHEN doc_id % 2 = 0 THEN 'apps' ELSE 'class_eval' END AS dataset,
       CASE WHEN doc_id % 2 = 0 THEN 'introductory' END AS difficulty_dir,
       CASE WHEN doc_id % 3 = 0 THEN 'vanilla' ELSE 'plain_summary' END AS transformation,
       'full_solution' AS solution_type, source AS first_solution, 2 AS n_solutions
FROM documents""")
def q_scan_problem_tree(spark, sf_dir):
    """S1 on the reference layout, with and without a difficulty folder, and the solutions tree joined."""
    root = f"{scratch(spark, 'tree')}/{ODD_ROOT}"
    d = V.table(spark, sf_dir, "documents").withColumn("qid", F.col("doc_id").cast("string"))
    for even, top in ((True, "apps/introductory"), (False, "class_eval")):
        half = d.filter((F.col("doc_id") % 2 == 0) == even)
        for plain, kind in ((True, "vanilla"), (False, "plain_summary")):
            text = F.col("text") if plain else F.concat(F.lit("Summary: "), F.col("lang"))
            (half.filter((F.col("doc_id") % 3 == 0) == plain).select("qid", text.alias("input"))
             .write.json(f"{root}/{top}/test/input/{kind}"))
        listed = F.to_json(F.array("source", "lang"))
        half.select("qid", listed.alias("solutions")).write.json(f"{root}/{top}/test/solutions/full_solution")
    p = SC.problem_scan(spark, root, lines=True).select("qid", "input", "dataset", "difficulty_dir", "transformation")
    s = SC.solution_scan(spark, root, lines=True)
    return p.join(s.drop("difficulty_dir"), ["dataset", "qid"]).select(
        "qid", "input", "dataset", "difficulty_dir", "transformation", "solution_type",
        F.col("solutions")[0].alias("first_solution"), F.size("solutions").alias("n_solutions"))


@register("scan_class_counts", V.with_views(["class_counts"], """
SELECT task, sample, test_class, errors, failures, tests_run FROM class_counts"""))
def q_scan_class_counts(spark, sf_dir):
    """``{task: {task_i: {TestClass: {errors, failures, testsRun}}}}`` documents,
    one per task and line, scanned back with three explodes."""
    root = scratch(spark, "class_counts")
    cc = V.class_counts(spark, sf_dir)
    per_run = (cc.groupBy("task", "sample").agg(F.map_from_entries(F.collect_list(F.struct(
        "test_class", F.struct(F.col("errors"), F.col("failures"), F.col("tests_run").alias("testsRun"))))).alias("m")))
    per_task = per_run.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.col("task"), F.lit("_"), F.col("sample").cast("string")), "m"))).alias("runs"))
    docs = per_task.select(F.to_json(F.create_map(F.col("task"), F.col("runs"))).alias("value"))
    docs.write.mode("overwrite").text(root)
    return SC.class_count_scan(spark, f"{root}/part-*", wholetext=False)


@register("scan_reports", V.with_views(["class_counts"], "\nUNION ALL\n".join(
    _class_report_sql(k) for k in CLASS_PASS_K), REPORT_CTES))
def q_scan_reports(spark, sf_dir):
    """S17/S19 -> S6: report rows written per setting directory and found again by
    a recursive file-name scan; the setting comes from the parent directory."""
    root = scratch(spark, "reports")
    rep = _reports(spark, sf_dir, CLASS_PASS_K)
    rounded = rep.select("setting", "pass_k", *[F.round(c, 6).alias(c) for c in CE.RATES])
    SK.write_partitioned(rounded, root, ["setting"], fmt="json")
    r = SC.report_scan(spark, root, name="part-*.json")
    return r.select(F.col("setting").cast("int").alias("setting"), "pass_k", *CE.RATES)


@register("scan_consolidated", V.with_views(["turns"], """
SELECT qid, sample, step, arg_max(text, turn) AS code FROM turns
WHERE role = 'assistant' AND step = (SELECT max(step) FROM turns WHERE role = 'assistant')
GROUP BY 1, 2, 3"""))
def q_scan_consolidated(spark, sf_dir):
    """S21 (+ W8): per-task step records consolidated into one directory per step,
    written in parallel; the latest step is read back by partition pruning."""
    root = scratch(spark, "consolidated")
    codes = H.step_code(V.turns(spark, sf_dir)).withColumnRenamed("final_code", "code")
    SK.consolidate(codes, root)
    back = spark.read.json(root)
    latest = back.agg(F.max("step").alias("_m"))
    # one-row aggregate: its broadcast is bounded by construction
    out = back.join(F.broadcast(latest), F.col("step") == F.col("_m"))
    return out.select("qid", F.col("sample").cast("int").alias("sample"), F.col("step").cast("long").alias("step"),
                      "code")


#: Result records of a delivered file.
DELIVERY_RECORDS = 200_000


@register("scan_stream_ingest", None)  # oracle: the overall_stats query, see below
def q_scan_stream_ingest(spark, sf_dir):
    """Streaming ingest (J3 by checkpoint and keyed state): result records (a stretch of a rollout's results
    per JSON line) are read by a file stream (availableNow) into a verdict table. First come records of which
    step 1 was graded wrongly, then the same again, then the corrections of step 1 with a higher version, which
    replace them; the overall statistics are computed from the last versions."""
    from ..streaming.incremental import ingest_verdicts, ingested_statistics
    from .catalogue import finish
    root = scratch(spark, "stream")
    lines = SK.verdict_lines(V.verdicts(spark, sf_dir, positions=True))
    wrong = F.when(F.col("step") == 1, F.regexp_replace("results", "true|false", "-2")).otherwise(F.col("results"))
    first = lines.withColumn("results", wrong).withColumn("version", F.lit(1))
    # files of bounded length, so that a batch of the stream is bounded, too
    first.write.option("maxRecordsPerFile", DELIVERY_RECORDS).json(f"{root}/in")
    table, ck = f"{root}/table", f"{root}/checkpoint"
    ingest_verdicts(spark, f"{root}/in", table, ck, name="part-*", layout="lines")
    first.write.option("maxRecordsPerFile", DELIVERY_RECORDS).mode("append").json(f"{root}/in")                     # delivered again
    lines.filter("step = 1").withColumn("version", F.lit(2)).write.option("maxRecordsPerFile", DELIVERY_RECORDS).mode("append").json(f"{root}/in")
    ingest_verdicts(spark, f"{root}/in", table, ck, name="part-*", layout="lines")
    return finish(ingested_statistics(spark, table))


@register("scan_labels", None)  # oracle: the sample_labels query, see below
def q_scan_labels(spark, sf_dir):
    """Per-problem label documents written and read back (labels in step order)."""
    from .catalogue import QUERIES
    root = scratch(spark, "labels")
    lab = QUERIES["sample_labels"](spark, sf_dir)
    docs = SK.label_documents(lab.select("qid", "sample", F.split("labels", ",").alias("labels"),
                                         F.split("labels", ",").alias("full_outputs")))
    docs.select("qid", "doc").write.json(root)
    back = SC.label_lines_scan(spark, root)
    return back.select("qid", "sample", F.array_join("labels", ",").alias("labels"))


@register("verdict_tree", V.with_views(["supplier_verdicts"], f"""
SELECT 'q ' || CAST(supplier AS VARCHAR) || '{ODD_KEY}' AS qid, step, sample, test_idx, verdict FROM supplier_verdicts"""))
def q_verdict_tree(spark, sf_dir):
    """S13 -> S4 on the reference layout: one ``raw_output/<qid>/test_case_results.json`` per problem,
    streamed into files by the document writer and scanned back; root and keys hold blanks, ``%`` and ``+``."""
    root = f"{scratch(spark, 'verdict_tree')}/{ODD_ROOT}"
    path = F.concat(F.lit("raw_output/"), _odd("q ", "supplier"), F.lit("/test_case_results.json"))
    write_documents(SK.verdict_documents(V.supplier_verdicts(spark, sf_dir), path), root)
    return SC.verdict_scan(spark, root)


@register("setting_tree", V.with_views(["supplier_verdicts"], f"""
SELECT 'set ' || CAST(supplier % 5 AS VARCHAR) || '{ODD_KEY}' AS setting, CAST(supplier AS VARCHAR) AS qid, step AS part, sample, test_idx, verdict
FROM supplier_verdicts"""))
def q_setting_tree(spark, sf_dir):
    """S22, both halves: ``test_cases_results/<setting>/<index>.json`` written and scanned back."""
    root = f"{scratch(spark, 'setting_tree')}/{ODD_ROOT}"
    v = V.supplier_verdicts(spark, sf_dir).withColumn("five", F.col("supplier") % 5)
    path = F.concat(F.lit("test_cases_results/"), _odd("set ", "five"), F.lit("/"), F.col("supplier").cast("string"), F.lit(".json"))
    write_documents(SK.verdict_documents(v, path), root)
    return SC.setting_verdict_scan(spark, root)


@register("stored_report", V.with_views(["verdicts"], """
SELECT qid, step, CASE WHEN CAST(qid AS BIGINT) % 10 = 0 THEN -count(*) ELSE count(*) END AS n_tests,
       CASE WHEN step = 1 THEN count(*) FILTER (WHERE verdict = 1) END AS n_passed, CASE WHEN CAST(qid AS BIGINT) % 10 = 0 THEN 'regraded' END AS note
FROM verdicts GROUP BY qid, step"""))
def q_stored_report(spark, sf_dir):
    """A stored report per problem and step, updated twice: step 1 gets a second metric (the first is kept),
    then every tenth problem gets a new value of the first and a column that the report did not have."""
    from ..sources import report_store as RS
    root = scratch(spark, "stored_report")
    v = V.verdicts(spark, sf_dir).groupBy("qid", "step").agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("verdict") == 1).alias("n_passed"))
    RS.upsert(v.select("qid", "step", "n_tests"), root, ["qid", "step"])
    RS.upsert(v.filter("step = 1").select("qid", "step", "n_passed"), root, ["qid", "step"])
    tenth = v.filter(F.col("qid").cast("long") % 10 == 0)
    RS.upsert(tenth.select("qid", "step", (-F.col("n_tests")).alias("n_tests"), F.lit("regraded").alias("note")), root, ["qid", "step"])
    return RS.read_report(spark, root)


@register("label_tree", None)  # oracle: the sample_labels query, see below
def q_label_tree(spark, sf_dir):
    """S18 on the reference layout: a label document per problem in a folder of its own, written and scanned back."""
    from .catalogue import QUERIES
    root = f"{scratch(spark, 'label_tree')}/{ODD_ROOT}"
    lab = QUERIES["sample_labels"](spark, sf_dir)
    docs = SK.label_documents(lab.select("qid", "sample", F.split("labels", ",").alias("labels"), F.split("labels", ",").alias("full_outputs")))
    write_documents(docs.select(*whole(F.concat(_odd("q ", "qid"), F.lit("/labels.json")), F.col("doc"))), root)
    back = SC.label_scan(spark, root)
    return back.select("qid", "sample", F.array_join("labels", ",").alias("labels"))


@register("setting_folders", V.with_views(["setting_values"], """
SELECT setting, part, count(*) AS n, round(sum(value), 4) AS total FROM setting_values GROUP BY 1, 2"""))
def q_setting_folders(spark, sf_dir):
    """All records of a key in one file of its own (``<setting>/<part>.json``), streamed line by line, and read back."""
    root = f"{scratch(spark, 'setting_folders')}/{ODD_ROOT}"
    v = V.setting_values(spark, sf_dir)
    line = F.concat(F.to_json(F.struct("qid", "sample", "value")), F.lit("\n"))
    path = F.concat(F.col("setting"), F.lit("/"), F.col("part").cast("string"), F.lit(".json"))
    write_documents(v.select(path.alias("path"), F.col("sample").cast("long").alias("part"), line.alias("piece")), root)
    lines = spark.read.schema("qid string, sample int, value double").json(f"{root}/*/*.json").select(*SC.keys_below(root, setting=0, part=-1), "value")
    return lines.groupBy("setting", F.col("part").cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("source_tree", f"""
SELECT 'src/' || source || '{ODD_KEY}/mod_' || CAST(doc_id % 20 AS VARCHAR) || '.py' AS path, source || '{ODD_KEY}' AS repo,
       'f_' || CAST(doc_id AS VARCHAR) AS name, CAST(len(string_split(text, chr(10))) + 1 AS INTEGER) AS significant_lines
FROM documents""")
def q_source_tree(spark, sf_dir):
    """S10 -> T3: modules written as a tree of source files (a function per document), found again and parsed.
    The files are read as stretches of lines, whose splits Spark deals by size, and parsed as streams, so neither a folder nor many
    small files hold a task, and no row or worker holds a module that grows with the documents."""
    from ..operators import pyjobs as PJ
    from .q_pyjobs import quoted
    root = f"{scratch(spark, 'source_tree')}/{ODD_ROOT}"
    d = V.table(spark, sf_dir, "documents")
    body = F.array_join(F.transform(F.split(F.col("text"), "\n", -1), lambda l: F.concat(F.lit("    v = "), quoted(l))), "\n")
    piece = F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit("():\n"), body, F.lit("\n    return v\n\n\n"))
    path = F.concat(F.lit("src/"), _odd("", "source"), F.lit("/mod_"), (F.col("doc_id") % 20).cast("string"), F.lit(".py"))
    write_documents(d.select(path.alias("path"), F.col("doc_id").alias("part"), piece.alias("piece")), root)
    fn = PJ.function_rows(SC.source_tree_scan(spark, root, lines=True), content="lines", order=["start", "id"], size="size")
    return fn.select(F.substring_index("path", f"{ODD_ROOT}/", -1).alias("path"), "repo", "name", "significant_lines")


def _step_table_sql() -> str:
    from .q_stats import _se, problem_cte, rollout_cte
    tables = f"""
SELECT 'problem_level_stats' AS name, step, count(*) AS n, round(sum(strict_accuracy), 6) AS strict FROM r GROUP BY step
UNION ALL
SELECT 'problem_level_agg_stats', step, (SELECT count(DISTINCT qid) FROM r), round(sum(strict_accuracy), 6) FROM p GROUP BY step
UNION ALL
SELECT 'agg_results', step, 1, round(avg(strict_accuracy), 6) FROM r GROUP BY step
UNION ALL
SELECT 'agg_stats', step, 1, round(CASE WHEN count(*) = (SELECT count(DISTINCT qid) FROM r) THEN avg(strict_accuracy) END, 6) FROM p GROUP BY step"""
    return V.with_views(["verdicts"], tables, [rollout_cte(["step"]), problem_cte(["step"])])


@register("step_tables", _step_table_sql())
def q_step_tables(spark, sf_dir):
    """The four per-step statistic tables, written and read back."""
    from ..operators import stats as S
    root = scratch(spark, "step_tables")
    r = S.rollout_stats(V.verdicts(spark, sf_dir))
    SK.write_step_tables(r, None, root)
    out = None
    for name in SK.STEP_TABLES:
        t = SC.table_scan(spark, f"{root}/{name}").groupBy(F.col("step").cast("long").alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("strict_accuracy"), 6).alias("strict")).withColumn("name", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("name", "step", "n", "strict")


@register("splits_and_lines", """
SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, source FROM documents""")
def q_splits_and_lines(spark, sf_dir):
    """S20 + S9 + S7 + S2: two splits saved and loaded back as one table, joined with JSON lines read by a schema."""
    root = scratch(spark, "splits")
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    SK.save_split(d.filter("doc_id % 5 <> 0").drop("source"), f"{root}/saved", "train")
    SK.save_split(d.filter("doc_id % 5 = 0").drop("source"), f"{root}/saved", "test", mode="append")
    d.select("doc_id", "source").write.json(f"{root}/lines")
    lines = SC.jsonl_scan(spark, f"{root}/lines", "doc_id long, source string")
    return SC.table_scan(spark, f"{root}/saved").join(lines, "doc_id").select("doc_id", "lang", "split", "source")


@register("first_matches", "SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 100 ORDER BY doc_id LIMIT 50")
def q_first_matches(spark, sf_dir):
    """S8 + O4: the first 50 documents of a language (the limit is the feature)."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return SC.first_matches(d, (F.col("lang") == "de") & (F.col("n_chars") > 100), 50, ["doc_id"]).select("doc_id", "lang")


@register("first_of_files", "SELECT doc_id, lang, text FROM documents WHERE lang = 'de' AND n_chars > 100 ORDER BY doc_id LIMIT 50")
def q_first_of_files(spark, sf_dir):
    """S8 + O4: the first 50 documents of a language in a listing of 48 files; files behind the last of them are not opened."""
    root = f"{scratch(spark, 'first_of_files')}/{ODD_ROOT}"
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    d.repartitionByRange(48, "doc_id").sortWithinPartitions("doc_id").write.parquet(root)
    found = SC.first_of_files(spark, root, (F.col("lang") == "de") & (F.col("n_chars") > 100), 50)
    return found.select("doc_id", "lang", "text")


@register("appended_by_key", V.with_views(["setting_values"], """
SELECT setting, part, count(*) * 2 AS n, round(sum(value) * 2, 4) AS total FROM setting_values GROUP BY 1, 2"""))
def q_appended_by_key(spark, sf_dir):
    """S16 + S17 + S19: records split into a folder per setting, then appended a second time, old files kept."""
    root = scratch(spark, "appended")
    v = V.setting_values(spark, sf_dir)
    SK.split_by_key(v, f"{root}/split", ["setting"])
    SK.append(spark.read.json(f"{root}/split"), f"{root}/all")
    SK.append(v, f"{root}/all")
    return spark.read.json(f"{root}/all").groupBy("setting", F.col("part").cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("report_tsv", None)  # oracle added below (text columns)
def q_report_tsv(spark, sf_dir):
    """S14 + S15: the latest-step report written as TSV with a header and read back."""
    from .catalogue import QUERIES
    root = scratch(spark, "report_tsv")
    SK.write_tsv(QUERIES["latest_step_report"](spark, sf_dir), root)
    return spark.read.option("sep", "\t").option("header", True).csv(root)


def _tsv_oracle() -> str:
    from .catalogue import ORACLES
    return "SELECT CAST(step AS VARCHAR) AS step, * EXCLUDE (step) FROM (" + ORACLES["latest_step_report"] + ") t"


from .catalogue import ORACLES as _O  # noqa: E402
_O["report_tsv"] = _tsv_oracle()
_O["scan_labels"] = _O["sample_labels"]
_O["label_tree"] = f"SELECT 'q ' || qid || '{ODD_KEY}' AS qid, * EXCLUDE (qid) FROM ({_O['sample_labels']}) t"
_O["scan_stream_ingest"] = _O["overall_stats"]

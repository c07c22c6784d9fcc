"""Prompt rendering.

Templates come from a prompt config: keys ``<type>_sys``, ``<type>_query``,
``<type>_prefill`` and optional ``<type>_<task>_sys_suffix`` holding
``{slot}`` placeholders. The config is resolved on the driver into a small
table - one row per (prompt type, task), its size fixed by the config, so
broadcasting it is bounded - and joined to the data rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

TEMPLATE_SCHEMA = "prompt_type string, task string, sys string, query string, prefill string, sys_suffix string"


def template_rows(config: Mapping[str, str], prompt_types: Sequence[str],
                  tasks: Sequence[str]) -> list[tuple]:
    """Resolve config keys per (prompt type, task); the initial-code prompt
    borrows the code prompt's system text and prefill."""
    rows = []
    for pt in prompt_types:
        sys_key, prefill_key = f"{pt}_sys", f"{pt}_prefill"
        if pt == "asst_initial_code":
            sys_key, prefill_key = "asst_code_sys", "asst_code_prefill"
        for task in tasks:
            rows.append((pt, task, config.get(sys_key), config.get(f"{pt}_query"),
                         config.get(prefill_key), config.get(f"{pt}_{task}_sys_suffix")))
    return rows


def templates(spark: SparkSession, config: Mapping[str, str], prompt_types: Sequence[str],
              tasks: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(template_rows(config, prompt_types, tasks), TEMPLATE_SCHEMA)


#: Templates that are broadcast.
MOST_TEMPLATES = 10_000


def render_prompts(rows: DataFrame, tmpl: DataFrame, slots: Mapping[str, Column],
                   prompt_type: str = "prompt_type", task: str = "task") -> DataFrame:
    """J8 + X28: look up the templates of each row and fill their slots.

    sys = strip(sys.rstrip() + " " + suffix) when a suffix exists, query and
    prefill stripped; rows without a template get NULL prompts (left join). Up to
    ``MOST_TEMPLATES`` templates are broadcast, more are joined as Spark plans it.
    """
    t = tmpl.withColumnRenamed("prompt_type", prompt_type).withColumnRenamed("task", task)
    t = F.broadcast(t) if t.limit(MOST_TEMPLATES + 1).count() <= MOST_TEMPLATES else t
    j = rows.join(t, [prompt_type, task], "left")
    sys_ = X.join_suffix(X.fill_slots("sys", slots), X.fill_slots("sys_suffix", slots))
    return j.select(*rows.columns,
                    X.py_strip(sys_).alias("sys_prompt"),
                    X.py_strip(X.fill_slots("query", slots)).alias("query_prompt"),
                    X.py_strip(X.fill_slots("prefill", slots)).alias("prefill"))


def render_fixed(template: str, slots: Mapping[str, Column]) -> Column:
    """One template for every row - a literal, so no join at all."""
    return X.py_strip(X.fill_slots(F.lit(template), slots))

"""Problem-corpus operators: projections, filters, joins, ordering, set operations
(P1-P9, P16, P17, P20, J1-J3, O1-O9, U1-U3, W1).

Scale notes: "first n" is an ordered limit, which Spark plans as a
distributed top-k (``TakeOrderedAndProject``), never a full sort. Per-group
top-k (W1) filters ``row_number() <= k``; Spark inserts a partial
``WindowGroupLimit`` before the shuffle, so each map task forwards at most k
rows per group and a hot group costs no more than a cold one. Joins are equi
joins; AQE picks broadcast for small sides at run time and splits skewed
partitions of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.compare import splitlines

# Fixed value: the text used when no solution is given to the simulated user.
NO_SOLUTION = "(No solution provided. Use the only information from the question to help the assistant.)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ P1 P2 P3
def effective_input(transformation, orig_input, transformed) -> Column:
    """The vanilla transformation asks the original question."""
    return F.when(_c(transformation) == "vanilla", _c(orig_input)).otherwise(_c(transformed))


def solution_info(mode, solutions) -> Column:
    """P2 + O7: fixed sentence, or the first solution; any other mode is an error."""
    m = _c(mode)
    return (F.when(m == "no_solution", F.lit(NO_SOLUTION))
            .when(m == "full_solution", F.try_element_at(_c(solutions), F.lit(1)))
            .otherwise(F.raise_error(F.concat(F.lit("Invalid solution_info_type: "), m)).cast("string")))


def union_optional(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a frame become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def reshape_records(df: DataFrame, settings: dict[str, str], query: str = "query") -> DataFrame:
    """Old-to-new record reshape on long rows: each new setting takes the query column of
    its old style; the other styles' columns go (one generated row per setting, no lists or maps)."""
    keep = [c for c in df.columns if c not in settings.values()]
    pairs = F.array(*[F.struct(F.lit(name).alias("setting"), F.col(old).alias(query)) for name, old in settings.items()])
    return df.select(*keep, F.explode(pairs).alias("_s")).select(*keep, "_s.*")


# ------------------------------------------------------------------ P4 P5 P9 P16 P17
def single_problem(df: DataFrame, qid: str, col: str = "qid") -> DataFrame:
    """One problem (a filter Catalyst pushes into the scan)."""
    return df.filter(F.col(col) == qid)


def existing_steps(rollouts: DataFrame, steps: DataFrame, keys: Sequence[str] = ("qid", "sample", "step")) -> DataFrame:
    """Keep only (problem, sample, step) that exist on the other side (inner join)."""
    return rollouts.join(steps.select(*keys).distinct(), list(keys))


def mark_complete(df: DataFrame, n_samples: int, keys: Sequence[str] = ("qid", "step"), sample: str = "sample") -> DataFrame:
    """``complete`` (1/0) of each row: whether its group has all ``n_samples`` samples. One aggregate, one join."""
    ok = F.when(F.countDistinct(sample) >= n_samples, 1).otherwise(0).alias("complete")
    return df.join(df.groupBy(*keys).agg(ok), list(keys))


def complete_samples(df: DataFrame, n_samples: int, keys: Sequence[str] = ("qid", "step"),
                     sample: str = "sample") -> tuple[DataFrame, DataFrame]:
    """Groups with all ``n_samples`` samples, and the quarantined rest.

    The reference aborts the run; a distributed job keeps going and returns
    the incomplete groups separately so nothing is silently dropped.
    """
    marked = mark_complete(df, n_samples, keys, sample)
    return marked.filter("complete = 1").select(*df.columns), marked.filter("complete = 0").select(*df.columns)


# ------------------------------------------------------------------ P20
def test_mode(fn_name) -> Column:
    """P20: no function name -> standard input, else call-based."""
    return F.when(_c(fn_name).isNull(), F.lit("stdin")).otherwise(F.lit("call"))


# ------------------------------------------------------------------ J1 J2 J3
def attach_problems(gens: DataFrame, problems: DataFrame, key: str = "qid") -> DataFrame:
    """Generations joined to their problem by key - one join instead of a scan per problem."""
    return gens.join(problems, key)


def todo(problems: DataFrame, done: DataFrame, key: str = "qid", overwrite: bool = False) -> DataFrame:
    """Problems without finished output (anti-join); ``overwrite`` redoes all."""
    if overwrite:
        return problems
    return problems.join(done.select(key), key, "left_anti")


def test_cases(df: DataFrame, inputs: str = "inputs", outputs: str = "outputs",
               keys: Sequence[str] = ("qid",)) -> DataFrame:
    """D3 -> long tests (qid, test_idx, input, output): ``posexplode(arrays_zip(...))``."""
    z = F.arrays_zip(F.col(inputs).alias("input"), F.col(outputs).alias("output"))
    return (df.select(*keys, F.posexplode(z).alias("test_idx", "t"))
            .select(*keys, F.col("test_idx").cast("int").alias("test_idx"), "t.input", "t.output"))


# ------------------------------------------------------------------ O1 O2 O3 O5 O8 O9
def first_n(df: DataFrame, n: int, key: str = "qid") -> DataFrame:
    """First n by key; -1 keeps everything."""
    if n is None or n < 0:
        return df
    return df.orderBy(key).limit(n)


def seeded_shuffle(df: DataFrame, seed, key: str = "qid") -> DataFrame:
    """O1: deterministic shuffle: rank rows by md5(seed | key).

    Returns the rows with their 0-based shuffled position. The rank is the
    skew-safe positional index over one global group, so the ordering is
    range-partitioned across tasks instead of a single-partition window.
    """
    from .positions import group_positions
    h = X.seeded_rank_key(seed, F.col(key))
    r = group_positions(df.withColumn("_h", h).withColumn("_g", F.lit(0)), ["_g"], ["_h", key], "shuffle_rank")
    return r.drop("_h", "_g")


def random_index(tests: DataFrame, seed, key: str = "qid", idx: str = "test_idx") -> DataFrame:
    """(key, idx) of one test per problem, picked by a seeded md5 rank over *all* its tests.

    The first 60 bits of the rank and the index share one number, whose minimum
    is a hash aggregate that carries no text.
    """
    rank = F.conv(F.substring(X.seeded_rank_key(seed, F.col(key), F.col(idx)), 1, 15), 16, 10).cast("decimal(20,0)")
    packed = (rank * F.lit(1 << 31).cast("decimal(11,0)") + F.col(idx).cast("decimal(10,0)")).cast("decimal(38,0)")
    least = tests.groupBy(key).agg(F.min(packed).alias("_m"))
    return least.select(key, (F.col("_m") % F.lit(1 << 31).cast("decimal(11,0)")).cast("int").alias(idx))


def random_test(tests: DataFrame, seed, key: str = "qid", idx: str = "test_idx") -> DataFrame:
    """The test of :func:`random_index`, fetched by its key."""
    return tests.join(random_index(tests, seed, key, idx), [key, idx])


# ------------------------------------------------------------------ W1
def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int,
                    index: str = "index") -> DataFrame:
    """At most k rows per group with their 0-based index inside the group.

    ``row_number() <= k`` lets Spark push a partial per-group limit below the
    shuffle (WindowGroupLimit), so hot groups are cut map-side.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            .withColumn(index, (F.col("_rn") - 1).cast("int")).drop("_rn"))


# ------------------------------------------------------------------ P5 P6 P7 P8
def first_python_file(files: DataFrame, repo: str = "repo", path: str = "path", pos: str = "position",
                      content: str = "content") -> DataFrame:
    """The first ``.py`` file of each repository with non-empty content.

    On the long file table the first position is a minimum (a hash aggregate
    without texts); the one file that has it is fetched by its key. Positions
    are unique in a repository.
    """
    py = files.filter(F.col(path).endswith(".py"))
    first = py.groupBy(repo).agg(F.min(pos).alias(pos))
    return py.join(first, [repo, pos]).filter(F.col(content) != "").select(repo, path, content)


def eligible_repos(repos: DataFrame, language: str, min_stars: int, max_size: int,
                   language_col: str = "language", stars: str = "stars", size: str = "size") -> DataFrame:
    """P5 + P8 (metadata part): language, stars >= n, size <= n."""
    return repos.filter((F.col(language_col) == language) & (F.col(stars) >= min_stars) & (F.col(size) <= max_size))


def top_repos_per_day(repos: DataFrame, k: int, created: str = "created", stars: str = "stars", repo: str = "repo") -> DataFrame:
    """P8 (search part): of the repositories created on a day the k with most stars, for every day."""
    return top_k_per_group(repos, [created], [F.desc(stars), repo], k, "rank")


def has_long_python_file(files: DataFrame, min_lines: int, repo: str = "repo", path: str = "path",
                         pos: str = "position", size: str = "size", content: str = "content") -> DataFrame:
    """P8 (file part): the first .py file larger than 40 bytes per wanted line must
    have more than ``min_lines`` lines."""
    big = files.filter(F.col(path).endswith(".py") & (F.col(size) > min_lines * 40))
    first = big.groupBy(repo).agg(F.min_by(F.col(content), F.col(pos)).alias("_c"))
    n = F.size(splitlines(F.col("_c")))
    return first.select(repo, (n > min_lines).alias("long_file"))


def significant(functions: DataFrame, min_lines: int = 20, col: str = "significant_lines") -> DataFrame:
    """Keep functions with more than ``min_lines`` significant lines."""
    return functions.filter(F.col(col) > min_lines)

"""Fill-in-middle transformation with cuts found in a Fenwick tree over text blocks.

1. A text's UTF-8 bytes are seen as blocks of ``block`` bytes. A block counts
   the units (tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``)
   that end in it and the code points that begin in it; a Fenwick tree holds
   both counts.
2. The end of the k-th unit is found by binary lifting: a descent from the
   widest node that adds up units and code points of whole blocks, then a look
   at the bytes of the one block where the unit ends.
3. The Python step (an Arrow function, texts go in and only five numbers come
   back) does no more than that. Which rows are rearranged, where the cuts
   fall, the output and the text rebuilt from it are Spark expressions; rows
   stay where they are, nothing is shuffled.

Blocks are slices of a text's own bytes; besides them a text takes two numbers
a block and, one block at a time, a few bytes per byte of the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table, whole_text

#: Bytes of a block.
BLOCK = 4096
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
KIND = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,chars:bigint>"


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Places in [start, stop) of the bytes that are the last of a unit."""
    near = _blank(data[start:stop + 1])
    if stop == len(data):                  # the end of the text ends a unit, of blanks too
        near = np.append(near[:stop - start], True)
        last = ~near[:-1] & near[1:]
        last[-1] = True
        return start + np.flatnonzero(last)
    return start + np.flatnonzero(~near[:-1] & near[1:])


def point_starts(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80


def fenwick(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Node i (from 1) holds (units, code points) of the ``i & -i`` blocks that end with block i."""
    blocks = -(-len(data) // block)
    counts = np.zeros((blocks + 1, 2), np.int64)
    for b in range(blocks):
        a, z = b * block, min(len(data), (b + 1) * block)
        counts[b + 1] = len(unit_ends(data, a, z)), np.count_nonzero(point_starts(data[a:z]))
    upto = np.cumsum(counts, axis=0)
    node = np.arange(blocks + 1)
    return upto - upto[node - (node & -node)]


def total(tree: np.ndarray) -> np.ndarray:
    """(units, code points) of the whole text."""
    at, out = len(tree) - 1, np.zeros(2, np.int64)
    while at:
        out += tree[at]
        at &= at - 1
    return out


def descend(tree: np.ndarray, k: int) -> tuple[int, int, int]:
    """(block, units before it, code points before it) of the block in which unit ``k`` (from 1) ends."""
    at = units = points = 0
    step = 1 << (len(tree) - 1).bit_length()
    while step:
        if at + step < len(tree) and units + tree[at + step, 0] < k:
            at += step
            units += int(tree[at, 0])
            points += int(tree[at, 1])
        step >>= 1
    return at, units, points


def cut(data: np.ndarray, tree: np.ndarray, k: int, block: int = BLOCK) -> int:
    """Code points of the first ``k`` units."""
    if k == 0:
        return 0
    at, units, points = descend(tree, k)
    a, z = at * block, min(len(data), (at + 1) * block)
    end = int(unit_ends(data, a, z)[k - units - 1])
    # the rest of the unit's last code point may lie behind its first byte, never before it
    return points + int(np.count_nonzero(point_starts(data[a:end + 1])))


def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """KIND of each text: its units, code points of the prefix and the middle, all code points."""
    out = np.zeros((len(text), 4), np.int64)
    for i, (t, x, y) in enumerate(zip(text, h1.to_pylist(), h2.to_pylist(), strict=True)):
        data = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)
        tree = fenwick(data)
        n, chars = map(int, total(tree))
        a, b = sorted((x % (n + 1), y % (n + 1)))
        first, second = cut(data, tree, a), cut(data, tree, b)
        out[i] = n, first, second - first, chars
    names = ["n", "prefix_chars", "middle_chars", "chars"]
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(4)], names)


def hashes(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:id`` (a null id: ``seed:``)."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``n`` counts the text's units. A text that is empty (or null) or holds a
    mark stays plain, as do ``100 - fim_percent`` of 100 others; of the rest
    ``spm_percent`` of 100 put the suffix first. Equal ids get equal choices,
    a null id those of the empty string; the two numbers are null for plain
    rows. A text may be one unit (a cut then leaves parts empty) and of any
    length; repeated rows give equal rows, other columns are not read, an empty
    table gives an empty result.
    """
    python_ready(docs.sparkSession)
    h1, h2, h3, h4 = hashes(F.col(f"`{id_col}`"), seed)
    p, s, m = (F.lit(x) for x in marks)
    text = F.col("text")
    marked = F.lit(False)
    for x in marks:
        marked = marked | text.contains(x)
    form = (F.when((text == "") | marked | (h3 % 100 >= fim_percent), "plain")
            .when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(F.col(f"`{text_col}`").cast("string")).alias("text"),
                       h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.select("doc_id", "text", form.alias("form"), F.arrow_udf(cuts, KIND)("text", "h1", "h2").alias("cut"))
    a, b = F.col("cut.prefix_chars"), F.col("cut.prefix_chars") + F.col("cut.middle_chars")
    prefix, middle = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), F.col("cut.middle_chars").cast("int"))
    suffix = F.substring(text, (b + 1).cast("int"), (F.col("cut.chars") - b).cast("int"))
    plain = F.col("form") == "plain"
    output = (F.when(plain, text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    return rows.select("doc_id", F.col("cut.n").alias("n"), "form", F.when(~plain, F.col("cut.prefix_chars")).alias("prefix_chars"),
                       F.when(~plain, F.col("cut.middle_chars")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its form and output alone.

    Exact: a rearranged text holds no mark, and no mark can arise where a part
    and a mark meet, so each occurs once.
    """
    p, s, m = marks
    middle = F.substring_index(output, m, -1)
    front = F.substring_index(output, m, 1)
    # psm: <P>prefix<S>suffix, spm: <S>suffix<P>prefix
    psm = F.concat(F.substring(F.substring_index(front, s, 1), F.lit(len(p) + 1), F.length(front)), middle, F.substring_index(front, s, -1))
    spm = F.concat(F.substring_index(front, p, -1), middle, F.substring(F.substring_index(front, p, 1), F.lit(len(s) + 1), F.length(front)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim_fenwick(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


#: Independent of the trees: units as a list, parts as joined slices of it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {"op11_fim_fenwick": op11_fim_fenwick}
ORACLES = {"op11_fim_fenwick": ORACLE}

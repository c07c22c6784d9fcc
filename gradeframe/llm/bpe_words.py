"""BPE encoding through a table of distinct words, decoding through a table of pieces.

1. Splitting. A pass over the whole texts splits them into the tokeniser's
   words. A batch of texts becomes one row: its texts as positions in the list
   of its distinct words (most frequent first, in compressed byte planes), and
   that list dealt into parts by a hash of the word, each part compressed. The
   rows form a table bucketed by batch in the shared checkpoint folder.
2. Encoding. The parts are shuffled by part number, so all batches' copies of a
   word meet in one task, and each distinct word is encoded once there.
3. Joining back. The ids of a batch's parts meet the batch's texts (read in
   place from the bucketed table, only the ids are shuffled), and every
   position is replaced by the ids of its word. A batch has at most
   ``batch_words`` words (or one text).
4. Decoding. The 50,257 pieces of the vocabulary are an array by id; the ids of
   a text fetch their pieces, and the bytes are decoded once whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import map_arrow, table

BATCH_WORDS = 1_000_000
#: Words a task remembers; beyond that it starts anew, and words met again are encoded again.
KNOWN_WORDS = 2_000_000
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose characters have had their classes for long; texts with others go
#: through the tokeniser's own splitter, whose Unicode version is not ours.
LONG_KNOWN = (r"\x00-՗؀-ۿऀ-୿Ḁ-⁰₠-₿℀-⯿　-鿿"
              r"가-힣＀-￯\U0001F000-\U0001FAFF")


def public_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def splitter(path: str) -> Callable[[str], list[str]]:
    """Text -> words that are encoded independently, added tokens as words of their own."""
    import regex
    with open(path, encoding="utf-8") as f:
        added = [a["content"] for a in json.load(f)["added_tokens"]]
    pieces = regex.compile(PATTERN).findall
    rare = regex.compile(f"[^{LONG_KNOWN}]").search
    special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
    own = None

    def plain(text: str) -> list[str]:
        nonlocal own
        if text.isascii() or not rare(text):
            return pieces(text)
        own = own or load(path).pre_tokenizer
        return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]

    def words(text: str) -> list[str]:
        if special is None or not any(a in text for a in added):
            return plain(text)
        return [w for k, part in enumerate(special.split(text)) for w in ([part] if k % 2 else plain(part))]

    return words


def pack(codes: np.ndarray) -> bytes:
    """Numbers as compressed planes of their low, middle and high bytes."""
    import zstandard
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: list[str]) -> bytes:
    """A list of words as their lengths in bytes and the bytes, compressed."""
    import zstandard
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), "<u4", len(raw))
    return zstandard.ZstdCompressor(level=3).compress(
        np.array([len(raw)], "<u4").tobytes() + sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(raw))


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)
    ends = np.cumsum(sizes) + 4 + 4 * n
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


BATCH_SCHEMA = ("batch long, ids array<long>, sizes binary, codes binary, parts binary, "
                "lists array<struct<part:int,words:binary>>")


def word_batches(docs: DataFrame, path: str, parts: int, batch_words: int = BATCH_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """BATCH_SCHEMA: texts as positions (``codes``) in their batch's words, the part
    of each word (``parts``), and the words of each part in the order of their positions."""
    def row(ids, sizes, codes, index) -> pa.RecordBatch:
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
        rank = np.empty(len(index), np.int64)
        rank[order] = np.arange(len(index))
        words = list(index)
        words = [words[k] for k in order]
        part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
        lists: dict[int, list[str]] = defaultdict(list)
        for p, w in zip(part.tolist(), words, strict=True):
            lists[p].append(w)
        made = [{"part": p, "words": pack_words(ws)} for p, ws in sorted(lists.items())]
        kind = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([pack(np.array(sizes))], pa.binary()), pa.array([pack(rank[flat])], pa.binary()),
             pa.array([pack(part)], pa.binary()), pa.array([made], kind)],
            ["batch", "ids", "sizes", "codes", "parts", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        index: dict = defaultdict(count().__next__)
        ids, sizes, codes, n = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                got = split(t.as_py() or "")
                ids.append(i.as_py())
                sizes.append(len(got))
                codes.append(np.fromiter(map(index.__getitem__, got), np.int32, len(got)))
                n += len(got)
                if n >= batch_words:
                    yield row(ids, sizes, codes, index)
                    index = defaultdict(count().__next__)
                    ids, sizes, codes, n = [], [], [], 0
        if ids:
            yield row(ids, sizes, codes, index)

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(src, run, BATCH_SCHEMA)


def encode_lists(lists: DataFrame, path: str) -> DataFrame:
    """(batch, part, words) -> (batch, part, sizes, word_ids); each distinct word of a task is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        known: dict[bytes, bytes] = {}
        for b in batches:
            for i in range(b.num_rows):
                words = unpack_words(b.column(2)[i].as_py())
                if len(known) > KNOWN_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 4096):
                    some = new[k:k + 4096]
                    got = t.encode_batch([w.decode() for w in some], add_special_tokens=False)
                    known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, got, strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([pack(sizes)], pa.binary()),
                     pa.array([pack(np.frombuffer(b"".join(ids), "<u4"))], pa.binary())], ["batch", "part", "sizes", "word_ids"])

    return map_arrow(lists, run, "batch long, part int, sizes binary, word_ids binary")


def gather(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all parts of the items ``of`` end to end, parts per item)."""
    sizes = size[of]
    places = np.repeat(start[of] - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return places, sizes


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from its bytes and the end of each value."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _join_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of one batch (left) with their word positions replaced by ids (right)."""
    names, types = ["doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.binary()]
    if not left.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in types], names)
    row = left.to_pylist()[0]
    sizes, codes, part = unpack(row["sizes"]).astype(np.int64), unpack(row["codes"]).view("<i4"), unpack(row["parts"]).view("<i4")
    got = sorted(right.select(["part", "sizes", "word_ids"]).to_pylist(), key=lambda r: r["part"])
    word_sizes = [unpack(r["sizes"]).astype(np.int64) for r in got]
    # words of the parts in turn, each part in the order of its positions
    order = np.argsort(part, kind="stable")
    if not np.array_equal(part[order], np.repeat([r["part"] for r in got], [len(x) for x in word_sizes])):
        raise ValueError(f"batch {row['batch']}: the encoded parts are not those of its words")
    in_turn = np.concatenate(word_sizes) if got else np.zeros(0, np.int64)
    size, start = np.empty_like(in_turn), np.empty_like(in_turn)
    size[order], start[order] = in_turn, np.cumsum(in_turn) - in_turn
    flat = np.concatenate([unpack(r["word_ids"]) for r in got]) if got else np.zeros(0, "<u4")
    places, per_word = gather(start, size, codes)
    ends = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(sizes)]
    out = flat[places].astype("<u4")
    return pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.diff(ends, prepend=0)),
                                 binaries(out.view(np.uint8), ends * 4)], names)


def encode(docs: DataFrame, path: str, batch_words: int = BATCH_WORDS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit).

    Equal to the tokenizers library on the whole text without added specials
    (strings of added tokens in a text become those tokens). Null and empty
    texts have no ids; repeated rows and null ids are encoded like any other;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    name = f"gradeframe_words_{uuid.uuid4().hex}"
    parts = min(1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (word_batches(docs, path, parts, batch_words, id_col, text_col).write.bucketBy(parts, "batch")
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    lists = spark.table(name).select("batch", F.inline("lists")).repartition(parts, "part")
    return (spark.table(name).select("batch", "ids", "sizes", "codes", "parts").groupBy("batch")
            .cogroup(encode_lists(lists, path).groupBy("batch"))
            .applyInArrow(_join_back, "doc_id long, n_tokens long, ids binary"))


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    # byte-level BPE writes printable bytes as themselves and the others from U+0100 on, in order
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    by_id |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` (with ``ids``) and ``text``, the decoded ids, specials included.

    Null ids give a null text, no ids an empty one; a column ``text`` is replaced.
    """
    from pyspark.sql import types as T
    keep = [c for c in encoded.columns if c not in ("text", "ids")]
    src = encoded.select("ids", F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(path)
        size = np.array([len(p) for p in pieces], np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(pieces), np.uint8)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = []
                for x in part.column(0):
                    if not x.is_valid:
                        texts.append(None)
                        continue
                    places, _ = gather(start, size, np.frombuffer(x.as_buffer(), "<u4").astype(np.int64))
                    texts.append(flat[places].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["ids", "row", "text"])

    done = map_arrow(src, run, T.StructType([src.schema["ids"], src.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*[F.col("ids") if c == "ids" else F.col(f"row.`{c}`").alias(c) for c in encoded.columns if c != "text"], "text")


def op2_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_vocabulary()
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe_words": op2_bpe_words}
ORACLES: dict[str, str] = {}

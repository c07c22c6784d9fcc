"""Token counts from a finite-state machine compiled from a tokeniser file.

1. Compilation. A word-end BPE tokeniser becomes a deterministic transducer
   over characters whose transitions carry the change of the token count. Its
   outer part splits words (letters, single digits, other characters,
   contractions); inside a word a state holds what decides the rest: the
   longest end of the word that begins a token, and for each place in it the
   last token and the count of the word up to there. The tokens of a word's
   beginning are the tokens of the whole up to its last ones, and a token can
   follow another exactly if the merges of the two together give these two, so
   the next state follows from the state and the character alone. The states
   are finite but far too many to write down, so a state and its transitions
   are made when they are first met; a task keeps at most ``STATES`` and then
   starts anew.
2. Counting. Normalised texts of up to ``chunk`` characters are walked through
   the machine where they are; nothing is shuffled.
3. Longer texts are cut into chunks (where normalisation cannot reach over the
   cut), which Spark deals out over all tasks. A chunk's map from the state
   before it to the count and the state behind it is constant from the first
   place on where every state meets (a blank, a digit, a special token, a
   letter after another character): the map is kept as the piece before that
   place, the count after it and the piece since the last such place.
4. Maps of neighbours compose to a map, associatively. A prefix scan in two
   shuffles composes runs of ``FAN`` neighbours, then the runs: at most
   ``FAN`` rows meet in a task for every 2^32 characters.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, python_ready, table, whole_text

#: Characters of a chunk, chunk maps composed at once.
CHUNK, FAN = 1 << 16, 1 << 8
#: States a machine remembers; beyond that it starts anew, with equal results.
STATES = 250_000
#: Transitions on whole pieces between spaces that the start state remembers, characters of such a piece.
PIECES, PIECE_CHARS = 200_000, 32
#: Fixed value: the split pattern of the tokeniser files this machine is written for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The contractions of that pattern, by what the apostrophe is followed by.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A special token in a stream of characters (texts hold no lone surrogates).
SPECIAL = "\ud800"
LETTER, DIGIT, OTHER, BLANK, MARK = range(5)


class State(dict):
    """character -> (next state, change of the count); made when first asked for."""

    __slots__ = ("ends", "kind", "machine", "word")

    def __init__(self, machine: Machine, kind: int | str, word: tuple = ()):
        self.machine, self.kind, self.word, self.ends = machine, kind, word, None

    def closing(self) -> int:
        """Change of the count when the word that is open here ends."""
        if self.ends is None:
            self.ends = self.machine.closing(self)
        return self.ends

    def __missing__(self, char: str) -> tuple[State, int]:
        self[char] = step = self.machine.step(self, char)
        return step


class Machine:
    """The transducer of one tokeniser file. ``start`` is the state outside of any word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != PATTERN or not end or model["dropout"] or model["byte_fallback"]:
            raise ValueError(f"{path}: the machine is written for word-end BPE with the split pattern {PATTERN}")
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = [a["content"] for a in spec["added_tokens"]]
        # byte-level BPE writes printable bytes as themselves and the others from U+0100 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        self.inner: dict[bytes, int] = {}      # tokens inside a word
        self.final: dict[bytes, int] = {}      # tokens that end one
        for piece, i in model["vocab"].items():
            ends = piece.endswith(end)
            data = bytes(letters[c] for c in (piece[:-len(end)] if ends else piece))
            (self.final if ends else self.inner)[data] = i
        self.begins = {data[:k] for data in (*self.inner, *self.final) for k in range(1, len(data) + 1)}
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        # a token as its two parts and the rank of the merge that makes it
        self.parts = {new: (rank, a, b) for (a, b), (rank, new) in sorted(self.merged.items(), key=lambda x: -x[1][0])}
        if any(self.parts.get(x, (-1,))[0] >= rank for rank, a, b in self.parts.values() for x in (a, b)):
            raise ValueError(f"{path}: a merge comes before those that make its parts")
        self.bytes_of = {i: data for kind in (self.inner, self.final) for data, i in kind.items()}
        self.ends_word = set(self.final.values())
        self.classes: dict[str, int] = {}
        self.pair_fits: dict[tuple[int, int], bool] = {}
        if self.class_of(" ") != BLANK or self.class_of("'") != OTHER:
            raise ValueError(f"{path}: a space must part words, an apostrophe join other characters")
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pieces_met: dict[str, int] = {}
        self.start = self.state(BLANK)

    def state(self, kind: int | str, word: tuple = ()) -> State:
        made = self.states.get((kind, word))
        if made is None:
            made = self.states[kind, word] = State(self, kind, word)
        return made

    def class_of(self, char: str) -> int:
        """As the library splits: blanks vanish, digits part, letters join letters."""
        got = self.classes.get(char)
        if got is None:
            if char == SPECIAL:
                got = MARK
            elif not self.pieces(char):
                got = BLANK
            elif len(self.pieces(char * 2)) == 2:
                got = DIGIT
            else:
                got = LETTER if len(self.pieces("a" + char)) == 1 else OTHER
            self.classes[char] = got
        return got

    def merge(self, tokens: list[int]) -> list[int]:
        """Apply the merges: the lowest rank first, from the left."""
        while len(tokens) > 1:
            best = min(((self.merged.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False))),
                       key=lambda x: (x[0][0], x[1]))
            (rank, new), at = best
            if rank == 1 << 60:
                break
            tokens = [*tokens[:at], new, *tokens[at + 2:]]
        return tokens

    def symbols(self, token: int) -> list[int]:
        data = self.bytes_of[token]
        out = [self.inner[data[k:k + 1]] for k in range(len(data))]
        if token in self.ends_word:
            out[-1] = self.final[data[-1:]]
        return out

    def alone(self, token: int) -> bool:
        """Whether the merges of a token's own characters give the token."""
        got = self.pair_fits.get((-1, token))
        if got is None:
            got = self.pair_fits[-1, token] = self.merge(self.symbols(token)) == [token]
        return got

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand behind ``before`` (-1: the word's beginning).

        Both are taken apart again at their common edge, the later merge first:
        they stay apart if no two pieces that met there had a merge that came
        before the merges that made the pieces grow.
        """
        if before < 0:
            return self.alone(token)
        got = self.pair_fits.get((before, token))
        if got is None:
            x, y, grew_x, grew_y, got = before, token, 1 << 60, 1 << 60, True
            none = (-1, x, y)
            while True:
                rank = self.merged.get((x, y), (1 << 60,))[0]
                if rank < grew_x and rank <= grew_y:         # of equal merges the left one comes first
                    got = False
                    break
                of_x, of_y = self.parts.get(x, none), self.parts.get(y, none)
                if of_x[0] < 0 and of_y[0] < 0:
                    break
                if of_x[0] > of_y[0]:
                    grew_x, x = of_x[0], of_x[2]
                else:
                    grew_y, y = of_y[0], of_y[1]
            if len(self.pair_fits) > 4 * STATES:
                self.pair_fits = {}
            self.pair_fits[before, token] = got
        return got

    #: A word's end that begins a token; for its places, backwards from the word's end: last tokens (-1: the word's beginning, -2: of no use), counts less that of the whole.
    EMPTY = (b"", (-1,), (0,))

    def grow(self, word: tuple, byte: int) -> tuple[tuple, int]:
        tail, last, less = word
        end = tail + bytes((byte,))
        while end not in self.begins:
            end = end[1:]
        for n in range(len(end), 0, -1):
            token = self.inner.get(end[-n:])
            if token is not None and self.alone(token) and self.fits(last[n - 1], token):
                break
        else:
            raise ValueError(f"no token ends {end!r}")
        change = less[n - 1] + 1
        # a place counts only if a token that goes on can begin there
        open_at = [end[-n:] in self.begins for n in range(1, len(end) + 1)]
        return (end, (token, *[x if o else -2 for x, o in zip(last, open_at)]),
                (0, *[x - change if o else 0 for x, o in zip(less, open_at)])), change

    def closing(self, state: State) -> int:
        """Change of the count when the word of a state ends there."""
        if state.kind == BLANK:
            return 0
        if isinstance(state.kind, str):          # an apostrophe and what may become a contraction
            return sum(map(self.word_tokens, state.kind))
        tail, last, less = state.word
        for n in range(len(tail), 0, -1):
            token = self.final.get(tail[-n:])
            if token is not None and self.alone(token) and self.fits(last[n], token):
                return less[n] + 1
        raise ValueError(f"no token ends the word {tail!r}")

    def step(self, state: State, char: str) -> tuple[State, int]:
        kind, found = state.kind, self.class_of(char)
        if isinstance(kind, str):
            if kind[1:] + char in CONTRACTIONS:
                return self.start, self.word_tokens(kind + char)
            if kind == "'" and char in ("r", "v", "l"):
                return self.state(kind + char), 0
            if kind == "'" and found == OTHER:   # no contraction: the apostrophe begins a word of others
                word, n = self.grown(self.EMPTY, "'")
                word, m = self.grown(word, char)
                return self.state(OTHER, word), n + m
            if len(kind) == 2 and found == LETTER:
                word, n = self.grown(self.EMPTY, kind[1])
                word, m = self.grown(word, char)
                return self.state(LETTER, word), self.word_tokens("'") + n + m
        elif kind == found and kind in (LETTER, OTHER):
            word, n = self.grown(state.word, char)
            return self.state(kind, word), n
        # the word of the state ends here
        if found == BLANK:
            return self.start, state.closing()
        if found == MARK:
            return self.start, state.closing() + 1
        if found == DIGIT:
            return self.start, state.closing() + self.word_tokens(char)
        if char == "'":
            return self.state("'"), state.closing()
        word, n = self.grown(self.EMPTY, char)
        return self.state(found, word), state.closing() + n

    def grown(self, word: tuple, chars: str) -> tuple[tuple, int]:
        n = 0
        for byte in chars.encode():
            word, k = self.grow(word, byte)
            n += k
        return word, n

    def word_tokens(self, chars: str) -> int:
        """Tokens of the characters as one word."""
        word, n = self.grown(self.EMPTY, chars)
        return n + State(self, OTHER, word).closing()

    def walk(self, chars: str, state: State | None = None) -> tuple[State, int]:
        """(state behind the characters and the count, the word that is open there closed)."""
        state, n = state or self.start, 0
        for c in chars:
            state, k = state[c]
            n += k
        return state, n + state.closing()

    def count(self, chars: str) -> int:
        """Tokens of the characters. A space leads every state to the start, so what
        the machine does between two spaces is one transition of the start state."""
        if len(self.states) > STATES:
            self.reset()
        met, n = self.pieces_met, 0
        for piece in chars.split(" "):
            k = met.get(piece)
            if k is None:
                k = self.walk(piece)[1]
                if len(met) < PIECES and len(piece) <= PIECE_CHARS:
                    met[piece] = k
            n += k
        return n

    def stream(self, text: str) -> str:
        """The normalised characters of a text, special tokens as ``SPECIAL``.

        Blanks stay as they are: to the machine any number of them is one. As
        in the library, special tokens are found first and the pieces between
        them are normalised apart.
        """
        for a in self.added:
            if a in text:
                parts = re.split("|".join(map(re.escape, self.added)), text)
                return SPECIAL.join(map(self.stream, parts))
        return text.lower() if text.isascii() else self.normalise(text)

    def meets(self, chars: str, at: int) -> bool:
        """Whether all states are one before the character ``at``, the word before it closed."""
        before = self.class_of(chars[at - 1])
        return before in (BLANK, DIGIT, MARK) or before == OTHER and chars[at - 1] != "'" and self.class_of(chars[at]) == LETTER

    def chunk_map(self, chars: str) -> tuple[str, bool, int, str]:
        """(piece before the first meeting place, whether there is one, count between it and the last, piece behind)."""
        places = range(1, len(chars))
        first = next((p for p in places if self.meets(chars, p)), None)
        if first is None:
            return chars, False, 0, ""
        last = next(p for p in reversed(places) if self.meets(chars, p))
        return chars[:first], True, self.count(chars[first:last]), chars[last:]

    def compose(self, a: tuple[str, bool, int, str], b: tuple[str, bool, int, str]) -> tuple[str, bool, int, str]:
        """The map of two neighbours. Without a meeting place in either, or at their edge, the pieces join."""
        if not a[1]:
            return (a[0] + b[0], *b[1:])
        if not b[1]:
            return (*a[:3], a[3] + b[0])
        return (a[0], True, a[2] + self.count(a[3] + b[0]) + b[2], b[3])

    def applied(self, m: tuple[str, bool, int, str]) -> int:
        """Count of a whole text's map: from the start, the last word closed."""
        return self.count(m[0]) + m[2] + self.count(m[3])


@cache
def machine(path: str) -> Machine:
    """One per Python worker; its states serve all its tasks."""
    return Machine(path)


@cache
def seconds() -> frozenset[str]:
    """Characters that can melt into the one before them though they are no combining marks."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000) if not 0xAC00 <= c < 0xD7A4)
    found = {chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d}
    return frozenset(found | {chr(c) for c in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))})


def cut_place(text: str, at: int, added: list[str], near: int) -> int:
    """First place from ``at`` on where a text can be cut: before a blank among the
    next ``near`` characters, else before a character that starts anew under
    normalisation, never inside a special token; else the text's end."""
    for p in range(at, min(len(text), at + near)):
        if text[p] in " \n\t\r":
            return p
    widest = max(map(len, added), default=1)
    for p in range(at, len(text)):
        c = text[p]
        if not c.isascii() and (unicodedata.combining(c) or unicodedata.category(c) == "Cn" or c in seconds()):
            continue
        if any(a in text[max(0, p - len(a) + 1):p + len(a) - 1] for a in added if widest > 1):
            continue
        return p
    return len(text)


def cut_up(text: str, chunk: int, added: list[str]) -> Iterator[str]:
    a = 0
    while a < len(text):
        z = cut_place(text, a + chunk, added, max(1, chunk // 4))
        yield text[a:z]
        a = z


MAP = "rid long, doc_id long, n_bytes long, part long, head binary, met boolean, n long, tail binary"


def _map_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()]
    rows = [(*r[:4], _packed(r[4]), *r[5:7], _packed(r[7])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names)


def _packed(chars: str) -> bytes:
    return chars.encode("utf-8", "surrogatepass")        # SPECIAL is no character of UTF-8


def _map_of(row: dict) -> tuple[str, bool, int, str]:
    return (row["head"].decode("utf-8", "surrogatepass"), row["met"], row["n"], row["tail"].decode("utf-8", "surrogatepass"))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens.

    ``n_tokens`` equals the length of the tokenizers library's ids for the
    whole text, nothing added; special tokens written in a text count as such.
    Null and empty texts have none; texts of any length are whole (a run
    without a meeting place, such as one endless word, is walked by one task);
    repeated rows and null ids are counted like any other, other columns are
    not read, an empty table gives an empty result.
    """
    python_ready(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(F.col(f"`{text_col}`").cast("string")).alias("text"))
    src = src.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = F.octet_length("text") > chunk

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            n = [m.count(m.stream(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = machine(path).added
        for b in batches:
            for rid, i, size, t in zip(*b.columns, strict=True):
                for k, piece in enumerate(cut_up(t.as_py(), chunk, added)):
                    yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()], pa.int64()), pa.array([i.as_py()], pa.int64()),
                                                      pa.array([size.as_py()], pa.int64()), pa.array([k], pa.int64()),
                                                      pa.array([piece], pa.string())], ["rid", "doc_id", "n_bytes", "part", "piece"])

    names = ["rid", "doc_id", "n_bytes", "part", "head", "met", "n", "tail"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                yield _map_rows([(*row[:4], *m.chunk_map(m.stream(row[4])))], names)

    def composed(group: pa.Table) -> pa.Table:
        m = machine(path)
        rows = group.sort_by("part").select(names).to_pylist()
        out = None
        for r in rows:
            out = _map_of(r) if out is None else m.compose(out, _map_of(r))
        first = rows[0]
        return pa.Table.from_batches([_map_rows([(first["rid"], first["doc_id"], first["n_bytes"], first["part"] // FAN, *out)], names)])

    short = map_arrow(src.filter(~long).select("doc_id", "n_bytes", "text"), counted, "doc_id long, n_bytes long, n_tokens long")
    # an id of a task's own is enough: all chunks of a text come from one task
    pieces = map_arrow(src.filter(long).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_bytes", "text"), chunks,
                       "rid long, doc_id long, n_bytes long, part long, piece string")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scan = map_arrow(pieces.repartition(spread, "rid", "part"), maps, MAP)
    for _ in range(2):
        scan = scan.groupBy("rid", F.floor(F.col("part") / FAN)).applyInArrow(composed, MAP)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            n = [m.applied(_map_of(r)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return short.unionByName(map_arrow(scan, ended, "doc_id long, n_bytes long, n_tokens long"))


#: Tokens above which a document is over the limit.
LIMIT = 2048


def op13_token_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    done = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_machine": op13_token_machine}
ORACLES: dict[str, str] = {}

"""Encode whole texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; merges never cross words. Each task
keeps the ids of the words it has met, and sends the new words of a batch through one
recursive DuckDB query: rows (word, position, token) are joined with the merge table, every
word's leftmost pairs of least rank are contracted, and the words that changed go round
again until nothing does. Only the newest state of each position is kept (``USING KEY``). An
ordered aggregation turns it into id lists. DuckDB gets no folder to spill to.

Two things keep long words linear, and both are exact. A word is first cut where no entry of
the vocabulary that occurs in it spans the place: no merge can ever join its two sides. And
a pair is contracted as soon as its rank is the least within the length of the longest
entry to the left and twice that to the right: any token that could take one of its two
tokens before it would have to be built from pairs of lower rank in that stretch.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from terracell.functions.textform import to_codepoints

TOKENIZERS = os.environ.get("TERRACELL_TOKENIZERS", "/opt/tokenizers")
MOST_WORDS = 300_000

_WORD = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

LONG = 64  # words of more bytes are cut first
LONGEST = 128  # bytes of the longest entry that the windows of the query allow for
_BUDGET = 500_000  # bytes that go through one query, and fit into 300 MB

_MERGE = f"""
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM symbols
    UNION ALL
    SELECT word, pos, CASE WHEN swallowed THEN NULL WHEN taken THEN merged ELSE tok END AS tok
    FROM (
        SELECT *, coalesce(lag(taken) OVER w, false) AS swallowed, bool_or(taken) OVER (PARTITION BY word) AS changed
        FROM (
            SELECT *, settled AND (row_number() OVER (PARTITION BY word, island ORDER BY pos)) % 2 = 1 AS taken
            FROM (
                SELECT *, bool_and(least_here) OVER (PARTITION BY word, island ORDER BY pos) AS settled
                FROM (
                    SELECT *, rank IS NOT NULL AND rank = least AS least_here, sum(fresh) OVER w AS island
                    FROM (
                        SELECT *, (rank IS DISTINCT FROM lag(rank) OVER w OR rank IS NULL)::INT AS fresh,
                               min(rank) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {LONGEST} PRECEDING AND {2 * LONGEST} FOLLOWING) AS least
                        FROM (
                            SELECT p.word, p.pos, p.tok, m.rank, m.merged
                            FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS following FROM state WHERE tok IS NOT NULL) p
                            LEFT JOIN merges m ON m.lhs = p.tok AND m.rhs = p.following
                        )
                        WINDOW w AS (PARTITION BY word ORDER BY pos)
                    )
                    WINDOW w AS (PARTITION BY word ORDER BY pos)
                )
            )
        )
        WINDOW w AS (PARTITION BY word ORDER BY pos)
    )
    WHERE changed
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok IS NOT NULL GROUP BY word ORDER BY word
"""


_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def _classes() -> np.ndarray:
    """The pattern's class of each code point."""
    kind = np.fromiter(({"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    kind[list(_SPACES)] = _SPACE
    return kind


def word_starts(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where the words of the pattern begin, for the code points of many texts at once.

    The pattern, in words: 's 't 'm 'd 're 've 'll at the start of a word; else a run of
    letters, of numbers or of other signs with the one space before it; else a run of white
    space, without its last character where something follows.
    """
    n = len(points)
    kind = _classes()[points]
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    start = new_row | np.concatenate([[True], kind[1:] != kind[:-1]])
    goes_on = np.concatenate([~new_row[1:], [False]])
    following = np.concatenate([kind[1:], [_SPACE]])
    last_space = np.flatnonzero((kind == _SPACE) & goes_on & (following != _SPACE))
    start[last_space] = True
    start[last_space[points[last_space] == 0x20] + 1] = False
    mark = np.flatnonzero((points == 0x27) & start & goes_on & (following == _LETTER))
    if len(mark):
        one = points[mark + 1]
        two = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        two = np.where((mark + 2 < n) & ~new_row[np.minimum(mark + 2, n - 1)], two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        hit = short | long
        start[mark[hit] + 1] = False
        rest = mark[hit] + np.where(long[hit], 3, 2)
        rest = rest[rest < n]
        rest = rest[(kind[rest] == _LETTER) & ~new_row[rest]]
        start[rest] = True
    return start


def distinct_words(points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(a first place of each distinct word, the distinct word of each word) by a rolling hash.

    Every word is then compared with its representative, character by character; None if
    two different words had one hash.
    """
    n = len(points)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        mixed = (points.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:-1])])
        end = np.concatenate([begin[1:], [n]])
        key = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    like = first[which]
    size = end - begin
    if not (size == size[like]).all() or not (points == points[np.arange(n) - np.repeat(begin - begin[like], size)]).all():
        return None
    return first, which


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


@functools.cache
def vocabulary(path: str) -> dict[str, np.ndarray]:
    """The merge table and the ids of the single bytes, from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    letters = byte_letters()
    return {
        "lhs": np.array([ids[a] for a, _ in pairs], np.int32),
        "rhs": np.array([ids[b] for _, b in pairs], np.int32),
        "merged": np.array([ids[a + b] for a, b in pairs], np.int32),
        "bytes": np.array([ids[letters[b]] for b in range(256)], np.int32),
    }


def spellings(table: dict[str, np.ndarray]) -> dict[int, bytes]:
    """The bytes of every token."""
    out = {int(i): bytes([b]) for b, i in enumerate(table["bytes"])}
    for a, b, m in zip(table["lhs"].tolist(), table["rhs"].tolist(), table["merged"].tolist(), strict=True):
        out[m] = out[a] + out[b]
    return out


def _stretches(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every stretch of ``size`` bytes."""
    out = np.zeros(len(raw) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + raw[k : len(raw) - size + 1 + k] + np.uint64(1)
    return out


def connection():
    """A DuckDB of one thread and 300 MB in memory, which never writes to a disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})


class Encoder:
    """Word cache of one task over the recursive query."""

    def __init__(self, table: dict[str, np.ndarray]) -> None:
        self.bytes = table["bytes"]
        self.con = connection()
        merges = pa.table({"lhs": table["lhs"], "rhs": table["rhs"], "rank": np.arange(len(table["lhs"]), dtype=np.int32), "merged": table["merged"]})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        by_size: dict[int, list[bytes]] = {}
        for entry in spellings(table).values():
            if len(entry) > 1:
                by_size.setdefault(len(entry), []).append(entry)
        if max(by_size, default=0) > LONGEST:
            raise ValueError(f"an entry of the vocabulary has more than {LONGEST} bytes")
        self.known = {n: np.unique(np.concatenate([_stretches(np.frombuffer(e, np.uint8), n) for e in some])) for n, some in sorted(by_size.items())}
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str | bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def pieces(self, word: bytes) -> list[bytes]:
        """A long word cut at the places that no entry of the vocabulary spans.

        Entries are recognised by hash; a false one only leaves a cut out.
        """
        raw = np.frombuffer(word, np.uint8)
        spans = np.zeros(len(raw) + 1, np.int32)
        for n, known in self.known.items():
            if n <= len(raw):
                stretch = _stretches(raw, n)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, stretch), len(known) - 1)] == stretch)
                spans[at + 1] += 1
                np.add.at(spans, at + n, -1)
        cut = np.flatnonzero(np.cumsum(spans)[1 : len(raw)] == 0) + 1
        return [word[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(word)], strict=True)]

    def learn(self, words: list[str | bytes]) -> None:
        """Ids of words that are new, in the order given."""
        raw = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else w for w in words]
        ends = np.cumsum([len(r) for r in raw])
        first = 0
        while first < len(raw):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _BUDGET, "right")))
            last = min(last, first + 5_000)
            self._learn(words[first:last], raw[first:last])
            first = last

    def _learn(self, words: list[str | bytes], raw: list[bytes]) -> None:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        tok = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        wide = len(tok) > _BUDGET  # one piece that cannot be cut, such as a million times the same letter
        if wide:
            self.con.execute(f"SET memory_limit = '{300 + len(tok) * 800 // 1_000_000}MB'")
        self.con.register("symbols", pa.table({"word": word, "pos": pos, "tok": tok}))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ids = self.con.execute(_MERGE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("symbols")
        if wide:
            self.con.execute("SET memory_limit = '300MB'")
        size = np.diff(ids.offsets.to_numpy())
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
        first = len(self.slot)
        for k, w in enumerate(words):
            self.slot[w] = first + k

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words, or pieces of long ones, of all texts, one after another, and how many each text has."""
        if len(self.slot) > MOST_WORDS:
            self.reset()
        points, row = to_codepoints(column)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
        begin = np.flatnonzero(word_starts(points, row))
        found = distinct_words(points, begin)
        if found is None:
            cut = [_WORD.findall(t) if t else [] for t in column.to_pylist()]
            flat = [w for some in cut for w in some]
            each = list(dict.fromkeys(flat))
            place = {w: k for k, w in enumerate(each)}
            which = np.fromiter((place[w] for w in flat), np.int64, len(flat))
            n = np.fromiter(map(len, cut), np.int64, len(cut))
        else:
            first, which = found
            end = np.concatenate([begin[1:], [len(points)]])
            size = (end - begin)[first]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[first], size)
            text = points[at].astype("<u4").tobytes().decode("utf-32-le")
            stop = np.cumsum(size).tolist()
            each = [text[a:b] for a, b in zip([0, *stop], stop, strict=False)]
            n = np.bincount(row[begin], minlength=len(column))
        parts: dict[int, list[bytes]] = {}
        for k, w in enumerate(each):
            if len(w) * 4 > LONG and len(raw := w.encode("utf-8", "surrogatepass")) > LONG:
                parts[k] = self.pieces(raw)
        if not parts:
            self.learn([w for w in each if w not in self.slot])
            known = np.fromiter(map(self.slot.__getitem__, each), np.int64, len(each))
            return known[which], n
        cut = [parts.get(k) or [w] for k, w in enumerate(each)]
        self.learn([w for w in dict.fromkeys(w for some in cut for w in some) if w not in self.slot])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        begins = np.cumsum(size) - size
        known = np.fromiter((self.slot[w] for some in cut for w in some), np.int64, int(size.sum()))
        many = size[which]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins[which], many)
        ends = np.concatenate([[0], np.cumsum(many)])
        return known[at], np.diff(ends[np.concatenate([[0], np.cumsum(n)])])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        word, n = self.words(column)
        size = self.start[word + 1] - self.start[word]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[word], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        stop = ends[np.cumsum(n)] if len(n) else ends[:0]
        return self.flat[at], np.diff(np.concatenate([[0], stop]))

    def count(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        word, n = self.words(column)
        ends = np.concatenate([[0], np.cumsum(self.start[word + 1] - self.start[word])])
        return np.diff(np.concatenate([[0], ends[np.cumsum(n)]]))


_encoders: dict[int, Encoder] = {}


def encoder_of(table: dict[str, np.ndarray]) -> Encoder:
    """The encoder of this process: the words it has met serve its later tasks as well."""
    key = hash((len(table["lhs"]), table["merged"].tobytes()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(table)
    return _encoders[key]


def default_path() -> str:
    return os.path.join(TOKENIZERS, "byte_bpe_50k.json")


def encode(df: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """The token ids of every text: ``ident, ids`` (array of int), without special tokens.

    Null and empty texts give an empty list. Strings of special tokens in a text are
    ordinary text. Texts of any length are encoded whole; repeated rows each give a row;
    other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 2_000):
                part = batch.slice(k, 2_000)
                ids, n = encoder.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [ident, "ids"])

    kind = dict(df.select(ident).dtypes)[ident]
    return df.select(df[ident], df[text].cast("string").alias("__text")).mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def token_counts(df: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """The number of tokens of every text: ``ident, tokens``; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 2_000):
                part = batch.slice(k, 2_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.count(part.column(1)), pa.int64())], [ident, "tokens"])

    kind = dict(df.select(ident).dtypes)[ident]
    return df.select(df[ident], df[text].cast("string").alias("__text")).mapInArrow(run, f"`{ident}` {kind}, tokens bigint")


def decode(df: DataFrame, ident: str, ids: str, path: str | None = None) -> DataFrame:
    """The text of every id list: ``ident, text``; bytes that are no UTF-8 become U+FFFD.

    The tokens of a batch are joined with their bytes and put together by an ordered
    aggregation. A null list gives null, an empty list an empty text; an id that the
    vocabulary lacks adds nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(spellings(vocabulary(path or default_path())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        con.register("given", pa.table({"id": list(shared.value), "hex": [v.hex() for v in shared.value.values()]}))
        con.execute("CREATE TABLE spelled AS SELECT id::INT AS id, hex FROM given")
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())])
            k = 0
            while k < batch.num_rows or k == 0:  # some texts of together as many tokens as fit into the memory
                stop = max(k + 1, int(np.searchsorted(size, size[k] + _BUDGET, "right")) - 1)
                part = batch.slice(k, stop - k)
                lists = part.column(1)
                many = int(size[min(stop, batch.num_rows)] - size[k])
                con.execute(f"SET memory_limit = '{300 + max(0, many - _BUDGET) * 400 // 1_000_000}MB'")
                con.register("rows", pa.table({"row": np.arange(part.num_rows, dtype=np.int32), "ids": lists}))
                got = con.execute(
                    "SELECT r.row AS row, string_agg(s.hex, '' ORDER BY pos) AS hex FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM rows) r JOIN spelled s ON s.id = r.id GROUP BY r.row"
                ).to_arrow_table()
                con.unregister("rows")
                text: list[str | None] = [None if v is None else "" for v in lists.to_pylist()]
                for row, raw in zip(got.column("row").to_pylist(), got.column("hex").to_pylist(), strict=True):
                    text[row] = bytes.fromhex(raw).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], [ident, "text"])
                k = stop

    kind = dict(df.select(ident).dtypes)[ident]
    return df.select(df[ident], df[ids].cast("array<int>").alias("__ids")).mapInArrow(run, f"`{ident}` {kind}, text string")

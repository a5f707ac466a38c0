"""One comparable form for text whose characters only look alike.

The kernel works on whole Arrow columns: the text buffer becomes a numpy array of code
points, lookup tables are gathered, replacements longer than one code point are laid out
with expansion offsets, and combining marks are joined to their base letters by a sorted
pair table. No string method is called per row.

What is changed
    * wide, narrow and font variants (full-width letters, mathematical alphabets,
      presentation-form ligatures) become the plain letters they stand for;
    * format characters (zero width, soft hyphen, byte order mark, bidi controls, tags,
      variation selectors) are dropped;
    * signs that are another sign under a second code point become that sign;
    * every space separator becomes U+0020;
    * base letter + combining mark becomes the composed letter;
    * Greek and Cyrillic letters that look Latin become Latin when they stand in a word
      with Latin letters, or in a word made of such letters only (of two or more, since a
      single Greek letter is a sign of its own).
What is not changed: case, accents, punctuation, spelling, signs that imitate nothing.
Spaces at the ends are trimmed and runs collapsed in the form, but are not reported as a
change.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ѵ": "v", "к": "k", "т": "t", "п": "n",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Greek small letters
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "γ": "y", "η": "n", "τ": "t", "ε": "e",
    # Armenian and phonetic letters
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ɑ": "a", "ɡ": "g",
}

# The tables hold these ranges of code points one after another; all others are kept as they are.
_RANGES = ((0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
_SIZE = sum(b - a for a, b in _RANGES)
_OTHER = 0xFFFF  # no character, so nothing happens to it
_KEEP, _DROP, _SPACE, _REPLACE = 0, 1, 2, 3
_CONTROL_SPACES = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}


def _place(points: np.ndarray) -> np.ndarray:
    """The place of each code point in the tables."""
    out = np.where(points < _RANGES[0][1], points, _OTHER)
    if (out == _OTHER).any():
        base = _RANGES[0][1]
        for a, b in _RANGES[1:]:
            out = np.where((points >= a) & (points < b), points - a + base, out)
            base += b - a
    return out


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over the ranges of code points that matter, made from the Unicode database by rule."""
    action = np.zeros(_SIZE, np.uint8)
    points = np.concatenate([np.arange(a, b, dtype=np.uint32) for a, b in _RANGES])
    single = points.copy()
    kind = np.zeros(_SIZE, np.uint8)  # 0 no word, 1 Latin letter, 2 other letter, 3 mark or digit
    ccc = np.zeros(_SIZE, np.uint8)
    long: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    apart: dict[int, list[int]] = {}
    for at, cp in enumerate(points.tolist()):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        ccc[at] = unicodedata.combining(ch)
        if cat[0] == "L":
            kind[at] = 1 if cp < 0x80 or "LATIN" in unicodedata.name(ch, "") else 2
        elif cat[0] in "MN":
            kind[at] = 3
        deco = unicodedata.decomposition(ch)
        if cat == "Zs" and cp != 0x20:
            action[at] = _SPACE
        elif cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x034F):
            action[at] = _DROP
        elif deco.startswith(("<wide>", "<narrow>", "<font>")) or (0xFB00 <= cp <= 0xFB06):
            to = [ord(c) for c in unicodedata.normalize("NFKC", ch)]
            action[at] = _REPLACE
            if len(to) == 1:
                single[at] = to[0]
            else:
                long[at] = to
        elif deco and deco[0] != "<":
            apart[at] = [ord(c) for c in unicodedata.normalize("NFD", ch)]
            two = [int(x, 16) for x in deco.split()]
            if len(two) == 1:  # one sign under two code points, such as the kelvin sign
                action[at], single[at] = _REPLACE, ord(unicodedata.normalize("NFC", ch))
            elif unicodedata.normalize("NFC", ch) == ch:
                pairs[two[0] << 21 | two[1]] = cp
    length = np.ones(_SIZE, np.int64)
    long_at = np.zeros(_SIZE, np.int64)
    flat: list[int] = []
    for at, to in long.items():
        length[at], long_at[at] = len(to), len(flat)
        flat += to
    length[action == _DROP] = 0
    apart_length, apart_at, apart_flat = np.ones(_SIZE, np.int64), np.zeros(_SIZE, np.int64), []
    for at, to in apart.items():
        apart_length[at], apart_at[at] = len(to), len(apart_flat)
        apart_flat += to
    look = np.zeros(_SIZE, np.uint32)
    for a, b in LOOKALIKES.items():
        look[ord(a)] = ord(b)
    keys = np.array(sorted(pairs), np.int64)
    return {
        "action": action, "single": single, "kind": kind, "ccc": ccc, "length": length, "long_at": long_at,
        "apart_length": apart_length, "apart_at": apart_at, "apart_flat": np.array(apart_flat, np.uint32),
        "flat": np.array(flat or [0], np.uint32), "look": look, "pair_key": keys,
        "pair_to": np.array([pairs[int(k)] for k in keys], np.uint32),
    }


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, one after another, and the row of each; nulls have none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(starts)])[offsets - offsets[0]]
    return points, np.repeat(np.arange(len(column)), np.diff(at))


def from_codepoints(points: np.ndarray, row: np.ndarray, n: int, valid: np.ndarray) -> pa.Array:
    """Rebuild a string column of n rows from code points and the row of each."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), n, [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def canonical(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The common form of every value, and whether more than ordinary spaces had to change.

    Null stays null and counts as unchanged; an empty value stays empty. Values of any
    length are taken whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    valid = np.asarray(pc.is_valid(column))
    t = tables()
    points, row = to_codepoints(column)
    changed = np.zeros(n, bool)
    if not len(points):
        return column.cast(pa.large_string()), changed
    low = _place(points)
    act = t["action"][low]
    touched = act != _KEEP
    if touched.any():
        changed[row[touched]] = True
        size = t["length"][low]
        out = np.where(act == _REPLACE, t["single"][low], np.where(act == _SPACE, 0x20, points)).astype(np.uint32)
        at = np.repeat(np.arange(len(points)), size)
        grown = size[at] > 1
        result = out[at]
        if grown.any():
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            within = np.arange(len(at)) - first[at]
            result[grown] = t["flat"][t["long_at"][low[at[grown]]] + within[grown]]
        points, row = result, row[at]
    points, looks = _lookalikes(points, row, t)
    changed[looks] = True
    points, row, composed = _compose(points, row, t)
    changed[composed] = True
    points, row = _spaces(points, row)
    return from_codepoints(points, row, n, valid), changed


def _compose(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join combining marks to the letter before them, innermost first, until nothing joins."""
    hit: list[np.ndarray] = []
    low = _place(points)
    ccc = t["ccc"][low]
    if not ccc.any():
        return points, row, np.zeros(0, np.int64)
    # a composed letter before a mark comes apart first, so that all marks stand in canonical order
    before = np.concatenate([(ccc[1:] > 0) & (row[1:] == row[:-1]), [False]])
    size = np.where(before, t["apart_length"][low], 1)
    if (size > 1).any():
        at = np.repeat(np.arange(len(points)), size)
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        grown = size[at] > 1
        points, row = points[at], row[at]
        points[grown] = t["apart_flat"][t["apart_at"][low[at[grown]]] + within[grown]]
        ccc = t["ccc"][_place(points)]
    if ((ccc[1:] > 0) & (ccc[:-1] > 0)).any():  # canonical order within each cluster
        cluster = np.cumsum((ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
        order = np.lexsort((np.arange(len(points)), ccc, cluster))
        points, row, ccc = points[order], row[order], ccc[order]
    while True:
        base = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(ccc)), -1))
        mark = np.flatnonzero(ccc > 0)
        mark = mark[(mark > 0) & (base[mark] >= 0)]
        mark = mark[(row[mark] == row[base[mark]]) & ((base[mark] == mark - 1) | (ccc[mark - 1] < ccc[mark]))]
        if not len(mark):
            break
        key = points[base[mark]].astype(np.int64) << 21 | points[mark]
        where = np.minimum(np.searchsorted(t["pair_key"], key), len(t["pair_key"]) - 1)
        joins = t["pair_key"][where] == key
        if not joins.any():
            break
        mark, where = mark[joins], where[joins]
        _, first = np.unique(base[mark], return_index=True)  # one mark for each letter and turn
        mark, where = mark[first], where[first]
        points = points.copy()
        points[base[mark]] = t["pair_to"][where]
        hit.append(row[mark])
        keep = np.ones(len(points), bool)
        keep[mark] = False
        points, row, ccc = points[keep], row[keep], ccc[keep]
    return points, row, np.concatenate(hit) if hit else np.zeros(0, np.int64)


def _lookalikes(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    low = _place(points)
    to = t["look"][low]
    if not to.any():
        return points, np.zeros(0, np.int64)
    kind = t["kind"][low]
    in_word = (kind > 0) | (points == 0x2019) | (points == 0x27)
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (in_word[1:] != in_word[:-1])])
    word = np.cumsum(fresh) - 1
    n = int(word[-1]) + 1
    latin = np.bincount(word, weights=(kind == 1) & (to == 0), minlength=n)
    strange = np.bincount(word, weights=(kind == 2) & (to == 0), minlength=n)
    alike = np.bincount(word, weights=to > 0, minlength=n)
    cyrillic = (points >= 0x400) & (points < 0x530)
    swap = (to > 0) & ((latin > 0) | (strange == 0) & (alike > 1))[word] | (to > 0) & cyrillic & (strange == 0)[word]
    out = np.where(swap, to, points).astype(np.uint32)
    return out, row[swap]


def _spaces(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trim and collapse spaces."""
    blank = (points == 0x20) | np.isin(points, list(_CONTROL_SPACES))
    before = np.concatenate([[True], blank[:-1] | (row[1:] != row[:-1])])
    keep = ~(blank & before)
    points, row = np.where(blank, 0x20, points).astype(np.uint32)[keep], row[keep]
    if not len(points):
        return points, row
    last = np.concatenate([row[1:] != row[:-1], [True]]) & (points == 0x20)
    return points[~last], row[~last]

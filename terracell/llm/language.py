"""Languages of texts and of their stretches, by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1. A trigram is its three letter vectors, turned
by two, one and no places, bound by multiplication; a text or a language is the sum (bundle)
of its trigram vectors, and a text is compared with a language by the cosine of their
bundles. The cosine is linear in the text's bundle, so the products of all trigram vectors
with all language prototypes are computed once, as one matrix product, and a text's
products are gathered from that table and added up; the result is the same.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.checkpoint import cut
from terracell.functions.textform import to_codepoints

DIMENSIONS = 8192
SAMPLE_DOCUMENTS = 4_000
UNIT_LETTERS = 70
SWITCH_SENTENCE, SWITCH_WITHIN = 3.0, 8.0
LEAST_LETTERS, LEAST_CONFIDENCE = 12, 0.9

# Notations of a language in labels, in small letters.
NOTATIONS = {
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francese", "francés", "frans", "francês"),
    "en": ("en", "eng", "english", "anglais", "englisch", "inglese", "inglés", "engels", "inglês"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "tedesco", "alemán", "duits", "alemão"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch", "italiaans"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch", "spagnolo", "spaans", "espanhol"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portoghese", "portugués", "portugees"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "néerlandais", "hollandais", "niederländisch", "olandese", "neerlandés", "holandês"),
}
LANGUAGES = tuple(NOTATIONS)
# The accented letters of these languages.
ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõœßùúûüÿ"
SYMBOLS = 64


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, in whatever notation; null where it names none."""
    text = F.lower(F.trim(label))
    main = F.regexp_extract(text, r"^(\p{L}+)([-_ ]\p{L}+)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(text.isin(*names) | main.isin(*names), code).otherwise(out)
    return out


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter, 1 to 26, accented letters, one for all other letters."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x80, 0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = SYMBOLS - 1
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED, 1):
        table[ord(c)] = k
        if len(c.upper()) == 1:
            table[ord(c.upper())] = k
    return table


def trigram_codes(points: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of many texts at once, and the text of each; runs of non-letters are one blank."""
    symbol = _symbols()[points]
    letter = symbol > 0
    fresh = np.concatenate([[True], part[1:] != part[:-1]])
    keep = letter | (np.concatenate([[False], letter[:-1]]) & ~fresh)
    symbol, part = symbol[keep].astype(np.int64), part[keep]
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    whole = part[:-2] == part[2:]
    return code[whole], part[:-2][whole]


@functools.cache
def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20240229).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))


def products(counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For every trigram, the cosine-like product with each language's prototype.

    ``counts`` (trigrams, languages). Counts are damped and made relative to the mean of
    the languages, so that what all languages share says nothing. The vector of a trigram
    (a, b, c) is turn(turn(a)) * turn(b) * c, so bundles and products go by pairs (a, b).
    """
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1)
    seen = counts.sum(1) > 0
    weight = np.log1p(share * 20_000)
    weight = np.where(seen[:, None], weight - weight.mean(1, keepdims=True), 0.0).astype(np.float32)
    letter = letter_vectors(dimensions)
    turned, twice = np.roll(letter, 1, 1), np.roll(letter, 2, 1)
    cube = weight.reshape(SYMBOLS, SYMBOLS, SYMBOLS, -1)
    n = counts.shape[1]
    prototype = np.zeros((n, dimensions), np.float32)
    for a in range(SYMBOLS):  # one first letter at a time, so that no more than its pairs are held
        if np.any(cube[a]):
            pair = twice[a] * turned
            for lang in range(n):  # bundle: sum over (a, b, c) of weight * pair(a, b) * c
                prototype[lang] += np.einsum("pd,pd->d", pair, cube[a, :, :, lang] @ letter)
    prototype /= np.maximum(np.linalg.norm(prototype, axis=1, keepdims=True), 1e-9)
    towards = (letter[None, :, :] * prototype[:, None, :]).reshape(n * SYMBOLS, dimensions).T
    out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS, n), np.float32)
    for a in range(SYMBOLS):
        some = (twice[a] * turned) @ towards
        out[a] = some.reshape(SYMBOLS, n, SYMBOLS).transpose(0, 2, 1)
    return out.reshape(-1, n) / np.float32(np.sqrt(dimensions))


def unit_bounds(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and whether a sentence or line begins there.

    Longer sentences, and texts without stops, are cut at words into parts of about
    UNIT_LETTERS characters.
    """
    n = len(points)
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    blank = np.isin(points, (0x20, 0x09, 0x0A, 0x0D, 0xA0))
    line = np.isin(points, (0x0A, 0x0D))
    stop = np.isin(points, [ord(c) for c in ".!?…;/|"])
    start = fresh.copy()
    start[1:] |= line[:-1] & ~line[1:]
    ends = np.flatnonzero(blank & np.concatenate([[False], stop[:-1]]))
    ends = ends[ends + 1 < n]
    start[ends + 1] = True
    begin = np.flatnonzero(start)
    size = np.diff(np.concatenate([begin, [n]]))
    parts = np.where(size > 2 * UNIT_LETTERS, size // UNIT_LETTERS, 1)
    owner = np.repeat(np.arange(len(begin)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    want = begin[owner] + (size[owner] * k) // parts[owner]
    next_blank = np.minimum.accumulate(np.where(blank, np.arange(n), n)[::-1])[::-1]
    want = np.where(k > 0, next_blank[want] + 1, want)
    at = np.unique(want[(want < (begin + size)[owner]) | (k == 0)])
    return at, start[at]


class Units:
    """The units of many texts at once, with their trigrams."""

    def __init__(self, column: pa.Array) -> None:
        self.points, self.row = to_codepoints(column)
        if not len(self.points):
            self.begin = self.letters = self.code = self.whose = self.of = np.zeros(0, np.int64)
            self.sentence = np.zeros(0, bool)
            return
        self.begin, self.sentence = unit_bounds(self.points, self.row)
        part = np.repeat(np.arange(len(self.begin)), np.diff(np.concatenate([self.begin, [len(self.points)]])))
        self.letters = np.bincount(part, weights=_symbols()[self.points] > 0, minlength=len(self.begin)).astype(np.int64)
        self.code, self.whose = trigram_codes(self.points, part)
        self.of = self.row[self.begin]

    def evidence(self, table: np.ndarray) -> np.ndarray:
        some = table[self.code]
        return np.stack([np.bincount(self.whose, weights=some[:, k], minlength=len(self.begin)) for k in range(table.shape[1])], 1)


def best_path(evidence: np.ndarray, of: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The language of each unit, where a change costs SWITCH_SENTENCE at a sentence and SWITCH_WITHIN elsewhere.

    A Viterbi search through the units of each text; texts whose units all say the same need none.
    """
    label = evidence.argmax(1)
    if not len(label):
        return label
    first = np.concatenate([[True], of[1:] != of[:-1]])
    begin = np.flatnonzero(first)
    end = np.concatenate([begin[1:], [len(of)]])
    mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
    for a, b in zip(begin[mixed].tolist(), end[mixed].tolist(), strict=True):
        some = evidence[a:b].tolist()
        langs = range(len(some[0]))
        best, back = some[0][:], []
        for i in range(1, b - a):
            top = max(langs, key=best.__getitem__)
            change = best[top] - (SWITCH_SENTENCE if sentence[a + i] else SWITCH_WITHIN)
            back.append([k if best[k] >= change else top for k in langs])
            best = [max(best[k], change) + some[i][k] for k in langs]
        k = max(langs, key=best.__getitem__)
        for i in range(b - a - 1, -1, -1):
            label[a + i] = k
            if i:
                k = back[i - 1][k]
    return label


def training_sample(df: DataFrame, ident: str, text: str, label: str, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``text, named``: about ``documents`` labelled texts, those of least hash of their id; a bounded, fixed sample.

    The labelled texts are counted; then the hash of the last one is found among the hashes
    under a limit that lets about half as many again through. Texts stay in the executors.
    """
    named = F.array_position(F.array(*map(F.lit, LANGUAGES)), named_language(df[label])).cast("int") - 1
    rows = df.select(F.xxhash64(df[ident]).alias("turn"), df[text].cast("string").alias("text"), named.alias("named"))
    rows = rows.where(F.col("named").isNotNull() & (F.length("text") > 0))
    share = min(1.0, (1.5 * documents + 500) / max(1, rows.count()))
    if share < 1.0:
        rows = rows.where(F.col("turn") < int(-(2**63) + share * 2**64))
    last = rows.select("turn").orderBy("turn").limit(documents).agg(F.max("turn")).first()[0]
    context = df.sparkSession.sparkContext
    return cut(rows.where(F.col("turn") <= F.lit(last).cast("long")).select("text", "named").repartition(2 * context.defaultParallelism))


def _over_units(sample: DataFrame, fields: str, work):
    """Runs ``work(units, named of each unit)`` over some texts at a time; it gives columns for ``fields``."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                units = Units(part.column(0))
                if len(units.code):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(units, part.column(1).to_numpy()[units.of])], names)

    return sample.mapInArrow(run, fields)


def train(sample: DataFrame, rounds: int = 3) -> np.ndarray:
    """The product table, scaled to nats, from labelled texts of which some are wrong or mixed.

    The first prototypes believe the labels; then each unit is taken for the language that
    the best path through its text gives it, and the prototypes are bundled again. The
    table is scaled so that a trigram is worth a quarter of a nat at the median margin. The
    executors count trigrams by language and find the median; the driver holds the table.
    """
    n, context = len(LANGUAGES), sample.sparkSession.sparkContext
    shared = None
    table = np.zeros((SYMBOLS**3, n), np.float32)
    for _ in range(rounds):
        believed = shared

        def counted(units: Units, named: np.ndarray, believed=believed) -> list:
            label = named if believed is None else best_path(units.evidence(believed.value), units.of, units.sentence)
            slot, many = np.unique(units.code * n + label[units.whose], return_counts=True)
            return [slot, many]

        rows = _over_units(sample, "slot bigint, many bigint", counted).groupBy("slot").agg(F.sum("many").alias("many")).toArrow()
        if not rows.num_rows:
            return table
        counts = np.zeros(SYMBOLS**3 * n)
        counts[rows.column("slot").to_numpy()] = rows.column("many").to_numpy()
        table = products(counts.reshape(-1, n))
        bundled = context.broadcast(table)

        def margins(units: Units, named: np.ndarray, bundled=bundled) -> list:
            size = np.bincount(units.whose, minlength=len(units.begin))
            ranked = np.sort(units.evidence(bundled.value)[size >= 15], 1)
            return [(ranked[:, -1] - ranked[:, -2]) / size[size >= 15]]

        median = _over_units(sample, "margin double", margins).agg(F.median("margin")).first()[0]
        table *= 0.25 / max(0.25 if median is None else median, 1e-6)
        shared = context.broadcast(table)
    return table


_SEGMENT = "segment int, begins bigint, characters bigint, letters bigint, sentences int, lang string, confidence double"


def segments(df: DataFrame, ident: str, text: str, label: str, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The stretches of one language of every text.

    ``ident, segment, begins, characters, letters, sentences, lang, confidence``: stretches
    are counted from 0 and lie one after another through the whole text; ``sentences`` is
    the number of sentences (or lines) that begin in them. ``confidence`` is the share of
    the language under a softmax of the evidence of all trigrams of the stretch: short
    stretches have a language too, and a low confidence. Only a stretch without a trigram of
    letters that the profiles know has language null and confidence 0. Null and empty texts
    have no stretch. The profiles are trained
    on a bounded sample of the labelled rows (``documents``); every text is read whole, and
    its own label plays no part. Without any labelled text all languages are null.
    """
    shared = df.sparkSession.sparkContext.broadcast(train(training_sample(df, ident, text, label, documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                units = Units(part.column(1))
                if not len(units.begin):
                    continue
                evidence = units.evidence(table)
                lang = best_path(evidence, units.of, units.sentence)
                fresh = np.flatnonzero(np.concatenate([[True], (units.of[1:] != units.of[:-1]) | (lang[1:] != lang[:-1])]))
                total = np.add.reduceat(evidence, fresh)
                letters = np.add.reduceat(units.letters, fresh)
                sentences = np.add.reduceat(units.sentence.astype(np.int64), fresh)
                begins = units.begin[fresh]
                size = np.diff(np.concatenate([begins, [len(units.points)]]))
                of = units.of[fresh]
                first_of = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                many = np.diff(np.concatenate([first_of, [len(of)]]))
                number = np.arange(len(of)) - np.repeat(first_of, many)
                text_begin = np.repeat(begins[first_of], many)
                shifted = np.exp(total - total.max(1, keepdims=True))
                sure = shifted[np.arange(len(fresh)), lang[fresh]] / shifted.sum(1)
                known = np.abs(total).sum(1) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of)),
                        pa.array(number.astype(np.int32)),
                        pa.array(begins - text_begin),
                        pa.array(size),
                        pa.array(letters),
                        pa.array(sentences.astype(np.int32)),
                        pa.array([LANGUAGES[x] if k else None for x, k in zip(lang[fresh].tolist(), known.tolist(), strict=True)], pa.string()),
                        pa.array(np.where(known, sure, 0.0)),
                    ],
                    [ident, *(c.split()[0] for c in _SEGMENT.split(", "))],
                )

    kind = dict(df.select(ident).dtypes)[ident]
    return df.select(df[ident], df[text].cast("string").alias("__text")).mapInArrow(run, f"`{ident}` {kind}, {_SEGMENT}")


def document_languages(df: DataFrame, found: DataFrame, ident: str) -> DataFrame:
    """The main language of each text (most letters) and all that it has: ``ident, lang_main, confidence, languages``.

    One row for every row of ``df``; a text that is null, empty or without letters has no
    main language, confidence 0 and an empty list. A language is listed if a stretch of it
    holds the beginning of a sentence and at least LEAST_LETTERS letters, and reaches
    LEAST_CONFIDENCE.
    """
    sure = (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("sentences") >= 1) & (F.col("letters") >= LEAST_LETTERS)
    each = found.where("lang is not null").groupBy(ident, "lang").agg(
        F.sum("letters").alias("letters"), F.max("confidence").alias("confidence"), F.max(sure).alias("sure")
    )
    known = each.groupBy(ident).agg(
        F.max_by("lang", F.struct("letters", "lang")).alias("lang_main"),
        F.max_by("confidence", F.struct("letters", "lang")).alias("confidence"),
        F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("lang")))).alias("languages"),
    )
    none = F.array().cast("array<string>")
    return df.select(df[ident]).join(known, ident, "left").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "languages": F.coalesce("languages", none)})

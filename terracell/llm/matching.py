"""Map free-entered values to the entries of a canonical list."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.textform import canonical

# Weights of the n-grams and of what the list does not know, and the decision limits.
BIGRAM, TRIGRAM, SKIPGRAM = 0.6, 0.7, 0.45
UNKNOWN_GRAM = 0.35
FLOOR, ACCEPT, MARGIN = 0.25, 0.495, 0.02
BLOCK = 200_000  # entries that are compared with all values at a time

_PARTS = regex.compile(r"\s+[-–—/|©]\s+|[(\[].*|[,;:]|\s§.*")
_BLANK = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(values: list[str]) -> list[str]:
    """Letters and digits of all scripts, in small letters without accents, words parted by one space."""
    forms = canonical(pa.array(values, pa.string()))[0].to_pylist()
    out = []
    for form in forms:
        text = unicodedata.normalize("NFKD", (form or "").casefold().replace("œ", "oe").replace("æ", "ae"))
        out.append(_BLANK.sub(" ", "".join(c for c in text if not unicodedata.combining(c) and c != "�")).strip())
    return out


def grams(text: str) -> dict[str, float]:
    """Character n-grams within words: pairs, triples, and pairs with one letter between."""
    out: dict[str, float] = defaultdict(float)
    for word in text.split():
        x = f"^{word}$"
        for k in range(len(x) - 1):
            out[x[k : k + 2]] += BIGRAM
        for k in range(len(x) - 2):
            out[x[k : k + 3]] += TRIGRAM
            out[x[k] + "_" + x[k + 2]] += SKIPGRAM
    return out


def edits(a: str, b: str) -> int:
    """Edit distance with exchanges of neighbours."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


@functools.lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The letters of a word as bits; two letters may share one."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


class Index:
    """The n-gram inverted index of one list, with the words of its entries.

    ``counted``: the numbers of entries, and of entries by n-gram and by word, where the
    entries are only a block of the list; by default they are counted here.
    """

    def __init__(self, entries: list[tuple[int, str]], counted: tuple[int, dict[str, int], dict[str, int]] | None = None) -> None:
        self.ids = [i for i, _ in entries]
        self.text = normalise([t for _, t in entries])
        vectors = [grams(t) for t in self.text]
        n, df, words = counted or (len(entries), Counter(g for v in vectors for g in v), Counter(w for t in self.text for w in set(t.split())))
        n = max(1, n)
        self.weight = {g: math.log(1 + n / k) for g, k in df.items()}
        self.unknown = UNKNOWN_GRAM * math.log(1 + n)
        norm = [math.sqrt(sum((m * self.weight[g]) ** 2 for g, m in v.items())) or 1.0 for v in vectors]
        posting: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, v in enumerate(vectors):
            for g, m in v.items():
                posting[g].append((k, m * self.weight[g] / norm[k]))
        self.posting = {g: (np.array([k for k, _ in p]), np.array([w for _, w in p])) for g, p in posting.items()}
        self.words = [[(w, math.log(1 + n / words[w]) * min(1.0, len(w) / 4)) for w in t.split()] for t in self.text]
        self.numbers = any(c.isdigit() for t in self.text for c in t)
        self.likeness: dict[tuple[str, str], float] = {}

    def candidates(self, text: str) -> list[tuple[float, int]]:
        """(cosine, entry) of every entry whose cosine reaches FLOOR, the greatest first.

        Only the postings of the n-grams of most weight are opened to find entries: the
        others together are too short a vector to reach FLOOR with any entry of length one.
        """
        mine = sorted(((m * self.weight.get(g, self.unknown), g) for g, m in grams(text).items()), reverse=True)
        size = math.sqrt(sum(w * w for w, _ in mine))
        if not size:
            return []
        rest, opened = size * size, 0
        while opened < len(mine) and rest > (FLOOR * size) ** 2 * 0.999:
            rest -= mine[opened][0] ** 2
            opened += 1
        met = [self.posting[g][0] for _, g in mine[:opened] if g in self.posting]
        if not met:
            return []
        entry = np.unique(np.concatenate(met))
        score = np.zeros(len(entry))
        for w, g in mine:
            if g in self.posting:
                at, theirs = self.posting[g]
                place = np.minimum(np.searchsorted(at, entry), len(at) - 1)
                score += np.where(at[place] == entry, w * theirs[place], 0.0)
        score /= size
        order = np.flatnonzero(score >= FLOOR)
        return sorted(zip(score[order].tolist(), entry[order].tolist(), strict=True), key=lambda x: (-x[0], x[1]))

    def alike(self, word: str, other: str) -> float:
        got = self.likeness.get((word, other))
        if got is None:
            if word == other:
                got = 1.0
            elif other.startswith(word) and len(word) >= 2:
                got = 0.75 + 0.2 * len(word) / len(other)
            else:
                got = max(0.0, 1 - 1.2 * edits(word, other) / max(len(word), len(other)))
            if len(self.likeness) > 500_000:
                self.likeness.clear()
            self.likeness[word, other] = got
        return got

    def aligned(self, words: list[str], entry: int) -> float:
        """How far each word of an entry is met by a word of the value, by weight."""
        total = got = 0.0
        for other, w in self.words[entry]:
            total += w
            if other in words:
                got += w
                continue
            best, bits = 0.0, _letters(other)
            for x in words:
                longest = max(len(x), len(other))
                apart = _letters(x)
                least = max(abs(len(x) - len(other)), (apart & ~bits).bit_count(), (bits & ~apart).bit_count())
                if 1 - 1.2 * least / longest > best or other.startswith(x):  # else the distance is too long to matter
                    best = max(best, self.alike(x, other))
            got += w * best
        return got / total if total else 0.0

    def best(self, parts: list[str]) -> list[tuple[int, float]]:
        """The two best (id, score), of different ids, over the parts of a value; none below FLOOR."""
        scores: dict[int, float] = {}
        second = 0.0
        for part in dict.fromkeys(parts):
            words = part.split()
            if not self.numbers:  # numbers say nothing where the list has none
                words = [w for w in words if not w.isdigit()]
                part = " ".join(words)
            for cosine, k in self.candidates(part):
                if (cosine + 1) / 2 < second:
                    break
                s = (cosine + self.aligned(words, k)) / 2
                if s > scores.get(self.ids[k], 0.0):
                    scores[self.ids[k]] = s
                    second = sorted(scores.values())[-2] if len(scores) > 1 else 0.0
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]


def entry_table(labels: DataFrame) -> DataFrame:
    """The labels and aliases of each field: ``field, ref_id, entry``; nulls and blanks left out."""
    names = F.array_union(F.array("label"), F.coalesce(F.split("aliases", "[|]"), F.array().cast("array<string>")))
    each = labels.where("label is not null").select("field", F.col("ref_id").cast("int").alias("ref_id"), F.explode(names).alias("entry"))
    return each.where(F.length(F.trim("entry")) > 0)


def _token_counts(entries: DataFrame) -> DataFrame:
    """How many entries of a field hold each n-gram and each word: ``field, kind, token, n``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some: Counter = Counter()
            for field, text in zip(batch["field"], normalise(list(batch["entry"])), strict=True):
                some.update((field, "g", g) for g in grams(text))
                some.update((field, "w", w) for w in set(text.split()))
            yield pd.DataFrame([(*k, n) for k, n in some.items()], columns=["field", "kind", "token", "n"])

    return entries.mapInPandas(run, "field string, kind string, token string, n long").groupBy("field", "kind", "token").agg(F.sum("n").alias("n"))


def blocks(labels: DataFrame) -> Iterator[dict[str, tuple[list[tuple[int, str]], tuple | None]]]:
    """The lists in blocks of about BLOCK entries: for each field its entries and the counts over its whole list.

    All entries of one id are in one block. A list that is one block is counted where it is
    indexed; for a longer one the n-grams and words are counted over the whole list first.
    """
    entries = entry_table(labels)
    sizes = {r["field"]: r["n"] for r in entries.groupBy("field").agg(F.count("*").alias("n")).collect()}
    parts = max(1, math.ceil(sum(sizes.values()) / BLOCK))
    counts = _token_counts(entries) if parts > 1 else None
    for k in range(parts):
        some = entries.where(F.pmod(F.xxhash64("field", "ref_id"), F.lit(parts)) == k) if parts > 1 else entries
        found: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for r in sorted(some.collect(), key=lambda r: (r.ref_id, r.entry)):
            found[r.field].append((r.ref_id, r.entry))
        if counts is None:
            yield {f: (e, None) for f, e in found.items()}
            continue
        here = _token_counts(some).where("kind = 'w'").select("field", "kind", "token")
        counted: dict[str, tuple] = {f: (sizes[f], {}, {}) for f in found}
        # n-grams of the whole list, bounded by the alphabet, since values are weighed by them; words of the block alone
        for r in counts.where("kind = 'g'").unionByName(counts.join(here, ["field", "kind", "token"]).select(counts.columns)).collect():
            if r.field in counted:
                counted[r.field][1 if r.kind == "g" else 2][r.token] = r.n
        yield {f: (e, counted[f]) for f, e in found.items()}


_indexes: dict[tuple, dict[str, Index]] = {}


def _index_of(ident: int, lists: dict[str, tuple]) -> dict[str, Index]:
    """The indexes of a broadcast block, built once a process."""
    key = ident, tuple((f, len(e), hash(tuple(e))) for f, (e, _) in sorted(lists.items()))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = {f: Index(e, counted) for f, (e, counted) in lists.items()}
    return _indexes[key]


def match_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """The entry that each distinct value means: ``field, value, ref_id, score, runner_up``.

    ``values`` has ``field, value, text``: the value and the text to compare (the value, or
    its repaired form). The whole text and its parts between separators are scored against
    the entries whose n-grams they share, by the mean of the weighted cosine and of the
    word alignment; the best entry is taken if it reaches ACCEPT and is MARGIN above the
    next, else ``ref_id`` is 0. Ties therefore give 0. Null or blank texts and fields
    without entries give 0; texts of any length are compared whole. Letters and digits of
    all scripts count, but words of digits only where the list has digits itself.

    Lists of any length: every block of at most about BLOCK entries is broadcast and
    compared with all values, and the two best of all blocks decide. Values are spread over
    tasks by number, since the work is in the comparing and not in the bytes.
    """
    context = values.sparkSession.sparkContext
    spread = values.select("field", "value", "text").repartition(2 * context.defaultParallelism, "field", "value")
    found = None
    for number, lists in enumerate(blocks(labels)):
        best = spread.mapInPandas(_compare(context.broadcast(lists), number), "field string, value string, ref_id int, score double, runner_up double, other int")
        found = best if found is None else found.unionByName(best)
    if number:
        pair = F.array(F.struct("score", (-F.col("ref_id")).alias("r")), F.struct(F.col("runner_up").alias("score"), (-F.col("other")).alias("r")))
        top = F.sort_array(F.flatten(F.collect_list(pair)), asc=False)
        first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
        found = found.groupBy("field", "value").agg(top.alias("top")).select("field", "value", (-first["r"]).alias("ref_id"), first["score"].alias("score"), second["score"].alias("runner_up"))
    sure = (F.col("score") >= ACCEPT) & (F.col("score") - F.col("runner_up") >= MARGIN)
    return found.select("field", "value", F.when(sure, F.col("ref_id")).otherwise(0).alias("ref_id"), "score", "runner_up")


def _compare(shared, number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index_of(number, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            pieces = [[t, *(p for p in _PARTS.split(t) if p and len(p.strip()) >= 3)] for t in texts]
            flat = normalise([p for some in pieces for p in some])
            at, found = 0, []
            for f, some in zip(batch["field"], pieces, strict=True):
                parts = [p for p in flat[at : at + len(some)] if p]
                at += len(some)
                top = index[f].best(parts) if f in index and parts else []
                (ref, score), (other, second) = (top + [(0, 0.0), (0, 0.0)])[:2]
                found.append((ref, score, second, other))
            ref, score, second, other = zip(*found, strict=True) if found else ((),) * 4
            yield pd.DataFrame({"field": batch["field"], "value": batch["value"], "ref_id": ref, "score": score, "runner_up": second, "other": other})

    return run

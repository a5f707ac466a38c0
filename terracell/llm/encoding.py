"""Text read in a wrong character encoding: find it, and restore it where possible.

Noisy channel. The unit is a span: a stretch of a value between ordinary spaces that holds
more than ASCII. Every span becomes a lattice of bytes: an edge leads over one or more
characters and stands for what they may have been,

* the character itself,
* the character of a UTF-8 sequence whose bytes the characters are in some single-byte
  encoding (again after a second wrong reading, and after a change of case),
* the character that the same byte is in another single-byte encoding,
* a wildcard over the accented letters of the corpus, for a byte that was lost (U+FFFD, or
  a lead byte without its continuation).

The source is the corpus itself: its words by their frequency over all records, and a
character trigram model of them for words that it does not hold. A Viterbi search finds the
cheapest ways through the lattice, the words on them are looked up by a join, and the
cheapest way wins; the span is damaged if that is not the span itself.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.terms import term_counts

PAGES = ("cp1252", "mac_roman", "cp850", "cp437")
BEAM, KEPT = 24, 12
MOST_GRAMS = 2_000_000
_SIGNS = "–—‘’“”„‚…•€™œŒŠšŽžŸ‹›†‡‰ˆ˜ƒ−"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LETTER = regex.compile(r"\p{L}")
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"

# Costs in nats. Chosen once, on the channel's strength of evidence.
COST_UTF8, COST_CASED, COST_PAGE, COST_PAGE_CASED, COST_PAGE_AGAIN, COST_WILDCARD, COST_LOST = 0.5, 1.0, 3.0, 6.0, 0.5, 3.0, 4.0
KEEP_UTF8, KEEP_CASED, KEEP_BROKEN, KEEP_ENDING = 14.0, 7.0, 14.0, 5.0
COST_CASE, COST_UNKNOWN_WORD, COST_STRANGE_SIGN = 2.5, 3.0, 5.0


@functools.cache
def bytes_of() -> dict[str, dict[str, int]]:
    """For each encoding the byte of a character; the Windows page lets undefined bytes through."""
    out: dict[str, dict[str, int]] = {}
    for page in PAGES:
        table: dict[str, int] = {}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                pass
            if page == "cp1252":
                table.setdefault(chr(b), b)
        out[page] = table
    return out


def _plausible(ch: str) -> bool:
    """What a text can hold: Latin letters with accents, Greek letters, usual signs."""
    o = ord(ch)
    return 0xA0 <= o < 0x180 or ch in _SIGNS or 0x391 <= o <= 0x3C9 or ch == "�"


@functools.lru_cache(1 << 16)
def utf8_edges(text: str, cased: bool = False) -> tuple[tuple[int, str], ...]:
    """(length, character) of every UTF-8 sequence that the characters at the start spell.

    ``cased``: the text may have been put in capitals or small letters after it was misread.
    """
    found = []
    for page in PAGES:
        table = bytes_of()[page]

        def byte(ch: str, table: dict[str, int] = table) -> list[int]:
            forms = dict.fromkeys((ch, ch.upper(), ch.lower())) if cased else (ch,)
            return [table[f] for f in forms if f in table]

        for lead in byte(text[0]):
            n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 0
            if not n or len(text) < n:
                continue
            rest = [[b for b in byte(ch) if 0x80 <= b <= 0xBF] for ch in text[1:n]]
            for second in rest[0]:
                for third in rest[1] if n == 3 else [None]:
                    try:
                        ch = bytes([lead, second] + ([] if third is None else [third])).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if _plausible(ch):
                        found.append((n, ch))
    return tuple(dict.fromkeys(found))


@functools.lru_cache(1 << 16)
def lost_edges(text: str) -> tuple[int, ...]:
    """Lengths of the starts of a UTF-8 sequence whose last byte is gone."""
    found = []
    for lead in dict.fromkeys((text[0], text[0].upper())):
        b = bytes_of()["cp1252"].get(lead)
        if b in (0xC3, 0xC5):
            found.append(1)
        if b == 0xE2 and len(text) > 1 and bytes_of()["cp1252"].get(text[1]) == 0x80:
            found.append(2)
    return tuple(dict.fromkeys(found))


@functools.lru_cache(1 << 12)
def page_edges(ch: str) -> tuple[tuple[str, float], ...]:
    """(character, cost): what the byte of a character is when one of the two encodings is the Windows page."""
    out: dict[str, float] = {}
    for form in dict.fromkeys((ch, ch.upper() if len(ch.upper()) == 1 else ch)):
        for read in PAGES:
            b = bytes_of()[read].get(form)
            if b is None or 0x80 <= ord(form) < 0xA0:
                continue
            for written in PAGES[1:3] if read == "cp1252" else PAGES[:1]:
                try:
                    to = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    continue
                if to != ch and (_LETTER.match(to) and 0xC0 <= ord(to) < 0x180 or "─" <= ch <= "▟" and 0xA0 <= ord(to) < 0x180):
                    out.setdefault(to, COST_PAGE if form == ch else COST_PAGE_CASED)
                    if form != ch:
                        out.setdefault(to.lower(), COST_PAGE_CASED)
    return tuple(out.items())


class CharModel:
    """Character trigrams of the corpus words, in small letters, with back-off."""

    def __init__(self, grams: dict[str, float]) -> None:
        self.grams = grams
        self.before: dict[str, float] = defaultdict(float)
        self.single: dict[str, float] = defaultdict(float)
        for g, n in grams.items():
            self.before[g[:2]] += n
            self.single[g[2]] += n
        self.total = sum(self.single.values()) or 1.0
        some = [(n, c) for c, n in self.single.items() if 0xC0 <= ord(c) < 0x180]  # rare ones too: the costs decide
        self.letters = [c for _, c in sorted(some, reverse=True)]
        self.capitals = [c.upper() for c in self.letters if len(c.upper()) == 1 and c.upper() > "\x7f" and c.upper() != c]
        self.usual = {*self.letters, *self.capitals}
        self.rare = {f for n, c in some if n <= 1e-4 * self.total for f in (c, c.upper())}
        self.beam = max(BEAM, 2 * (len(self.usual) + 2))
        self.cache: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        got = self.cache.get(gram)
        if got is None:
            base = (self.single.get(gram[2], 0.0) + 0.01) / (self.total + 3.0)
            got = -math.log((self.grams.get(gram, 0.0) + 2.0 * base) / (self.before.get(gram[:2], 0.0) + 2.0))
            self.cache[gram] = got
        return got

    def word(self, word: str) -> float:
        text = f"^^{word}$"
        return sum(self.cost(text[k : k + 3]) for k in range(len(text) - 2))


def trigrams(word: str) -> list[str]:
    text = f"^^{word}$"
    return [text[k : k + 3] for k in range(len(text) - 2)]


def edges(text: str, at: int, model: CharModel) -> list[tuple[int, str, float]]:
    """(length, reading, cost) of the edges that leave a position of the lattice."""
    ch = text[at]
    if ch < "\x80":
        return [(1, ch, 0.0)]
    both = [(c, 0.0) for c in model.letters] + [(c, 1.0) for c in model.capitals]
    if ch == "�":  # one sign may stand for all bytes of a character, or each byte has its own
        return [(n, c, COST_WILDCARD + p) for n in (1, 2, 3) if text[at : at + n] == ch * n for c, p in [*both, ("–", 2.0), ("°", 2.0)]]
    some = text[at : at + 3]
    exact = utf8_edges(some)
    cased = [e for e in utf8_edges(some, True) if e not in exact]
    lost = lost_edges(some)
    after = text[at + 1 : at + 2]
    keep = KEEP_BROKEN if ch <= "\x9f" else KEEP_UTF8 if exact else KEEP_CASED if cased else 0.0
    if not keep and lost and not _LETTER.match(after or " ") and (ch.isupper() or at == 0):
        keep = KEEP_ENDING
    out = [(1, ch, keep)]
    out += [(n, c, COST_UTF8) for n, c in exact]
    out += [(n, c, COST_CASED) for n, c in cased]
    out += [(n, c, COST_LOST + p) for n in lost for c, p in both]
    out += [(1, c, p) for c, p in page_edges(ch) if c in model.usual or not _LETTER.match(c)]
    return out


def worth_reading(span: str, model: CharModel) -> bool:
    """Whether any other reading of a span could win."""
    padded = "^^" + span.lower() + "$$"
    for k, ch in enumerate(span):
        if ch < "\x80":
            continue
        if ch == "�" or ch <= "\x9f":
            return True
        some = span[k : k + 3]
        if utf8_edges(some) or utf8_edges(some, True) or lost_edges(some):
            return True
        left, right = padded[k : k + 2], padded[k + 3 : k + 5]

        def local(c: str, left: str = left, right: str = right) -> float:
            text = left + c.lower() + right
            return sum(model.cost(text[j : j + 3]) for j in range(3))

        own = local(ch)
        if "─" <= ch <= "▟" or any(c in model.usual and own - local(c) > 1.0 for c, _ in page_edges(ch)):
            return True
    return False


def _spells_utf8(text: str) -> bool:
    return any(c > "\x7f" and bool(utf8_edges(text[k : k + 3])) for k, c in enumerate(text))


def readings(span: str, model: CharModel, rounds: int = 3) -> dict[str, float]:
    """Viterbi search: the cheapest readings of a span, with what the channel asks for them.

    A state is all that the cost of what follows depends on: the last two characters, the
    case of the last, whether another encoding has been paid for, and whether a rare letter
    was read. Ways that meet in a state are merged, and each state keeps the KEPT cheapest;
    of all states of a position the BEAM cheapest ways go on, or twice as many as there are
    accented letters, so no letter of a single wildcard falls out. The KEPT cheapest readings
    come out with usual letters only, and as many with rare ones. Readings that still spell
    UTF-8 sequences are read again.
    """
    best: dict[str, float] = {span: 0.0}
    fresh = {span: 0.0}
    for turn in range(rounds):
        grown: dict[str, float] = {}
        for text, cost in fresh.items():
            # front[at][state][reading so far] = (cost of the channel, cost of the characters)
            front: list[dict[tuple, dict[str, tuple[float, float]]]] = [defaultdict(dict) for _ in range(len(text) + 3)]
            front[0]["", False, False, False][""] = (0.0, 0.0)
            for at in range(len(text)):
                merged = [(sum(step), state, now, step) for state, some in front[at].items() for now, step in sorted(some.items(), key=lambda x: sum(x[1]))[:KEPT]]
                here: dict[tuple, list] = defaultdict(list)
                for _, state, now, step in sorted(merged)[: model.beam]:
                    here[state].append((now, step))
                front[at] = {}
                ways = edges(text, at, model) if here else []
                for (tail, low, paged, odd), kept in here.items():
                    for n, to, price in ways:
                        asked = COST_PAGE_AGAIN if paged and price in (COST_PAGE, COST_PAGE_CASED) else price
                        asked += COST_CASE if low and to > "\x7f" and to.isupper() else 0.0
                        gram = ("^^" + tail + to.lower())[-3:]
                        spelled = model.cost(gram)
                        goal = front[at + n][gram[1:].replace("^", ""), to.islower(), paged or asked > 0, odd or to in model.rare]
                        for so_far, (channel, source) in kept:
                            now = so_far + to
                            step = (channel + asked, source + spelled)
                            old = goal.get(now)
                            if old is None or step[0] + step[1] < old[0] + old[1]:
                                goal[now] = step
            done: dict[str, tuple[tuple[float, float], bool]] = {}
            for (_, _, _, odd), some in front[len(text)].items():
                for now, step in some.items():  # one reading can end in several states: its cheapest way counts
                    if now not in done or sum(step) < sum(done[now][0]):
                        done[now] = step, odd
            ranked = sorted(done.items(), key=lambda x: sum(x[1][0]))
            # rare letters take no place of the usual ones
            ends = [(now, step) for kind in (False, True) for now, (step, odd) in [e for e in ranked if e[1][1] == kind][:KEPT]]
            for now, (channel, _) in [*ends, *((t, s) for t, (s, _) in done.items() if t == text)]:
                if now == text and turn == 0:
                    best[span] = channel
                elif now != text and cost + channel < grown.get(now, math.inf):
                    grown[now] = cost + channel
        fresh = {}
        for now, cost in grown.items():
            if cost < best.get(now, math.inf):
                best[now] = cost
                if _spells_utf8(now):
                    fresh[now] = cost
        if not fresh:
            break
    for now in best:  # what still spells UTF-8 sequences is hardly an end
        if now != span:
            best[now] += KEEP_UTF8 * sum(c > "\x7f" and bool(utf8_edges(now[k : k + 3])) for k, c in enumerate(now))
    return best


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def signs_cost(reading: str, model: CharModel) -> float:
    """What the characters outside words cost."""
    rest = _WORD.sub("", reading)
    return sum(3 * COST_STRANGE_SIGN if "\x80" <= c <= "\x9f" or c == "�" else COST_STRANGE_SIGN if "─" <= c <= "▟" else 1.0 for c in rest if c > "\x7f")


_models: dict[int, CharModel] = {}


def _model_of(grams: dict[str, float]) -> CharModel:
    """The character model of this process, made once for a broadcast."""
    if id(grams) not in _models:
        _models.clear()
        _models[id(grams)] = CharModel(grams)
    return _models[id(grams)]


def _read_spans(grams) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model_of(grams.value)
        for batch in batches:
            rows = []
            for span in batch["span"]:
                if not worth_reading(span, model):
                    continue
                for reading, channel in readings(span, model).items():
                    base = channel + signs_cost(reading, model)
                    for word in words_of(reading) or [""]:
                        rows.append((span, reading, base, word, model.word(word) + COST_UNKNOWN_WORD if word else 0.0))
            yield pd.DataFrame(rows, columns=["span", "reading", "base", "word", "spelled"])

    return run


def clean_start(value: Column) -> Column:
    """The value without characters that only hide, none of which a single-byte page has."""
    return F.translate(value, INVISIBLE, "")


def span_readings(values: DataFrame, words: DataFrame) -> DataFrame:
    """The best reading of each span that is worth reading: ``span, reading, damaged``.

    ``values``: ``value, n``; ``words``: ``term, occurrences`` of the whole corpus.
    """
    spans = (
        values.select(F.explode(F.array_distinct(F.split(clean_start(F.col("value")), " "))).alias("span"), "n")
        .where(F.col("span").rlike(r"[^\x00-\x7f]"))
        .groupBy("span")
        .agg(F.sum("n").alias("own"))
    )
    counts = words.groupBy("term").agg(F.sum("occurrences").alias("n"))
    spark = values.sparkSession

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some: dict[str, int] = defaultdict(int)
            for term, n in zip(batch["term"], batch["n"], strict=True):
                for g in trigrams(term):
                    some[g] += n
            yield pd.DataFrame({"gram": list(some.keys()), "n": list(some.values())}, columns=["gram", "n"])

    # trigrams of letters: their number is bounded by the alphabet, and checked
    grams = counts.mapInPandas(grams_of, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).limit(MOST_GRAMS + 1).collect()
    if len(grams) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} trigrams of letters")
    total = float(sum(g["n"] for g in grams if g["gram"].startswith("^^"))) or 1.0
    shared = spark.sparkContext.broadcast({g["gram"]: float(g["n"]) for g in grams})
    # few bytes, much work: spread by number, since by size they would all be one task
    read = spans.select("span").repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("span")).mapInPandas(_read_spans(shared), "span string, reading string, base double, word string, spelled double")
    known = read.join(counts.withColumnRenamed("term", "word"), "word", "left").join(spans, "span")
    n = F.coalesce("n", F.lit(0)) - F.when(F.lower("reading") == F.lower("span"), F.col("own")).otherwise(0)
    word_cost = F.when(n > 0, F.least("spelled", -F.log(n / total))).otherwise(F.col("spelled"))
    cost = known.groupBy("span", "reading").agg((F.first("base") + F.sum(word_cost)).alias("cost"))
    best = cost.groupBy("span").agg(F.min_by("reading", F.struct("cost", "reading")).alias("reading"))
    return best.select("span", "reading", ((F.col("span") != F.col("reading")) | F.col("span").rlike("[�\x80-\x9f]")).alias("damaged"))


def repair(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Every damaged value of some text columns with its most likely original: ``value, restored, whole``.

    One row per distinct damaged value. ``whole`` is false where signs for lost characters
    remain. Null, empty and plain ASCII values are never damaged; genuine foreign letters
    and signs stay as long as no other reading of them is likelier. Values of any length
    are read whole, span by span; repeated rows are read once. Other columns are ignored.
    """
    each = [df.select(df[c].cast("string").alias("value")) for c in fields]
    values = each[0]
    for more in each[1:]:
        values = values.unionAll(more)
    values = values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return repair_values(values, term_counts(df, fields))


def repair_values(values: DataFrame, words: DataFrame) -> DataFrame:
    """:func:`repair` for distinct values with their numbers and the corpus terms."""
    best = span_readings(values, words).where("damaged")
    # a digest stands for the value while its spans are looked up, so long values travel once
    odd = values.where(F.col("value").rlike(r"[^\x00-\x7f]")).select("value", F.sha2(F.col("value"), 256).alias("digest"))
    spans = odd.select("digest", F.posexplode(F.split(clean_start(F.col("value")), " ")).alias("at", "span")).where(F.col("span").rlike(r"[^\x00-\x7f]"))
    found = spans.join(best, "span").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("at", "reading"))).alias("fix"))
    pieces = F.transform(F.split(clean_start(F.col("value")), " "), lambda s, i: F.coalesce(F.try_element_at("fix", i), s))
    restored = odd.join(found, "digest").select("value", F.array_join(pieces, " ").alias("restored"))
    return restored.select("value", "restored", (~F.col("restored").rlike("[�\x80-\x9f]")).alias("whole"))

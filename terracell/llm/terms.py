"""How often every term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
FLUSH_TERMS = 500_000


class LastSeen:
    """Per term: occurrences, records, and the last record it was seen in.

    Tokens come in order of record, so a term's record count goes up exactly when its last
    record is another one; no set of records is kept.
    """

    def __init__(self) -> None:
        self.slot: dict[tuple[str, str], int] = {}
        self.occurrences: list[int] = []
        self.records: list[int] = []
        self.last: list[int] = []

    def add(self, field: str, record: int, terms: list[str]) -> None:
        for term in terms:
            k = self.slot.setdefault((field, term), len(self.last))
            if k == len(self.last):
                self.occurrences.append(1)
                self.records.append(1)
                self.last.append(record)
                continue
            self.occurrences[k] += 1
            if self.last[k] != record:
                self.last[k] = record
                self.records[k] += 1

    def drain(self) -> pa.RecordBatch:
        pairs = list(self.slot)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, _ in pairs], pa.string()),
                pa.array([t for _, t in pairs], pa.string()),
                pa.array(np.array(self.occurrences, np.int64)),
                pa.array(np.array(self.records, np.int64)),
            ],
            ["field", "term", "occurrences", "records"],
        )
        self.__init__()
        return out


def _counter(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, record = LastSeen(), 0
        for batch in batches:
            for name, column in zip(names, batch.columns, strict=True):
                for k, value in enumerate(column.to_pylist(), record + 1):
                    if value:
                        seen.add(name, k, _TERM.findall(value.lower()))
            record += batch.num_rows
            if len(seen.slot) > FLUSH_TERMS:  # between records, so that none is counted twice
                yield seen.drain()
        yield seen.drain()

    return run


def term_counts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Occurrences and records of every term of some text columns: ``field, term, occurrences, records``.

    ``fields`` gives the columns and the names under which they are reported. A term is a
    longest run of letters, marks and digits of the value in lower case. Each task reads
    records one after another into last-seen counters and hands over one partial row for
    each term (or several, when its terms pass half a million); the partial rows are
    hash-partitioned by term and added up. A record is read by one task only, so the sums
    are exact, and a term in a third of all records is still one row per task.

    Null and empty values hold no term; values of any length are read whole; each row is a
    record of its own, repeated or not; other columns are ignored.
    """
    chosen = df.select(*[df[c].cast("string").alias(f"c{k}") for k, c in enumerate(fields)])
    partial = chosen.mapInArrow(_counter(list(fields.values())), "field string, term string, occurrences bigint, records bigint")
    return partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def field_sizes(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The number of non-null values of each column: ``field, values``."""
    wide = df.agg(*[F.count(df[c]).alias(f"c{k}") for k, c in enumerate(fields)])
    each = [F.struct(F.lit(f).alias("field"), F.col(f"c{k}").alias("values")) for k, f in enumerate(fields.values())]
    return wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def marked_terms(counts: DataFrame, sizes: DataFrame, rare_records: int = 2, common_share: float = 0.08) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` up to ``rare_records`` records, ``common`` above
    ``common_share`` of the field's non-null values, else null. Rare wins where both hold."""
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.col("values") * common_share, "common")
    return counts.join(F.broadcast(sizes), "field").withColumn("mark", mark).drop("values")

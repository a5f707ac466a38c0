"""Text that looks the same but is made of other characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.textform import canonical

# A value of these characters only, without blanks at its ends, is in the common form already.
PLAIN = r"^[\x20-\x7e¡-¬®-ɏ‐‒-‧‰-⁞₠-⃀℀-⅏←-⋿─-◿]*$"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, changed = canonical(batch.column("value"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("value"), form.cast(pa.string()), pa.array(np.asarray(changed))], ["value", "form", "imitates"]
        )


def visual_forms(values: DataFrame) -> DataFrame:
    """The common form of distinct values: ``value, form, imitates``.

    ``values`` has a column ``value``; each Arrow batch is turned into code points and put
    through lookup tables, expansion offsets and mark composition without a call per row.
    ``imitates`` says that more had to change than surplus ordinary spaces. Null gives null
    and does not imitate; an empty value stays empty; values of any length are taken whole.
    """
    return values.select(F.col("value").cast("string")).mapInArrow(_forms, "value string, form string, imitates boolean")


def with_forms(df: DataFrame, column: str) -> DataFrame:
    """All rows of ``df`` with the common form of a text column and whether it imitates: adds ``form, imitates``.

    One pass over Arrow batches beside the rows, without a shuffle; columns of these names
    are replaced.
    """
    rest = [c for c in df.columns if c not in ("form", "imitates")]
    at = rest.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, changed = canonical(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, form.cast(pa.string()), pa.array(np.asarray(changed))], [*rest, "form", "imitates"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    return df.select(*rest).mapInArrow(run, f"{fields}, form string, imitates boolean")

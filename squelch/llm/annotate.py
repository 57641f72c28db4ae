"""Add what a Python function makes of each text to the rows of a frame, in one map without shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from squelch.llm.hashing import slices
from squelch.llm.shared import bounded_batches

#: Text that ``make`` gets at once (or one longer text): its arrays over all words are many times as large.
PART_BYTES = 8_000_000
#: Takes the text column of a part of an Arrow batch, gives one Python value per row.
PerText = Callable[[pa.Array], list]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(df: DataFrame, text: str, make: PerText, name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name`` of type ``kind`` (DDL)."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    at = df.columns.index(text)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(schema[-1].dataType)
        for batch in batches:
            for first, stop, _, _ in slices(batch.column(at), PART_BYTES):
                part = batch.slice(first, stop - first)
                made = pa.array(make(part.column(at)), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)

"""Row functions over Arrow batches: columns come in as Python lists, rows go out under an explicit schema."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def over_batches(df: DataFrame, function: Callable[[Iterator[tuple[list, ...]]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """Apply `function` to each partition: it reads tuples of column lists and yields lists of output rows."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (tuple(c.to_pylist() for c in b.columns) for b in batches)
        for out in function(columns):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), target)], schema=target)

    return df.mapInArrow(run, schema)


#: Most bytes of input whose rows are Python lists at one time, and most rows of a batch that goes out.
SLICE_BYTES, BATCH_ROWS = 1 << 18, 20_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about SLICE_BYTES; a longer row is a slice by itself."""
    for b in batches:
        if b.nbytes <= SLICE_BYTES:
            yield b
            continue
        variable = [c for c in b.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        sizes = [sum(row) for row in zip(*(pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in variable))]
        rest = max(0, b.nbytes - sum(sizes)) / b.num_rows
        first, held = 0, 0.0
        for i, n in enumerate(sizes or [0] * b.num_rows):
            if i > first and held + n + rest > SLICE_BYTES:
                yield b.slice(first, i - first)
                first, held = i, 0.0
            held += n + rest
        yield b.slice(first)


def over_slices(df: DataFrame, function: Callable[[Iterator[tuple[list, ...]]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """`over_batches` for functions that give many rows for one: neither the rows read nor those given are held together.

    A batch of Spark has up to 10,000 texts, and their units are millions of tuples. Here `function` reads small slices
    of it, and what it yields leaves in batches of BATCH_ROWS rows at most.
    """
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (tuple(c.to_pylist() for c in b.columns) for b in _slices(batches))
        for out in function(columns):
            for lo in range(0, len(out), BATCH_ROWS):
                part = out[lo : lo + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), target)], schema=target)

    return df.mapInArrow(run, schema)


def in_parts(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of BATCH_ROWS, made as they are read."""
    rows = iter(rows)
    while part := list(islice(rows, BATCH_ROWS)):
        yield part


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with the named string columns in canonical composition (NFC); null stays null.

    Neither the JVM's columns nor Arrow have a sound function for it (Arrow's cuts long values), so the values pass Python.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in columns:
                at = b.schema.get_field_index(name)
                values = [None if x is None else unicodedata.normalize("NFC", x) for x in b.column(at).to_pylist()]
                b = b.set_column(at, b.schema.field(at), pa.array(values, type=b.schema.field(at).type))
            yield b

    return df.mapInArrow(run, schema)

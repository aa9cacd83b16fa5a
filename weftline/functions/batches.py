"""UDFs over slices of Arrow batches: what a task holds in Python follows the slice, not the batch.

Spark hands over up to 10,000 rows at once. Where rows are whole files, or their results are lists of structs, these are gigabytes
once they are Python objects; here only one slice is, and its results go back before the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

ROWS, WIDE = 256, 2000


def sliced(kind: DataType, rows: int = ROWS):
    """Makes a UDF of a function that takes lists of values, one a column, and gives a list of values of ``kind``."""
    arrow = to_arrow_type(kind)

    def made(f: Callable):
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for cols in batches:
                cols = cols if isinstance(cols, tuple) else (cols,)
                for at in range(0, len(cols[0]), rows):
                    yield pa.array(f(*(c.slice(at, rows).to_pylist() for c in cols)), arrow)
            pa.default_memory_pool().release_unused()  # the worker lives on

        return F.arrow_udf(run, kind)

    return made


def each_row(df: DataFrame, keep: Sequence[str], text: str, schema: str, work: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """(keep, schema): the rows that ``work`` gives of each text, handed on while it still gives them."""
    told = df.select(*keep, F.col(text).alias("_text"))
    out = StructType([*told.drop("_text").schema, *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    whole = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            kept, texts = batch.select(list(range(len(keep)))), batch.column(len(keep))
            at, rows = [], []

            def packed():
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                old = [c.take(pa.array(at)).cast(whole.field(i).type) for i, c in enumerate(kept.columns)]
                return pa.RecordBatch.from_arrays([*old, *new], schema=whole)

            for i in range(batch.num_rows):
                for some in batched(work(texts[i].as_py()), WIDE):
                    rows += some
                    at += [i] * len(some)
                    if len(rows) >= WIDE:
                        yield packed()
                        at, rows = [], []
            if rows:
                yield packed()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return told.mapInArrow(run, out)

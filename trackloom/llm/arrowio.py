"""Arrow batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from trackloom.plans.runtime import ship

#: Rows unpacked at once. Arrow batches themselves are bounded in bytes by Spark
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set otherwise).
ROWS = 500


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list], Iterator[tuple] | list]]) -> DataFrame:
    """``make()`` runs once per task and returns a function from a batch's
    columns (lists) to output rows (tuples in schema order)."""
    spark = df.sparkSession
    ship(spark)
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        f = make()
        for batch in sliced(batches):
            rows = f([c.to_pylist() for c in batch.columns])
            part: list = []
            for r in rows:
                part.append(r)
                if len(part) >= 5000:
                    yield _pack(part, arrow)
                    part = []
            if part:
                yield _pack(part, arrow)

    return df.mapInArrow(run, out)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _pack(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")

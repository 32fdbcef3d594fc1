"""Row-preserving Arrow maps: new columns beside the ones that are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veloria.llm.blocks import trim


def append(df: DataFrame, needs: list[str], keep: list[str], made: T.StructType, make: Callable[[dict[str, pa.Array]], dict[str, pa.Array]]) -> DataFrame:
    """Columns ``keep`` of df plus those that ``make`` returns for each Arrow batch.

    ``make`` gets the columns in ``needs``.  Only columns that are kept or
    needed are read.  A kept column whose name is also made is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name for f in made}
    keep = [c for c in keep if c not in names]
    source = df.select(*dict.fromkeys([*keep, *needs]))
    schema = T.StructType([*(T.StructField(c, source.schema[c].dataType, True) for c in keep), *made])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = make({c: batch.column(batch.schema.get_field_index(c)) for c in needs})
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [new[f.name] for f in made]
                yield pa.RecordBatch.from_arrays([a.cast(t.type) if a.type != t.type else a for a, t in zip(arrays, target, strict=True)], schema=target)
                del new, arrays, batch
                trim()

    return source.mapInArrow(run, schema)


def crc32_text(column: str):
    """crc32 of a column's text, as Spark computes it."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary"))


_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType}


def schema(ddl: str) -> T.StructType:
    """A flat schema from "name type, ...", without a session (workers import these modules)."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, T.ArrayType(_TYPES[kind[6:-1]]()) if kind.startswith("array<") else _TYPES[kind]()))
    return T.StructType(fields)

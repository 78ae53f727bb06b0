"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ``WORD_BYTES`` keeps: a-z, 0-9 and every byte of a character beyond ASCII; A-Z are lowered, the rest is a gap.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lowered; bytes beyond ASCII count as letters."""
    return text.translate(WORD_BYTES).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """What lies between white space (U+0020, U+0009-U+000D), A-Z lowered."""
    return text.lower().split() if text else []


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids belong to fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n)), F.lit(0))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, one object per row."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def schema_of(*parts: T.StructType | str | list[T.StructField]) -> T.StructType:
    fields: list[T.StructField] = []
    for part in parts:
        fields += T._parse_datatype_string(part).fields if isinstance(part, str) else list(part)
    return T.StructType(fields)


#: Rows worked on at a time; what Python holds for a batch of Spark's is bounded by this share of it.
SLICE_ROWS = 1024


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], added: str, drop: Sequence[str] = ()) -> DataFrame:
    """Every row, without the columns to drop, with columns computed from a batch appended."""
    new = schema_of(added)
    names = [f.name for f in new.fields]
    kept = [c for c in df.columns if c not in names and c not in drop]
    schema = schema_of([df.schema[c] for c in kept], added)
    kinds = [arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            columns = [batch.column(c) for c in kept]
            columns += [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return df.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types used here."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next (caches only)."""
    return sys.modules.setdefault("_hiretide_worker", types.ModuleType("_hiretide_worker")).__dict__


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer of them at once between Spark and Python, which bounds what both sides hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))


def clean_name(df: DataFrame, name: str) -> str:
    """A column name the frame does not use yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns called c0, c1, .., which no operator's own names meet, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], outputs: Sequence[str]) -> DataFrame:
    """Columns called as before, then the outputs, which replace input columns of the same name."""
    back = [F.col(new).alias(old) for old, new in names.items() if new in df.columns and old not in outputs]
    return df.select(*back, *outputs)

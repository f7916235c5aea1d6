"""What the operators of this subpackage share: tables, shared folders, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.shared import cut, shared_folder  # noqa: F401

#: Bytes A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every byte outside the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` becomes a space.
LOWER_WORDS = bytes(32 if b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) else LOWER[b] for b in range(256))
#: UTF-8 continuation bytes; deleting them leaves one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Texts are worked on in slices of about so many bytes, to bound a Python worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 by 5; those rows are never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words(text: bytes) -> list[bytes]:
    """Lower-cased ASCII alphanumeric or non-ASCII runs of UTF-8 text."""
    return text.translate(LOWER_WORDS).split()


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch in slices of SLICE_BYTES or one row, with ``column`` as bytes (None for null)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start = total = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            total += n
            if total >= SLICE_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
                start, total = i + 1, 0


def with_columns(df: DataFrame, column: str, work, fields: list[T.StructField], keep: bool = True) -> DataFrame:
    """Add ``fields`` to every row of ``df`` by ``work(texts) -> list of Arrow arrays or lists``, batch by batch.

    ``work`` gets the UTF-8 bytes of ``column`` (None for null) of a slice of rows. Columns of ``df`` with the name of a
    new field are replaced, and ``column`` goes if not ``keep``. No shuffle; only ``column`` and the columns that the caller
    keeps are read.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names and (keep or c != column)]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    drop_text = column not in kept

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for part, texts in slices(batches, "__text" if drop_text else column):
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
            old = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(old + new, names=kept + names)

    source = df.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{column}`").alias("__text")] if drop_text else []))
    return source.mapInArrow(run, schema)

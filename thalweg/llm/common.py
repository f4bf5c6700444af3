"""Helpers shared by the training-data operators.

Conventions that every operator of this subpackage follows:

* only the columns it needs are selected from its input, so extra columns
  with clashing names cannot disturb it;
* a null text counts as the empty text;
* large intermediate tables are written as Parquet below the folder that the
  session names in ``spark.checkpoint.dir`` (``materialize``), which cuts the
  lineage and survives the loss of executors.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.plans.scratch import apart, materialize, partitions, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the further columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: What Python workers keep between tasks: name -> what empties it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Registers a cache of this worker."""
    _KEPT[name] = clear


def only(*names: str) -> None:
    """Empties the worker's other caches, so that an operator does not run beside those of the one before."""
    for name, clear in _KEPT.items():
        if name not in names:
            clear()
    give_back()


def give_back() -> None:
    """Returns memory that is free to the system, so that a worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def small_batches(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of the Arrow batches of bounded size, so that a Python worker holds few texts at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(most_rows, int(most_bytes * n / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_bytes: int = 8 << 20, most_rows: int = 2048, cache: str = "") -> DataFrame:
    """``fn`` over bounded Arrow batches; ``cache`` names the worker's cache that it uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(cache)
        for batch in small_batches(batches, most_bytes, most_rows):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


#: Fixed values of the contracts: A-Z to lower case and every ASCII byte that is not a letter or digit to a space;
#: bytes of 0x80 and above stay as they are.
_ALNUM = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)).lower()
#: A-Z to lower case only.
_LOWER = bytes(range(256)).lower()


def alnum_words(text: str) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def space_words(text: str) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after A-Z were lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def crc_mod(column, m: int):
    """crc32 of the id as text, modulo ``m``, as a column."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(m)

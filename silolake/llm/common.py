"""Small helpers shared by the operators: shared-folder files, stored tables, a bounded memo."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silolake import session
from silolake.session import checkpoint_dir, cut_lineage

__all__ = ["TEXT_BYTES", "Memo", "batches_of", "give_back", "open_input", "open_output", "shared_folder", "ship_package", "stored", "table",
           "text_or_empty", "tokenizer_path"]

#: Entries of a :class:`Memo` generation; two generations live at a time, in each Python worker.
MEMO_ENTRIES = 150_000
#: Arrow batches of this size go to the Python workers: by rows alone, long texts would fill memory on both sides.
ARROW_BYTES = 8 << 20
#: Texts that are cut into words at once.
TEXT_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches of a bounded size for them."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back."""
    return cut_lineage(df, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, as a URI or an absolute path."""
    return f"{checkpoint_dir(spark).rstrip('/')}/silolake-{name}-{uuid.uuid4().hex}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A binary stream into the shared folder (file, hdfs, s3, gs); parents are created."""
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable file of the shared folder."""
    store, path = _filesystem(uri)
    return store.open_input_file(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``SILOLAKE_TOKENIZERS`` or the ``public_tokenizers`` package name the folder."""
    folder = os.environ.get("SILOLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """``memo[key]`` computes ``make(key)`` once; holds at most two generations of ``entries`` keys.

    When the young generation is full it becomes the old one, so frequent keys
    survive and memory stays bounded however many distinct keys there are.
    """

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._make, self._entries, self._old = make, entries, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._entries:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Returns free memory of Arrow and of the C library to the system: idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def batches_of(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded size, so that a batch of very long texts is not expanded at once."""
    for batch in batches:
        at = 0
        step = max(1, min(max_rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step
    give_back()


if sys.byteorder != "little":  # the file formats and digests below are little-endian
    raise ImportError("silolake.llm needs a little-endian machine")

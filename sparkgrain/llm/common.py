"""What the operators share: the shared folder, written tables, Arrow tokenising, hashing."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.sources.store import shared_dir

# freed buffers go back to the system at once: Python workers live long beside a Java heap
pa.set_memory_pool(pa.system_memory_pool())

#: Rows of (key, value) arrays that may be broadcast; larger ones take a shuffled join instead.
BROADCAST_ROWS = 4_000_000
#: Bytes of text that a Python worker tokenises at once.
SLICE_BYTES = 8 << 20
#: Bytes of rows that Spark hands a Python worker at once, where the session allows more.
BATCH_BYTES = 8 << 20


def c(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: The folder of this process's tables in the shared one, and the tables that are there.
_RUN, _MADE = f"sparkgrain-{uuid.uuid4().hex}", []


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut, and lost executors lose nothing.

    The table goes with forget(), with settled() or, at the latest, when this process ends in good order.
    """
    spark = df.sparkSession
    if not _MADE:
        atexit.register(_sweep, spark, f"{shared_dir(spark).rstrip('/')}/{_RUN}")
    path = f"{shared_dir(spark).rstrip('/')}/{_RUN}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        _delete(spark, path)


def forget(*tables: DataFrame) -> None:
    """Delete the files behind written() tables that no later step reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that make() gives, written; the tables that were written on the way to them are deleted."""
    mark = len(_MADE)
    out = written(make(), name)
    for path in _MADE[mark:-1]:
        _delete(out.sparkSession, path)
    del _MADE[mark:-1]
    return out


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkgrain_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sparkgrain-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if os.path.isdir(root):
        with zipfile.ZipFile(f"{folder}/sparkgrain.zip", "w") as z:
            for at, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", os.path.dirname(root)))
        sc.addPyFile(f"{folder}/sparkgrain.zip")
    sc._sparkgrain_shipped = True
    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(at)) > BATCH_BYTES:
        spark.conf.set(at, str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df reads or holds; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array with nulls as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr.cast(pa.large_string()), "")


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes, or one row."""
    size = pc.binary_length(arr).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(size):
        yield start, len(size)


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Words of each text: codes into a dictionary, row offsets, and the dictionary.

    A word is a run without white space, in lower case, without the signs around it; a run of signs alone is no word.
    """
    split = pc.utf8_split_whitespace(arr)
    offsets = split.offsets.to_numpy().astype(np.int64)
    enc = split.flatten().dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low = pc.replace_substring_regex(pc.utf8_lower(enc.dictionary), r"^[^\pL\pN]+|[^\pL\pN]+$", "").dictionary_encode()
    to = low.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = low.dictionary
    offsets = offsets - offsets[0]
    codes = to[codes] if len(to) else codes
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
    return codes, offsets, words


def word_hash(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)

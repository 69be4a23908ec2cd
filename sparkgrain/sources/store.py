"""Where results go: whole tables, upserts by key, partitions and kept history, on any Hadoop file system."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.errors import ConcurrentWrite
from sparkgrain.operators.rejects import upsert

NAMESPACES = {"bronze": "bronze", "silver": "silver", "gold": "gold"}
#: How a partition transform is spelt in Spark.
TRANSFORMS = {"days": "DAY", "months": "MONTH", "years": "YEAR", "hours": "HOUR"}
_VERSION = re.compile(r"_v\d+")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is named and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not (own := getattr(shared_dir, "own", None)):
        own = shared_dir.own = tempfile.mkdtemp(prefix="sparkgrain-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


@dataclass(frozen=True)
class Naming:
    """Logical name and layer to namespace and relation; marts are mart_<name>."""

    prefix: str = ""

    def relation(self, layer: str, name: str) -> tuple[str, str]:
        return f"{self.prefix}{NAMESPACES[layer]}", f"mart_{name}" if layer == "gold" else name


def partition_columns(parts: tuple[tuple[str | None, str], ...]) -> dict[str, tuple[str | None, str]]:
    """Directory columns of a table's partitions: the column itself, or one derived from it."""
    return {(col if fn is None else f"_{fn}_{col}"): (fn, col) for fn, col in parts}


class Store:
    """Tables under a folder, each a folder of snapshots and numbered versions that say what of them is read.

    A write goes to a new snapshot, and the next version appears after it is whole: readers never see half a table, and
    a failed or repeated job leaves the old one. A version is made once: of two writers that started from the same one,
    the later gets ConcurrentWrite and its rows are not to be seen. Snapshots that neither of the two latest versions
    reads go; those of a writer still at work are left alone.
    """

    def __init__(self, spark: SparkSession, base: str, naming: Naming | None = None):
        self.spark, self.base, self.naming = spark, base.rstrip("/"), naming or Naming()

    def path(self, layer: str, name: str) -> str:
        return "/".join((self.base, *self.naming.relation(layer, name)))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm

    def _names(self, path: str) -> list[str]:
        fs, p, _ = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _version(self, table: str) -> int:
        """The latest version, 0 if there is none."""
        return max([int(n[2:]) for n in self._names(table) if _VERSION.fullmatch(n)], default=0)

    def _held(self, table: str, version: int) -> dict[str, list[str] | None]:
        """What a version reads: snapshots, each with its partitions' directories, or None for all of it."""
        fs, p, jvm = self._fs(f"{table}/_v{version}")
        if not version or not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self, layer: str, name: str) -> bool:
        return self._version(self.path(layer, name)) > 0

    def read(self, layer: str, name: str) -> DataFrame:
        """A table as it was last written; directory columns that were derived are left out."""
        table = self.path(layer, name)
        if not (version := self._version(table)):
            raise FileNotFoundError(table)
        got = None
        for snapshot, dirs in sorted(self._held(table, version).items()):
            base = f"{table}/{snapshot}"
            part = self.spark.read.option("basePath", base).parquet(*([base] if dirs is None else [f"{base}/{d}" for d in dirs]))
            got = part if got is None else got.unionByName(part, allowMissingColumns=True)
        return got.drop(*[x for x in got.columns if x.split("_")[1:2] and x.startswith("_") and x.split("_")[1] in TRANSFORMS])

    def _publish(self, table: str, version: int, held: dict[str, list[str] | None], mine: str) -> None:
        """Make the next version after the one that a write started from."""
        fs, p, jvm = self._fs(f"{table}/_v{version + 1}")
        claim, draft = (jvm.org.apache.hadoop.fs.Path(f"{table}/_{x}{version + 1}") for x in ("claim", "draft"))
        try:
            fs.create(claim, False).close()
        except Exception as e:
            if not fs.exists(claim):
                raise
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{table}/{mine}"), True)
            raise ConcurrentWrite(f"version {version + 1} of {table} was written meanwhile") from e
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        fs.rename(draft, p)
        old = version - 1
        for snapshot in self._held(table, old).keys() - held.keys() - self._held(table, version).keys():
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{table}/{snapshot}"), True)
        for n in (f"_v{old}", f"_claim{old}"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{table}/{n}"), False)

    def _placed(self, table: str, rows: DataFrame, parts: tuple) -> str:
        """Rows written to a new snapshot. Those of a partition are gathered first, so that each directory gets few files."""
        snapshot, cols = f"snap-{uuid.uuid4().hex}", partition_columns(parts)
        for c, (fn, col) in cols.items():
            if fn:
                rows = rows.withColumn(c, F.date_trunc(TRANSFORMS[fn], F.col(col)).cast("date") if fn != "hours" else F.date_format(F.date_trunc("HOUR", F.col(col)), "yyyy-MM-dd-HH"))
        writer = (rows.repartition(*cols) if cols else rows).write
        (writer.partitionBy(*cols) if cols else writer).parquet(f"{table}/{snapshot}")
        return snapshot

    def _directories(self, table: str, snapshot: str, depth: int) -> list[str]:
        """A snapshot's partition directories."""
        found = [""]
        for _ in range(depth):
            found = [f"{d}/{n}".lstrip("/") for d in found for n in self._names(f"{table}/{snapshot}/{d}") if "=" in n]
        return found

    def full(self, layer: str, name: str, rows: DataFrame, parts: tuple = (), version: int | None = None) -> DataFrame:
        """Replace a table. version: the one that rows were made from, if it was read before this call."""
        table = self.path(layer, name)
        version = self._version(table) if version is None else version
        snapshot = self._placed(table, rows, parts)
        self._publish(table, version, {snapshot: None}, snapshot)
        return self.read(layer, name)

    def by_key(self, layer: str, name: str, rows: DataFrame, key: tuple[str, ...], parts: tuple = ()) -> DataFrame:
        """Upsert: arriving rows take the place of those with their key."""
        version = self._version(self.path(layer, name))
        return self.full(layer, name, upsert(self.read(layer, name), rows, key) if version else rows, parts, version)

    def by_partition(self, layer: str, name: str, rows: DataFrame, parts: tuple) -> DataFrame:
        """Replace the partitions that the arriving rows touch; the others' files are neither read nor moved."""
        table = self.path(layer, name)
        if not (version := self._version(table)):
            return self.full(layer, name, rows, parts, version)
        snapshot, depth = self._placed(table, rows, parts), len(partition_columns(parts))
        new = self._directories(table, snapshot, depth)
        held: dict[str, list[str] | None] = {}
        for old, dirs in self._held(table, version).items():
            dirs = self._directories(table, old, depth) if dirs is None else dirs
            if rest := sorted(set(dirs) - set(new)):
                held[old] = rest
        if new or not held:
            held[snapshot] = new or None
        self._publish(table, version, held, snapshot)
        return self.read(layer, name)

    def history(self, layer: str, name: str, rows: DataFrame, key: tuple[str, ...], at: datetime) -> DataFrame:
        version = self._version(self.path(layer, name))
        return self.full(layer, name, scd2(self.read(layer, name) if version else None, rows, key, at), (), version)


def scd2(history: DataFrame | None, arriving: DataFrame, key: tuple[str, ...], at: datetime) -> DataFrame:
    """Kept history: each key's rows with valid_from and valid_to (null while open).

    A key whose columns changed has its open row closed at `at` and a new one opened; unchanged and absent keys stay.
    One null-safe outer join of the open rows with the arriving ones; closed rows pass by without a shuffle.
    """
    now = F.lit(at).cast("timestamp_ntz")
    fresh = arriving.withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    if history is None:
        return fresh
    cols = arriving.columns
    closed = history.where(F.col("valid_to").isNotNull()).select(*cols, "valid_from", "valid_to")
    old = history.where(F.col("valid_to").isNull()).select(F.struct(*cols).alias("o"), "valid_from")
    new = arriving.select(F.struct(*cols).alias("n"))
    on = None
    for k in key:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    both = old.join(new, on, "full")
    kind = F.struct(*[F.col(f"o.{x}").alias(x) for x in cols], F.col("valid_from").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    shut = F.struct(*[F.col(f"o.{x}").alias(x) for x in cols], F.col("valid_from").alias("valid_from"), now.alias("valid_to"))
    open_ = F.struct(*[F.col(f"n.{x}").alias(x) for x in cols], now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    there, here = F.col("valid_from").isNotNull(), F.col("n").isNotNull()
    same = F.lit(True)
    for x in cols:
        same = same & F.col(f"o.{x}").eqNullSafe(F.col(f"n.{x}"))
    out = F.when(~here | (there & same), F.array(kind)).when(~there, F.array(open_)).otherwise(F.array(shut, open_))
    return closed.unionByName(both.select(F.explode(out).alias("r")).select("r.*"))

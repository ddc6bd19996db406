"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions are shipped with the plan, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: What separates words: blank, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    All executors and the driver see it. Only a local master (tests) may leave
    it unset; the warehouse folder is used then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Session setting by which a query's shuffle files go when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: an executor that is lost later costs no more than
    the tasks that it was running. With ``free`` the shuffle files of the job
    are removed as soon as it has ended, not when the driver forgets them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if free:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


class Memo:
    """Results by key in two generations. When the younger one is full it
    becomes the older, and the older goes; keys that are asked for again move
    to the younger. So frequent keys stay, and keys seen once go."""

    def __init__(self) -> None:
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that neither generation holds; the younger one
        holds the others afterwards."""
        new, old = self.new, self.old
        keys = keys.difference(new)
        if not old or not keys:
            return keys
        found = [k for k in keys if k in old]
        new.update(zip(found, map(old.__getitem__, found)))
        return keys.difference(found)

    def age(self, limit: int) -> dict:
        """The younger generation, begun anew if it holds more than ``limit``."""
        if len(self.new) > limit:
            self.new, self.old = {}, self.new
        return self.new


def worker_memo(group: str, name: str, limit: int) -> Memo:
    """A memo that lives as long as the Python worker does.

    It holds results that depend on the key alone. A generation ends at more
    than ``limit`` entries, and everything goes when the worker turns to another
    group (another operator, tokenizer or model), so its memory is bounded
    however long the worker lives.
    """
    store = sys.modules.setdefault("_gatewatch_worker", types.ModuleType("_gatewatch_worker"))
    if store.__dict__.get("group") != group:
        store.group, store.memos = group, {}
    memo = store.memos.setdefault(name, Memo())
    memo.age(limit)
    return memo


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, unless a row is larger by
    itself, about ``size`` bytes of a text column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = sizes.cumsum()
    low = 0
    while low < len(sizes):
        full = int(ends.searchsorted(ends[low] - sizes[low] + size, "right"))
        high = min(low + rows, max(low + 1, full))
        yield batch.slice(low, high - low)
        low = high


def worker_once(name: str, make):
    """``make()`` once per Python worker."""
    store = sys.modules.setdefault("_gatewatch_worker", types.ModuleType("_gatewatch_worker"))
    if name not in store.__dict__:
        store.__dict__[name] = make()
    return store.__dict__[name]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

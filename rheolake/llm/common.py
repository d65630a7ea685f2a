"""Helpers that the corpus operators share."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch of whole texts on its way to Python.
ARROW_BATCH = "8m"


def bound_batches(df: DataFrame) -> DataFrame:
    """df; its session hands whole texts to Python in small batches from now on, so long texts cannot pile up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder in here is deleted at the end, so results must be written elsewhere by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        discard(spark, *made)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that driver and executors share.

    Where that setting is missing, a temporary folder takes its place on a single machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rheolake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.shared_folder = path
    return found


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(*frames: DataFrame | list[str]) -> Callable[[str], str]:
    """A maker of column names that occur in none of the frames (or lists of names), whatever their case."""
    taken = {c.lower() for f in frames for c in (f if isinstance(f, list) else f.columns)}

    def name(wish: str) -> str:
        while wish.lower() in taken:
            wish += "_"
        taken.add(wish.lower())
        return wish

    return name


def packed(columns: Sequence[str]) -> Column:
    """The columns in one struct, so that whatever their names are, they clash with none of an operator's own."""
    return F.struct(*(F.col(quoted(c)) for c in columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, row: str, columns: Sequence[str], outputs: Sequence[str] = ()) -> DataFrame:
    """The packed columns and the outputs; an output takes the place of a packed column of its name."""
    own = {c.lower() for c in outputs}
    kept = [F.col(row).getField(c).alias(c) for c in columns if c.lower() not in own]
    return df.select(*kept, *outputs)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast value (of a size that its maker bounds); tasks call the result to get it, whatever its class."""
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(box.value)


def per_worker(kind: str, key: object, make: Callable[[], object]) -> object:
    """The object that this Python worker made for key; one of each kind is kept between the tasks it runs."""
    kept = sys.modules.setdefault("rheolake_worker_objects", types.ModuleType("rheolake_worker_objects")).__dict__
    if kept.get(kind) is None or kept[kind][0] != key:
        kept[kind] = None  # the old one goes first
        kept[kind] = (key, make())
    return kept[kind][1]

"""Lineage cuts in the folder that the whole cluster shares, and broadcasts behind a check of their size.

``materialize`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
reads it back, so a lost executor costs a re-read and never a re-run.  Only a
local session may go without the setting; it then gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side with at most this many rows and bytes, both counted before the join, is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_current: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in a local session one is set if there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` as a table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{label}-{uuid.uuid4().hex}"
    made = _current.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that are made within; what is built from them must have been written by then."""
    made: list[str] = []
    token = _current.set(made)
    try:
        yield
    finally:
        _current.reset(token)
        for path in made:
            remove(spark, path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; 8 at least."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            size = F.aggregate(value, F.lit(0), lambda a, x: (a + _bytes(x, kind.elementType)).cast("int"))
        else:
            size = F.size(value) * 8
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def small_side(df: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, counted, are few; otherwise unchanged, for a shuffled join."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    found = df.agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("size")).first()
    return F.broadcast(df) if found.n <= most_rows and (found.size or 0) <= most_bytes else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made unlike any column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

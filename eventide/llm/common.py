"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: One word: a run of letters, digits or underscores.
WORD = re.compile(r"\w+")
#: Quarters of a second for which ``release`` waits at most.
MOST_WAITS = 40


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, which only a local master may do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="eventide-checkpoint-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have shuffle files of steps removed whose results are written already.

    Spark's cleaner does so once the driver's garbage is collected, which may take longer than the job. The JVM learns only
    within a second or so what Python has collected, in order: once an object that is collected last is gone, the ones before are garbage too.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    last = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    gc.collect()
    for _ in range(MOST_WAITS):
        jvm.System.gc()
        if last.refersTo(None):
            break
        time.sleep(0.25)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces(batch: pa.RecordBatch, column: str, most_chars: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a batch's text column of about ``most_chars`` characters: first row and texts, nulls as ''."""
    start, texts, chars = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py() or ""
        texts.append(t)
        chars += len(t)
        if chars >= most_chars:
            yield start, texts
            start, texts, chars = i + 1, [], 0
    if texts:
        yield start, texts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

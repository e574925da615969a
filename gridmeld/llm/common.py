"""Helpers shared by the training-data operators: shared storage, hashes, columns."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and the control characters 9 to 13.
SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset (tests, a single machine) a temporary folder is made once
    for the session and removed when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridmeld.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridmeld-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("gridmeld.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage so that
    a lost executor costs a re-read, and fixes the rows for all later uses."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridmeld-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a model with its class, so that executors need no installed copy of
    this package; tasks call the result once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def fresh(columns: list[str]) -> str:
    """A prefix for columns of our own that none of the given columns begins with."""
    out = "_own_"
    while any(c.lower().startswith(out) for c in columns):
        out = f"_{out}"
    return out


def hash128(col: Column) -> list[Column]:
    """Two independent 64-bit hashes of a column; together a key that does not
    collide on corpora of any practical size."""
    return [F.xxhash64(col), F.xxhash64(F.lit(0x5BD1E995), col)]


def ascii_lower(col: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def bitmap_of(df: DataFrame, col: str, bits: int = 24) -> "object":
    """A fixed-size bitmap (2**bits bits, as numpy uint64 words) of a long column's hashes.

    It goes to tasks as a prefilter only: what passes is joined exactly
    afterwards. Its size doesn't depend on the data.
    """
    import numpy as np

    slot = F.expr(f"pmod(`{col}`, {1 << bits}L)")
    words = (
        df.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS INT))")).alias("b"))
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toArrow()  # at most 2**(bits-6) rows
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap, values):
    """Which of the int64 or uint64 values may be in a bitmap of bitmap_of()."""
    import numpy as np

    slot = values.view(np.uint64) & np.uint64(bitmap.size * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

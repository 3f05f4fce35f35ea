"""Helpers shared by the operators: cutting lineage, checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (of a few longs each) up to which a side is broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset and everything runs in this process (as
    in tests), a temporary folder; a cluster without the setting is an error, for no executor sees another's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="waymark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no more than a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for rows that are wide or read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (counted unless given), else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def batched(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers, in rows and in bytes, where the session's bounds
    are wider. A batch is planned when a result is asked for, so the setting stays with the session."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most or not spark.conf.get(key).isdigit():
            spark.conf.set(key, str(most))


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """(key, slice) for each run of equal keys (integer columns called names) in each batch."""
    for batch in batches:
        if batch.num_rows:
            keys = [batch.column(n).to_numpy() for n in names]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                yield tuple(int(k[i]) for k in keys), batch.slice(i, j - i)


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % modulus


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. bytes.lower and bytes.split know ASCII only, which is the rule."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def like(df: DataFrame, name: str) -> T.StructField:
    """The field of df called name, nullable."""
    return T.StructField(name, df.schema[name].dataType, True)


#: White space that text libraries disagree about; texts that hold it take the slow way.
ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

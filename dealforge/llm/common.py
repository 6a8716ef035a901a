"""What the corpus operators share: the shared folder, checkpoints and word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes other than ASCII space and the controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_AZ, _AZ.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only where the session names none and everything runs on one machine (as
    in tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else "file://" + at


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a checkpointed table of a few numbers a row (about 32 MB) up to which it is broadcast.
BROADCAST_ROWS = 500_000


def small_or_merged(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join: broadcast if it has ``rows`` rows at most (``BROADCAST_ROWS``), else hinted to a merge join. ``table`` must be cheap to count."""
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if rows is None else rows) else table.hint("merge")


def lower_az(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def lower_az_col(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def as_text(df: DataFrame) -> DataFrame:
    """``df`` with its columns of whole numbers as text. On the way to pandas a column of numbers that holds nulls becomes doubles, and large numbers others; ``as_before`` takes the text back."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, T.IntegralType)})


def text_schema(schema: T.StructType) -> T.StructType:
    """``schema`` as it is after ``as_text``."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.IntegralType) else f.dataType) for f in schema])


def as_before(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns that ``schema`` names with its types again."""
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema if isinstance(f.dataType, T.IntegralType)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

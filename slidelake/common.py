"""Small helpers that every part shares: reading tables, the shared folder, repeatable hashes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Without that setting a session that runs on this machine alone uses a local folder; on a cluster it is an error, as no folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/slidelake-{os.getpid()}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it again.

    Cuts the lineage with files that outlive a lost executor, so what follows more than once is computed once.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blank(c: Column) -> Column:
    """True for null and for text of white space and NUL alone."""
    return F.coalesce(F.btrim(c, F.lit(" \t\r\n\x0b\f\x00 ")) == "", F.lit(True))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt: str | None = None, salts: int = 16) -> DataFrame:
    """Left join in which each key of ``big`` is spread over ``salts`` tasks by the hash of its column ``salt``, or of where the row lies.

    ``small`` has a row per key and is repeated for every salt, so a key that a third of ``big`` holds is no single task.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(salt if salt else F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return spread.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"], "left").drop("_salt")

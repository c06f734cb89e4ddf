"""What every operator needs of the session: shared checkpoints, checked broadcasts, empty-safe reads."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side is broadcast only when its values take at most this many bytes.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of this machine only where all tasks run on it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "foliant-checkpoints")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back; survives the loss of executors.

    The files go when nothing refers to the result any more.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda n, x: n + width(x, kind.elementType)), F.lit(0))
        return F.coalesce(8 * F.size(value) + 16, F.lit(0))
    if isinstance(kind, StructType):
        return sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values take at most `most` bytes, else df for a shuffled join, which AQE splits if skewed.

    df is written once to be measured, so that its plan runs only once.
    """
    held = checkpoint(df)
    size = held.agg(F.sum(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in held.schema.fields), F.lit(16)).cast("long")).alias("n")).first()["n"]
    return F.broadcast(held) if (size or 0) <= most else held


def ship(spark: SparkSession) -> None:
    """Give the package to the tasks of a session whose Python workers may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_has_foliant", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._has_foliant = True

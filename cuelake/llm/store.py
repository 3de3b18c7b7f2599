"""Tables in the shared folder and other things that several operators of this subpackage need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cuelake-"))
        found = sc.getCheckpointDir()
    return found


def table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cuelake_path = path
    _made.append(path)
    return out


#: Folders that ``table`` wrote in this process and that still stand.
_made: list[str] = []


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing lazy reads it any more."""
    _delete(spark, df.cuelake_path)


def table_mark() -> set[str]:
    """What stands now, for ``sweep``."""
    return set(_made)


def sweep(spark: SparkSession, mark: set[str], keep: list[DataFrame]) -> None:
    """Deletes all that ``table`` wrote after ``mark`` but for ``keep``: for a caller whose other results are written."""
    spared = mark | {df.cuelake_path for df in keep}
    for path in [x for x in _made if x not in spared]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, from a scan that moves one number a task."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def text_hashes(text: str) -> list[Column]:
    """Two hashes of a text, ``text_hash`` and ``text_hash2``, that tell rows of one key (or without one) apart."""
    c = F.col(f"`{text}`")
    return [F.xxhash64(c).alias("text_hash"), F.xxhash64(F.lit(9), c).alias("text_hash2")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

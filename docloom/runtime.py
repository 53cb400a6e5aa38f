"""Session-level helpers: reading tables, cutting lineage, size-checked broadcasts.

Lineage is cut by writing a parquet table into the folder all executors share
(``spark.checkpoint.dir``), so a lost executor costs recomputation of a task
and never a result. Nothing is kept on one machine only.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a table of key columns is broadcast; above it the join shuffles.
BROADCAST_BYTES = 8 << 20
_WIDTH = {"long": 8, "integer": 4, "short": 2, "byte": 1, "boolean": 1, "double": 8, "float": 4, "timestamp": 8, "timestamp_ntz": 8, "date": 4}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it on the PYTHONPATH they inherit."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(app)
    out = tempfile.mkdtemp(prefix="docloom-ship-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/docloom", "zip", root, "docloom"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session on one machine may go without: it gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docloom.shared.dir", None)
    if named:
        return named.rstrip("/")
    if not _local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    own = f"file://{own}"
    spark.conf.set("docloom.shared.dir", own)
    return own


_staged: dict[str, list[str]] = {}


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_unstage_all)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def unstage(spark: SparkSession) -> None:
    """Delete the tables this application has staged so far; results that read them must have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def _unstage_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            unstage(spark)
        except Exception:  # noqa: BLE001 - the session is ending; what stays is removed with the shared folder
            return


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as a table in the shared folder and return a scan of it. It is deleted when the application ends, or by ``unstage``."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, column: str = "bucket") -> dict[int, str]:
    """Write df in one folder for each value of a column of few small numbers, and return the folders."""
    path = _path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(where)]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{column}=")}


def row_limit(df: DataFrame, budget: int = BROADCAST_BYTES) -> int:
    """Rows of df that fit the budget, with 24 bytes for each row and 64 for a value without a fixed width; ``small_enough`` measures texts as they are."""
    return budget // (24 + sum(_WIDTH.get(f.dataType.typeName(), 64) for f in df.schema.fields))


def small_enough(df: DataFrame, budget: int = BROADCAST_BYTES) -> bool:
    """Whether df stays within the budget; counts no further than that. df should be staged, as it is read for it."""
    rows = row_limit(df, budget)
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    long = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(long), F.lit(0))).first()
    return n <= rows and size + 24 * n <= budget


def sized(df: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is within the budget; else the join shuffles, with AQE splitting skew."""
    return F.broadcast(df) if small_enough(df, budget) else df


def drop_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str], budget: int = BROADCAST_BYTES) -> DataFrame:
    """df without the rows whose key is in keys (staged)."""
    return df.join(sized(keys, budget), on, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str], budget: int = BROADCAST_BYTES) -> DataFrame:
    """df with only the rows whose key is in keys (staged)."""
    return df.join(sized(keys, budget), on, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """df, a scan with projections and filters, in more partitions if its files are so few or small that most cores would idle in a costly step on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """df without repeated rows, for rows that hold long texts: only rows of keys that come more than once are shuffled."""
    df = spread(df)
    again = stage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(key), "again")
    several = df.join(sized(again.where(F.col(key).isNotNull())), key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    return df.where(F.col(key).isNotNull()).join(sized(again), key, "left_anti").unionByName(several.distinct()).select(*df.columns)


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows of df, those with the smallest hashed keys; the same ones on every run.

    A threshold on the hash leaves about three times n rows first, so the driver never merges n rows of every partition.
    """
    ring = 1 << 40
    h = F.pmod(F.xxhash64(*keys), F.lit(ring))
    total = df.count()
    if total > 3 * n:
        df = df.where(h < F.lit(3 * n * ring // total))
    return df.orderBy(h, *keys).limit(n)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column | str) -> Column:
    """128-bit key of a text in two longs, as a struct: equal texts have equal keys, others practically never."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), F.length(c), c).alias("b"))

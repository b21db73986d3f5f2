"""Small shared pieces: where the shared folder is, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.session import prepare

#: Words are runs of characters other than space, \t, \n, \x0b, \f and \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset in local mode, as in tests, a temporary folder is taken and set;
    on several machines that would lose what others write, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not path:  # the session's setting cannot be changed while it runs
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loglake-"))
            path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that made them ends; no other plan reads them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the plan is
    cut there, so that a lost executor costs the lost tasks and not a new start."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text):
    """Column: the words of ``text`` (null and blank: an empty array)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def lower_ascii(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(id_col, k: int):
    """Column: crc32 of the id as text, mod ``k``."""
    return F.crc32(id_col.cast("string")) % k


def join_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], size_col: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row of ``groups`` per key, where a key may hold any share
    of the rows. Keys with over a thousandth of ``total`` rows are broadcast; all other keys
    are small and meet in a shuffled join. ``size_col`` counts the key's own rows, so that the
    sizes sum to ``total`` at most and the broadcast ones number less than 1000; a wrong
    ``total`` makes the broadcast larger, but loses no row."""
    bound = max(1, total // 1000)
    hot = F.broadcast(groups.filter(F.col(size_col) > bound))
    cold = groups.filter(F.col(size_col) <= bound)
    left = rows.join(F.broadcast(groups.filter(F.col(size_col) > bound).select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(hot, key).unionByName(left.join(cold, key, how), allowMissingColumns=True)


#: Parts into which ``join_salted`` deals the rows of a hot key.
SALTS = 16


def join_salted(rows: DataFrame, groups: DataFrame, key: list[str], size_col: str, total: int) -> DataFrame:
    """As ``join_hot``, for rows that are dear to compute: they are evaluated once. Rows of
    keys with over a thousandth of ``total`` rows are dealt by their input partition to
    ``SALTS`` parts, for each of which there is a copy of the key's group. The join is a
    merge at every size, so that what is shuffled follows the input."""
    bound = max(1, total // 1000)
    hot = groups.filter(F.col(size_col) > bound).select(*key, F.lit(SALTS).alias("_salts"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.spark_partition_id() % SALTS)).drop("_salts")
    salts = F.when(F.col(size_col) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("_salt", F.explode(salts)).hint("merge"), [*key, "_salt"]).drop("_salt")

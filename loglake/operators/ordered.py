"""Order within groups of any size: ranks, running sums and order statistics.

A window over one key is one task, and a key may hold most of the rows. Here rows are sorted
by range over (key, order), so that a key is as many tasks as its rows ask for; what one
task has to know of those before it is a row a task and key, and is summed up by a window
over these. The sorted rows are written once in the shared folder: a plan that read them
twice from the shuffle might sort them by other bounds, and a lost executor costs its tasks
only.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a window of one key goes over at once.
BLOCK = 1 << 16
#: Rows of one task, about; parsing takes some tenths of a millisecond a row.
TASK_ROWS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only where it is
    unset in local mode, as in tests, a temporary one is taken and set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
        if not top and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not top:  # the session's setting cannot be changed while it runs
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loglake-"))
            top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out to tasks of about ``rows``."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``hold(df)``: ``df`` as a table in the shared folder, for several plans that read it; the
    tables go when the block ends. On disk they take no memory, whatever their rows."""
    top, tables = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def hold(df: DataFrame) -> DataFrame:
        tables.append(f"{top}/{len(tables)}")
        df.write.option("compression", "zstd").parquet(tables[-1])
        return df.sparkSession.read.schema(df.schema).parquet(tables[-1])

    try:
        yield hold
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def range_sorted(df: DataFrame, keys: list[str], order: list[str], name: str = "sorted") -> DataFrame:
    """The rows by range of (keys, order), written, with _part, the number of the range, and
    _at, which rises with the order within it."""
    by = [*keys, *order]
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return written(out, name).withColumn("_part", F.shiftright("_at", 33))


def before_parts(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """(keys, _part, _first, _before, _total): the sum of ``weight`` over the key's rows in the
    ranges before, and over all of them."""
    parts = rows.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"), F.min("_at").alias("_first"))
    of = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_sum").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select(*keys, "_part", "_first", "_sum", before.alias("_before"), F.sum("_sum").over(of).alias("_total"))


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds _rank: the number of a row of its key in ``order``, from 1. Ties are told apart in
    one way, which stays. A null key is a key."""
    rows = range_sorted(df, [key], order, "ranked")
    parts = before_parts(rows, [key], F.lit(1)).select(F.col(key).alias("_key"), F.col("_part").alias("_p"), (F.col("_first") - F.col("_before") - 1).alias("_zero"))
    j = rows.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return j.withColumn("_rank", F.col("_at") - F.col("_zero")).select(*df.columns, "_rank")


def over_last(rows: DataFrame, key: str, last: int, block: int | None = None) -> tuple[DataFrame, Window]:
    """``ranked`` rows for a window of ``last`` rows up to the current one: blocks of ranks,
    each with the ``last`` rows before it (_home is false there), and the window's partition
    and order. Drop the rows that are not at home when the window is applied."""
    block = block or BLOCK
    own = F.floor((F.col("_rank") - 1) / block)
    needed = F.col("_rank") - 1 - own * block >= block - last
    blocks = F.when(needed, F.array(own, own + 1)).otherwise(F.array(own)) if last < block else F.sequence(own, own + F.floor((F.lit(last) + block - 1) / block).cast("long"))
    out = rows.withColumn("_own", own).withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_own") == F.col("_block")).drop("_own")
    return out, Window.partitionBy(key, "_block").orderBy("_rank")


def hot_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, n) of the keys with more than ``most`` rows: one in ``most`` rows at most."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """(keys, n, ...): for each name in ``places`` the value at an index from 0, an SQL
    expression of n, of the key's sorted values. Null values do not count.

    Equal values are one row with their number. These rows are sorted by range; the sums of
    the ranges tell in which of them an index lies, and only there the rank is taken."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    rows = range_sorted(cells, keys, [value], "values")
    parts = before_parts(rows, keys, F.col("_c")).withColumn("n", F.col("_total"))
    wanted = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in places]), F.array(*[F.expr(f"bigint({x})") for x in places.values()])))
    wanted = parts.select(*keys, "_part", "n", "_before", "_sum", wanted.alias("_name", "_index"))
    wanted = wanted.filter((F.col("_index") >= F.col("_before")) & (F.col("_index") < F.col("_before") + F.col("_sum")))
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "n", "_name", (F.col("_index") - F.col("_before")).alias("_index"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    asked = wanted.select(*[c for c in wanted.columns if c.startswith("_k")], "_p").distinct()
    inside = rows.join(asked, on, "left_semi")
    inside = inside.withColumn("_sofar", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.join(wanted, on).filter((F.col("_index") < F.col("_sofar")) & (F.col("_index") >= F.col("_sofar") - F.col("_c")))
    return hit.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in places])


# --- folds over blocks ---------------------------------------------------------------------


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null ones meet too; the keys are those of ``a``."""
    b = b.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return a.join(b, on, how).drop(*[f"_j{i}" for i in range(len(keys))])


def block_of(order: str, kind: str, size: int) -> Column:
    """The block of a number or a time (by microseconds); other orders are one block."""
    if kind.startswith("timestamp"):
        return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / size)
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return F.floor(F.col(order) / size).cast("long") if numeric else F.lit(0).cast("long")


def fold_blocks(df: DataFrame, keys: list[str], order: str, start, summarise: Callable, advance: Callable, apply: Callable, schema: str) -> DataFrame:
    """A sequential process over the rows of a key, of which blocks (column _block) are worked
    on at the same time.

    ``summarise(rows)`` tells what a block does to any state, ``advance(summary, state)`` is the
    state behind it, and ``apply(rows, state, last)`` has the output rows of a block that is
    entered with ``state``, and may be the key's last. Summaries are small; those of a key go by as a sorted stream, so that
    nothing but one state is held. ``rows`` are in ``order``."""
    by, ddl = [*keys, "_block"], ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    ddl = f"{ddl + ', ' if ddl else ''}_block long, _held binary"

    def one(rows):
        rows = rows.sort_values(order, kind="stable")
        return rows[by].head(1).assign(_held=[pickle.dumps(summarise(rows))])

    def stream(batches):
        now, state, held = None, start, None  # held: the row before, of which it is open whether it is the key's last
        for b in batches:
            out = []
            for row in zip(*[b[c].astype(object).where(b[c].notna(), None) for c in by], b["_held"]):
                key = row[: len(keys)]
                if held is not None:
                    out.append((*held[0], pickle.dumps((held[1], key != now))))
                if key != now:
                    now, state = key, start
                held = row[:-1], state
                state = advance(pickle.loads(row[-1]), state)
            yield pd.DataFrame(out, columns=[*by, "_held"], dtype=object)
        if held is not None:
            yield pd.DataFrame([(*held[0], pickle.dumps((held[1], True)))], columns=[*by, "_held"], dtype=object)

    def out(rows, entry):
        return apply(rows.sort_values(order, kind="stable"), *pickle.loads(entry["_held"].iloc[0]))

    blocks = df.groupBy(*by).applyInPandas(one, ddl)
    blocks = (blocks.repartition(*keys) if keys else blocks.repartition(1)).sortWithinPartitions(*by)
    entries = blocks.mapInPandas(stream, ddl)
    return df.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(out, schema)

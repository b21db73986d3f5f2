"""Exact deduplication by two passes over a Bloom filter.

Pass 1 sets bits for every hash and finds the bits that two or more rows set. Pass 2
tests every row against those bits: a row whose bits are not all among them has a text
that occurs once and passes straight through; only the others are shuffled and grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import join_hot, materialize

BITS_PER_ROW = 16
HASHES = 4


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` bit positions per hash, by double hashing (bits: a power of two)."""
    u = h.view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([(u + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)], axis=1)


def _added(parts: list[tuple]) -> tuple:
    """Parts of (word, ones, twos) as one: a bit that is in two parts is set twice."""
    word, ones, twos = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(word, kind="stable")
    word, ones, twos = word[order], ones[order], twos[order]
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    # bits of a word in its order: what is set again, having been set before
    twos = np.bitwise_or.reduceat(twos, start)
    seen, at = ones[start].copy(), start + 1
    end = np.r_[start[1:], len(word)]
    while (more := np.flatnonzero(at < end)).size:
        twos[more] |= seen[more] & ones[at[more]]
        seen[more] |= ones[at[more]]
        at = at + 1
    return word[start], seen, twos


def _local_bits(bits: int):
    def run(batches):
        waiting, size = [], 0
        held = None  # words that have bits set, ascending; bits set by one row, by two
        for b in batches:
            pos = _positions(b.column(0).to_numpy(zero_copy_only=False), bits)
            # a row may set one bit by two of its hashes: count it once
            pos.sort(axis=1)
            first = np.ones(pos.shape, bool)
            first[:, 1:] = pos[:, 1:] != pos[:, :-1]
            at, n = np.unique(pos[first], return_counts=True)
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            if not len(word):
                continue
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ones = np.bitwise_or.reduceat(bit, start)
            twos = np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint64(0)), start)
            new = (word[start], ones, twos)
            waiting.append(new)
            size += len(start)
            if held is None or size > len(held[0]):  # merged when it is as much as what is held
                held, waiting, size = _added([*([held] if held else []), *waiting]), [], 0
        if waiting:
            held = _added([*([held] if held else []), *waiting])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held], names=["word", "ones", "twos"])

    return run


def _merge_bits(batches):
    """Rows sorted by word: the bits that two or more partitions, or one twice, have set."""
    held = None
    for b in [*batches, None]:
        new = None if b is None else [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
        rows = new if held is None else held if new is None else [np.concatenate(x) for x in zip(held, new)]
        if rows is None or not len(rows[0]):
            continue
        # the last word may go on in the next batch: reduce it, keep it back
        start = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        ones = np.bitwise_or.reduceat(rows[1], start)
        twos = np.bitwise_or.reduceat(rows[2], start)
        each = np.unpackbits(rows[1].view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint32)
        many = np.packbits(np.add.reduceat(each, start, axis=0) > 1, axis=1).view(np.uint64).ravel()
        twos = twos | many
        word = rows[0][start]
        end = len(word) if new is None else len(word) - 1
        held = None if new is None else [word[end:], ones[end:], twos[end:]]
        keep = twos[:end] != 0
        yield pa.RecordBatch.from_arrays([pa.array(word[:end][keep].view(np.int64)), pa.array(twos[:end][keep].view(np.int64))], names=["word", "twos"])


def _probe(words, bits: int):
    def run(batches):
        table = words.value
        for b in batches:
            pos = _positions(b.column(b.schema.get_field_index("h")).to_numpy(zero_copy_only=False), bits)
            hit = ((table[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1)).all(axis=1)
            yield b.append_column("maybe", pa.array(hit))

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest id stays. Rows that repeat id and text share one verdict. A null id never
    stays if an equal text has an id; if all ids of a group are null, keep_id is null and
    its rows are kept. An empty table gives an empty result. Other columns are not read.

    Ids may be of any type that has an order. The broadcast filter has 16 bits a row, up to
    ``max_bits`` (128 MB). More rows are taken in slices of the hash range, each with a filter
    of its own within that bound, which is freed when the slice is done.
    """
    spark = df.sparkSession
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    hashed = df.select(F.col(id_col).alias("id"), sha.alias("sha")).withColumn("h", F.xxhash64("sha"))
    total = df.count()
    slices = max(1, -(-total * BITS_PER_ROW // max_bits))
    # by slice, so that each one reads its own rows only
    hashed = hashed.withColumn("slice", F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(slices)).cast("int"))
    hashed = materialize(hashed, "hashes", *(["slice"] if slices > 1 else []))
    kind = dict(hashed.dtypes)["id"]
    want = min(max_bits, max(1024, total * BITS_PER_ROW // slices))
    bits = 1 << (want - 1).bit_length()  # at most max_bits, a power of two
    parts = []
    for k in range(slices):
        own = hashed.filter(F.col("slice") == k).select("id", "sha", "h")
        local = own.select("h").mapInArrow(_local_bits(bits), "word long, ones long, twos long")
        merged = local.repartition("word").sortWithinPartitions("word").mapInArrow(_merge_bits, "word long, twos long")
        table = np.zeros(bits // 64, np.uint64)
        got = merged.toArrow()
        table[got.column("word").to_numpy()] = got.column("twos").to_numpy().view(np.uint64)
        words = spark.sparkContext.broadcast(table)
        part = own.mapInArrow(_probe(words, bits), f"id {kind}, sha string, h long, maybe boolean")
        if slices > 1:
            part = materialize(part, "probed")
            words.destroy()
        parts.append(part)
    probed = parts[0]
    for p in parts[1:]:
        probed = probed.unionByName(p)
    single = probed.filter(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = probed.filter("maybe").select("id", "sha")
    groups = maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = single.unionByName(join_hot(maybe, groups, "sha", "group_size", total))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))

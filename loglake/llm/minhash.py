"""Near-duplicate documents: minima of many universal hashes, bands, verification on full
shingle sets, and connected components by alternating large-star and small-star.

Documents with one shingle set form a class, and only its smallest id goes on. A band's
bucket never emits its pairs: first its members are tested against centers of their
buckets, the closest ones only; once these links are verified and joined into
components, only the members outside a bucket's largest component are compared with its
other members. Before texts are moved, a pair must pass a sketch that loses no link: a bit
array that every shingle flips, in which two sets differ in no more bits than they differ
in shingles.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import join_hot, materialize
from loglake.llm.components import components


@dataclass(frozen=True)
class Shape:
    """Shingles of ``words`` words; links at 100 * intersection >= ``percent`` * union.

    With 36 bands of 7 rows a pair at 0.85 shares no band once in a million times; with
    44 bands of 6 rows that holds for 0.8.
    """

    words: int = 5
    percent: int = 80
    bands: int = 44
    rows: int = 6


CONTRACT = Shape(3, 85, 36, 7)
_U = np.uint64
#: Bits of the array that shingles flip.
ODD = 1024
#: Centers that a member is compared with by sketch, and those it is verified against.
CENTERS, CLOSEST = 8, 3
#: Of a mixed bucket, so many members outside its largest component meet the others in a task.
BLOCK = 1024


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Shingler:
    def __init__(self, shape: Shape):
        self.shape, self.words = shape, _Words()
        rng = np.random.default_rng(65537)
        self.mult = rng.integers(1 << 62, 1 << 63, shape.words, np.uint64) * _U(2) + _U(1)
        n = shape.bands * shape.rows
        self.a = rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)
        self.band_mult = rng.integers(1 << 62, 1 << 63, shape.rows, np.uint64) * _U(2) + _U(1)

    def shingles(self, text: str | bytes | None) -> np.ndarray:
        """The distinct shingles as sorted 64-bit hashes."""
        raw = (text or "").encode() if not isinstance(text, bytes) else text
        words = raw.lower().split()  # bytes: A-Z only, and space, \t, \n, \x0b, \f, \r
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.shape.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h + w[i : len(w) - k + 1 + i] * self.mult[i]
            h ^= h >> _U(29)
        h = h * _U(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> _U(32)))

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> _U(32)).astype(np.uint32)
        out = None
        for at in range(0, len(x), 2048):  # long texts: bounded memory
            m = (np.multiply.outer(self.a, x[at : at + 2048]) + self.b[:, None]).min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def keys(self, m: np.ndarray) -> np.ndarray:
        v = m.reshape(self.shape.bands, self.shape.rows).astype(np.uint64)
        h = (v * self.band_mult).sum(axis=1) + np.arange(self.shape.bands, dtype=np.uint64)
        h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
        return (h ^ (h >> _U(29))).view(np.int64)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        bits = (np.bincount((s & _U(ODD - 1)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)
        return np.packbits(bits).view(np.int64)


def _prepare(shape: Shape):
    def run(batches):
        s = Shingler(shape)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, key, bands, sketch = [], [], [], []
                for t in b.column(1):
                    x = s.shingles(t.as_py())
                    n.append(len(x))
                    key.append(hashlib.blake2b(x.tobytes(), digest_size=12).hexdigest() if len(x) else None)
                    bands.append(s.keys(s.minima(x)) if len(x) else None)
                    sketch.append(s.sketch(x) if len(x) else None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(bands, longs), pa.array(sketch, longs)], names=["id", "n", "k", "bands", "sketch"])

    return run


def _compress(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress((t.as_py() or "").encode(), 1) for t in b.column(1)], pa.binary())], names=["id", "z"])


def _verify(shape: Shape):
    def run(batches):
        s, held, size = Shingler(shape), {}, 0
        for b in batches:
            out = []
            for x, y, zx, zy in zip(*[b.column(i) for i in range(4)]):
                sets = []
                for i, z in ((x.as_py(), zx), (y.as_py(), zy)):
                    if i not in held:
                        if size > 2_000_000:
                            held, size = {}, 0
                        held[i] = s.shingles(zlib.decompress(z.as_py()))
                        size += len(held[i])
                    sets.append(held[i])
                both = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * both >= shape.percent * (len(sets[0]) + len(sets[1]) - both):
                    out.append((x.as_py(), y.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])

    return run


def _apart(x: str, y: str) -> str:
    """SQL: bits in which the flipped arrays of two sets differ; at most |x - y| + |y - x|."""
    return "(" + " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(ODD // 64)) + ")"


def _close(x: str, y: str, shape: Shape) -> str:
    """SQL condition, true for every pair at the threshold: sizes and sketches allow it."""
    sizes = f"100 * least({x}.n, {y}.n) >= {shape.percent} * greatest({x}.n, {y}.n)"
    return f"{sizes} AND {_apart(x, y)} * {100 + shape.percent} <= ({x}.n + {y}.n) * {100 - shape.percent}"


def verified(pairs: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. texts: id, z."""
    kind = dict(texts.dtypes)["id"]
    j = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return materialize(j.select("a", "b", "za", "zb").mapInArrow(_verify(shape), f"a {kind}, b {kind}"), "links")


def near_dedup(df: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    A text without words (null, empty, blank) has no shingles and is linked with nothing;
    one with fewer words than a shingle is one shingle. component_id is the smallest id
    reachable over links, itself included; kept where that is its own id. A null id
    cannot be named by a link: its component_id is null and it is kept. Rows that share
    an id count as one node. Other columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["id"]
    prepared = materialize(docs.mapInArrow(_prepare(shape), f"id {kind}, n long, k string, bands array<long>, sketch array<long>"), "prepared")
    named = prepared.filter("k IS NOT NULL AND id IS NOT NULL")
    classes = materialize(named.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    total = prepared.count()
    reps = materialize(named.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "reps")

    entries = reps.select("id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("c1"), F.min_by("id", F.xxhash64("id", "key")).alias("c2")).filter("size > 1")
    members = join_hot(entries, buckets.hint("merge"), "key", "size", total * shape.bands)
    members = materialize(members.select("key", "id", "c1", "c2"), "members")
    light = reps.select("id", "n", "sketch")
    texts = docs.mapInArrow(_compress, f"id {kind}, z binary").join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = materialize(texts.dropDuplicates(["id"]), "texts")

    # the centers with which a member shares most bands; of these the closest by sketch
    star = members.select("id", F.explode(F.array("c1", "c2")).alias("c")).filter("id <> c").groupBy("id", "c").count()
    star = star.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "c"))).filter(F.col("r") <= CENTERS)
    star = star.join(light.select("id", F.struct("n", "sketch").alias("x")), "id").join(light.select(F.col("id").alias("c"), F.struct("n", "sketch").alias("y")), "c")
    star = star.filter(_close("x", "y", shape)).select("id", "c", F.expr(_apart("x", "y")).alias("d"))
    star = star.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "c"))).filter(F.col("r") <= CLOSEST)
    tested = materialize(star.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct(), "star")
    links = verified(tested, texts, shape)
    comp = components(links)

    # buckets that still hold two or more components: what is outside the largest one
    m = members.select("key", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    m = materialize(m, "bucket-components")
    per = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size")).filter("parts > 1")
    m = join_hot(m, mixed, "key", "size", total * shape.bands).join(reps.select("id", "n", "sketch", "bands"), "id")
    m = materialize(m.select("key", "id", "n", "sketch", "bands", "component", "main", F.expr(f"1 + size div {BLOCK}").alias("blocks")), "mixed")
    rest, x, y = m.filter("component <> main").withColumn("block", F.expr("pmod(xxhash64(id), blocks)")), "x", "y"
    m = m.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    once = "(y.component = y.main OR x.id < y.id)"  # two outsiders meet once
    first = "element_at(filter(zip_with(x.bands, y.bands, (p, q) -> if(p = q, p, null)), p -> p is not null), 1) = x.key"  # in the first band they share
    cross = rest.alias(x).join(m.alias(y), F.expr(f"x.key = y.key AND x.block = y.block AND x.component <> y.component AND {once} AND {_close(x, y, shape)} AND {first}"))
    cross = cross.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()
    cross = materialize(cross.join(tested, ["a", "b"], "left_anti"), "cross")
    more = verified(cross, texts, shape)
    if more.isEmpty():
        final = comp
    else:
        final = components(links.unionByName(more))
    named_classes = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k", F.coalesce("component", "rep").alias("component"), "size")
    linked = join_hot(named, named_classes, "k", "size", total).select("id", "n", "component")
    alone = prepared.filter("k IS NULL OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))

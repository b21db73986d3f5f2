"""A Merkle manifest of a table, with proofs by octopus multiproofs.

Every row is a leaf. The leaves of a group (a source) make a tree of nodes with up to
sixteen children, the roots of the groups another one. Leaves get their places by a range
sort, so that a group of any share of the rows is dealt out, and are cut into partitions of
whole subtrees. A partition hashes what lies in it, lists the coordinates of the nodes that
all its proofs together lack, each once, and gets them in one join. Then it derives the
nodes that its proofs share and writes out each row's proof without further exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import fold, lower_ascii, materialize

FAN = 16
#: A partition is a subtree of so many levels: 4096 leaves at most.
DEPTH = 3
#: Levels of so few nodes are sent to all tasks, for the tree of groups and for groups of
#: over 2^28 rows: all partitions ask for them. 273 nodes a tree, one tree in 2^28 rows.
FEW, WIDE = 256, 1 << 28
TOP = -1  # the tree of groups

_KEY = ["_class", "_a", "_b"]
_NODE = "t long, level int, pos long, n long, hot boolean, h string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Column: sha256 of the fields, each with its length in bytes before it; null is '-'."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(f.cast("string")) for f in fields]), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def octopus(known: np.ndarray, n: int):
    """For each level of a tree from ``n`` nodes up: the nodes that are missing to hash the
    parents of the known ones. The parents are known on the next level."""
    known = np.unique(known)
    while n > 1:
        above = np.unique(known // FAN)
        every = (above[:, None] * FAN + np.arange(FAN)).ravel()
        yield np.setdiff1d(every[every < n], known, assume_unique=True)
        known, n = above, -(-n // FAN)


def _at_level(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    return -(-n // FAN**level)


def _hot(t: int, size: int, n: int) -> bool:
    return n <= FEW and (t == TOP or size > WIDE)


def _hot_column(t: Column, size: Column, n: Column) -> Column:
    return (n <= FEW) & ((t == TOP) | (size > WIDE))


def _up(level: list[str]) -> list[str]:
    return [sha("".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]


def place(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds pos, the number of a row in its group by ``order``, and size, the group's rows. The
    rows are sorted by range, so a large group is many tasks; what is summed up in one place
    is a row for each task and group. ``order`` must tell all rows apart."""
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    runs = ordered.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", (F.col("_first") - before).alias("_zero"), F.sum("_n").over(of).alias("size"))
    return ordered.join(runs, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_zero")).drop("_at", "_part", "_zero")


def _partitioned(leaves: DataFrame, depth: int) -> DataFrame:
    """Adds the partition of a leaf: of a large group, a subtree; small groups of about one
    size that follow each other are together."""
    large, most = F.col("size") > FAN**depth, FAN**depth
    kind = F.when(large, 99).otherwise(F.ceil(F.log2("size")).cast("int"))
    beside = F.when(large, F.col("r")).otherwise(F.floor(F.col("r") / F.pow(F.lit(2.0), F.log2(F.lit(most)) - kind)).cast("long"))
    return leaves.withColumn("_class", kind).withColumn("_a", beside).withColumn("_b", F.when(large, F.floor(F.col("pos") / most).cast("long")).otherwise(F.lit(0).cast("long")))


class _Part:
    """The leaves of one partition by tree, with the nodes that follow from them alone."""

    def __init__(self, table: pa.Table, depth: int):
        r, pos, size = (table.column(c).to_numpy() for c in ("r", "pos", "size"))
        self.order = np.lexsort((pos, r))
        r, pos, size = r[self.order], pos[self.order], size[self.order]
        leaf = table.column("leaf").take(pa.array(self.order)).to_pylist()
        cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist() + [len(r)]
        #: (tree, its leaves, place of the first one, levels of digests)
        self.trees = []
        for a, z in zip(cuts, cuts[1:]):
            levels = [leaf[a:z]]
            for _ in range(min(depth, height(int(size[a])))):
                levels.append(_up(levels[-1]))
            self.trees.append((int(r[a]), int(size[a]), int(pos[a]), levels))

    def roots(self):
        """(tree, leaves, level, place, digest) of the highest nodes."""
        for r, size, first, levels in self.trees:
            k = len(levels) - 1
            yield r, size, k, first // FAN**k, levels[-1][0]

    def missing(self, groups: int):
        """(tree, leaves, level, place) of all nodes that the proofs lack."""
        for r, size, k, at, _ in self.roots():
            for level, lacks in enumerate(octopus(np.array([at]), _at_level(size, k)), k):
                yield from ((r, size, level, int(p)) for p in lacks)
        for level, lacks in enumerate(octopus(np.array([r for r, *_ in self.trees]), groups)):
            yield from ((TOP, groups, level, int(p)) for p in lacks)


def _roots_and_requests(groups: int, depth: int):
    def run(key, table):
        part, rows = _Part(table, depth), []
        for t, size, level, pos, h in part.roots():
            rows.append((t, level, pos, _at_level(size, level), _hot(t, size, _at_level(size, level)), h))
        for t, size, level, pos in part.missing(groups):
            rows.append((t, level, pos, _at_level(size, level), _hot(t, size, _at_level(size, level)), None))
        t, level, pos, n, hot, h = zip(*rows)
        cls, a, b = (k.as_py() for k in key)
        return pa.table({
            "_class": pa.array([cls] * len(rows), pa.int32()), "_a": pa.array([a] * len(rows), pa.int64()), "_b": pa.array([b] * len(rows), pa.int64()), "t": pa.array(t, pa.int64()), "level": pa.array(level, pa.int32()),
            "pos": pa.array(pos, pa.int64()), "n": pa.array(n, pa.int64()), "hot": pa.array(hot), "h": pa.array(h, pa.string()),
        })

    return run


def _upward(nodes: DataFrame, name: str, most: int) -> DataFrame:
    """All levels above ``nodes`` (t, level, pos, n, size, h), and themselves: one written
    table a level, each a sixteenth of the one before. ``most``: nodes of the largest tree."""
    out = nodes = materialize(nodes, name)
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "h")))  # sixteen at most
        up = nodes.filter("n > 1").groupBy("t", "level", "size", F.expr("pos div 16").alias("up"), F.expr("(n + 15) div 16").alias("m")).agg(run.alias("run"))
        up = up.select("t", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.col("m").alias("n"), "size", F.sha2(F.array_join(F.transform("run", lambda x: x["h"]), ""), 256).alias("h"))
        nodes = materialize(up, name)
        out, most = out.unionByName(nodes), -(-most // FAN)
    return out


def _expand(root: str, groups: int, depth: int, proofs: bool):
    """Rows with their proofs, from the leaves of a partition and the nodes it asked for."""

    def derive(nodes: dict, t: int, size: int, level: int, known) -> str:
        """Adds the nodes above the known ones, level by level; the root of the tree."""
        n = _at_level(size, level)
        while n > 1:
            known = {p // FAN for p in known}
            for p in known:
                nodes[t, level + 1, p] = sha("".join(nodes[t, level, c] for c in range(p * FAN, min(p * FAN + FAN, n))))
            level, n = level + 1, -(-n // FAN)
        return nodes[t, level, 0]

    def steps(nodes: dict, t: int, size: int, level: int, pos: int) -> list[tuple[str, str]]:
        """What stands before and behind a node at each level."""
        out, n = [], _at_level(size, level)
        while n > 1:
            a, k = pos - pos % FAN, pos % FAN
            run = "".join(nodes[t, level, p] for p in range(a, min(a + FAN, n)))
            out.append((run[: 64 * k], run[64 * (k + 1) :]))
            level, pos, n = level + 1, pos // FAN, -(-n // FAN)
        return out

    def run(table, fetched):
        part = _Part(table, depth)
        nodes = {(x["t"], x["level"], x["pos"]): x["h"] for x in fetched.to_pylist()}
        for t, size, level, pos, h in part.roots():
            nodes[t, level, pos] = h
            nodes[TOP, 0, t] = derive(nodes, t, size, level, [pos])
        derive(nodes, TOP, groups, 0, [t for t, *_ in part.trees])
        ways = [(steps(nodes, t, size, level, pos) + steps(nodes, TOP, groups, 0, t), nodes[TOP, 0, t]) for t, size, level, pos, _ in part.roots()]
        bad = table.column("tampered").take(pa.array(part.order)).to_pylist()
        leaves, subroots, digests, folded, lists, at = [], [], [], [], [], 0
        for (_, _, _, levels), (above, subroot) in zip(part.trees, ways):
            runs = [["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)] for level in levels[:-1]]
            for i, leaf in enumerate(levels[0]):
                way, h, j = [], bad[at] or leaf, i
                for level in runs:
                    text, k = level[j // FAN], j % FAN
                    way.append((text[: 64 * k], text[64 * (k + 1) :]))
                    j //= FAN
                way += above
                for before, behind in way:
                    h = sha(before + h + behind)
                leaves.append(leaf)
                subroots.append(subroot)
                digests.append(sha("".join(x for pair in way for x in pair)))
                folded.append(h)
                if proofs:
                    lists.append([{"before": x, "behind": y} for x, y in way])
                at += 1
        out = {
            "id": table.column("id").take(pa.array(part.order)), "leaf": pa.array(leaves, pa.string()), "subroot": pa.array(subroots, pa.string()), "root": pa.array([root] * len(leaves), pa.string()),
            "proof_sha256": pa.array(digests, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([h == root for h in folded], pa.bool_()),
        }
        if proofs:
            out["proof"] = pa.array(lists, pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())])))
        return pa.table(out)

    return run


def manifest(df: DataFrame, fields: list[str], tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "source", proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified; with ``proofs``, also proof,
    the digests before and behind the node at each level, from which ``fold_proof`` finds the
    root. ``tampered`` is a column of leaf digests to verify in place of a row's own (null:
    the own one). A partition holds ``FAN**depth`` leaves at most.

    A null group is a group, the first. A null id comes first in its group; rows of one id
    stand in the order of their leaves, and equal rows are leaves of their own. Null and
    empty values of fields differ. Long texts are hashed where they are read; only digests
    move. An empty table gives no rows. Columns that are not in ``fields`` are not read; no
    name can clash."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g")
    bad = (tampered if tampered is not None else F.lit(None)).cast("string").alias("tampered")
    rows = df.select(F.col(id_col).alias("id"), group, leaf_digest(*[F.col(c) for c in fields]).alias("leaf"), bad, F.monotonically_increasing_id().alias("row"))
    leaves = place(materialize(rows, "leaves"), "g", ["id", "leaf", "row"], "leaves")
    trees = place(leaves.groupBy("g").agg(F.max("size").alias("size")).withColumn("all", F.lit(0)).withColumnRenamed("size", "leaves"), "all", ["g"], "trees")
    trees = materialize(trees.select("g", F.col("pos").alias("r")), "trees")
    largest, groups = leaves.agg(F.max("size")).first()[0] or 0, trees.count()
    leaves = materialize(_partitioned(leaves.join(trees, "g"), depth).select(*_KEY, "r", "size", "pos", "id", "leaf", "tampered"), "leaves")

    part = leaves.select(*_KEY, "r", "size", "pos", "leaf").groupBy(*_KEY)
    found = materialize(part.applyInArrow(_roots_and_requests(groups, depth), f"_class int, _a long, _b long, {_NODE}"), "nodes")
    roots = found.filter("h IS NOT NULL")
    sizes = leaves.filter(F.col("size") > FAN**depth).select(F.col("r").alias("t"), "size").distinct()
    large = _upward(roots.filter("n > 1").join(sizes, "t").select("t", "level", "pos", "n", "size", "h"), "nodes", _at_level(largest, depth))
    subroots = roots.filter("n = 1").select("t", "h").unionByName(large.filter("n = 1").select("t", "h"))
    total = F.lit(groups).cast("long")
    top = _upward(subroots.select(F.lit(TOP).cast("long").alias("t"), F.lit(0).alias("level"), F.col("t").alias("pos"), total.alias("n"), total.alias("size"), "h"), "nodes", groups)
    nodes = large.unionByName(top).withColumn("hot", _hot_column(F.col("t"), F.col("size"), F.col("n"))).select("t", "level", "pos", "hot", "h")
    root = top.filter("n = 1").select("h").first()

    asked, where = found.filter("h IS NULL").drop("h", "n"), ["t", "level", "pos"]
    near, far = (nodes.filter(F.col("hot") == hot).drop("hot") for hot in (True, False))
    fetched = asked.filter("hot").join(F.broadcast(near), where).unionByName(asked.filter("NOT hot").join(far, where)).drop("hot")
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<before: string, behind: string>>" * proofs
    both = leaves.groupBy(*_KEY).cogroup(fetched.groupBy(*_KEY))
    return both.applyInArrow(_expand(root[0] if root else "", groups, depth, proofs), out).withColumnRenamed("id", id_col)


def fold_proof(leaf: str, proof) -> str:
    """The root that a leaf and a proof lead to."""
    for step in proof:
        leaf = sha(step["before"] + leaf + step["behind"])
    return leaf


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(df: DataFrame) -> DataFrame:
    """The manifest of documents, where the rows of one fold of ids in five are verified with
    their texts in lower case."""
    lower = leaf_digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    return manifest(df, FIELDS, F.when(fold(F.col("doc_id"), 5) == 0, lower))

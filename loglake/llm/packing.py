"""Sequence packing as vector bin packing.

Every input partition is packed on its own, so nothing is shuffled: a task tokenises its
rows, emits full sequences of the long ones at once and packs what is left in batches of
bounded size. A bin has three limits (tokens, segments, loss-bearing tokens); the next
example is the one with the largest dot product of its sizes with what is left in the
bin. When no example fits, one is cut to fill the bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
#: Remainders are packed in batches of this many; the last bin of a batch is split at
#: powers of two, which need no padding.
BATCH = 2048
END = 1

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_pack(tokens, loss, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=None, cut=True) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, start, length). With ``cut``, an example that fits nowhere is cut
    where the bin is full; loss tokens of an example are its last ones. Without it, each
    example must fit an empty bin, and stays whole."""
    max_loss = max_tokens if max_loss is None else max_loss
    left, lossy = np.array(tokens, np.int64), np.minimum(np.array(loss, np.int64), np.array(tokens, np.int64))
    total, bins, open_ = left.copy(), [], int((left > 0).sum())
    if not cut and len(left) and (left.max() > max_tokens or lossy.max() > max_loss):
        raise ValueError("an example exceeds the limits of an empty sequence")
    while open_:
        room, room_loss, now = max_tokens, max_loss, []
        while open_ and room and len(now) < max_segments:
            score = np.where((left > 0) & (left <= room) & (lossy <= room_loss), left * (room / max_tokens**2) + lossy * (room_loss / max(1, max_loss) ** 2) + 1.0 / max_segments, -1.0)
            k = int(score.argmax())
            n = int(left[k])
            if score[k] < 0:
                if not cut:
                    break
                k = int(left.argmax())
                n = min(room, int(left[k] - lossy[k]) + room_loss, int(left[k]))
                if not n:
                    break
            head = min(n, int(left[k] - lossy[k]))
            now.append((k, int(total[k] - left[k]), n))
            room, room_loss = room - n, room_loss - (n - head)
            left[k] -= n
            lossy[k] -= n - head
            open_ -= left[k] == 0
        bins.append(now)
    return bins


def _powers(items: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of one bin, cut into sequences whose lengths are powers of two."""
    items = list(items)[::-1]
    rest = sum(x[2] for x in items)
    while rest:
        size = room = 1 << (rest.bit_length() - 1)
        now = []
        while room:
            k, start, n = items.pop()
            if n > room:
                items.append((k, start + room, n - room))
                n = room
            now.append((k, start, n))
            room -= n
        rest -= size
        yield now


def pack_partition(rows: Iterator[tuple[int | None, np.ndarray]], first_id: int) -> Iterator[tuple]:
    """Pieces of (id, token ids) rows, with sequence ids counted from ``first_id``."""
    seq, held = first_id, []

    def piece(doc, ids, start, n, offset):
        return doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), seq, offset

    def flush():
        nonlocal seq
        sizes = [len(ids) - at for _, ids, at in held]
        # a document's first token has nothing before it to be predicted from
        bins = dot_product_pack(sizes, [n - (at == 0) for n, (_, _, at) in zip(sizes, held)])
        for b in bins:
            full = sum(x[2] for x in b) == MAX_TOKENS
            for s in [b] if full else _powers(b):
                offset = 0
                for k, start, n in s:
                    doc, ids, at = held[k]
                    yield piece(doc, ids, at + start, n, offset)
                    offset += n
                seq += 1
        held.clear()

    for doc, ids in rows:
        at = 0
        while len(ids) - at >= MAX_TOKENS:
            yield piece(doc, ids, at, MAX_TOKENS, 0)
            at += MAX_TOKENS
            seq += 1
        if at < len(ids):
            held.append((doc, ids, at))
        if len(held) >= BATCH:
            yield from flush()
    yield from flush()


class Tokens:
    """Ids of byte_bpe_50k.json with the end id after each text.

    ``tiktoken`` gives the same ids from the same vocabulary four times as fast, but its
    tables of Unicode classes are its own. So it takes texts of characters below U+0250,
    where a test compares both for every character; all other texts, and those that hold
    a special token, go to ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        self.other = re.compile(r"[^\x00-ɏ‐-‟…]|<\|endoftext\|>").search

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        ids = self.full.encode(text, add_special_tokens=False).ids if self.other(text) else self.fast.encode_ordinary(text)
        return np.array([*ids, END], "<u4")


def _pack(json_path: str, ranks_path: str, pattern: str):
    def run(batches):
        tokens = Tokens(json_path, ranks_path, pattern)

        kind = pa.int64()

        def rows():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                for doc, text in zip(b.column(0), b.column(1)):
                    yield doc.as_py(), tokens(text.as_py())

        def batch():
            ids, *numbers = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, pa.int64()) for c in numbers]], names=names)

        names, out = ["doc_id", *[c.split()[0] for c in PIECE.split(", ")]], []
        for p in pack_partition(rows(), TaskContext.get().partitionId() << 32):
            out.append(p)
            if len(out) == 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def _id(df: DataFrame, id_col: str):
    """The id: numbers as longs, all else of its own type."""
    c = F.col(id_col)
    kind = dict(df.select(c.alias("id")).dtypes)["id"]
    return (c.cast("long"), "long") if kind in ("tinyint", "smallint", "int", "bigint") else (c, kind)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then the end id, all but the first loss-bearing. Null and
    empty texts are the end id alone. Ids of any type; a null id is kept as null; repeated rows are
    packed once each. An empty table gives no pieces. Other columns are not read.

    A sequence id is the partition's number in the upper bits and a count in the lower
    ones, so that a task that runs again gives the same ids.
    """
    import public_tokenizers as P

    doc_id, kind = _id(df, id_col)
    docs = df.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_pack(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), f"doc_id {kind}, {PIECE}")


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = MAX_TOKENS, max_segments: int = 64, max_loss: int | None = None) -> DataFrame:
    """Instruction data with given sizes, packed whole under all three limits.

    Returns id, sequence_id, position. Ids of any type, null too; repeated rows are packed once
    each. A null size counts as 0; examples without tokens are left out; one that exceeds an
    empty sequence raises ValueError. An empty table gives no rows; other columns are not read.
    """
    example, kind = _id(df, id_col)

    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                ids, tokens, loss = (part.column(i).to_pylist() for i in range(3))
                out = []
                for bin_ in dot_product_pack(tokens, loss, max_tokens, max_segments, max_loss, cut=False):
                    out += [(ids[k], seq, i) for i, (k, _, _) in enumerate(bin_)]
                    seq += 1
                if out:
                    names, at_seq, position = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(names, b.schema.field(0).type), pa.array(at_seq, pa.int64()), pa.array(position, pa.int64())], names=["id", "sequence_id", "position"])

    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = df.select(example.alias("id"), size(tokens_col).alias("t"), size(loss_col).alias("l"))
    return rows.mapInArrow(run, f"id {kind}, sequence_id long, position long").withColumnRenamed("id", id_col)

"""Byte-level BPE as a lazily determinised finite-state transducer.

The encoding of a prefix is a prefix chain: the last token of every prefix of a piece,
each with the prefix that it was added to, form a tree. A new byte adds one node to it:
the token that ends there is the one whose bytes are a suffix, and which follows the last
token of the prefix before it without a merge across the seam. Only prefixes from which
a vocabulary entry may still go on matter; when all of them share an ancestor, the
tokens up to it are final and are emitted. So the lookahead is bounded by the longest
entry. What is left, the shape of the live tree, is the state. States are numbered and
their transitions kept when they are met again; where a piece takes a transition for the
first time, its tree is followed to the end of the piece without making states.

Decoding joins the bytes of ids; an incremental UTF-8 automaton turns them into text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(piece: bytes, ranks: dict[bytes, int]):
    """Plain BPE: the parts after each merge of the leftmost pair of least rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
        yield parts


class Transducer:
    """A state is a tuple of nodes (parent, token, place): the live tree in the order of
    the prefixes. Node 0 is the root, whose tokens are all emitted; ``token`` is the last
    token of that prefix (-1: none) and ``place`` where the bytes read since have led to in
    the trie of the vocabulary, or -1 where no entry goes on from there."""

    START = ((-1, -1, 0),)

    def __init__(self, ranks: dict[bytes, int], most_states: int = 100_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        # the trie: (place << 8 | byte) -> place; the entry at a place, and whether one goes on
        self.next, self.entry, self.more = {}, [-1], [True]
        for b, t in ranks.items():
            at = 0
            for x in b:
                self.more[at] = True
                if (to := self.next.get(at << 8 | x)) is None:
                    to = self.next[at << 8 | x] = len(self.entry)
                    self.entry.append(-1)
                    self.more.append(False)
                at = to
            self.entry[at] = t
        self.edge: dict[int, tuple[list[bytes], list[bytes]] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.numbers, self.states, self.steps, self.ends = {self.START: 0}, [self.START], {}, {}
        self.once, self.seams = set(), {}

    def _edges(self, t: int) -> tuple[list[bytes], list[bytes]] | None:
        """What stands at the left and at the right end of entry ``t`` while it is merged
        from its bytes, in the order of time; None if merging its bytes gives another result."""
        if t not in self.edge:
            parts, b = None, self.bytes_of[t]
            left, right = [b[:1]], [b[-1:]]
            for parts in merges(b, self.ranks):
                if parts[0] != left[-1]:
                    left.append(parts[0])
                if parts[-1] != right[-1]:
                    right.append(parts[-1])
            self.edge[t] = (left, right) if parts is None or len(parts) == 1 else None
            if len(b) == 1:
                self.edge[t] = (left, right)
        return self.edge[t]

    def _follows(self, a: int, b: int) -> bool:
        seam = (a + 1) << 20 | b
        if seam not in self.seams:
            self.seams[seam] = self._meet(a, b)
        return self.seams[seam]

    def _meet(self, a: int, b: int) -> bool:
        """Whether ``b`` can stand after ``a``: while both are merged from bytes, no pair
        that meets at the seam comes before the next merge on its left and right."""
        two = self._edges(b)
        if two is None or a < 0:
            return two is not None
        x, y, i, j, rank, never = self._edges(a)[1], two[0], 0, 0, self.ranks, 1 << 60
        while True:
            next_x = rank[x[i + 1]] if i + 1 < len(x) else never
            next_y = rank[y[j + 1]] if j + 1 < len(y) else never
            seam = rank.get(x[i] + y[j], never)
            if seam < next_x and seam <= next_y and seam < never:  # of equal ranks the leftmost goes first
                return False
            if next_x == next_y == never:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        nodes = self.states[state]
        live, parent, token = {}, -1, -1
        for k, (_, last, place) in enumerate(nodes):
            to = self.next.get(place << 8 | byte) if place >= 0 else None
            if to is not None:
                if parent < 0 and (t := self.entry[to]) >= 0 and self._follows(last, t):
                    parent, token = k, t
                if self.more[to]:
                    live[k] = to
        # the nearest node above all that is live: what leads to it is final
        new = len(nodes)
        above = [n[0] for n in nodes]
        above.append(parent)
        root = new
        for k in live:
            while root != k:
                if root > k:
                    root = above[root]
                else:
                    k = above[k]
        out, k = [], root
        while k:
            out.append(token if k == new else nodes[k][1])
            k = above[k]
        # what is live stays, with all between it and that node
        kept = {new, root}
        for k in (new, *live):
            while k not in kept or k == new and k != root:
                kept.add(k)
                k = above[k]
        order = sorted(kept)
        key = [(-1, token if root == new else nodes[root][1], 0 if root == new else live.get(root, -1))]
        for k in order[1:]:
            key.append((order.index(above[k]), token, 0) if k == new else (order.index(above[k]), nodes[k][1], live.get(k, -1)))
        key, out = tuple(key), out[::-1]
        if (number := self.numbers.get(key)) is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, tuple(out)

    def _end(self, state: int) -> list[int]:
        """The tokens still held when the piece ends: the path to the newest node."""
        nodes, out = self.states[state], []
        k = len(nodes) - 1
        while k > 0:
            out.append(nodes[k][1])
            k = nodes[k][0]
        return out[::-1]

    def _run(self, state: int, piece: bytes, at: int) -> list[int]:
        """The tokens from ``state`` to the end of the piece, with no states made on the way."""
        nodes = self.states[state]
        above, token = [n[0] for n in nodes], [n[1] for n in nodes]
        live = [(k, n[2]) for k, n in enumerate(nodes) if n[2] >= 0]
        follow, entry, more, seams = self.next.get, self.entry, self.more, self.seams
        for byte in piece[at:]:
            parent, found, go = -1, -1, []
            for k, place in live:
                to = follow(place << 8 | byte)
                if to is not None:
                    if parent < 0 and (t := entry[to]) >= 0:
                        seam = (token[k] + 1) << 20 | t
                        if seam not in seams:
                            seams[seam] = self._meet(token[k], t)
                        if seams[seam]:
                            parent, found = k, t
                    if more[to]:
                        go.append((k, to))
            go.append((len(token), 0))
            above.append(parent)
            token.append(found)
            live = go
        out, k = [], len(token) - 1
        while k > 0:
            out.append(token[k])
            k = above[k]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:  # an entry stands for itself
            return [whole]
        if len(self.states) > self.most_states or len(self.once) + len(self.seams) > 10 * self.most_states:
            self.clear()
        state, out, steps = 0, [], self.steps
        for at, b in enumerate(piece):
            step = steps.get((state, b))
            if step is None:
                if (state, b) not in self.once:  # most transitions are taken once only: not kept yet
                    self.once.add((state, b))
                    return out + self._run(state, piece, at)
                step = steps[state, b] = self._step(state, b)
            state, tokens = step
            if tokens:
                out += tokens
        if (rest := self.ends.get(state)) is None:
            rest = self.ends[state] = self._end(state)
        return out + rest


def _utf8_steps() -> list[list[int]]:
    """The automaton: next state by state and byte; -1 where a byte cannot come.

    State 0 is between characters; 1, 2 and 3 wait for so many bytes of any value from 80 to
    BF; 4 to 7 wait for the second byte after E0, ED, F0 and F4, whose range is narrower, as
    no character has two forms and none is a surrogate or above 10FFFF."""
    steps = [[-1] * 256 for _ in range(8)]

    def go(state: int, low: int, high: int, to: int) -> None:
        steps[state][low : high + 1] = [to] * (high + 1 - low)

    go(0, 0x00, 0x7F, 0)
    for low, high, to in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        go(0, low, high, to)
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        go(state, low, high, to)
    return steps


_STEPS = _utf8_steps()
#: The bits of a first byte that belong to the character, by the state it leads to.
_FIRST = [0x7F, 0x1F, 0x0F, 0x07, 0x0F, 0x0F, 0x07, 0x07]
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]+")


class Utf8Stream:
    """Incremental decoding of UTF-8 by an automaton. Its state is the number of the state and
    the bits of the character so far; nothing is held back. What cannot go on becomes U+FFFD,
    once for each longest part that could have. Runs of ASCII are passed on whole, as they
    leave state 0 where it is."""

    def __init__(self):
        self.state = self.bits = 0

    def _ascii(self, run: bytes, out: list[str]) -> None:
        if run and self.state:
            out.append("\ufffd")
            self.state = 0
        out.append(run.decode("ascii"))

    def feed(self, chunk: bytes, last: bool = False) -> str:
        out, at = [], 0
        for m in _BEYOND_ASCII.finditer(chunk):
            self._ascii(chunk[at : m.start()], out)
            state, bits = self.state, self.bits
            for b in m[0]:
                to = _STEPS[state][b]
                if to < 0:
                    out.append("\ufffd")
                    if state:  # the byte may begin a character
                        to = _STEPS[0][b]
                        if to < 0:
                            out.append("\ufffd")
                    state = max(to, 0)
                    bits = b & _FIRST[state]
                elif state:
                    bits = bits << 6 | b & 0x3F
                    state = to
                    if not to:
                        out.append(chr(bits))
                else:
                    state, bits = to, b & _FIRST[to]
            self.state, self.bits, at = state, bits, m.end()
        self._ascii(chunk[at:], out)
        if last and self.state:
            out.append("\ufffd")
            self.state = 0
        return "".join(out)


class _Memo(dict):
    """Piece → its ids as bytes; emptied when it is full."""

    def __init__(self, fst: Transducer, most: int):
        self.fst, self.most = fst, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[piece] = np.array(self.fst.encode(piece.encode()), "<u4").tobytes()
        return got


#: A pattern whose classes ``re`` has too, in characters where its letters, digits and
#: spaces are those of the original: a test compares both for every character.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMMON_FAST = r""" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
COMMON_OTHER = r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]"


class Codec:
    """Encodes texts by pieces of ``pattern`` and decodes ids, with a bounded memo of
    pieces: words repeat, so most pieces are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 800_000):
        import re

        import regex

        full = regex.compile(pattern).findall
        if pattern == COMMON_PATTERN:
            fast, other = re.compile(COMMON_FAST).findall, re.compile(COMMON_OTHER).search
            self.split = lambda text: full(text) if other(text) else fast(text)
        else:
            self.split = full
        self.fst = Transducer(ranks)
        self.table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.table[i] = b
        self.memo = _Memo(self.fst, memo)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray, chunk: int = 4096) -> str:
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), chunk):
            out.append(stream.feed(self.decode_bytes(ids[at : at + chunk])))
        return "".join(out) + stream.feed(b"", last=True)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(read_ranks(path), pattern)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of ints). Null and empty texts give an empty array; rows are kept
    one to one, with their order in a partition; other columns are not read."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [c.encode(t.as_py() or "").astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text, decoded as a stream. A null array gives an empty text; an id outside
    the vocabulary raises IndexError."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            texts = [c.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def bpe_digest(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, decoded_chars: encodes, decodes the ids as a
    stream and hashes both; decoded_chars counts the characters that the automaton finds in
    the bytes. A row for every row, repeated ones and null ids too; null and empty texts have
    no tokens; other columns are not read; an empty table gives no rows."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            n, a, z, k = [], [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                stream, h, size = Utf8Stream(), hashlib.sha256(), 0
                for at in range(0, len(ids), 65536):
                    raw = c.decode_bytes(ids[at : at + 65536])
                    h.update(raw)
                    size += len(stream.feed(raw, last=at + 65536 >= len(ids)))
                z.append(h.hexdigest())
                k.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string()), pa.array(k, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long").withColumnRenamed("id", id_col)

"""Token counts by rank-synchronous merging of arrays.

The pre-tokens of many texts lie end to end in one array of symbols. In every round each
pre-token's pair of lowest rank is applied, in all pre-tokens at once, until no pair of any
of them is a merge; what survives is counted. A merge only makes pairs of higher rank (a
token is made before it is used), so all places of one pair within a pre-token go together,
from the left where they overlap. Long pre-tokens take their pairs in the order of ranks
from a queue instead, so that a round touches only what it changes.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.bpe import COMMON_FAST, COMMON_OTHER, COMMON_PATTERN

NO = np.int64(1) << 40
#: Pre-tokens of more bytes take their merges from the queue.
LONG = 128
#: Characters of the texts that are split before their new pre-tokens are counted, and
#: entries of the memo, which is emptied when it is full.
AT_ONCE, MEMO = 2_000_000, 400_000
#: Where a longer text may be cut: a piece of the pattern ends between a letter and a space
#: with a letter behind it, whatever else the text holds.
CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
CUT_EVERY = 1_000_000


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for 256 and on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class RankMerger:
    """Counts of byte-level BPE tokens from a ``tokenizers`` file without a normaliser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        vocab = model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.width = len(vocab) + 1
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(set(self.merged.tolist())) < len(pairs):
            raise ValueError("two merges make one token, so ranks do not rise")
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.first = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.first[b] = vocab[letter]
        # special tokens in a text are one token each, and cut it
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.fast, self.other = re.compile(COMMON_FAST).findall, re.compile(COMMON_OTHER).search
        self.full = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.memo: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens. The library's own splitter takes texts with characters that its tables
        of classes and those of ``re`` may differ in."""
        if self.other(text):
            return [text[a:z] for _, (a, z) in self.full(text)]
        return self.fast(text)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO)

    @staticmethod
    def _apart(follows: np.ndarray) -> np.ndarray:
        """Of hits that overlap in runs (``follows``: each with the one before it), every
        second one from the left."""
        at = np.arange(len(follows))
        return (at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0

    def _rounds(self, sym: np.ndarray, seq: np.ndarray, out: np.ndarray) -> None:
        """Merges all sequences round by round; ``seq`` rises, and out[seq] gets the counts."""
        rank = np.full(len(sym), NO)  # of the pair that begins at a place
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NO
            if done.any():
                out[seq[starts[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    return
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            hits = hits[self._apart(np.r_[False, hits[1:] == hits[:-1] + 1])]
            sym[hits] = self.merged[rank[hits]]
            gone = np.ones(len(sym), bool)
            gone[hits + 1] = False
            now = hits - np.arange(len(hits))  # their places when the seconds are gone
            sym, seq, rank = sym[gone], seq[gone], rank[gone]
            for at in (now, now[now > 0] - 1):
                to = np.minimum(at + 1, len(sym) - 1)
                rank[at] = np.where((to > at) & (seq[at] == seq[to]), self._ranks(sym[at], sym[to]), NO)

    def _queue(self, sym: np.ndarray, seq: np.ndarray, out: np.ndarray) -> None:
        """The same for long sequences: linked places, and a queue of ranks with the places
        at which each was seen."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, held, ranks = np.full(n, NO), {}, []

        def look(at: np.ndarray) -> None:
            to = after[at]
            inside = np.minimum(to, n - 1)
            rank[at] = np.where((to < n) & (seq[at] == seq[inside]), self._ranks(sym[at], sym[inside]), NO)
            at = at[rank[at] < NO]
            at = at[np.argsort(rank[at], kind="stable")]
            values, first = np.unique(rank[at], return_index=True)
            for r, part in zip(values.tolist(), np.split(at, first[1:])):
                if r not in held:
                    held[r] = []
                    heapq.heappush(ranks, r)
                held[r].append(part)

        if n:
            look(np.arange(n))
        lost = np.zeros(len(out), np.int64)
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(held.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[self._apart(np.r_[False, after[at[:-1]] == at[1:]])]
            second = after[at]
            sym[at], rank[second] = self.merged[r], NO
            after[at] = after[second]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            lost += np.bincount(seq[at], minlength=len(out))
            look(np.union1d(at, before[at][before[at] >= 0]))
        for s, k in zip(*np.unique(seq, return_counts=True)):
            out[s] = k - lost[s]

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [p.encode() for p in pieces]
        sizes, out = np.array([len(b) for b in raw], np.int64), np.zeros(len(raw), np.int64)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), sizes)
        long = np.repeat(sizes > LONG, sizes)
        self._rounds(sym[~long], seq[~long], out)
        self._queue(sym[long], seq[long], out)
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out, held, size = np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            new = list(set().union(*(pieces for _, pieces in held)).difference(self.memo))
            known, found = self.memo, dict(zip(new, self.count_pieces(new).tolist()))
            for i, pieces in held:
                out[i] += sum(found[p] if p in found else known[p] for p in pieces)
            known.update((p, k) for p, k in found.items() if k <= LONG and len(p) <= LONG)
            held.clear()

        for i, text in enumerate(texts):
            for part in _cut(text):
                out[i] += sum(1 for _ in self.added.finditer(part))
                for plain in self.added.split(part):
                    held.append((i, self.split(plain)))
                    size += len(plain)
                    if size > AT_ONCE:
                        flush()
                        size = 0
        flush()
        return out


def _cut(text: str):
    """The text, or parts of a very long one that have the same pre-tokens."""
    at = 0
    while len(text) - at > 2 * CUT_EVERY:
        m = CUT.search(text, at + CUT_EVERY)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """One for each Python worker."""
    return RankMerger(path)


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit: the tokens of each whole text by the vocabulary in
    ``path``, and whether they are more than ``limit``.

    One row for every row, repeated ones and null ids too; null and empty texts have no bytes
    and no tokens; an empty table gives no rows; other columns are not read, so their names
    cannot clash. Nothing is shuffled; a task holds one batch of texts."""

    def run(batches):
        m = merger(path)
        for b in batches:
            n = m.count([t.as_py() or "" for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

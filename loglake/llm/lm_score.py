"""Language-model scoring with a trie of n-grams in Elias-Fano levels.

Texts are cut into chunks of whole rows. For each order of the model, a chunk sends its
distinct n-grams, with their counts in training rows, to the shards of that level; a shard
adds them up, writes its part of the trie, looks every n-gram up in it, and answers the
chunk. So a task reads its own shard only, whatever the size of the model, and what moves
is added up before.

Levels are files in the shared folder, mapped into memory where it is mounted:

* words: Elias-Fano sequence of 64-bit hashes, their counts and ranks by count. A word's
  number is its rank in the shard, then the shard: small for frequent words, which then
  take few bytes in all that moves.
* pairs and triples: the contexts (numbers of a word, of a pair), the monotone pointers to
  their successors, and the successors (relative to the context, made monotone by the
  context's place) are Elias-Fano sequences; probabilities are 16-bit codes of logarithms.

p(w | c) = kept(c, w) + (1 - kept mass) * p(w | shorter c), with kept(c, w) = n(c w) / (n(c) + m)
and mass m / (n(c) + m) for the shorter context; p(w) = (n(w) + 1) / (N + V + 1). It sums to
one over the vocabulary and one unknown word. Nothing is pruned.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import fold, materialize, shared_path

#: Weight of the shorter context, as a count: for pairs, for triples.
WEIGHTS = (300.0, 3.0)
#: Tokens of a chunk, and tokens for each shard.
CHUNK, SHARD = 2_000_000, 2_000_000
#: A context's successors are dealt to shards in blocks of this many word numbers (a power of 2).
BLOCK_BITS = 8
#: Quantised probabilities: code q stands for 2 ** (-q / STEPS).
STEPS = 1024
ABSENT = 65535
_U = np.uint64


# --- files ---------------------------------------------------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays. It takes its name when it is complete, so a task that runs
    again, or twice at once, leaves the same file."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw = len(raw).to_bytes(8, "little") + raw
    raw += b" " * (-len(raw) % 8)
    fs, path = _fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    spare = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(spare) as f:
        f.write(raw)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    fs.move(spare, path)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the folder is mounted, else read."""
    fs, path = _fs(uri)
    if os.path.exists(path) and fs.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    start = -(-(8 + n) // 8) * 8
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[start + at : start + at + np.dtype(t).itemsize * m].view(t) for k, (t, m, at) in head.items()}


def _uri(path: str) -> str:
    """A place in the shared folder as pyarrow takes it."""
    if "://" in path:
        return path
    return "file://" + path if path.startswith("/") else path.replace("file:/", "file:///")


def _exists(uri: str) -> bool:
    fs, path = _fs(uri)
    return bool(fs.get_file_info(path).is_file)


# --- Elias-Fano ----------------------------------------------------------------------------


#: The place of the k-th one in a byte, from the lowest bit, at 8 * byte + k.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint64).ravel()
#: A one in every byte, and the highest bit of every byte.
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each 64-bit word."""
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # ones up to each byte
    at = ((((((k * _EACH) | _TOPS) - s) & _TOPS) >> _U(7)) * _EACH >> _U(56)) << _U(3)  # bits of the bytes before
    inner = k - (((s << _U(8)) >> at) & _U(255))
    return at + _PLACE[((((x >> at) & _U(255)) << _U(3)) + inner).astype(np.int64)]


def bits_packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2 ** bits, bit by bit in 64-bit words."""
    at = np.arange(len(values)) * bits
    w, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if len(values):
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        out[w[start]] = np.bitwise_or.reduceat(values << shift, start)
        over = np.flatnonzero((at & 63) + bits > 64)  # at most one number runs over the end of a word
        out[w[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


def bits_at(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    """The numbers at places ``i`` of packed bits."""
    at = i * bits
    w, shift = at >> 6, (at & 63).astype(np.uint64)
    return ((words[w] >> shift) | ((words[w + 1] << _U(1)) << (_U(63) - shift))) & _U((1 << bits) - 1)


class EliasFano:
    """A sequence of ascending numbers: low bits packed, high bits in unary, with the count
    of ones before every 64-bit word for selection."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}.shape"])
        self.low, self.high, ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones"))
        self.ones = ones.astype(np.int64)
        self.zeros = np.arange(len(ones)) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        low_bits = min(63, max(1, (universe // max(1, n)).bit_length() - 1))
        high = (values >> _U(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))[:-1]]
        return {
            f"{name}.shape": np.array([n, low_bits], np.int64),
            f"{name}.low": bits_packed(values & _U((1 << low_bits) - 1), low_bits),
            f"{name}.high": words,
            f"{name}.ones": ones.astype(np.uint32),
        }

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero (from 0)."""
        before = self.ones if one else self.zeros
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 1 << 16):
            q = k[at : at + (1 << 16)]
            w = np.searchsorted(before, q, "right") - 1
            word = self.high[w] if one else ~self.high[w]
            out[at : at + len(q)] = w * 64 + _in_word(word, (q - before[w]).astype(np.uint64)).astype(np.int64)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << _U(self.low_bits)) | bits_at(self.low, self.low_bits, i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each ``x`` (-1: absent), looked for within [first, last) if given."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> _U(self.low_bits)).astype(np.int64)
        ok = np.flatnonzero(high < len(self.high) * 64 - self.n)  # as many zeros as there are
        high, low = high[ok], x[ok] & _U((1 << self.low_bits) - 1)
        end = self._select(high, False) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        if first is not None:
            start, end = np.maximum(start, first[ok]), np.minimum(end, last[ok])
        stop = end
        while (open_ := np.flatnonzero(start < end)).size:  # the successor of each low part in its bucket
            middle = (start[open_] + end[open_]) >> 1
            less = bits_at(self.low, self.low_bits, middle) < low[open_]
            start[open_[less]] = middle[less] + 1
            end = end.copy() if end is stop else end
            end[open_[~less]] = middle[~less]
        hit = np.flatnonzero(start < stop)
        hit = hit[bits_at(self.low, self.low_bits, start[hit]) == low[hit]]
        out[ok[hit]] = start[hit]
        return out


# --- what moves ----------------------------------------------------------------------------


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of whole numbers as compressed bytes: first bytes together, then second ones,
    as many as the largest number takes; of ascending numbers the differences."""
    head, body = [], []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        rises = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rises:
            a = np.r_[a[:1], np.diff(a)]
        kind = a.dtype
        if kind.kind == "u" and len(a):
            a = a.astype(np.min_scalar_type(int(a.max())))
        head.append([k, kind.str, a.dtype.str, len(a), rises])
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(raw).to_bytes(8, "little") + raw + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    out, at = {}, 8 + n
    for k, kind, moved, size, rises in json.loads(raw[8 : 8 + n]):
        width = np.dtype(moved).itemsize
        part = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out[k] = np.ascontiguousarray(part.T).view(moved).ravel().astype(kind, copy=False)
        if rises:
            out[k] = np.cumsum(out[k], dtype=np.uint64)
        at += width * size
    return out


def _write(uri: str, data: bytes) -> None:
    """A file that takes its name when it is complete."""
    fs, path = _fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    spare = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(spare) as f:
        f.write(data)
    fs.move(spare, path)


def _read(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


# --- words ---------------------------------------------------------------------------------

END = xxhash.xxh3_64_intdigest(b"\n")  # no word has this form


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _chunks(batches) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole rows (id, train, text): ids, training marks, lengths, hashes of the
    tokens, of which the last one of each text is the end."""
    hashes = _Hashes()
    ids, train, parts, size = [], [], [], 0

    def chunk():
        return pa.chunked_array(ids).combine_chunks(), np.array(train, np.uint8), np.array([len(p) for p in parts], np.int64), np.concatenate(parts)

    for b in batches:
        start = 0
        marks = b.column(1).to_pylist()
        for r, text in enumerate(b.column(2)):
            words = (text.as_py() or "").encode().lower().split()  # bytes: A-Z and ASCII spaces only
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            h[-1] = END
            parts.append(h)
            train.append(marks[r])
            size += len(h)
            if size >= CHUNK:
                ids.append(b.column(0).slice(start, r + 1 - start))
                yield chunk()
                ids, train, parts, size, start = [], [], [], 0, r + 1
        if start < b.num_rows:
            ids.append(b.column(0).slice(start))
    if parts:
        yield chunk()


# --- shards --------------------------------------------------------------------------------


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(keys) else counts


def _mix(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash by which a context's block of successors is dealt."""
    x = (c * _U(0x9E3779B97F4A7C15)) ^ (w >> _U(BLOCK_BITS))
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(33))


def _count_of(code: np.ndarray, total: np.ndarray, weight: float) -> np.ndarray:
    """The count of an n-gram whose context has been seen ``total`` times, from its code."""
    n = 2.0 ** (-code.astype(np.float64) / STEPS) * (total + weight)
    return np.where(code < ABSENT, np.maximum(1, np.rint(n)), 0).astype(np.uint64)


def _code_of(n: np.ndarray, total: np.ndarray, weight: float) -> np.ndarray:
    """The code of an n-gram that was seen ``n`` times; ``_count_of`` gives back ``n`` below a
    thousand, and what has the same code above."""
    p = np.maximum(n, 1) / (total + weight)
    return np.where(n > 0, np.clip(np.rint(-np.log2(p) * STEPS), 0, ABSENT - 1), ABSENT).astype(np.uint16)


class Words:
    """The first level of a shard."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.hashes, self.counts, self.ranks = EliasFano(arrays, "hash"), arrays["count"], arrays["rank"]

    @staticmethod
    def build(parts: list[dict], low: int, width: int) -> dict[str, np.ndarray]:
        h, n = (np.concatenate([p[k] for p in parts]) for k in ("hash", "n"))
        h, n = _added(h[n > 0], n[n > 0].astype(np.int64))
        kind = np.min_scalar_type(int(n.max())) if len(n) else np.uint8
        rank = np.empty(len(n), np.min_scalar_type(len(n)))
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        return EliasFano.build(h - _U(low), width, "hash") | {"count": n.astype(kind), "rank": rank}

    def answer(self, part: dict, low: int) -> dict[str, np.ndarray]:
        at = self.hashes.find(part["hash"] - _U(low))
        known = at >= 0
        count = np.zeros(len(at), np.uint64)
        count[known] = self.counts[at[known]]
        number = np.zeros(len(at), np.uint64)
        number[known] = self.ranks[at[known]]
        return {"number": number, "count": count}


class Successors:
    """A later level of a shard: probabilities of (context, word)."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.contexts, self.pointers, self.words = (EliasFano(arrays, k) for k in ("contexts", "pointers", "words"))
        self.code, self.bits = arrays["code"], _U(arrays["bits"][0])

    @staticmethod
    def build(parts: list[dict], weight: float) -> dict[str, np.ndarray]:
        contexts, totals = (np.concatenate([p[k] for p in parts]) for k in ("context", "total"))
        order = np.unique(contexts, return_index=True)
        contexts, totals = order[0], totals[order[1]]
        # a pair is its context's place among the contexts, and the word
        bits = _U(max(1, int(max((p["word"].max() for p in parts if len(p["word"])), default=0)).bit_length()))
        keys = [(np.repeat(np.searchsorted(contexts, p["context"]), p["runs"]).astype(np.uint64) << bits) | p["word"] for p in parts]
        n = np.concatenate([p["n"] for p in parts]).astype(np.int64)
        keys, n = _added(np.concatenate(keys)[n > 0], n[n > 0])
        place = (keys >> bits).astype(np.int64)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(keys) else np.zeros(0, np.int64)
        kept = place[start]
        relative = (np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(keys)])).astype(np.uint64) << bits) | (keys & ((_U(1) << bits) - _U(1)))
        return (
            EliasFano.build(contexts[kept], int(contexts[kept][-1]) + 1 if len(kept) else 1, "contexts")
            | EliasFano.build(np.r_[start, len(keys)].astype(np.uint64), len(keys) + 1, "pointers")
            | EliasFano.build(relative, max(1, len(start)) << int(bits), "words")
            | {"code": _code_of(n, totals[place], weight), "bits": np.array([bits], np.int64)}
        )

    def answer(self, part: dict, weight: float) -> dict[str, np.ndarray]:
        """Places of the pairs of a part, in their order, and the counts that their codes stand
        for: most are 1, which takes less room than a code."""
        number, code = np.zeros(len(part["word"]), np.uint64), np.full(len(part["word"]), ABSENT, np.uint16)
        found = self.contexts.find(part["context"])
        place = np.repeat(found, part["runs"])
        ok = np.flatnonzero((place >= 0) & (part["word"] >> self.bits == 0))
        if len(ok):
            near = np.maximum(found, 0)
            first, last = (np.repeat(self.pointers.access(near + i).astype(np.int64), part["runs"])[ok] for i in (0, 1))
            at = self.words.find((place[ok].astype(np.uint64) << self.bits) | part["word"][ok], first, last)
            ok, at = ok[at >= 0], at[at >= 0]
            number[ok], code[ok] = at, self.code[at]
            number = np.maximum.accumulate(number)  # those of absent pairs are not read
        total = np.repeat(part["total"], part["runs"])
        return {"number": number, "n": _count_of(code, total, weight)}


@dataclass
class Model:
    """Where the levels are, in how many shards; training tokens and distinct ones."""

    uri: str
    shards: int
    tokens: int = 0
    vocabulary: int = 0


def _free(uri: str) -> None:
    """Deletes a file or a folder, if it is there."""
    fs, path = _fs(uri)
    kind = fs.get_file_info(path)
    if kind.is_file:
        fs.delete_file(path)
    elif kind.type.name == "Directory":
        fs.delete_dir(path)


MOVED = "shard int, chunk string, blob binary, tokens long, words long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in MOVED.split(", ")])


def _groups(batches, key: int) -> Iterator[tuple]:
    """Rows that come sorted by a column, group by group: (key, [rows])."""
    now, held = None, []
    for b in batches:
        for row in zip(*[b.column(i) for i in range(b.num_columns)]):
            row = tuple(x.as_py() for x in row)
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _level(model: Model, order: int, build: bool, keep: bool):
    """The task of one shard of a level: builds it or opens it, and answers every chunk. A
    level that is not to be kept is the task's own file, which it deletes when it has answered."""
    width = (1 << 64) // model.shards + 1

    def run(batches):
        for s, rows in _groups(batches, 0):
            parts = [unpack(r[2]) for r in rows]
            uri, low = f"{model.uri}/level{order}-{s}", s * width
            if build and not keep:
                uri += f"-{uuid.uuid4().hex}"
            if build:
                write_arrays(uri, Words.build(parts, low, width) if order == 1 else Successors.build(parts, WEIGHTS[order - 2]))
            if _exists(uri):
                arrays = read_arrays(uri)
            else:  # a shard without training rows has no file
                none = [{k: v[:0] for k, v in p.items()} for p in parts]
                arrays = Words.build(none, low, width) if order == 1 else Successors.build(none, WEIGHTS[order - 2])
            level = Words(arrays) if order == 1 else Successors(arrays)
            if order == 1:
                yield _rows([(s, None, None, int(arrays["count"].sum(dtype=np.int64)), len(arrays["count"]))])
            for part, r in zip(parts, rows):
                got = level.answer(part, low) if order == 1 else level.answer(part, WEIGHTS[order - 2])
                got["shard"] = np.array([s], np.uint32)
                if order == 3:
                    del got["number"]
                yield _rows([(s, r[1], pack(got), 0, 0)])
            if build and not keep:
                _free(uri)

    return run


# --- chunks --------------------------------------------------------------------------------


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct keys in ascending order a place of each, and which one each key is."""
    order = np.argsort(key)
    rising = key[order]
    new = np.r_[True, rising[1:] != rising[:-1]][: len(key)]
    which = np.empty(len(key), np.int32)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Asked:
    """What a chunk asks of a level: its distinct (context, word) pairs by shard, and which
    of them each token is (-1: none). It follows from the chunk and from earlier answers, so
    it is computed again where it is needed and takes no room in the shared folder.

    ok: the tokens that ask; context and word: theirs.
    """

    def __init__(self, tokens: int, ok: np.ndarray, context: np.ndarray, word: np.ndarray, shards: int):
        bits = _U(max(1, int(word.max(initial=0)).bit_length()))
        dense = context
        if int(context.max(initial=0)).bit_length() + int(bits) > 64:
            dense = np.unique(context, return_inverse=True)[1].astype(np.uint64)
        first, which = _distinct((dense << bits) | word)
        shard = (_mix(context[first], word[first]) % _U(shards)).astype(np.min_scalar_type(shards))
        order = np.argsort(shard, kind="stable")
        self.cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        self.ok, self.at, self.context, self.word = ok, ok[first[order]], context[first[order]], word[first[order]]
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.index = np.full(tokens, -1, np.int32)
        self.index[ok] = back[which]

    def rows(self, chunk: str, total: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        """The rows for the shards. total: each token's count of its context; n: what it counts."""
        count = np.bincount(self.index[self.ok], weights=n[self.ok], minlength=len(self.at)).astype(np.uint32)
        total = total[self.at]
        for s, (a, z) in enumerate(zip(self.cuts, self.cuts[1:])):
            if a < z:
                c = self.context[a:z]
                start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                runs = np.diff(np.r_[start, z - a]).astype(np.uint32)
                yield s, chunk, pack({"context": c[start], "total": total[a:z][start], "runs": runs, "word": self.word[a:z], "n": count[a:z]}), 0, 0


def _before(text: dict) -> np.ndarray:
    """The word before each token; before the first one of a text is an end."""
    out = np.r_[np.searchsorted(text["kinds"], _U(END)), text["which"][:-1]]
    out[np.cumsum(text["sizes"]) - text["sizes"]] = np.searchsorted(text["kinds"], _U(END))
    return out


def _pairs_asked(text: dict, words: dict, shards: int) -> Asked:
    which, before = text["which"], _before(text)
    ok = np.flatnonzero((words["count"][which] > 0) & (words["count"][before] > 0))
    return Asked(len(which), ok, words["number"][before[ok]], words["number"][which[ok]], shards)


def _triples_asked(text: dict, words: dict, pair: np.ndarray, number: np.ndarray, total: np.ndarray, shards: int) -> Asked:
    """``total``: how often the pair before each token was seen; ``number``: of the pairs."""
    which = text["which"]
    ok = np.flatnonzero((total > 0) & (words["count"][which] > 0))
    return Asked(len(which), ok, number[pair[ok - 1]], words["number"][which[ok]], shards)


def _joined(rows: list[tuple], key: str) -> np.ndarray:
    return np.concatenate([a[key] for a in rows]) if rows else np.zeros(0, np.uint16)


def _answers(rows: list[tuple]) -> list[bytes]:
    """The answers to a chunk in the order in which it asked; a chunk's own row has none."""
    return [r[2] for r in sorted((r for r in rows if r[2] is not None), key=lambda r: r[0])]


class Chunk:
    """One chunk's files in the shared folder: its tokens and what it has been told."""

    def __init__(self, uri: str, name: str):
        self.at = f"{uri}/chunk-{name}"

    def save(self, part: str, **arrays) -> None:
        _write(f"{self.at}-{part}", pack(arrays))

    def load(self, part: str) -> dict[str, np.ndarray]:
        return unpack(_read(f"{self.at}-{part}"))

    def save_answers(self, part: str, blobs: list[bytes]) -> None:
        """Answers as they came; shard by shard, as numbers ascend there and so take little room."""
        sizes = np.array([len(blobs), *map(len, blobs)], np.int64)
        _write(f"{self.at}-{part}", sizes.tobytes() + b"".join(blobs))

    def load_answers(self, part: str) -> list[dict]:
        raw = _read(f"{self.at}-{part}")
        n = int.from_bytes(raw[:8], "little")
        cuts = np.cumsum(np.frombuffer(raw, np.int64, n + 1)) - n + 8 * (n + 1)
        return [unpack(raw[a:z]) for a, z in zip(cuts, cuts[1:])]

    def numbered(self, part: str, shards: int) -> list[dict]:
        """Answers with numbers of the whole level: a place in a shard, then the shard."""
        return [a | {"number": a["number"] * _U(shards) + a["shard"].astype(np.uint64)} for a in self.load_answers(part)]

    def words(self, shards: int) -> dict[str, np.ndarray]:
        got = self.numbered("words", shards)
        return {k: _joined(got, k) for k in ("number", "count")}


def _tokenise(uri: str):
    def run(batches):
        for ids, train, sizes, h in _chunks(batches):
            name = uuid.uuid4().hex
            first, which = _distinct(h)
            kinds = h[first]
            n = np.bincount(which, weights=np.repeat(train, sizes), minlength=len(kinds)).astype(np.uint32)
            Chunk(uri, name).save("text", train=train, sizes=sizes, kinds=kinds, n=n, which=which.astype(np.int32))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as f:
                f.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
            _write(f"{uri}/chunk-{name}-ids", sink.getvalue().to_pybytes())
            yield _rows([(None, name, None, len(h), len(sizes))])

    return run


def _send_words(model: Model):
    def run(batches):
        width = (1 << 64) // model.shards + 1
        for b in batches:
            for name in b.column(1).to_pylist():
                text = Chunk(model.uri, name).load("text")
                cuts = np.searchsorted(text["kinds"], np.array([min(s * width, (1 << 64) - 1) for s in range(model.shards)], np.uint64))
                rows = [(s, name, pack({"hash": text["kinds"][a:z], "n": text["n"][a:z]}), 0, 0) for s, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(text["kinds"])])) if a < z]
                yield _rows(rows)

    return run


def _told(model: Model, part: str):
    """Keeps the answers to a chunk among its files, so that what moved them can go."""

    def run(batches):
        for name, rows in _groups(batches, 1):
            Chunk(model.uri, name).save_answers(part, _answers(rows))
            yield _rows([(None, name, None, 0, 0)])

    return run


def _send_pairs(model: Model):
    def run(batches):
        for b in batches:
            for name in b.column(1).to_pylist():
                chunk = Chunk(model.uri, name)
                text, words = chunk.load("text"), chunk.words(model.shards)
                asked = _pairs_asked(text, words, model.shards)
                out = asked.rows(name, words["count"][_before(text)], np.repeat(text["train"], text["sizes"]))
                yield from (_rows([r]) for r in out)

    return run


def _of_tokens(asked: Asked, n: np.ndarray) -> np.ndarray:
    """For each token the count that its n-gram was answered; 0 where it did not ask."""
    return np.where(asked.index >= 0, n[np.maximum(asked.index, 0)] if len(n) else 0, 0).astype(np.uint64)


def _context_counts(text, counts) -> np.ndarray:
    """For each token, the count of the pair before it; 0 for the first one of a text."""
    out = np.r_[_U(0), counts[:-1]]
    out[np.cumsum(text["sizes"]) - text["sizes"]] = 0
    return out


def _send_triples(model: Model):
    def run(batches):
        for b in batches:
            for name in b.column(1).to_pylist():
                chunk = Chunk(model.uri, name)
                text, words, got = chunk.load("text"), chunk.words(model.shards), chunk.numbered("pairs", model.shards)
                pairs = _pairs_asked(text, words, model.shards)
                total = _context_counts(text, _of_tokens(pairs, _joined(got, "n")))
                asked = _triples_asked(text, words, pairs.index, _joined(got, "number"), total, model.shards)
                yield from (_rows([r]) for r in asked.rows(name, total, np.repeat(text["train"], text["sizes"])))

    return run


def _kept(asked: Asked, n: np.ndarray, total: np.ndarray, weight: float) -> np.ndarray:
    """The share of each token's n-gram, as its code has it."""
    code = _code_of(n, total[asked.at], weight) if len(n) else np.zeros(0, np.uint16)
    p = np.where(code < ABSENT, 2.0 ** (-code.astype(np.float64) / STEPS), 0.0)
    return np.where(asked.index >= 0, p[np.maximum(asked.index, 0)] if len(p) else 0.0, 0.0)


def _score(model: Model):
    def run(batches):
        for name, rows in _groups(batches, 1):
            chunk, n3 = Chunk(model.uri, name), _joined([unpack(a) for a in _answers(rows)], "n")
            text, words, got = chunk.load("text"), chunk.words(model.shards), chunk.numbered("pairs", model.shards)
            n2, which, sizes = _joined(got, "n"), text["which"], text["sizes"]
            pairs, before = _pairs_asked(text, words, model.shards), words["count"][_before(text)]
            total = _context_counts(text, _of_tokens(pairs, n2))
            triples = _triples_asked(text, words, pairs.index, _joined(got, "number"), total, model.shards)
            single = ((words["count"] + 1) / (model.tokens + model.vocabulary + 1))[which]
            first = np.cumsum(sizes) - sizes
            p = _kept(pairs, n2, before, WEIGHTS[0]) + WEIGHTS[0] / (before + WEIGHTS[0]) * single
            p = _kept(triples, n3, total, WEIGHTS[1]) + WEIGHTS[1] / (total + WEIGHTS[1]) * p
            sums = lambda x: np.add.reduceat(x, first)
            with pa.ipc.open_stream(_read(f"{chunk.at}-ids")) as f:
                ids = f.read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(sums((words["count"][which] > 0).astype(np.int64))), pa.array(np.full(len(sizes), model.tokens, np.int64)), pa.array(sums(np.log10(single))), pa.array(sums(np.log10(p)))],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


# --- jobs ----------------------------------------------------------------------------------


def _level_job(moved: DataFrame, model: Model, order: int, build: bool, keep: bool) -> DataFrame:
    by_shard = moved.repartition(model.shards, "shard").sortWithinPartitions("shard")
    return by_shard.mapInArrow(_level(model, order, build, keep), MOVED)


def _run(docs: DataFrame, model: Model | None, keep: bool = True) -> tuple[Model, DataFrame]:
    """Rows (id, train, text) through all levels, built from them or, with a model, opened.
    Levels are deleted by their tasks unless the model is to be kept; answers are, when the
    chunks have them."""
    spark, build = docs.sparkSession, model is None
    uri = _uri(shared_path(spark, "lm"))
    chunks = materialize(docs.mapInArrow(_tokenise(uri), MOVED), "lm-chunks")
    tokens, n = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    at = Model(uri, max(1, -(-tokens // SHARD))) if build else Model(uri, model.shards, model.tokens, model.vocabulary)
    levels = at if build else model
    parts = max(1, n)
    by_chunk = lambda df: df.filter("chunk IS NOT NULL").repartition(parts, "chunk").sortWithinPartitions("chunk")
    # the levels' own places are those of the model; chunks' files are this run's

    def level(order, send, path=None):
        sent = chunks.repartition(parts, "chunk").mapInArrow(send(at), MOVED)
        return materialize(_level_job(sent, levels, order, build, keep), f"lm-answers{order}", path=path)

    def told(part, answers, path):
        materialize(by_chunk(answers.union(chunks)).mapInArrow(_told(at, part), MOVED), f"lm-{part}")
        _free(_uri(path))

    places = [shared_path(spark, f"lm-answers{order}") for order in (1, 2)]
    answers = level(1, _send_words, places[0])
    if build:
        at.tokens, at.vocabulary = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    told("words", answers, places[0])
    told("pairs", level(2, _send_pairs, places[1]), places[1])
    answers = level(3, _send_triples)
    kind = dict(docs.dtypes)["id"]
    return at, by_chunk(answers.union(chunks)).mapInArrow(_score(at), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train(df: DataFrame, text_col: str = "text") -> Model:
    """Counts all texts of ``df`` and writes the levels to the shared folder; null texts are
    empty, repeated rows count each. The driver gets sums only."""
    model, scores = _run(df.select(F.lit(0).alias("id"), F.lit(1).cast("byte").alias("train"), F.col(text_col).alias("text")), None)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score: a row for every row. A null
    or empty text is one end. Without training texts all probabilities are one."""
    docs = df.select(F.col(id_col).alias("id"), F.lit(0).cast("byte").alias("train"), F.col(text_col).alias("text"))
    return _run(docs, model)[1].withColumnRenamed("id", id_col)


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for every row.

    Learns from rows whose fold of 7 is not 2; a null id is in no fold and teaches nothing,
    but is scored. Null and empty texts are one end; rows that share an id or a text count
    each; an empty table gives no rows; other columns are not read.
    """
    train_row = F.coalesce(fold(F.col(id_col), 7) != 2, F.lit(False)).cast("byte")
    docs = df.select(F.col(id_col).alias("id"), train_row.alias("train"), F.col(text_col).alias("text"))
    out = _run(docs, None, keep=False)[1].withColumnRenamed("id", id_col)
    return out.select(id_col, (fold(F.col(id_col), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

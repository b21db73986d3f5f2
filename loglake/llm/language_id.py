"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its
letters' vectors, each rotated by its place. A document is the sum of its n-grams'
vectors, a language the sum of its documents' (each scaled to one length), and a
document's language is the prototype with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import fold

DIMENSIONS = 1024
N = 3
#: Letters are dealt to this many vectors by code point; 0 stands for all else.
ALPHABET = 512
#: Characters that are handled at once; bounds memory for long texts.
AT_ONCE = 1 << 19
#: Kinds of n-grams that are handled at once.
CHUNK = 4096
UNIT = 4096


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point → letter (0: none) for the whole of Unicode, and the letters' vectors."""
    kind = np.zeros(0x110000, np.int16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            kind[cp] = 1 + (ord(low[0]) if len(low) else cp) % (ALPHABET - 1)
    vectors = np.random.default_rng(20240501).integers(0, 2, (ALPHABET, DIMENSIONS), np.int8) * 2 - 1
    return kind, np.stack([np.roll(vectors, i, axis=1) for i in range(N)])


class Space:
    def __init__(self):
        self.kind, self.rolled = _letters()

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum of its n-gram vectors (integers, as floats), and its letters."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        letters = np.zeros(len(texts), np.int64)
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t)), AT_ONCE):
                # an n-gram that crosses two chunks belongs to the first
                part = t[at : at + AT_ONCE + N - 1]
                held.append((i, part, len(t) - at > AT_ONCE))
                size += len(part)
                if size >= AT_ONCE:
                    self._add(held, out, letters)
                    held, size = [], 0
        self._add(held, out, letters)
        return out, letters

    def _add(self, held, out, letters) -> None:
        docs, grams = [], []
        for i, part, more in held:
            code = self.kind[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            letters[i] += int((code[: AT_ONCE if more else None] > 0).sum())
            code = np.concatenate([[0], code, [0]]) if not more else code
            code = code[(code > 0) | np.r_[True, code[:-1] > 0]]  # one gap between words
            if len(code) < N:
                continue
            g = code[: len(code) - N + 1].copy()
            for k in range(1, N):
                g = g * ALPHABET + code[k : len(code) - N + 1 + k]
            grams.append(g)
            docs.append(np.full(len(g), i, np.int64))
        if not grams:
            return
        g, d = np.concatenate(grams), np.concatenate(docs)
        kinds, which = np.unique(g, return_inverse=True)
        low = int(d[0])
        docs_here = int(d[-1]) - low + 1
        pair, count = np.unique(which * docs_here + (d - low), return_counts=True)
        for at in range(0, len(kinds), CHUNK):
            k = kinds[at : at + CHUNK]
            v = self.rolled[N - 1][k % ALPHABET]
            for place in range(N - 2, -1, -1):
                v = v * self.rolled[place][(k // ALPHABET ** (N - 1 - place)) % ALPHABET]
            own = slice(*np.searchsorted(pair, [at * docs_here, (at + len(k)) * docs_here]))
            counts = np.zeros((docs_here, len(k)), np.float32)
            counts[pair[own] % docs_here, pair[own] // docs_here - at] = count[own]
            out[low : low + docs_here] += counts @ v.astype(np.float32)


_SPACE: Space | None = None


def space() -> Space:
    """One for each Python worker."""
    global _SPACE
    if _SPACE is None:
        _SPACE = Space()
    return _SPACE


def _batches(b, size=256):
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language: sums of whole numbers, so that no order of rows matters.

    Rows with a null language or without a letter teach nothing. What comes to the driver
    is one vector a language: ``DIMENSIONS`` numbers each.
    """

    def run(batches):
        s, sums = space(), {}
        for whole in batches:
            for b in _batches(whole):
                v, letters = s.sums([t or "" for t in b.column(0).to_pylist()])
                length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                scaled = np.rint(v * (UNIT / np.maximum(length, 1e-9))[:, None]).astype(np.int64)
                for lang, row, n in zip(b.column(1).to_pylist(), scaled, letters):
                    if n:
                        sums[lang] = sums[lang] + row if lang in sums else row
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(row)], names=["lang", "i", "v"])

    rows = df.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(run, "lang string, i int, v long")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["v"]
    return {k: out[k] / max(1e-9, float(np.linalg.norm(out[k]))) for k in sorted(out)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score: the nearest prototype and its cosine, at least 0. ``und`` and
    0 where the text is null or has no letter, or nothing was learned; of equal cosines
    the first language in order. Only the text is looked at."""
    langs = list(prototypes)
    table = df.sparkSession.sparkContext.broadcast(np.array([prototypes[k] for k in langs], np.float32).reshape(-1, DIMENSIONS))

    def run(batches):
        s, protos = space(), table.value
        for whole in batches:
            for b in _batches(whole):
                v, letters = s.sums([t or "" for t in b.column(1).to_pylist()])
                pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if langs and b.num_rows:
                    cos = (v @ protos.T) / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), 1e-9)[:, None]
                    best = cos.argmax(axis=1)
                    pred = [langs[k] if n else "und" for k, n in zip(best, letters)]
                    score = np.where(letters > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score. Learns from the rows whose fold of 4 is not 2 and
    predicts all rows. A null id is in no fold: it teaches nothing, and held_out is null."""
    part = fold(F.col(id_col), 4)
    prototypes = learn(df.filter(part != 2), text_col, lang_col)
    out = predict(df, prototypes, id_col, text_col)
    return out.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "lang_pred", "score")

"""Framing: a table of raw lines or bodies becomes a table of records.

A source or body may be of any size. What its records need to know of the lines before them
(the record's number, its size so far, the depth of braces) is handed on from block to block.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators.ordered import BLOCK, block_of, fold_blocks, joined, ranked, written

MAX_BYTES = 2 * 1024 * 1024
KEPT = 1024
MARK = "...[TRUNCATED]"


def _flagged(df: DataFrame, max_bytes: int, error: Column | None = None) -> DataFrame:
    """Adds is_oversized and frame_error, and cuts the text (not the bytes) of what is too long."""
    raw = F.coalesce(F.col("raw_bytes"), F.col("line").cast("binary")) if "raw_bytes" in df.columns else F.col("line").cast("binary")
    df = df.withColumn("raw_bytes", raw).withColumn("is_oversized", F.octet_length("raw_bytes") > max_bytes)
    cause = F.when(F.col("is_oversized"), F.concat(F.lit("record exceeds "), F.lit(max_bytes).cast("string"), F.lit(" bytes")))
    df = df.withColumn("frame_error", cause if error is None else F.coalesce(error, cause))
    return df.withColumn("line", F.when(F.col("is_oversized"), F.concat(F.substring("line", 1, KEPT), F.lit(MARK))).otherwise(F.col("line")))


def frame_lines(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each line is a record; blank ones are dropped."""
    return _flagged(df.withColumn("line", F.regexp_replace("line", "\r+$", "")).filter(F.trim("line") != ""), max_bytes)


def frame_delimited(df: DataFrame, delimiter: str, max_bytes: int = MAX_BYTES, text_col: str = "line") -> DataFrame:
    """Records between delimiters, trimmed; empty ones are dropped."""
    rest = [c for c in df.columns if c not in (text_col, "raw_bytes", "line")]
    parts = F.split(F.col(text_col), re.escape(delimiter))
    out = df.select(*rest, F.posexplode(parts).alias("record", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\n"))).filter("line <> ''")
    return _flagged(out, max_bytes)


class _Pieces:
    """Where a record of lines is cut: behind the line with which it exceeds ``most`` characters.

    A block's lines are cut on from what the block was entered with only up to the first cut;
    from there on the places are the block's own. So a summary is the state behind the block
    for each first cut, and neighbours that lead to one state are one entry."""

    def __init__(self, most: int, order: str, size: str):
        self.most, self.order, self.size = most, order, size

    def summarise(self, rows: pd.DataFrame):
        sums = rows[self.size].to_numpy(np.int64).cumsum()
        k, labels = len(sums), [*rows[self.order].tolist(), None]
        before = np.r_[0, sums[:-1]]
        cut = np.searchsorted(sums, before + self.most, "right")  # of a piece that begins at a line
        behind = [(0, k)] * (k + 1)  # (size, first line) of the piece that is open at the end
        for j in range(k - 1, -1, -1):
            behind[j] = (int(sums[-1] - before[j]), j) if cut[j] == k else behind[cut[j] + 1]
        first = int(np.searchsorted(sums, self.most, "right"))  # no first cut is behind it
        runs: list = []
        for i in range(min(first + 1, k)):
            if runs and runs[-1][1] == behind[i + 1]:
                runs[-1] = (int(sums[i]), behind[i + 1])
            else:
                runs.append((int(sums[i]), behind[i + 1]))
        return int(sums[-1]), labels[0], [(s, size, labels[at]) for s, (size, at) in runs]

    def advance(self, summary, state):
        total, label, runs = summary
        size, piece = state
        piece = label if piece is None else piece
        for s, behind, first in runs:
            if size + s > self.most:
                return behind, first
        return size + total, piece

    def apply(self, rows: pd.DataFrame, state, last: bool) -> pd.DataFrame:
        size, piece = state
        sums, labels = rows[self.size].to_numpy(np.int64).cumsum(), rows[self.order].tolist()
        out, at, done = [], 0, -size
        while at < len(labels):
            piece = labels[at] if piece is None else piece
            end = min(int(np.searchsorted(sums, done + self.most, "right")) + 1, len(labels))
            out += [piece] * (end - at)
            done, at, piece = int(sums[end - 1]), end, None
        return rows.assign(_piece=out).drop(columns=["_block", self.size])


def frame_multiline(df: DataFrame, start_pattern: str, partition_by: str | list[str] = "source_tag", order_by: str = "seq", max_bytes: int = MAX_BYTES, block: int | None = None) -> DataFrame:
    """A line that matches opens a record and the others are appended to it. Lines before the
    first opening form a record, and blank lines are left out. A record is cut behind the
    line with which it has more than ``max_bytes`` characters; what follows up to the next
    opening is cut in the same way. So no record is much longer, and no text is lost.

    Windows go over ``block`` numbers of ``order_by`` (a number or a time), and records that go
    over blocks get their number and size from sums of blocks."""
    keys, block = [partition_by] if isinstance(partition_by, str) else list(partition_by), block or BLOCK
    opens = F.col("line").rlike("(?m)" + start_pattern).cast("int")
    d = df.filter(F.trim("line") != "").select(*keys, order_by, "line", opens.alias("_open"), block_of(order_by, dict(df.dtypes)[order_by], block).alias("_block"))
    # a record is not cut behind the line that opens it
    d = d.withColumn("_size", F.when(F.col("_open") == 1, F.least(F.length("line"), F.lit(max_bytes))).otherwise(F.length("line")).cast("long"))
    upto = lambda *by: Window.partitionBy(*keys, "_block", *by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum("_open").over(upto())).withColumn("_sofar", F.sum("_size").over(upto("_own")))
    ends = d.groupBy(*keys, "_block").agg(F.max(F.struct("_own", "_sofar")).alias("_end"))
    by = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_run", F.sum((F.col("_end._own") > 0).cast("int")).over(by))
    ends = ends.withColumn("_tail", F.sum("_end._sofar").over(Window.partitionBy(*keys, "_run").orderBy("_block")))
    before = F.coalesce(F.sum("_end._own").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*keys, "_block", before.alias("_before"), F.coalesce(F.lag("_tail").over(by), F.lit(0)).alias("_carried"))
    d = joined(d, ends, [*keys, "_block"])
    d = d.withColumn("record", F.col("_own") + F.col("_before")).withColumn("_sofar", F.col("_sofar") + F.when(F.col("_own") == 0, F.col("_carried")).otherwise(0))
    inside = F.col("_sofar") - F.col("_size") <= max_bytes
    cols = [*keys, "record", order_by, "line"]
    types = dict(d.dtypes)
    cut = _Pieces(max_bytes, order_by, "_size")
    beyond = d.filter(~inside).select(*cols, "_block", "_size")
    beyond = fold_blocks(beyond, [*keys, "record"], order_by, (0, None), cut.summarise, cut.advance, cut.apply, ", ".join(f"`{c}` {types[c]}" for c in cols) + f", _piece {types[order_by]}")
    d = d.filter(inside).select(*cols, F.lit(None).cast(types[order_by]).alias("_piece")).unionByName(beyond)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col("line").alias("l"))))
    out = d.groupBy(*keys, "record", "_piece").agg(F.min(order_by).alias(order_by), lines.alias("_l")).drop("_piece")
    return _flagged(out.withColumn("line", F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).drop("_l"), max_bytes)


#: Braces, and strings with what is escaped in them (an open one goes to the end); the group
#: is the closing quote.
_TOKENS = re.compile(r'[{}]|"(?:[^"\\]|\\.)*+(")?', re.S)
_IN_STRING = re.compile(r'(?:[^"\\]|\\.)*+(")?', re.S)


def _inside(text: str, at: int, depth: int):
    """Follows an object from a place outside strings: (its end, None), or (None, (mode, depth))
    where the text ends before."""
    for m in _TOKENS.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.end(), None
        elif not m[1]:
            return None, ("escape" if m.end() < len(text) else "string", depth)
    return None, ("inside", depth)


def _out_of_string(text: str, mode: str) -> tuple[int | None, str]:
    """Where a string ends that the text begins in, or the mode at the text's end."""
    at = 0
    if mode == "escape":
        if not text:
            return None, mode
        at = 1
    m = _IN_STRING.match(text, at)
    if m[1]:
        return m.end(), "inside"
    return None, "escape" if m.end() < len(text) else "string"


def _json_objects(text: str) -> list[tuple[str, bool]]:
    """Objects by depth of braces outside strings, and whether each one ends. Quotes count
    inside objects only; what stands between objects is passed over."""
    out, start = [], text.find("{")
    while start >= 0:
        end, _ = _inside(text, start + 1, 1)
        out.append((text[start:end], end is not None))
        start = text.find("{", end) if end else -1
    return out


class _Chunks:
    """A body in chunks: rows of text in order, of which a block's are taken as one text. A
    record is named by the row in which it begins and the place there."""

    START: tuple
    EMPTY: str | bytes = ""

    def __init__(self, keys: list[str], order: str, text: str):
        self.keys, self.order, self.text = keys, order, text

    def _joined(self, parts: list, labels: list):
        """The text of rows, and a function that names the row of a place and the place there."""
        parts = [x if x is not None else self.EMPTY for x in parts]
        starts = [0, *itertools.accumulate(map(len, parts))][:-1]

        def label(at: int):
            i = bisect.bisect_right(starts, at) - 1
            return labels[i], at - starts[i]

        return self.EMPTY.join(parts), label

    def _block(self, rows: pd.DataFrame):
        return self._joined(rows[self.text].tolist(), rows[self.order].tolist())

    def cut(self, text, label: Callable, state, last: bool) -> list:
        """(label, characters or bytes of the record before, text, whether it ends) of the
        records in a text that is entered with a state."""
        raise NotImplementedError

    def apply(self, rows: pd.DataFrame, state, last: bool) -> pd.DataFrame:
        found = self.cut(*self._block(rows), state, last)
        out = pd.DataFrame({self.order: [f[0][0] for f in found], "record": [f[0][1] for f in found], "_before": [f[1] for f in found], "_text": [f[2] for f in found], "_ends": [f[3] for f in found]}, dtype=object)
        for k in self.keys:
            out[k] = rows[k].iloc[0]
        return out

    def whole(self, batches):
        """Bodies that come one after the other, each in order and whole: their records."""
        n, key, parts, labels, out = len(self.keys), None, [], [], []

        def close():
            out.extend((*key, label[0], label[1], before, text, ends) for label, before, text, ends in self.cut(*self._joined(parts, labels), self.START, True))

        for b in batches:
            out = []
            columns = [c.to_pylist() for c in b.columns]
            for now, rows in itertools.groupby(zip(*columns), key=lambda r: r[:n]):
                if now != key:
                    if key is not None:
                        close()
                    key, parts, labels = now, [], []
                for r in rows:
                    labels.append(r[n])
                    parts.append(r[n + 1])
            types = [*b.schema.types[: n + 1], pa.int64(), pa.int64(), b.schema.types[n + 1], pa.bool_()]
            yield self._batch(out, types)
        if key is not None:
            out = []
            close()
            yield self._batch(out, types)

    def _batch(self, rows: list[tuple], types: list) -> pa.RecordBatch:
        names = [*self.keys, self.order, "record", "_before", "_text", "_ends"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Braces(_Chunks):
    """State: (mode, depth, label, size so far); mode is outside, inside, string or escape."""

    START = ("outside", 0, None, 0)

    def _outside(self, text: str, label: Callable, at: int, known: dict):
        """The state at the end of a text that is outside objects at a place."""
        met, start = [], text.find("{", at)
        while start >= 0 and start not in known:
            met.append(start)
            end, state = _inside(text, start + 1, 1)
            if end is None:
                known[start] = (*state, label(start), len(text) - start)
                break
            start = text.find("{", end)
        found = known.get(start, self.START)
        known.update((x, found) for x in met)
        return found

    def summarise(self, rows: pd.DataFrame):
        text, label = self._block(rows)
        known: dict = {}
        out = {"outside": self._outside(text, label, 0, known), "size": len(text)}
        for mode in ("inside", "string", "escape"):
            at, last = (0, "inside") if mode == "inside" else _out_of_string(text, mode)
            low = depth = 0
            ends = []  # where depths of one, two, ... are closed
            if at is not None:
                for m in _TOKENS.finditer(text, at):
                    if m[0] == "{":
                        depth += 1
                    elif m[0] == "}":
                        depth -= 1
                        if depth < low:
                            low = depth
                            ends.append(self._outside(text, label, m.end(), known))
                    elif not m[1]:
                        last = "escape" if m.end() < len(text) else "string"
            out[mode] = (last, depth, ends)
        return out

    def advance(self, summary, state):
        mode, depth, label, size = state
        if mode == "outside":
            return summary["outside"]
        last, change, ends = summary[mode]
        return ends[depth - 1] if depth <= len(ends) else (last, depth + change, label, size + summary["size"])

    def cut(self, text: str, label: Callable, state, last: bool) -> list:
        mode, depth, name, size = state
        found, at = [], 0
        if mode != "outside":
            at = 0 if mode == "inside" else _out_of_string(text, mode)[0]
            end = None if at is None else _inside(text, at, depth)[0]
            found.append((name, size, text[:end], end is not None))
            at = end
        start = -1 if at is None else text.find("{", at)
        while start >= 0:
            end, _ = _inside(text, start + 1, 1)
            found.append((label(start), 0, text[start:end], end is not None))
            start = text.find("{", end) if end else -1
        return found


_HEAD = re.compile(rb"\s*(\d{1,10}) ")
#: What may still become a head.
_HEAD_BEGUN = re.compile(rb"\s*\d{0,10}\Z")


def _octet_step(data: bytes, at: int):
    """What begins at a place: (kind, first byte, end), where the end of a message may lie
    behind the data, and that of a line is None if it is not there."""
    m = _HEAD.match(data, at)
    if m:
        return "message", m.end(), m.end() + int(m[1])
    if _HEAD_BEGUN.match(data, at):
        return "head", at, None
    end = data.find(b"\n", at)
    return "line", at, None if end < 0 else end


def _octet_messages(text: str) -> list[tuple[str, bool]]:
    """Messages with their length in bytes before them; where none is given, lines."""
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    while at < len(data):
        kind, first, end = _octet_step(data, at)
        out.append((data[first:end].decode("utf-8", "replace").rstrip("" if kind == "message" else "\r"), kind != "message" or end <= len(data)))
        at = len(data) if end is None else end if kind == "message" else end + 1
    return [x for x in out if x[0].strip()]


class _Octets(_Chunks):
    """State: (kind, bytes left or head begun, label, size so far); kind is start, message,
    line or head. Where a message ends may be any place of the next block, so a summary has
    the state behind the block for every place to begin at, with equal neighbours as one."""

    START = ("start", None, None, 0)
    EMPTY = b""

    def summarise(self, rows: pd.DataFrame):
        data, label = self._block(rows)
        size = len(data)
        b = np.frombuffer(data, np.uint8)
        digit, space = (b >= 48) & (b <= 57), np.isin(b, [9, 10, 11, 12, 13, 32])
        places = np.arange(size)

        def following(mask):  # the first place at or behind each one where mask holds
            return np.minimum.accumulate(np.r_[np.where(mask, places, size), size][::-1])[::-1]

        stop, word, line = following(~digit), following(~space), following(b == 10)
        value = np.zeros(size + 1, np.int64)
        count = stop[:-1] - places
        for k in range(1, 11):
            at = places[digit & (count == k)]
            value[at] = (b[at].astype(np.int64) - 48) * 10 ** (k - 1) + value[at + 1]
        first = np.where(space, word[:-1], places)  # of the digits
        stops = stop[first]
        blank = np.r_[b == 32, False][stops]
        short = stops - first <= 10
        head = (stops > first) & short & blank
        begun = (stops == size) & short
        end = np.where(head, stops + 1 + value[first], np.where(begun, size + 1, line[:-1] + 1))
        # places from which the block is left without a new start lead to themselves
        go = np.r_[np.where(end > size, places, end), size]
        while True:
            new = go[go]
            if (new == go).all():
                break
            go = new
        cuts = np.flatnonzero(np.r_[True, go[1:] != go[:-1]])
        states = []
        for r in go[cuts].tolist():
            if r == size:
                states.append(self.START)
            elif begun[r]:
                states.append(("head", data[r:], label(r), 0))
            elif head[r]:
                states.append(("message", int(end[r]) - size, label(r), size - int(stops[r]) - 1))
            else:
                states.append(("line", None, label(r), size - r))
        return {"size": size, "cuts": cuts.tolist(), "states": states, "line": int(line[0]), "front": data[:64]}

    def _behind(self, summary, at: int):
        return summary["states"][bisect.bisect_right(summary["cuts"], at) - 1]

    def advance(self, summary, state):
        kind, held, label, done = state
        size = summary["size"]
        if kind == "head":
            kind, first, end = _octet_step(held + summary["front"], 0)
            if kind == "head":  # the block is shorter than a head
                return "head", held + summary["front"], label, 0
            if kind == "message":
                first, held, done = first - len(held), end - len(held), 0
                if first >= size:
                    return "message", held - size, label, size - first
                return self._behind(summary, held) if held <= size else ("message", held - size, label, size - first)
            done = len(held)
        if kind == "start":
            return self._behind(summary, 0)
        if kind == "message":
            return self._behind(summary, held) if held <= size else ("message", held - size, label, done + size)
        return self._behind(summary, summary["line"] + 1) if summary["line"] < size else ("line", None, label, done + size)

    def cut(self, data: bytes, label: Callable, state, last: bool) -> list:
        kind, held, name, done = state
        found, at, shift = [], 0, 0
        if kind == "message":
            found.append((name, done, data[:held], held <= len(data)))
            at = held
        elif kind == "line":
            end = data.find(b"\n")
            found.append((name, done, data if end < 0 else data[:end], True))
            at = len(data) if end < 0 else end + 1
        elif kind == "head":
            data, shift = held + data, len(held)
        while at < len(data):
            what, first, end = _octet_step(data, at)
            if what != "head" or last:
                found.append((name if at < shift else label(at - shift), 0, data[first:end], what != "message" or end <= len(data)))
            at = len(data) if end is None else end if what == "message" else end + 1
        return found


def _in_chunks(df: DataFrame, text_col: str, keys: list[str], order: str, max_bytes: int, block: int, kind: type) -> DataFrame:
    octets, types = kind is _Octets, dict(df.dtypes)
    d = df.select(*keys, order, F.col(text_col).cast("binary" if octets else "string").alias("_text"))
    ddl = ", ".join(f"`{c}` {types[c]}" for c in [*keys, order]) + f", record long, _before long, _text {'binary' if octets else 'string'}, _ends boolean"
    fold = kind(keys, order, "_text")
    size = F.octet_length("_text") if octets else F.length("_text")
    out = [*keys, order, "record", "_part", "_text", "_ends", "_size"]
    long = written(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).withColumn("_long", F.lit(True)).drop("_n"), "long")
    some = not long.isEmpty()
    d = joined(d, F.broadcast(long), keys, "left") if some else d
    # most bodies are short: a task has many of them, one after the other and whole
    short = d.filter("_long IS NULL").drop("_long") if some else d
    short = (short.repartition(*keys) if keys else short.repartition(1)).sortWithinPartitions(*keys, order)
    found = short.mapInArrow(fold.whole, ddl).withColumns({"_part": F.lit(0).cast("long"), "_size": size}).select(*out)
    if some:
        key = F.struct(*keys) if keys else F.lit(0)
        rows = ranked(d.filter("_long").select(key.alias("_body"), *keys, order, "_text"), "_body", [order])
        rows = rows.withColumn("_block", F.floor((F.col("_rank") - 1) / block)).drop("_body")
        pieces = fold_blocks(rows, keys, "_rank", fold.START, fold.summarise, fold.advance, fold.apply, ddl)
        # a record of more than max_bytes is several rows, each of bounded length
        pieces = pieces.withColumn("_part", F.floor(F.col("_before") / max_bytes))
        part = F.array_sort(F.collect_list(F.struct("_before", (F.hex("_text") if octets else F.col("_text")).alias("t"))))
        pieces = pieces.groupBy(*keys, order, "record", "_part").agg(part.alias("_p"), F.bool_or("_ends").alias("_ends"), F.max(F.col("_before") + size).alias("_size"))
        text = F.array_join(F.transform("_p", lambda x: x["t"]), "")
        found = found.unionByName(pieces.withColumn("_text", F.unhex(text) if octets else text).select(*out))
    if octets:
        found = found.withColumnRenamed("_text", "raw_bytes").withColumn("line", F.rtrim(F.make_valid_utf8(F.col("raw_bytes").cast("string")), F.lit("\r"))).filter(F.trim("line") != "")
    else:
        found = found.withColumnRenamed("_text", "line")
    over = (F.col("_part") > 0) | (~F.col("_ends") & (F.col("_size") >= max_bytes))
    cause = F.when(over, F.lit(f"record exceeds {max_bytes} bytes")).when(~F.col("_ends"), F.lit("unterminated record"))
    return _flagged(found, max_bytes, cause).withColumn("is_oversized", F.col("is_oversized") | over).drop("_ends", "_size", "_part")


def _by_function(df: DataFrame, text_col: str, cut, max_bytes: int) -> DataFrame:
    @F.pandas_udf("array<struct<line:string,whole:boolean>>")
    def records(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": a, "whole": b} for a, b in cut(t or "")])

    rest = [c for c in df.columns if c not in (text_col, "raw_bytes", "line")]
    out = df.select(*rest, F.posexplode(records(F.col(text_col))).alias("record", "_r"))
    out = out.withColumn("line", F.col("_r.line"))
    out = _flagged(out, max_bytes, F.when(~F.col("_r.whole"), F.lit("unterminated record")))
    return out.drop("_r")


#: Rows of a long body that are one block; a body of so many rows at most is not divided.
CHUNKS = 4096


def frame_json_stream(df: DataFrame, text_col: str = "line", max_bytes: int = MAX_BYTES, partition_by: str | list[str] | None = None, order_by: str = "seq", block: int = CHUNKS) -> DataFrame:
    """Concatenated or pretty-printed JSON objects, one row each.

    Every row is a body of its own. With ``partition_by``, the rows of a key in ``order_by``
    are chunks of one body of any size, cut anywhere. Bodies of ``block`` rows at most are read
    whole, many in a task. Of longer ones blocks of so many rows are scanned at the same
    time, and the depth, string and escape that each is entered with follow from what the
    blocks before do to any state. Rows then have the key, the order of the row in which an
    object begins and its place there (record). An object of more than ``max_bytes`` is cut
    into several rows, all of them oversized."""
    if partition_by is None:
        return _by_function(df, text_col, _json_objects, max_bytes)
    return _in_chunks(df, text_col, [partition_by] if isinstance(partition_by, str) else list(partition_by), order_by, max_bytes, block, _Braces)


def frame_octet_counted(df: DataFrame, text_col: str = "line", max_bytes: int = MAX_BYTES, partition_by: str | list[str] | None = None, order_by: str = "seq", block: int = CHUNKS) -> DataFrame:
    """Syslog messages framed by octet counts, and lines where there is no count. With
    ``partition_by``, chunks of bodies of any size, as for JSON."""
    if partition_by is None:
        return _by_function(df, text_col, _octet_messages, max_bytes)
    return _in_chunks(df, text_col, [partition_by] if isinstance(partition_by, str) else list(partition_by), order_by, max_bytes, block, _Octets)


def frame_source(df: DataFrame, cfg: dict) -> DataFrame:
    """The framing that a source's definition names; lines if it names none."""
    f = cfg.get("framing") or {}
    kind, most = str(f.get("type", "line")).lower(), int(f.get("max_bytes", MAX_BYTES))
    if kind in ("multiline", "multiline_regex", "regex_multiline", "regex"):
        pattern = f.get("pattern") or f.get("start_pattern") or r"^\d{4}-\d{2}-\d{2}"
        return frame_multiline(df, ("(?i)" if f.get("case_insensitive") else "") + pattern, max_bytes=most)
    if kind == "delimiter":
        return frame_delimited(df, f.get("delimiter", "###EVENT_END###"), most)
    if kind in ("json_stream", "json"):
        return frame_json_stream(df, max_bytes=most)
    if kind in ("syslog_octet", "octet_counting"):
        return frame_octet_counted(df, max_bytes=most)
    return frame_lines(df, most)


def split_oversized(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and those to quarantine with their cause."""
    bad = F.col("is_oversized") | F.col("frame_error").isNotNull()
    return df.filter(~bad), df.filter(bad)

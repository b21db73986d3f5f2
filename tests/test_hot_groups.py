"""Windows, framing and order statistics where one key holds most of the rows: the same as a
plain loop, and no task with the key's rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loglake.operators import analytics, framing, ordered

EVENTS = "seq long, src_ip string, unix_ts long, severity double, bytes_in long"


def skewed(n=3000, seed=4):
    """One address with 90 % of the rows, crowded seconds, gaps of days, rows without time or
    address, and repeated times."""
    r, t, out = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        t += r.choice([0, 0, 0, 1, 1, 7, 59, 60, 61, 4000, 100_000] if r.random() < 0.3 else [0, 1])
        ip = "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
        out.append((i, ip, None if r.random() < 0.01 else t, float(r.randint(0, 9)), r.choice([None, 0, 5, 5, r.randint(1, 10**6)])))
    return out


def burst_by_loop(rows, w, mult, total, recent, last, span):
    by = collections.defaultdict(list)
    for seq, ip, ts, *_ in rows:
        by[ip or "unknown"].append((ts is not None, ts or 0, seq))
    out = {}
    for events in by.values():
        events.sort()
        for k, (timed, ts, seq) in enumerate(events):
            frame = [t for ok, t, _ in events[max(0, k - last + 1) : k + 1] if ok]
            if not timed:
                out[seq] = None
                continue
            n, wide = min(k + 1, last), ts - min(frame)
            near = sum(ok and ts - w <= t <= ts for ok, t, _ in events)
            out[seq] = n >= total and wide >= span and near >= recent and near / w > mult * n / max(wide, 1)
    return out


@pytest.mark.parametrize("hot", [200, 1 << 20])
def test_burst_of_a_hot_address_equals_a_loop(spark, hot, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 64)
    rows = skewed()
    d = spark.createDataFrame(rows, EVENTS).repartition(5)
    for w, last in ((60, 20), (90, 500), (10_000, 50)):
        got = {r["seq"]: r["is_burst"] for r in analytics.burst(d, w, 1.2, 5, 3, last, 2, hot=hot).collect()}
        want = burst_by_loop(rows, w, 1.2, 5, 3, last, 2)
        assert {k: bool(v) for k, v in got.items()} == {k: bool(v) for k, v in want.items()}
        assert 0 < sum(map(bool, want.values())) < len(rows)


def test_online_baseline_of_a_hot_address(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 50)
    d = spark.createDataFrame(skewed(1500), EVENTS).repartition(5)
    a, b = ({r["seq"]: (r["sev_n"], round(r["sev_mean"] or 0, 9), round(r["sev_std"] or 0, 9)) for r in analytics.online_baseline(d, 30, hot=h).collect()} for h in (100, 1 << 20))
    assert a == b and len(a) == 1500


def test_a_hot_address_is_many_tasks(spark):
    """90 % of the rows are one address: no range of the sort has over twice the median."""
    d = spark.range(40_000).selectExpr("id as seq", "if(id % 10 = 0, concat('ip', id % 100), 'hot') as src_ip", "id div 3 as unix_ts")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sizes = sorted(r["count"] for r in ordered.range_sorted(d, ["src_ip"], ["unix_ts", "seq"]).groupBy("_part").count().collect())
        rows, _ = ordered.over_last(ordered.ranked(d, "src_ip", ["seq"]), "src_ip", 20, block=2000)
        blocks = sorted(r["count"] for r in rows.groupBy("src_ip", "_block").count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert blocks[-1] <= 2020


def test_ranks_with_ties_and_nulls(spark):
    rows = [(None, 1), (None, 1), ("a", None), ("a", 3), ("a", 3), ("a", 1), ("b", 2)] * 3
    got = ordered.ranked(spark.createDataFrame(rows, "k string, v int").repartition(4), "k", ["v"]).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["k"]].append((r["_rank"], r["v"]))
    for k, v in by.items():
        values = sorted((x for kk, x in rows if kk == k), key=lambda x: (x is not None, x or 0))
        assert sorted(v) == list(enumerate(values, 1))


def test_quartiles_without_a_list(spark):
    rows = skewed(2500, 9) + [(9000 + i, "none", 1, 0.0, None) for i in range(3)]
    d = spark.createDataFrame(rows, EVENTS).repartition(6)
    got = {r["src_ip"]: (r["n"], r["q1"], r["q3"]) for r in analytics.index_quartiles(d, "src_ip", "bytes_in").collect()}
    by = collections.defaultdict(list)
    for _, ip, _, _, b in rows:
        by[ip] += [] if b is None else [b]
    want = {k: (len(v), *((sorted(v)[len(v) // 4], sorted(v)[3 * len(v) // 4]) if v else (None, None))) for k, v in by.items()}
    assert got == want
    assert "collect_list" not in analytics.index_quartiles(d, "src_ip", "bytes_in")._jdf.queryExecution().toString()
    assert ordered.order_statistics(d.filter("false"), ["src_ip"], "bytes_in", {"m": "n div 2"}).count() == 0
    top = ordered.order_statistics(d, [], "bytes_in", {"m": "n div 2", "z": "n - 1"}).first()
    v = sorted(b for *_, b in rows if b is not None)
    assert (top["n"], top["m"], top["z"]) == (len(v), v[len(v) // 2], v[-1])


# --- framing over blocks -------------------------------------------------------------------


def records_by_loop(lines, opening, most):
    out, now, first = [], [], None
    for order, line in lines:
        if not line.strip():
            continue
        if line.startswith(opening):
            if now:
                out.append((first, "\n".join(now)))
            now, first = [line], order
        else:
            first = order if not now else first
            now.append(line)
            if sum(map(len, now)) > most:
                out.append((first, "\n".join(now)))
                now = []
    return out + ([(first, "\n".join(now))] if now else [])


@pytest.mark.parametrize("most, block", [(100, 64), (400, 50), (10**6, 64), (3, 20), (60, 5000)])
def test_multiline_records_of_one_huge_source(spark, most, block):
    """Most lines are of one source; another one has no opening line at all."""
    r, rows = random.Random(3), []
    for i in range(1500):
        k = r.choice(["x", "x", "x", "y", None])
        rows.append((k, i, ("START " if r.random() < 0.02 and k != "y" else "") + "ab é" * r.randint(0, 12) if r.random() < 0.97 else " "))
    d = spark.createDataFrame(rows, "src string, seq long, line string").repartition(5)
    got = framing.frame_multiline(d, "^START", "src", "seq", most, block).collect()
    by = collections.defaultdict(list)
    for k, o, line in rows:
        by[k].append((o, line))
    assert sorted(((x.src, x.seq, bytes(x.raw_bytes).decode()) for x in got), key=str) == sorted(((k, o, t) for k, v in by.items() for o, t in records_by_loop(v, "START", most)), key=str)
    assert all(x.is_oversized == (len(x.raw_bytes) > most) for x in got)


def chunks(text, r, cut):
    at = sorted(r.sample(range(1, len(text)), min(cut, len(text) - 1)))
    return [text[a:z] for a, z in zip([0, *at], [*at, len(text)])]


JSON = ['{"a": 1}', '{"b": {"c": "}{ \\" \\\\"}, "d": [{}]}', ' noise " here\n', '{"e": "x\\u00e9\\\\\\\\"}', '{}', '}', '{\n "k": "é日" \n}']


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_json_bodies_in_chunks_equal_the_whole(spark, block):
    r, whole, parts = random.Random(8), [], []
    for body in range(12):
        text = "".join(r.choice(JSON) for _ in range(r.randint(1, 40))) + r.choice(["", '{"open": "', '{"open": {', '{"x": "\\'])
        whole.append((body if body else None, text))
        parts += [(body if body else None, i, c) for i, c in enumerate(chunks(text, r, r.choice([1, 9, 60])))]
    a = framing.frame_json_stream(spark.createDataFrame(whole, "k int, line string")).collect()
    b = framing.frame_json_stream(spark.createDataFrame(parts, "k int, seq long, line string").repartition(4), partition_by="k", block=block).collect()
    order = lambda rows, *by: sorted(((x.k, *(x[c] for c in by), x.line, x.frame_error) for x in rows), key=str)
    assert [(x[0], x[-2], x[-1]) for x in order(a)] == [(x[0], x[-2], x[-1]) for x in order(b)]
    # in the order of the body too
    one = [x.line for x in sorted((x for x in b if x.k == 5), key=lambda x: (x.seq, x.record))]
    assert one == [x.line for x in sorted((x for x in a if x.k == 5), key=lambda x: x.record)]


def test_an_object_without_end_is_cut(spark):
    text = '{"a": 1}{"open": "' + "x" * 5000
    rows = [(i, text[i * 100 : i * 100 + 100]) for i in range(len(text) // 100 + 1)]
    got = framing.frame_json_stream(spark.createDataFrame(rows, "seq long, line string").repartition(3), max_bytes=1000, partition_by=[], block=7).collect()
    assert sum(len(x.raw_bytes) for x in got) == len(text) and max(len(x.raw_bytes) for x in got) <= 1700
    assert [x.line for x in got if not x.is_oversized and x.frame_error is None] == ['{"a": 1}']
    assert all(x.frame_error for x in got if x.line != '{"a": 1}') and sum(x.is_oversized for x in got) >= 5


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_octet_counts_in_chunks_equal_the_whole(spark, block):
    r, whole, parts = random.Random(2), [], []
    for body in range(12):
        text = b""
        for _ in range(r.randint(1, 30)):
            m = r.choice(["<34>1 hello", "x", "é日本 12 3", "5 abcde", "a\nb 7 c", "  ", "9" * 12]).encode()
            text += r.choice([str(len(m)).encode() + b" " + m, m + b"\r\n", b"\n\n" + str(len(m)).encode() + b" " + m])
        text += r.choice([b"", b"99 short", b"12", b"a line"])
        whole.append((body, text))
        parts += [(body, i, c) for i, c in enumerate(chunks(text, r, r.choice([1, 9, 80])))]
    a = framing.frame_octet_counted(spark.createDataFrame([(k, t.decode()) for k, t in whole], "k int, line string")).collect()
    b = framing.frame_octet_counted(spark.createDataFrame(parts, "k int, seq long, line binary").repartition(4), partition_by="k", block=block).collect()
    key = lambda x: (x.k, x.line, x.frame_error)
    assert sorted(map(key, a), key=str) == sorted(map(key, b), key=str)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("frame, text", [(framing.frame_json_stream, ' {"a": %d}'), (framing.frame_octet_counted, "8 {'a': %d}")])
def test_short_bodies_are_no_groups_of_their_own(spark, frame, text):
    """Numbers far apart: a body's rows are read together, not each as a block."""
    rows = [(k, 10_000 * (7 * i + k) + h, t) for k in range(7) for i in range(30) for h, t in enumerate([(text % (i % 10))[:4], (text % (i % 10))[4:]])]
    d = spark.createDataFrame(rows, "k int, seq long, line string").repartition(5)
    one, many = frame(d, partition_by="k"), frame(d, partition_by="k", block=20)
    assert "InPandas" not in plan(one) and "InPandas" in plan(many)
    got = [sorted((x.k, x.seq, x.line, x.frame_error) for x in a.collect()) for a in (one, many)]
    assert got[0] == got[1] == sorted((k, 10_000 * (7 * i + k), (text % (i % 10)).lstrip(" 8") if "8" in text else (text % (i % 10)).strip(), None) for k in range(7) for i in range(30))

"""Enrichment, analytics, sinks, snapshots and streams on small tables."""

import ipaddress
import json

from pyspark.sql import functions as F

from loglake.operators import analytics, enrich, sinks, snapshots
from loglake.plans.ingest import ingest
from loglake.sources.readers import raw_from_lines, read_events, read_lake
from loglake.streaming import jobs

CEF = "CEF:0|Acme|Edge|1|7|threat|{sev}|src={ip} dst=10.0.0.1 dpt=443 act=deny in=5 suser=u"


def _events(spark, ips=("185.220.101.5", "10.0.0.3", "52.9.9.9")):
    raw = raw_from_lines(spark.createDataFrame([(i, CEF.format(sev=i + 1, ip=ip)) for i, ip in enumerate(ips)], "seq long, line string"), "t", seq_col="seq")
    good, _ = ingest(raw, [lambda d: enrich.enrich_ips(d, enrich.threat_table(spark), enrich.cloud_table(spark))], formats=["cef"])
    return good


def test_both_join_shapes_equal_a_loop(spark):
    ips = [f"{a}.{b}.101.7" for a in (3, 13, 52, 54, 104, 185, 192) for b in (16, 32, 42, 64, 208, 220)]
    t = spark.createDataFrame([(i,) for i in ips], "ip string")
    nets = enrich.network_table(spark, enrich.CLOUD_NETWORKS)
    want = {i: [c for c, *_ in enrich.CLOUD_NETWORKS if ipaddress.ip_address(i) in ipaddress.ip_network(c)] for i in ips}
    for small in (True, False):
        got = {r["ip"]: [m["cidr"] for m in r["matches"]] for r in enrich.match_cidr(t, nets, small=small).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_ip_classes(spark):
    want = {"127.0.0.1": "loopback", "::1": "loopback", "169.254.1.1": "link_local", "fe80::1": "link_local", "224.0.0.1": "multicast", "192.168.1.1": "private", "100.64.0.1": "private", "8.8.8.8": "public", "2001:db8::1": "public", "999.1.1.1": "invalid", "010.1.1.1": "invalid", "0.0.0.0": "public"}
    rows = spark.createDataFrame([(k,) for k in want], "ip string").select("ip", enrich.ip_class(F.col("ip")).alias("c")).collect()
    assert {r["ip"]: r["c"] for r in rows} == want


def test_enriched_events(spark):
    rows = {r["network"]["src_ip"]: r["enrichment"] for r in _events(spark).collect()}
    assert rows["185.220.101.5"]["threat_ip_detected"] and rows["10.0.0.3"]["src_ip_context"]["ip_type"] == "private"
    assert rows["52.9.9.9"]["src_ip_context"]["cloud_provider"] == "Amazon Web Services"


def test_sinks_round_trip(spark, tmp_path):
    e = _events(spark)
    sinks.write_ndjson(e.drop("seq", "ingest_ts", "event_ts", "source_tag"), f"{tmp_path}/nd")
    assert read_events(spark, f"{tmp_path}/nd").count() == 3
    sinks.write_lake(e, f"{tmp_path}/lake")
    assert read_lake(spark, f"{tmp_path}/lake", tenant_id="default").count() == 3
    sinks.write_kafka_envelope(e, f"{tmp_path}/k")
    assert json.loads(spark.read.text(f"{tmp_path}/k").first()[0])["topic"] == "loglake.events"

    def bad(_):
        raise OSError("disk")

    failed, dlq = sinks.fan_out(e, {"bad": bad, "cef": lambda d: sinks.write_cef(d, f"{tmp_path}/cef")})
    assert list(failed) == ["bad"] and dlq.count() == 3 and spark.read.text(f"{tmp_path}/cef").count() == 3


def test_escaping(spark):
    d = spark.createDataFrame([("a|b\\c=d\te\r\nf",)], "x string")
    from loglake.functions.scalars import cef_header, cef_value, leef_value

    r = d.select(cef_header(F.col("x")), cef_value(F.col("x")), leef_value(F.col("x"))).first()
    assert r[0] == "a\\|b\\\\c=d\te\r\nf" and r[1] == "a|b\\\\c\\=d\te\\nf" and r[2] == "a|b\\\\c=d\\te\\nf"


def test_baseline_save_and_merge(spark, tmp_path):
    rows = [(i, "a", "network", "success", float(i % 7), 100 + i, 0) for i in range(150)]
    d = spark.createDataFrame(rows, "seq long, src_ip string, category string, outcome string, severity double, bytes_in long, bytes_out long")
    b = analytics.build_baseline(d, 120)
    analytics.write_baseline(b, f"{tmp_path}/b")
    old = analytics.read_baseline(spark, f"{tmp_path}/b")
    assert old.first()["sev_n"] == 100
    m = analytics.merge_baseline(old, b, 130).first()
    assert m["sev_n"] == 130 and m["sev_values"][-1] == float(149 % 7)


def test_snapshot_forms_agree(spark):
    rows = [("h", t, p) for t, ps in enumerate([[1, 2], [2, 3], [3], [1, 3]]) for p in ps]
    d = spark.createDataFrame(rows, "host string, snap_ts long, pid long")
    a, b = (sorted(map(tuple, f(d, ["pid"]).collect())) for f in (snapshots.snapshot_diff, snapshots.snapshot_diff_anti))
    assert a == b and ("h", 1, 1, "stopped") in a and ("h", 3, 1, "started") in a


def _stream(spark, tmp_path, d, name):
    d.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(d.schema).parquet(f"{tmp_path}/{name}")


def _run(df, name, mode="append"):
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    w.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"ip{i % 3}", "authentication" if i % 4 else "network", ["failure", "failure", "success", "unknown", "failure"][i % 5], float(i % 6)) for i in range(120)]
    d = spark.createDataFrame(rows, "seq long, src_ip string, category string, outcome string, severity double")
    s = _stream(spark, tmp_path, d, "in")
    got = {(r["seq"], r["chain"]) for r in _run(jobs.stream_auth_chain(s, timeout=None), "chains").collect()}
    assert got == {(r["seq"], r["chain"]) for r in analytics.auth_failure_chain(d).collect()}
    z = {r["seq"]: round(r["z"], 6) for r in _run(jobs.stream_score(s, 20, timeout=None), "scores").collect()}
    o = analytics.online_baseline(d, 20)
    o = o.withColumn("z", analytics.z_of(F.col("severity"), F.col("sev_n"), F.col("sev_mean"), F.col("sev_std")))
    assert z == {r["seq"]: round(r["z"], 6) for r in o.collect()}


def test_stream_ingest_and_dedup(spark, tmp_path):
    import shutil

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.log").write_text("\n".join(CEF.format(sev=3, ip=f"10.0.0.{i}") for i in range(5)) + "\nplain\n")
    from loglake.sources.readers import stream_raw

    out = []
    q = jobs.stream_ingest(stream_raw(spark, str(tmp_path / "raw")), lambda d, hold: ingest(d, formats=["cef"], hold=hold), {"nd": lambda d, n: out.append(d.count())}, lambda d, n: out.append(-d.count()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert sorted(out) == [-1, 5]
    d = spark.sql("select cast(id % 10 as string) event_id, timestamp'2026-01-01' ingest_ts from range(30)")
    jobs.stream_index(_stream(spark, tmp_path, d, "ev"), str(tmp_path / "idx"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 10
    shutil.rmtree(tmp_path / "cp2")


def test_networks_of_both_families_equal_a_loop(spark):
    import ipaddress

    from loglake.operators import enrich

    nets = [("2001:db8::/33", "a"), ("2001:db8:8000::/35", "b"), ("10.0.0.0/9", "c"), ("::/0", "d"), ("fe80::1/128", "e")]
    ips = ["2001:db8::1", "2001:DB8:9fff::2", "10.1.2.3", "10.200.0.1", "fe80::1", "::1", "1:2:3:4:5:6:7:8", "bad", None]
    d, table = spark.createDataFrame([(i,) for i in ips], "ip string"), enrich.network_table(spark, nets)
    want = {i: [k for k, (c, _) in enumerate(nets) if i != "bad" and ipaddress.ip_address(i) in ipaddress.ip_network(c)] for i in ips if i}
    for small in (True, False):
        got = {r["ip"]: [m["rank"] for m in r["matches"]] for r in enrich.match_cidr(d, table, small=small).collect()}
        assert {i: got.get(i, []) for i in want} == want
    rows = d.select("ip", enrich.matches_in(F.col("ip"), table.collect()).alias("m")).collect()
    assert {r["ip"]: [m["rank"] for m in r["m"]] for r in rows if r["ip"]} == want


def test_enrichers_fail_on_their_own(spark, tmp_path):
    e = _events(spark)

    def port(n):
        return 1 // (n - 443)

    def broken(d):
        return d.withColumn("x", F.raise_error(F.lit("no")).cast("int"))

    def absent(d):
        return d.withColumn("y", F.col("no_such_column"))

    chain = [enrich.row_enricher("port", "p", "int", port, "network.dst_port"), enrich.guarded("broken", broken, {"x": "int"}), absent, enrich.guarded("fine", lambda d: d.withColumn("z", F.lit(3)), {"z": "int"}), enrich.row_enricher("name", "u", "string", str.upper, "identity.username")]
    d, counts = enrich.observe_failures(enrich.enrich_all(e, chain), ["port", "broken", "absent", "name"])
    rows = d.collect()
    assert [(r["p"], r["x"], r["z"], r["u"], r["enrichment_errors"]) for r in rows] == [(None, None, 3, "U", ["port", "broken", "absent"])] * 3
    assert counts.get == {"rows": 3, "port": 3, "broken": 3, "absent": 3, "name": 0}
    path = tmp_path / "feed"
    path.mkdir()
    (path / "x.parquet").write_text("no parquet")
    assert enrich.optional_feed(spark, str(path)).count() == 0 and enrich.optional_feed(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    from loglake.sources.readers import stream_raw

    (tmp_path / "raw").mkdir()
    for k in range(3):
        (tmp_path / f"raw/{k}.log").write_text("\n".join(CEF.format(sev=3, ip=f"10.0.{k}.{i}") for i in range(4)) + f"\nplain {k}\n")
    dead, calls = sinks.by_batch(f"{tmp_path}/dead", partition_by=("stage",)), []

    def failing(d, n):
        dead(d, n)
        calls.append(n)
        if len(calls) == 2:
            raise OSError("disk")

    def run():
        q = jobs.stream_ingest(stream_raw(spark, str(tmp_path / "raw"), max_files=1), lambda d, hold: ingest(d, formats=["cef"], hold=hold), {"files": sinks.by_batch(f"{tmp_path}/good")}, failing, f"{tmp_path}/ck", available_now=True)
        q.awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert calls == [0, 1, 1, 2]
    assert spark.read.json(f"{tmp_path}/good").count() == 12 and spark.read.json(f"{tmp_path}/dead").count() == 3


def test_state_is_carried_over_micro_batches(spark, tmp_path):
    rows = [(i, f"ip{i % 2}", "authentication", ["failure", "failure", "failure", "success", "unknown"][i * 7 % 5], float(i % 9)) for i in range(210)]
    schema = "seq long, src_ip string, category string, outcome string, severity double"
    d = spark.createDataFrame(rows, schema)
    for k in range(7):  # in the order of time, as a file source takes them
        spark.createDataFrame(sorted(rows[k * 30 : k * 30 + 30], key=lambda r: -r[0]), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, out in (("chains7", jobs.stream_auth_chain(s, timeout=None)), ("scores7", jobs.stream_score(s, 20, timeout=None))):
        w = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        w.awaitTermination(180)
        assert w.lastProgress.batchId >= 6
    assert {(r["seq"], r["chain"]) for r in spark.table("chains7").collect()} == {(r["seq"], r["chain"]) for r in analytics.auth_failure_chain(d).collect()}
    o = analytics.online_baseline(d, 20)
    o = o.withColumn("z", analytics.z_of(F.col("severity"), F.col("sev_n"), F.col("sev_mean"), F.col("sev_std")))
    assert {r["seq"]: round(r["z"], 6) for r in spark.table("scores7").collect()} == {r["seq"]: round(r["z"], 6) for r in o.collect()}


def test_spool_goes_on_after_a_restart(spark, tmp_path):
    from loglake.sources import readers

    def lot(a, z):
        readers.write_spool(spark.range(a, z).selectExpr("'t' as topic", "id % 2 as partition", "id as offset", "concat('line ', id) as value", "timestamp'2026-01-01' as timestamp"), f"{tmp_path}/in")
        s = readers.stream_spool_raw(spark, f"{tmp_path}/in", "a")
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)

    lot(0, 10)
    lot(6, 16)  # four of them again
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["seq"], r["line"]) for r in got) == [(i, f"line {i}") for i in range(16)] and got[0]["tenant_id"] == "a" and got[0]["source_tag"] == "t"


def test_crosswalk_counts_what_fails(spark, tmp_path):
    from loglake.operators import crosswalk

    sinks.write_ndjson(_events(spark).drop("seq", "ingest_ts", "event_ts", "source_tag"), f"{tmp_path}/nd")
    for i, bad in enumerate(['{"event_id": ', "[1]", "", "  ", "null", '{"event": 5}']):
        (tmp_path / f"nd/bad{i}.json").write_text(bad + "\n")
    for target, path in (("ocsf", "metadata.uid"), ("ecs", "event.id")):
        rows, counts = crosswalk.crosswalk_lines(spark.read.text(f"{tmp_path}/nd"), target)
        got = [json.loads(r["value"]) for r in rows.collect()]
        a, b = path.split(".")
        assert len({x[a][b] for x in got if x.get(a, {}).get(b)}) == 3
        assert counts.get == {"converted": 3, "failed": 4} and len(got) == 3


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """A file of one row group in many splits: one of them has all rows, the others none."""
    from loglake.plans import tables

    spark.range(20_000).selectExpr("id as event_id", "timestamp_micros(id) as ts", "id % 50 as user_id", "'view' as event_type", "double(id % 99) as value", "uuid() as props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(tables, "TASK_ROWS", 2000, raising=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = tables.raw(spark, str(tmp_path))
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 20_000 and len(sizes) >= 10 and max(sizes) <= 3000


def test_what_is_evaluated_once_is_no_generator(spark):
    """Expressions in a generator are interpreted; they belong into the projection before it."""
    from loglake.functions.scalars import let, once

    d = once(spark.range(3), {"x": let(F.col("id") + 1, lambda v: v * v), "id": F.col("id") * 2})
    made = next(line for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
    assert "transform" not in made and sorted(map(tuple, d.select("id", "x").collect())) == [(0, 1), (2, 4), (4, 9)]


def test_short_lists_of_networks_are_no_lambdas(spark):
    from loglake.operators import enrich

    d = spark.createDataFrame([("185.220.101.7",), ("2001:db8::5",), ("1.2.3.4",), (None,), ("x",)], "ip string")
    nets = enrich.network_table(spark, [("185.220.100.0/22", "b"), ("185.220.101.0/24", "a"), ("2001:db8::/32", "six")]).collect()
    m = d.select("ip", enrich.matches_in(F.col("ip"), nets).alias("m"))
    assert {r["ip"]: [x["service"] for x in r["m"]] for r in m.collect()} == {"185.220.101.7": ["b", "a"], "2001:db8::5": ["six"], "1.2.3.4": [], None: [], "x": []}
    assert "lo6" not in m._jdf.queryExecution().optimizedPlan().toString()

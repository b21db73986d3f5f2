"""Steps that all parsing queries share: what they give, and what a row costs."""

import ipaddress

from pyspark.sql import functions as F

from loglake.functions import scalars as S
from loglake.operators import enrich, normalize
from loglake.operators.detect import detect_format
from loglake.operators.extract import extract
from loglake.plans import tables

CEF = "CEF:0|Acme|Edge|1|100|Login failed|9|src=10.1.2.3 spt=4242 in=17 act=deny suser=ann"


def _plan(df) -> str:
    """The optimized plan with all members of its structs."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def test_every_field_is_looked_up_once(spark):
    df = spark.createDataFrame([(CEF, "t")], "line string, source_tag string")
    out = normalize.normalize(extract(detect_format(df), 2026, ["cef"]), formats=["cef"]).select("source", "event", "network", "identity", "rule")
    plan = _plan(out)
    for name in ("spt", "in", "deviceDirection", "suser"):
        assert plan.count(f", {name}, None") == 1, name
    r = out.first()
    assert (r["network"]["src_port"], r["network"]["bytes_in"], r["event"]["outcome"], r["event"]["category"], r["event"]["severity_numeric"]) == (4242, 17, "failure", "authentication", 9.0)


def test_addresses(spark):
    texts = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", " 9.8.7.6 ", "::1", "fe80::1", "2001:db8::a:1", "1:2", ":", "", "abc", None, "1.2.3.4:5", "01.2.3.4"]
    c = F.col("ip")
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", S.valid_ip(c).alias("v"), S.ip_num(c).alias("n"), S.ip_hex(c).alias("h")).collect()

    def parse(t):
        try:
            return ipaddress.ip_address(t)
        except ValueError:
            return None

    for r in got:
        want, bare = parse((r["ip"] or "").strip(" ")), parse(r["ip"] or "")
        assert r["v"] == (r["ip"].strip(" ") if want else None), r["ip"]
        assert r["n"] == (int(bare) if bare and bare.version == 4 else None), r["ip"]
        assert r["h"] == (f"{int(bare):032x}" if bare and bare.version == 6 else None), r["ip"]


def test_networks_of_an_address(spark):
    nets = enrich.network_table(spark, [("10.0.0.0/8", "a", "x"), ("10.1.0.0/16", "b", "y"), ("2001:db8::/32", "c", "z")]).collect()
    ips = ["10.1.2.3", "10.9.9.9", "11.0.0.1", "2001:db8::5", "nothing", None]
    got = spark.createDataFrame([(t,) for t in ips], "ip string").select(enrich.matches_in(F.col("ip"), nets).alias("m")).collect()
    assert [[x["service"] for x in r["m"]] for r in got] == [["a", "b"], ["a"], [], ["c"], [], []]


def test_tasks_of_larger_tables_have_no_more_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    sizes = [len(p) for p in tables.spread(spark.range(2000)).rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 110

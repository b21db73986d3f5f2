"""Jobs whose memory, disk and number of micro-batches follow the rows only as far as they must."""

import glob

from loglake.sources import readers

SPOOL = ["'t' as topic", "0 as partition", "id as offset", "concat('line ', id) as value", "timestamp'2026-01-01' as timestamp"]


def test_a_spool_has_files_by_its_rows_not_by_the_tasks(spark, tmp_path):
    readers.write_spool(spark.range(0, 2000, 1, 40).selectExpr(*SPOOL), f"{tmp_path}/in")
    assert len(glob.glob(f"{tmp_path}/in/*.parquet")) == 6
    assert spark.read.parquet(f"{tmp_path}/in").select("offset").distinct().count() == 2000


def test_state_of_a_spool_is_on_disk_and_goes_on(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    for a, z in ((0, 30), (20, 50)):  # ten of them again
        readers.write_spool(spark.range(a, z).selectExpr(*SPOOL), f"{tmp_path}/in")
        with readers.state_on_disk(spark):
            w = readers.stream_spool_raw(spark, f"{tmp_path}/in", max_files=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert spark.conf.get(key) == before
        assert w.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(50))
    assert "RocksDBStateStoreProvider" in "".join(open(x).read() for x in glob.glob(f"{tmp_path}/ck/offsets/[0-9]*"))


def test_bulk_crosswalk_leaves_its_output_only_and_that_compressed(spark, tmp_path):
    import json

    from loglake.operators.ordered import shared_dir
    from loglake.plans import surface

    spark.sql("select id as event_id, timestamp_micros(id) as ts, id % 50 as user_id, 'view' as event_type, double(id % 99) as value, '{}' as props from range(2000)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    top = shared_dir(spark).removeprefix("file:")
    before, made = set(glob.glob(f"{top}/*")), []
    old, surface._folder = surface._folder, lambda s, name: made.append(f"{tmp_path}/{name}") or made[-1]
    try:
        rows = surface.x03_crosswalk(spark, str(tmp_path)).collect()
    finally:
        surface._folder = old
    assert sorted(map(tuple, rows)) == [("ecs", 2000), ("ocsf", 2000)] and set(glob.glob(f"{top}/*")) == before
    for path in made:
        lines = spark.read.text(path)
        size = sum(len(open(x, "rb").read()) for x in glob.glob(f"{path}/part-*"))
        assert size * 4 < lines.selectExpr("sum(length(value)) as n").first()["n"]
        assert json.loads(lines.first()["value"])


def test_lines_and_their_crosswalks_are_compressed(spark, tmp_path):
    from loglake.plans import surface

    spark.sql("select id as event_id, timestamp_micros(id) as ts, id % 50 as user_id, 'view' as event_type, double(id % 99) as value, '{}' as props from range(2000)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    made, old = [], surface._folder
    surface._folder = lambda s, name: made.append(f"{tmp_path}/{name}") or made[-1]
    try:
        rows = surface.x03_crosswalk_lines(spark, str(tmp_path))
        assert {tuple(r) for r in rows.groupBy("target", "converted", "failed").count().collect()} == {(t, 2000, 400, 2000) for t in ("ocsf", "ecs")}
    finally:
        surface._folder = old
    assert len(made) == 3
    for path in made:
        size = sum(len(open(x, "rb").read()) for x in glob.glob(f"{path}/part-*"))
        assert size * 4 < spark.read.text(path).selectExpr("sum(length(value)) as n").first()["n"]


def test_a_micro_batch_is_held_on_disk_until_it_ends(spark, tmp_path):
    from loglake.operators.ordered import shared_dir
    from loglake.plans.ingest import ingest
    from loglake.streaming import jobs

    (tmp_path / "raw").mkdir()
    lines = [f"CEF:0|V|P|1|7|login|3|src=10.0.0.{i} spt={port}" for i, port in enumerate([22, 70000, 443, 25])]
    (tmp_path / "raw/a.log").write_text("\n".join([*lines, "plain"]) + "\n")
    top, seen = shared_dir(spark).removeprefix("file:"), []
    before = set(glob.glob(f"{top}/*"))

    def look(d, number):
        tables = [x for x in glob.glob(f"{top}/batch-*/*") if x.rsplit("/", 1)[0] not in before]
        seen.append((spark.sparkContext._jsc.getPersistentRDDs().size(), len(tables), d.count()))

    def transform(d, hold):
        assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one small file is one split
        return ingest(d, formats=["cef"], hold=hold)

    jobs.stream_ingest(readers.stream_raw(spark, f"{tmp_path}/raw"), transform, {"a": look, "b": look}, look, f"{tmp_path}/ck", available_now=True).awaitTermination(120)
    assert seen == [(0, 2, 3), (0, 2, 3), (0, 2, 2)]  # what is parsed and what is checked; nothing in memory
    assert set(glob.glob(f"{top}/*")) == before

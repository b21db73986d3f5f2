"""Security tables that are derived from the driver's tables, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglake.operators.ordered import TASK_ROWS, dealt
from loglake.session import prepare

SEC_EVENTS = """
    select event_id as seq,
      case when user_id % 2 = 0 then 'tenant_alpha' else 'tenant_beta' end as tenant_id,
      concat(case user_id % 6 when 0 then '10.0.0.' when 1 then '185.220.101.' when 2 then '104.16.5.' when 3 then '203.0.113.' when 4 then '52.10.1.'
             else '192.168.7.' end, cast(user_id % 250 as varchar(20))) as src_ip,
      1024 + user_id as src_port, 443 as dst_port,
      case when event_id % 200 = 0 then 'database' when event_type = 'signup' then 'authentication' when event_type = 'error' then 'threat'
           when event_type = 'purchase' then 'policy' else 'network' end as category,
      case when value > 60 then 'failure' when value > 20 then 'success' else 'unknown' end as outcome,
      cast(floor(value / 40) as int) as sev, cast(floor(value * 100) as bigint) as bytes_in, user_id, event_type, ts
    from events"""

_N = "cast({} as varchar(20))"
_P, _U, _S, _B, _Q = (_N.format(x) for x in ("src_port", "user_id", "sev", "bytes_in", "seq"))
_ACT = "case outcome when 'failure' then 'deny' when 'success' then 'allow' else 'log' end"

CEF = f"""concat('CEF:0|Acme|Edge|1.0|', event_type, '|', category, '|', {_S}, '|src=', src_ip, ' dst=10.0.0.1 spt=', {_P}, ' dpt=443 proto=TCP act=',
    {_ACT}, ' in=', {_B}, ' suser=user', {_U}, ' cs1=', {_Q})"""
SEC_LINES = f"select *, {CEF} as line from ({SEC_EVENTS}) s"

#: Seven formats and lines that no format takes, by user.
MIXED = f"""select *, case user_id % 9
      when 0 then {CEF}
      when 1 then concat('LEEF:1.0|Acme|Gate|1.0|', event_type, '|src=', src_ip, chr(9), 'dst=10.0.0.1', chr(9), 'spt=', {_P}, chr(9), 'sev=', {_S}, chr(9), 'usrName=user', {_U}, chr(9), 'srcBytes=', {_B}, chr(9), 'action=', {_ACT})
      when 2 then concat('<166>Aug  5 10:20:30 fw1 %ASA-4-106100: access-list OUT permitted tcp outside/', src_ip, '(', {_P}, ') -> inside/10.0.0.1(443) hit ', {_Q})
      when 3 then concat('2026/01/02 03:04:05,0011,TRAFFIC,end,1,x,', src_ip, ',10.0.0.1,,,"rule, ', event_type, '",user', {_U}, ',,web,vsys1,untrust,trust,e1,e2,log,end,', {_Q}, ',1,', {_P}, ',443,0,0,0x0,TCP,', {_ACT}, ',100,7,', {_B}, ',3,x,9')
      when 4 then concat('<34>Aug  5 10:20:30 host1 sshd[', {_P}, ']: login from ', src_ip, ' number ', {_Q})
      when 5 then concat('<165>1 2026-08-05T10:20:30Z host2 app ', {_P}, ' ID', {_U}, ' [ex@1 ip="', src_ip, '" n="', {_Q}, '"] something happened')
      when 6 then concat('{{"ts":"2026-08-05T10:20:30Z","event":"', event_type, '","src":"', src_ip, '","src_port":', {_P}, ',"severity":', {_S}, ',"user":"user', {_U}, '","n":', {_Q}, '}}')
      when 7 then concat('srcip=', src_ip, ' spt=', {_P}, ' n=', {_Q})
      else concat('plain text ', {_Q}) end as line
    from ({SEC_EVENTS}) s"""


def view(spark: SparkSession, sf_dir: str, sql: str, table: str = "events", even: bool = False) -> DataFrame:
    """The result of one of the statements above over the table's Parquet file, whose rows may
    be dealt out before."""
    t = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    name = f"_loglake_{table}"
    (spread(t) if even else t).createOrReplaceTempView(name)
    return spark.sql(sql.replace(f"from {table}", f"from {name}"))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table dealt out, so that tasks are of one size. A file's splits are not:
    a row group is in one of them, and the other splits that cover it have no rows."""
    return dealt(df, TASK_ROWS)


def raw(spark: SparkSession, sf_dir: str, sql: str = SEC_LINES) -> DataFrame:
    """Raw records of the lines, with the columns they were made of beside them."""
    return view(spark, sf_dir, sql, even=True).selectExpr("*", "'edge' as source_tag", "cast(line as binary) as raw_bytes", "cast(ts as timestamp) as ingest_ts", "unix_timestamp(cast(ts as timestamp)) as unix_ts", "sev as severity", "cast(0 as bigint) as bytes_out")

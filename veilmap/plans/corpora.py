"""Text corpora derived from the given tables."""

from pyspark.sql import DataFrame, SparkSession

# The same text runs in Spark SQL and DuckDB.
LOG_LINES_SQL = r"""
select event_id as line_id, concat('evt=',cast(event_id as string),' ',event_type,' user',cast(user_id%97 as string),
 '@corp',cast(user_id%7 as string),'.contoso.local from 10.',cast(user_id%4 as string),'.',cast(event_id%256 as string),'.',
 cast((event_id*7)%256 as string),':',cast(1024+event_id%5000 as string),' connected to SRV-APP-',
 lpad(cast(event_id%40 as string),2,'0'),'.fabrikam.local',
 case event_id%8
  when 0 then concat(' subnet 192.168.',cast(event_id%200 as string),'.0/24 bad 10.0.999.1/33')
  when 1 then concat(' object ',substr(md5(cast(user_id as string)),1,8),'-',substr(md5(cast(user_id as string)),9,4),'-',
        substr(md5(cast(user_id as string)),13,4),'-',substr(md5(cast(user_id as string)),17,4),'-',substr(md5(cast(user_id as string)),21,12))
  when 2 then concat(' sid S-1-5-21-',cast(1000000+user_id as string),'-',cast(event_id%9 as string),'-77-',cast(1000+user_id%50 as string))
  when 3 then concat(' mac AA:BB:CC:',upper(substr(md5(cast(user_id as string)),1,2)),':',upper(substr(md5(cast(user_id as string)),3,2)),':0F')
  when 4 then concat(' share ',chr(92),chr(92),'FILESVR',cast(user_id%5 as string),chr(92),'Finance$',chr(92),'q',cast(event_id%4 as string))
  when 5 then concat(' public 8.8.8.8 mail user',cast(user_id as string),'@gmail.com file report.txt at 2025-03-01T10:15 on 2025-03-01')
  when 6 then concat(' node FILESVR',lpad(cast(user_id%60 as string),2,'0'),' host SQL-PROD-',lpad(cast(user_id%12 as string),2,'0'))
  else ' heartbeat ok' end) as line
from events
"""


_PARTITIONS = "spark.veilmap.inputPartitions"
# Log lines of one task.
_LINES = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its files are split.  Where these are too few for the cores, as with one small
    file, the caller may set `spark.veilmap.inputPartitions`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def log_lines_of(events: DataFrame, with_time: bool = False) -> DataFrame:
    """(line_id, line) or (line_id, ts, line): infrastructure log lines, one per event."""
    sql = LOG_LINES_SQL.replace("from events", "from {events}")
    if with_time:
        sql = sql.replace("event_id as line_id,", "event_id as line_id, ts,", 1)
    return events.sparkSession.sql(sql, events=events)


def spread_events(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Events in partitions of some thousands: a file has few row groups, and a row much work."""
    n = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // _LINES)
    return events.repartition(n, "event_id") if n > 1 and not spark.conf.get(_PARTITIONS, None) else events


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_of(spread_events(spark, sf_dir, table(spark, sf_dir, "events")))

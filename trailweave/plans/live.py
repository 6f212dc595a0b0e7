"""Queries that run a stream to its end: a table is written as files, streamed through in batches, and the results are read back.

Files follow each other in event time, a few for each batch, so state goes from one batch to the next; rows that a query
names for a later batch come late. A row far in the future follows in a file of its own, so that every window of the
table closes; it is left out again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators.lineage import shared_folder
from trailweave.streaming import live, motion, session

from .evidence import rounded
from .views import fixes, imu, sql

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


BATCHES, FILES = 4, 2


def source(spark: SparkSession, df: DataFrame, ts: str = "ts", part=None) -> DataFrame:
    """The rows of ``df`` as a stream of ``BATCHES`` batches, and a last row a year after all others.

    ``part`` numbers the batch of each row, from 0; without it the time that the table spans is cut evenly.
    """
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if part is None:
        lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
        part = F.floor((F.unix_micros(ts) - (lo or 0)) * BATCHES / ((hi or 0) - (lo or 0) + 1))
    last = spark.range(1).select(*[(F.lit("2030-01-01").cast("timestamp") if f.name == ts else F.lit(-1 if f.name == "trip_id" else None).cast(f.dataType)).alias(f.name) for f in df.schema])
    for b in range(BATCHES):
        df.where(part == b).repartition(FILES).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    # files are taken in the order in which they were written
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def ended(stream: DataFrame) -> DataFrame:
    """All that the stream gives, once it has run to the end of its files."""
    spark, path = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/streamed-{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").where("trip_id >= 0")


def at(seconds):
    """A time on 2024-01-01, whole in microseconds."""
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long") + 1_704_067_200_000_000)


def sample_stream(spark, d):
    """Motion samples; every seventh comes twice, and every eleventh of the first quarter comes with the last batch: too late."""
    rows = imu(spark, d).select("trip_id", at(c("n") / 10.0).alias("ts"), c("a_long").alias("a"), c("yaw").alias("w"), "n")
    longest = rows.agg(F.max("n")).first()[0] or 0
    part = F.floor(c("n") * BATCHES / (longest + 1))
    rows = rows.unionByName(rows.where("n % 7 = 0")).withColumn("part", F.when((part == 0) & (c("n") % 11 == 5), BATCHES - 1).otherwise(part))
    return source(spark, rows.select("trip_id", "ts", "a", "w", "part"), part=c("part"))


put("SS-01", lambda spark, d: rounded(ended(motion.bins(sample_stream(spark, d), "500 milliseconds", "100 milliseconds")).select("trip_id", ((F.unix_micros("start") - 1_704_067_200_000_000) / 500_000).cast("long").alias("bin"), "n", "a", "w")),
    "with m as (select max(n) as longest from imu) select trip_id, n // 5 as bin, count(*) as n, round(avg(a_long), 6) as a, round(avg(yaw), 6) as w from imu cross join m where not (n * 4 // (longest + 1) = 0 and n % 11 = 5) group by 1, 2", "imu")


def fix_stream(spark, d):
    return source(spark, fixes(spark, d).select("trip_id", at(c("seq") * 1.0).alias("ts"), "seq", "speed", (c("k") / 10.0).alias("w")))


def waiting(spark, d):
    m = source(spark, imu(spark, d).select("trip_id", at(c("n") / 10.0).alias("mts"), c("a_long").alias("a")), "mts")
    out = ended(motion.aligned(fix_stream(spark, d), m))
    return rounded(out.groupBy("trip_id", ((F.unix_micros("ts") - 1_704_067_200_000_000) / 1_000_000).cast("long").alias("seq")).agg(F.count("*").alias("n"), F.sum("a").alias("a")))


put("SS-03", waiting, "select f.trip_id, f.seq, count(*) as n, round(sum(a_long), 6) as a from fixes f join imu i on i.trip_id = f.trip_id and i.n <= f.seq * 10 and i.n > f.seq * 10 - 10 group by 1, 2", "imu")
put("SS-07", lambda spark, d: rounded(ended(motion.rates(fix_stream(spark, d), "2 seconds")).select("trip_id", ((F.unix_micros("at") - 1_704_067_200_000_000) / 2_000_000).cast("long").alias("tick"), "n", "w")),
    "select trip_id, seq // 2 + 1 as tick, count(*) as n, round(arg_max(k, seq) / 10.0e0, 6) as w from fixes group by 1, 2", "fixes")
put("SS-08", lambda spark, d: ended(motion.sliding(fix_stream(spark, d), "20 seconds", "5 seconds")).select("trip_id", ((F.unix_micros("at") - 1_704_067_200_000_000) / 5_000_000).cast("long").alias("step"), "n", "slow"),
    "select trip_id, seq // 5 + j as step, count(*) as n, count(*) filter (where speed <= 3.0e0) as slow from fixes cross join (select unnest(range(1, 5)) as j) group by 1, 2", "fixes")
put("SS-14", lambda spark, d: ended(live.sessions(source(spark, fixes(spark, d).select("trip_id", at(c("t")).alias("ts"))), "60 seconds")).select("trip_id", F.round((F.unix_micros("start") - 1_704_067_200_000_000) / 1e6, 3).alias("start"), "fixes"),
    "with j as (select *, case when t - lag(t) over (partition by trip_id order by t, seq) < 60.0e0 then 0 else 1 end as new from fixes), g as (select *, sum(new) over (partition by trip_id order by t, seq) as s from j) select trip_id, round(min(t), 3) as start, count(*) as fixes from g group by trip_id, s", "fixes")


def still(spark, d):
    rows = imu(spark, d).select("trip_id", at(c("n") / 10.0).alias("ts"), c("t"), (c("a_long") / 4).alias("a"))
    return ended(motion.quiet(source(spark, rows), 0.3, 0.35)).groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if("quiet").alias("quiet"))


put("SS-02", still, """with b as (select *, case when abs(a_long / 4) >= 0.35e0 then 1 else 0 end as loud from imu), g as (select *, sum(loud) over (partition by trip_id order by n) as run from b), s as (select *, min(case when loud = 0 then t end) over (partition by trip_id, run) as start from g)
select trip_id, count(*) as n, count(*) filter (where loud = 0 and t - start >= 0.3e0) as quiet from s group by 1""", "imu")  # fmt: skip


def arrivals(spark, d):
    """Fixes and ends of trips as they arrive: every ninth fix a batch later than its time, an end after three quarters of
    the fixes and another after all."""
    f = fixes(spark, d).select("trip_id", "seq", F.max("seq").over(Window.partitionBy("trip_id")).alias("most"))
    part = F.floor((c("seq") - 1) * BATCHES / c("most"))
    late = F.least(F.lit(BATCHES - 1), part + F.when(c("seq") % 9 == 4, 1).otherwise(0))
    rows = f.select("trip_id", late.alias("part"), "seq", (c("seq") * 1.0).alias("t"), F.lit("fix").alias("kind"))
    ends = f.select("trip_id", "most").distinct()
    rows = rows.unionByName(ends.select("trip_id", F.lit(2).cast("long").alias("part"), (c("most") * 10).alias("seq"), (c("most") * 1.0).alias("t"), F.lit("end").alias("kind")))
    rows = rows.unionByName(ends.select("trip_id", F.lit(3).cast("long").alias("part"), (c("most") * 20).alias("seq"), (c("most") * 2.0).alias("t"), F.lit("end").alias("kind")))
    return rows.withColumn("arrival", c("part") * 1_000_000 + c("seq")).withColumn("ts", at(c("arrival") / 1000.0))


def judged(spark, d):
    return ended(session.policed(source(spark, arrivals(spark, d).select("trip_id", "ts", "arrival", "t", "kind", "part"), part=c("part"))))


ARRIVALS = """f as (select trip_id, seq, max(seq) over (partition by trip_id) as most from fixes
), a as (
  select trip_id, least(3, ((seq - 1) * 4) // most + case when seq % 9 = 4 then 1 else 0 end) as part, seq, seq * 1.0e0 as t, 'fix' as kind from f
  union all select distinct trip_id, 2, most * 10, most * 1.0e0, 'end' from f union all select distinct trip_id, 3, most * 20, most * 2.0e0, 'end' from f
), b as (
  select *, part * 1000000 + seq as arrival from a
), e as (
  select *, (select min(arrival) from b x where x.trip_id = b.trip_id and x.kind = 'end') as ended from b
), v as (
  select *, case when kind = 'end' then case when arrival = ended then 'finished' else 'finished_again' end when arrival > ended then 'after_end'
    when t <= max(case when kind = 'fix' then t end) over (partition by trip_id order by arrival rows between unbounded preceding and 1 preceding) then 'out_of_order' else 'accepted' end as verdict from e
)"""
put("SS-04", lambda spark, d: judged(spark, d).where("verdict not like 'finished%'").select("trip_id", "arrival", "t", "verdict"),
    "with " + ARRIVALS + " select trip_id, arrival, t, verdict from v where kind = 'fix'", "fixes")
put("SS-11", lambda spark, d: judged(spark, d).where("verdict like 'finished%'").select("trip_id", "arrival", "verdict", "n", "last"),
    "with " + ARRIVALS + ", r as (select trip_id, count(*) filter (where verdict = 'accepted') as n, max(t) filter (where verdict = 'accepted') as last from v group by 1) select v.trip_id, arrival, verdict, n, last from v join r on r.trip_id = v.trip_id where kind = 'end'", "fixes")


def warm_up(spark, d):
    """Motion of trips whose heading is known at the first strong push, of those with an odd number never; twelve rows are held."""
    rows = imu(spark, d).select("trip_id", at(c("n") / 10.0).alias("ts"), "n", c("a_long").alias("a"), ((c("a_long") > 1.9) & (c("trip_id") % 2 == 0)).alias("ready"))
    return rounded(ended(session.warmed(source(spark, rows), cap=12)))


put("SS-05", warm_up, """with r as (select trip_id, n, a_long as a, a_long > 1.9e0 and trip_id % 2 = 0 as ready from imu), k as (
  select *, min(case when ready then n end) over (partition by trip_id) as at_ from r), h as (
  select *, row_number() over (partition by trip_id, at_ is null or n < at_ order by n desc) as back from k)
select trip_id, n, round(a, 6) as a, case when at_ is null then 'forced' when n < at_ then 'held' else 'straight' end as how from h where n >= at_ or back <= 12""", "imu")  # fmt: skip


def settling(spark, d):
    """Turns that end at every tick of one kind, usable a second later and given up five seconds after their peak."""
    rows = imu(spark, d).select("trip_id", at(c("n") / 10.0).alias("ts"), c("t"), F.when(c("h") % 23 == 5, c("n")).alias("turn"), (c("t") - 0.2).alias("peak"))
    return rounded(ended(session.settled(source(spark, rows), age=5.0)))


put("SS-15", settling, """with k as (select a.trip_id, a.n as turn, min(b.t) filter (where b.t >= a.t + 1.0e0) as usable, a.t - 0.2e0 as peak, a.trip_id as q from imu a join imu b on b.trip_id = a.trip_id and b.n > a.n where a.h % 23 = 5 group by a.trip_id, a.n, a.t)
select trip_id, turn, 'usable' as what, round(usable, 6) as t from k where usable is not null
union all select k.trip_id, turn, 'expired', round(min(b.t), 6) from k join imu b on b.trip_id = k.trip_id and b.t > k.usable and b.t - k.peak > 5.0e0 group by 1, 2""", "imu")  # fmt: skip


def late_measurements(spark, d):
    """Speeds of fixes, every ninth a batch late, every thirteenth later still, filtered; a lag of a third of the trip's fixes."""
    f = fixes(spark, d).select("trip_id", "seq", "speed", F.max("seq").over(Window.partitionBy("trip_id")).alias("most"))
    part = F.floor((c("seq") - 1) * BATCHES / c("most"))
    later = F.when(c("seq") % 13 == 6, 3).when(c("seq") % 9 == 4, 1).otherwise(0)
    rows = f.select("trip_id", F.least(F.lit(BATCHES - 1), part + later).alias("part"), "seq", (c("seq") * 1.0).alias("t"), c("speed").alias("z"))
    ends = f.select("trip_id", F.lit(BATCHES - 1).cast("long").alias("part"), (c("most") + 1).alias("seq"), (c("most") + 1.0).alias("t"), F.lit(None).cast("double").alias("z")).distinct()
    rows = rows.unionByName(ends).withColumn("arrival", c("part") * 1_000_000 + c("seq"))
    stream = source(spark, rows.select("trip_id", at(c("arrival") / 1000.0).alias("ts"), "arrival", "t", "z", "part"), part=c("part"))
    return rounded(ended(session.delayed(stream, lag=6.0)).select("trip_id", "t", "z", "level", "var", "what"), 5)


put("SS-13", late_measurements, """with recursive f as (select trip_id, seq, speed as z, max(seq) over (partition by trip_id) as most from fixes
), a as (
  select *, seq * 1.0e0 as t, least(3, ((seq - 1) * 4) // most + case when seq % 13 = 6 then 3 when seq % 9 = 4 then 1 else 0 end) * 1000000 + seq as arrival from f
), w as (
  select *, max(t) over (partition by trip_id order by arrival rows between unbounded preceding and 1 preceding) as newest from a
), k as (
  select *, coalesce(t < newest - 6.0e0, false) as late from w
), told as (
  select trip_id, t, z, row_number() over (partition by trip_id order by t) as rn from k where not late
), r as (
  select trip_id, t, z, rn, 25.0e0 / 27.0e0 * z as level, 25.0e0 * 2.0e0 / 27.0e0 as var from told where rn = 1
  union all
  select r.trip_id, n.t, n.z, n.rn, r.level + (r.var + 0.5e0 * (n.t - r.t)) / (r.var + 0.5e0 * (n.t - r.t) + 2.0e0) * (n.z - r.level), (r.var + 0.5e0 * (n.t - r.t)) * 2.0e0 / (r.var + 0.5e0 * (n.t - r.t) + 2.0e0) from r join told n on n.trip_id = r.trip_id and n.rn = r.rn + 1
)
select trip_id, round(t, 5) as t, round(z, 5) as z, round(level, 5) as level, round(var, 5) as var, 'told' as what from r union all select trip_id, round(t, 5), round(z, 5), null, null, 'too_late' from k where late""", "fixes")  # fmt: skip

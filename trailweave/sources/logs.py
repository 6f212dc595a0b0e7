"""Readers of logger files and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import gates

GPS = ("timestamp_ms", "lat", "lon", "speed", "course")
IMU = ("timestamp", "acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z", "quat_w", "quat_x", "quat_y", "quat_z")
SAMPLE = "type string, monotonic_time double, latitude double, longitude double, horizontal_accuracy double, speed double, course double, user_acceleration_g array<double>, rotation_rate array<double>, quaternion array<double>"


def numbers(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Named columns of a CSV file with a header, as doubles; what is no finite number is null. Other columns are not read."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")

    def number(name: str):
        x = F.col(name).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(name)

    return raw.select(*[number(c) for c in columns])


def gps(spark: SparkSession, path: str) -> DataFrame:
    """Fixes with a time and coordinates in range."""
    d = numbers(spark, path, GPS)
    return d.where("timestamp_ms is not null and abs(lat) <= 90 and abs(lon) <= 180")


def imu(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Samples of which all columns are finite, within a window of time."""
    d = numbers(spark, path, IMU).dropna()
    d = d if start is None else d.where(F.col("timestamp") >= start)
    return d if end is None else d.where(F.col("timestamp") <= end)


def gga(spark: SparkSession, path: str) -> DataFrame:
    """Time of day, quality, satellites and dilution of the GGA sentences of an NMEA file.

    A sentence is a dollar sign, two letters of the talker, its kind, and fields between commas; the first field is the
    time as hhmmss.ss, the sixth the quality, then satellites and dilution. Sentences without a time or quality go.
    """
    field = F.split("value", ",")
    rows = spark.read.text(path).where(F.col("value").startswith("$") & (F.substring(field[0], 4, 3) == "GGA") & (F.length(field[0]) == 6) & (F.size(field) >= 10))
    at = lambda i: F.get(field, F.lit(i))
    part = lambda start, size: F.substring(at(1), start, size).try_cast("double")
    seconds = part(1, 2) * 3600 + part(3, 2) * 60 + part(5, 20)
    out = rows.select(seconds.alias("tod"), at(6).try_cast("int").alias("quality"), at(7).try_cast("int").alias("satellites"), at(8).try_cast("double").alias("hdop"))
    return out.where("tod is not null and quality is not null")


def parsed(lines: DataFrame, *keys: str) -> DataFrame:
    """The fields of JSON lines (value) and what kind each is; blank lines are skipped, a cut-off line counts as malformed."""
    rows = lines.where(F.trim("value") != "").select(*keys, F.from_json("value", SAMPLE).alias("x"))
    kind = F.when(F.col("x.type").isNull(), "malformed").when(F.col("x.type").isin("location", "motion"), F.col("x.type")).otherwise("unknown")
    return rows.select(*keys, "x.*", kind.alias("kind"))


def samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixes, motion samples and the counts of kinds of line of a trip in JSON lines; a cut-off line counts as malformed."""
    rows = parsed(spark.read.text(path))
    report = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return rows.where("kind = 'location'"), rows.where("kind = 'motion'"), report


def usable_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fixes that can be used, in order of time, and how many others were dropped for which reason."""
    located, _, _ = samples(spark, path)
    accuracy = F.col("horizontal_accuracy")
    good = gates.usable(F.col("monotonic_time"), F.col("latitude"), F.col("longitude"), accuracy)
    rows = located.withColumn("why", gates.rejection(good, accuracy))
    return rows.where("why is null").drop("why").sort("monotonic_time"), rows.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Only the times of a motion log; no other column is parsed."""
    return numbers(spark, path, ("timestamp",)).dropna()


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of an RFID log, strictly: a bad required number, a place off the globe, no row at all, or more than one
    device is an error."""
    needed, more = ("host_time_ms", "anchor_ts_ms", "heading", "lat", "lon"), ("imu_sample_ts_ms", "dt_residual_ms")
    raw = spark.read.csv(path, header=True)
    missing = {*needed, "device_id", "anchor_id"}.difference(raw.columns)
    if missing:
        raise ValueError(f"no column {' or '.join(sorted(missing))} in the checkpoints of {path}")
    finite = lambda n: F.when(~F.isnan(F.col(n).try_cast("double")) & (F.abs(F.col(n).try_cast("double")) < float("inf")), F.col(n).try_cast("double"))
    optional = [(finite(n) if n in raw.columns else F.lit(None).cast("double")).alias(n) for n in more]
    clamped = F.coalesce(F.lower(F.trim("clamped")) == "true", F.lit(False)) if "clamped" in raw.columns else F.lit(False)
    rows = raw.select("device_id", "anchor_id", *[finite(n).alias(n) for n in needed], *optional, clamped.alias("clamped"))
    bad = sum(F.col(n).isNull().cast("int") for n in needed)
    seen = rows.agg(F.count("*").alias("n"), F.sum((bad > 0).cast("int")).alias("bad"), F.sum(((F.abs("lat") > 90) | (F.abs("lon") > 180)).cast("int")).alias("off"), F.count_distinct("device_id").alias("devices")).first()
    if not seen["n"] or seen["bad"] or seen["off"] or seen["devices"] > 1:
        raise ValueError(f"{path}: {seen['n']} rows, {seen['bad']} with an invalid number, {seen['off']} with an invalid place, {seen['devices']} devices")
    return rows.withColumn("course", F.pmod(F.col("heading"), F.lit(360.0)))


def imu_si(spark: SparkSession, path: str, columns: int = 21, header: list[str] | None = None) -> DataFrame:
    """Motion rows in SI units as accelerations in g, rates in degrees and the attitude; rows of another width are dropped.

    Without ``header`` the first line names the columns; with it, files need none.
    """
    names = ("time", "ax", "ay", "az", "gx", "gy", "gz", "quat_w", "quat_x", "quat_y", "quat_z")
    text = spark.read.text(path)
    header = header or text.first()[0].split(",")
    place = {n: header.index(n) for n in names}
    cells = F.split("value", ",")
    rows = text.where((F.size(cells) == columns) & (cells[place["time"]] != "time"))
    d = rows.select(*[F.when(~F.isnan(cells[i].try_cast("double")), cells[i].try_cast("double")).alias(n) for n, i in place.items()]).dropna()
    return d.select("time", *[(F.col(n) / 9.80665).alias(n) for n in ("ax", "ay", "az")], *[F.degrees(n).alias(n) for n in ("gx", "gy", "gz")], "quat_w", "quat_x", "quat_y", "quat_z")


def days(gps_files: DataFrame, imu_files: DataFrame) -> DataFrame:
    """The dates, as in the names of the files (name), of which there is a position and a motion log."""
    date = lambda df: df.select(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1).alias("day")).where("day <> ''").distinct()
    return date(gps_files).join(date(imu_files), "day", "left_semi")

"""File sources with the schemas that condition-monitoring exports have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE = "timestamp string, sensorId string, value double, unit string, quality string"
SNAPSHOT = "timestamp string, machineId string, sensors map<string,struct<value:double,unit:string>>, operatingConditions struct<rpm:double,load:double,ambientTemp:double>, faultInfo struct<type:string,severity:double>"
WAVEFORM = "sensorId string, startTime string, sampleRate int, samples array<double>, metadata struct<unit:string,faultType:string,severity:double,windowSize:int>"
MESSAGES = "payload double, topic string, _msgid string, config struct<method:string,windowSize:int,zscoreThreshold:double>, timestamp double"
TRAINING = "features array<double>, timestamp string, label string, severity double"
DATASET = "datasetInfo struct<name:string,created:string,samples:int,features:array<string>,classes:array<string>,featureDimension:int>, data array<struct<x:array<double>,y:string,severity:double>>"


def single(spark: SparkSession, path: str) -> DataFrame:
    """One measurement a document: readings."""
    d = spark.read.schema(SINGLE).option("multiLine", True).json(path)
    return d.select(F.col("sensorId").alias("series_id"), F.col("timestamp").try_cast("timestamp").alias("ts"), "value", "unit", "quality")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Multi-sensor snapshots: records with a map of sensors."""
    d = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    return d.select(F.col("machineId").alias("entity_id"), F.col("timestamp").try_cast("timestamp").alias("ts"), F.transform_values("sensors", lambda _, v: v["value"]).alias("sensors"), "operatingConditions", "faultInfo")


def waveforms(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(WAVEFORM).option("multiLine", True).json(path)
    return d.select(F.col("sensorId").alias("series_id"), F.col("startTime").try_cast("timestamp").alias("ts"), "samples", F.col("sampleRate").cast("double").alias("sampling_rate"), "metadata")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages with settings of their own: readings with cfg columns."""
    d = spark.read.schema(MESSAGES).option("multiLine", True).json(path)
    return d.select(F.col("topic").alias("series_id"), F.timestamp_millis(F.col("timestamp").cast("long")).alias("ts"), F.col("payload").alias("value"), F.col("config.zscoreThreshold").alias("cfg_zscore_threshold"), F.col("config.method").alias("cfg_method"))


def ndjson(spark: SparkSession, path: str, time: str = "t", streaming: bool = False) -> DataFrame:
    """Wide lines {t, sensor, sensor, ...} to readings.  A stream needs its schema: it is taken from the files that are there."""
    schema = spark.read.json(path).schema
    d = (spark.readStream if streaming else spark.read).schema(schema).json(path)
    sensors = [c for c in d.columns if c != time]
    return d.unpivot([time], sensors, "series_id", "value")


def training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING).json(path)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a dataset document."""
    d = spark.read.schema(DATASET).option("multiLine", True).json(path)
    return d.select(F.explode("data").alias("s")).select(F.col("s.x").alias("values"), F.col("s.y").alias("label"), F.coalesce("s.severity", F.lit(0.0)).alias("severity"))


def collected_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A collector's CSV: rows with ``values``, and the feature names from its header."""
    d = spark.read.option("header", True).csv(path)
    names = [c for c in d.columns if c not in ("timestamp", "label", "severity")]
    return d.select(F.col("timestamp").try_cast("timestamp").alias("ts"), F.array(*[F.col(f"`{n}`").try_cast("double") for n in names]).alias("values"), "label", F.coalesce(F.col("severity").try_cast("double"), F.lit(0.0)).alias("severity")), names

"""Engine inputs from the star-schema tables: events as model predictions, orders as videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_WIDTH, IMAGE_HEIGHT = 1920, 1080
_LABELS = {"click": "Tapirus", "view": "Mazama", "purchase": "Canis lupus", "error": "未知动物", "signup": "未分类动物"}
_NAMES = ("demo-deer.jpg", "demo-BOAR.JPG", "demo-fox.jpg", "demo-wolf.jpg", "demo-empty-scene.jpg", "firefox-board.png", "IMG_0001.JPG", "")
_RATES = (25.0, 29.97, 30.0, 50.0, 0.0)
_INTERVALS = {"1-URGENT": 0.1, "2-HIGH": 0.5, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 2.0, "5-LOW": 5.0}


def _chosen(column, values: dict):
    chain = F
    for key, value in values.items():
        chain = chain.when(column == key, F.lit(value))
    return chain


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction an event."""
    e, u = F.col("event_id"), F.col("user_id")
    video = u % 3 == 0
    media_id = F.concat(F.lit("m"), F.lpad(u.cast("string"), 6, "0"))
    index = F.when(video, (e % 2250).cast("int")).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e, media_id.alias("media_id"), F.when(video, "video").otherwise("image").alias("media_type"), index.alias("frame_index"),
        F.bround(index / 25, 2).alias("frame_time"), ((e * 37) % 101 / 100).alias("det_conf"), (F.get_json_object("props", "$.k").cast("int") / 100).alias("cls_conf"),
        F.struct(((e * 13) % 2000 - 40).cast("int").alias("x"), ((e * 7) % 1140 - 30).cast("int").alias("y"), (40 + e % 400).cast("int").alias("width"), (40 + e % 300).cast("int").alias("height")).alias("bbox"),
        _chosen(e % 20, {0: "person", 1: "vehicle"}).otherwise("animal").alias("detected_type"), _chosen(F.col("event_type"), _LABELS).alias("species_label"),
        F.when(video, F.concat(media_id, F.lit(".mp4"))).otherwise(_chosen(u % 8, dict(enumerate(_NAMES)))).alias("source_name"), F.col("ts").alias("saved_at"),
    )
    order = Window.partitionBy("media_id", "frame_time").orderBy("event_id")
    return rows.withColumn("det_index", F.row_number().over(order) - 1)


def media(rows: DataFrame) -> DataFrame:
    """The media items of predictions, with the time each was saved."""
    return rows.groupBy("media_id").agg(F.first("media_type").alias("media_type"), F.first("source_name").alias("source_name"), F.max("saved_at").alias("saved_at"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video an order."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("v"), F.lpad(k.cast("string"), 8, "0")).alias("media_id"), _chosen(k % 5, dict(enumerate(_RATES))).alias("reported_fps"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("frame_count"), _chosen(F.col("o_orderpriority"), _INTERVALS).alias("interval"),
    )

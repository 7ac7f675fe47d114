"""Summaries of a media item's detections. Media without any keep their row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camtrail.functions.labels import DEMO_LABELS
from camtrail.functions.text import annotated_path
from camtrail.operators.detections import FALLBACK_CLASSIFIER

# Fixed values.
NOTHING_FOUND = "未发现达到阈值的动物目标"
DEMO_ONLY = "检测完成，当前使用轻量演示分类"
NO_CLASSIFIER = "检测完成，物种分类模型未接入"
RECOGNISED = "识别完成"


def species_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("media_id", "species_label").agg(F.count(F.lit(1)).alias("n"))


def species_map(detections: DataFrame) -> DataFrame:
    """media_id and the map of counts by label, in the labels' order."""
    entries = F.sort_array(F.collect_list(F.struct("species_label", "n")))
    return species_counts(detections).groupBy("media_id").agg(F.map_from_entries(entries).alias("species_summary"))


def message_of(n_detections, all_demo, classifier: str = FALLBACK_CLASSIFIER):
    """What to tell of a media item; n_detections may be null for none."""
    nothing = F.coalesce(n_detections, F.lit(0)) == 0
    found = F.when(all_demo, F.lit(DEMO_ONLY)).otherwise(F.lit(NO_CLASSIFIER)) if classifier == FALLBACK_CLASSIFIER else F.lit(RECOGNISED)
    return F.when(nothing, F.lit(NOTHING_FOUND)).otherwise(found)


def messages(media: DataFrame, detections: DataFrame, classifier: str = FALLBACK_CLASSIFIER) -> DataFrame:
    """media_id, n_detections and message of every media item."""
    counted = detections.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("species_label").isin(*DEMO_LABELS)).alias("all_demo"))
    joined = media.select("media_id").join(counted, "media_id", "left")
    return joined.select("media_id", F.coalesce("n", F.lit(0)).alias("n_detections"), message_of(F.col("n"), F.col("all_demo"), classifier).alias("message"))


def analyses(media: DataFrame, detections: DataFrame, status: dict[str, str], classifier: str = FALLBACK_CLASSIFIER) -> DataFrame:
    """One row a media item (media_id, media_type) as the ANALYSIS schema has it.

    detections are the rows of detection_rows(); a list is ordered by frame time and number. A media item has 90
    frames at most, so its list stays small. The counts by label come from the list, so detections, which may hold the
    models' work, are computed once. What the key tells isn't shuffled again with each detection.
    """
    others = ("bbox", "detected_type", "species_label", "confidence", "preview_crop_path")
    detection = lambda k: F.struct("media_id", k["frame_time"].alias("frame_time"), *(k[c].alias(c) for c in others))
    listed = detections.groupBy("media_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("frame_time", "det_index", *others))), detection).alias("detections"),
        F.bool_and(F.col("species_label").isin(*DEMO_LABELS)).alias("all_demo"),
    )
    joined = media.select("media_id", "media_type").join(listed, "media_id", "left")
    empty = F.array().cast(dict(listed.dtypes)["detections"])
    return _described(joined.withColumn("detections", F.coalesce("detections", empty)), status, classifier)


def listed_analyses(media: DataFrame, status: dict[str, str], classifier: str = FALLBACK_CLASSIFIER, more: tuple[str, ...] = ()) -> DataFrame:
    """analyses() of media (media_id, media_type) that hold their lists of detections (see kept_lists), with further columns of theirs."""
    demo = F.transform("detections", lambda d: d["species_label"].isin(*DEMO_LABELS))
    told = F.filter(demo, lambda x: x.isNotNull())
    return _described(media.withColumn("all_demo", F.when(F.size(told) > 0, F.forall(told, lambda x: x))), status, classifier, more)


def _described(listed: DataFrame, status: dict[str, str], classifier: str, more: tuple[str, ...] = ()) -> DataFrame:
    """ANALYSIS rows of media_id, media_type, detections and all_demo."""
    labels = F.transform("detections", lambda d: d["species_label"])
    counts = F.transform(F.array_sort(F.array_distinct(labels)), lambda label: F.struct(label, F.size(F.filter(labels, lambda x: x == label)).cast("long")))
    return listed.select(
        "media_id", "media_type", F.when(F.col("media_type") == "image", annotated_path(F.col("media_id"))).alias("preview_url"), "detections",
        F.coalesce(F.map_from_entries(counts), F.create_map().cast("map<string,bigint>")).alias("species_summary"),
        F.create_map(*[F.lit(x) for pair in status.items() for x in pair]).cast("map<string,string>").alias("model_status"),
        message_of(F.size("detections"), F.col("all_demo"), classifier).alias("message"), *more,
    )

"""From predictions to kept detections.

Predictions have media_id, source_name, frame_time, det_index, bbox, detected_type, det_conf, species_label and
cls_conf. The order of the steps matters: the first gate tests the detector's raw confidence, before any classifier
would run; the second the rounded combined one. Numbers of detections keep the gaps that the gates leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camtrail.functions.labels import EMPTY_SCENE, demo_label
from camtrail.functions.numbers import combined_confidence
from camtrail.functions.text import crop_name, crop_path

FALLBACK_CLASSIFIER = "fallback-classifier"
DEMO_CONFIDENCE = 0.92


def without_empty_scenes(frames: DataFrame) -> DataFrame:
    """Frames or predictions whose source isn't an empty scene; belongs before the detector."""
    label = demo_label(F.col("source_name"))
    return frames.where(label.isNull() | (label != EMPTY_SCENE))


def empty_scenes(media: DataFrame) -> DataFrame:
    """What without_empty_scenes() leaves out."""
    return media.where(demo_label(F.col("source_name")) == EMPTY_SCENE)


def passes(confidence: Column, threshold: float | Column, include_low: bool = False) -> Column:
    """Kept unless under the threshold: NaN is kept."""
    return F.lit(include_low) | (confidence >= threshold)


def detector_gate(predictions: DataFrame, threshold: float | Column, include_low: bool = False) -> DataFrame:
    return predictions.where(passes(F.col("det_conf"), threshold, include_low))


def demo_override(predictions: DataFrame, classifier: str = FALLBACK_CLASSIFIER) -> DataFrame:
    """With the fallback classifier, a demo source decides label and confidence."""
    if classifier != FALLBACK_CLASSIFIER:
        return predictions
    label = demo_label(F.col("source_name"))
    known = label.isNotNull() & (label != EMPTY_SCENE)
    return predictions.withColumns(
        {"species_label": F.when(known, label).otherwise(F.col("species_label")), "cls_conf": F.when(known, F.lit(DEMO_CONFIDENCE)).otherwise(F.col("cls_conf"))}
    )


def combined_gate(predictions: DataFrame, threshold: float | Column, include_low: bool = False) -> DataFrame:
    combined = predictions.withColumn("confidence", combined_confidence(F.col("det_conf"), F.col("cls_conf")))
    return combined.where(passes(F.col("confidence"), threshold, include_low))


def kept(predictions: DataFrame, threshold: float | Column, include_low: bool = False, classifier: str = FALLBACK_CLASSIFIER) -> DataFrame:
    """Predictions that make detections, with their combined confidence."""
    able = detector_gate(without_empty_scenes(predictions), threshold, include_low)
    return combined_gate(demo_override(able, classifier), threshold, include_low)


def detection_rows(detections: DataFrame) -> DataFrame:
    """Stored fields of kept detections; bbox is the predicted box, not the clipped one."""
    path = crop_path(crop_name(F.col("media_id"), F.col("frame_time"), F.col("det_index")))
    return detections.select("media_id", "frame_time", "det_index", "bbox", "detected_type", "species_label", "confidence", path.alias("preview_crop_path"))


def kept_lists(inferred: DataFrame, threshold: float, include_low: bool = False, classifier: str = FALLBACK_CLASSIFIER) -> DataFrame:
    """INFERRED rows with `detections`, what detection_rows() of kept() makes of each row's predictions, by frame time and number.

    All of it is within a row, so detections are never shuffled to meet their media.
    """
    label = demo_label(F.col("source_name"))
    override = F.when(label != EMPTY_SCENE, label) if classifier == FALLBACK_CLASSIFIER else F.lit(None).cast("string")
    named = inferred.withColumn("_demo", override).withColumn("_sure", F.when(F.col("_demo").isNotNull(), F.lit(DEMO_CONFIDENCE)))

    def combined(f: Column, p: Column) -> Column:
        sure = F.coalesce("_sure", p["cls_conf"])
        return F.struct(f["frame_time"].alias("frame_time"), p.alias("p"), combined_confidence(p["det_conf"], sure, in_lambda=True).alias("confidence"))

    def detection(d: Column) -> Column:
        p, name = d["p"], crop_name(F.col("media_id"), d["frame_time"], d["p"]["det_index"])
        species = F.coalesce("_demo", p["species_label"])
        fields = F.struct(
            F.col("media_id").alias("media_id"), d["frame_time"].alias("frame_time"), p["bbox"].alias("bbox"), p["detected_type"].alias("detected_type"),
            species.alias("species_label"), d["confidence"].alias("confidence"), crop_path(name).alias("preview_crop_path"),
        )
        return F.struct(d["frame_time"].alias("frame_time"), p["det_index"].alias("det_index"), fields.alias("detection"))

    able = lambda p: passes(p["det_conf"], threshold, include_low)
    every = F.flatten(F.transform("frames", lambda f: F.transform(F.filter(f["predictions"], able), lambda p: combined(f, p))))
    stay = named.withColumn("_kept", F.filter(every, lambda d: passes(d["confidence"], threshold, include_low)))
    keyed = F.sort_array(F.transform("_kept", detection))
    return stay.withColumn("detections", F.transform(keyed, lambda k: k["detection"])).drop("_kept", "_demo", "_sure")

"""Named queries over the star-schema tables, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from camtrail import adapter, engine_queries
from camtrail.config import EngineConfig
from camtrail.functions.labels import demo_label, knowledge_key
from camtrail.functions.numbers import clipped, corners, rounded
from camtrail.functions.text import annotated_path, annotation_label, crop_name, origin_list, upload_suffix
from camtrail.operators import detections as det
from camtrail.operators import frames, summary, views
from camtrail.sources import reference_data, results

THRESHOLD = EngineConfig.default_confidence_threshold
STATUS = {"detector": "fallback-detector", "classifier": det.FALLBACK_CLASSIFIER}


def _kept(spark: SparkSession, sf_dir: str, include_low: bool = False) -> DataFrame:
    return det.kept(adapter.predictions(spark, sf_dir), THRESHOLD, include_low)


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.predictions(spark, sf_dir)
    return summary.analyses(adapter.media(rows), det.detection_rows(det.kept(rows, THRESHOLD)), STATUS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every media item as a record of the store."""
    rows = adapter.predictions(spark, sf_dir)
    items = adapter.media(rows)
    return items.join(summary.messages(items, det.kept(rows, THRESHOLD)), "media_id")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.newest(_records(spark, sf_dir), "saved_at", "media_id")


def detector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det.detector_gate(det.without_empty_scenes(adapter.predictions(spark, sf_dir)), THRESHOLD)
    return rows.select("event_id", "media_id", "det_index", "det_conf")


def combined_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("event_id", "media_id", "species_label", "confidence")


def combined_gate_include_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, include_low=True).select("event_id", "media_id", "species_label", "confidence")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept detections at each setting of the threshold slider."""
    rows = det.without_empty_scenes(adapter.predictions(spark, sf_dir)).select("source_name", "det_conf", "cls_conf", "species_label")
    # counted by distinct confidences before thresholds multiply them
    rows = det.demo_override(rows).groupBy("det_conf", "cls_conf").agg(F.count(F.lit(1)).alias("n"))
    settings = F.array(*[F.lit(5 * i / 100) for i in range(20)])
    swept = rows.withColumn("threshold", F.explode(settings))
    passed = det.combined_gate(det.detector_gate(swept, F.col("threshold")), F.col("threshold"))
    return passed.groupBy("threshold").agg(F.sum("n").alias("n_kept"))


def empty_scene_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det.without_empty_scenes(adapter.predictions(spark, sf_dir))
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_predictions"))


def demo_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapter.media(adapter.predictions(spark, sf_dir))
    return items.select("media_id", "source_name", demo_label(F.col("source_name")).alias("demo_label"))


def demo_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det.demo_override(det.without_empty_scenes(adapter.predictions(spark, sf_dir)))
    return rows.select("event_id", "species_label", "cls_conf")


def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det.detection_rows(_kept(spark, sf_dir))
    return rows.select("media_id", "frame_time", "det_index", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"), "detected_type", "species_label", "confidence", "preview_crop_path")


def clip_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = clipped(F.col("bbox"), F.lit(adapter.IMAGE_WIDTH), F.lit(adapter.IMAGE_HEIGHT))
    return adapter.predictions(spark, sf_dir).select("event_id", box.alias("c")).select("event_id", "c.*")


def annotation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(spark, sf_dir).where("media_type = 'image'")
    return rows.select("event_id", annotation_label(F.col("species_label"), F.col("confidence")).alias("label"), corners(F.col("bbox")).alias("c"), annotated_path(F.col("media_id")).alias("path")).select("event_id", "label", "c.*", "path")


def crop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("event_id", crop_name(F.col("media_id"), F.col("frame_time"), F.col("det_index")).alias("crop_name"))


def upload_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("name"))
    names = adapter.media(adapter.predictions(spark, sf_dir)).select(F.col("source_name").alias("name"))
    return pages.unionByName(names).groupBy(upload_suffix(F.col("name")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def species_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.species_counts(_kept(spark, sf_dir))


def species_summary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.map_entries("species_summary")
    text = F.array_join(F.transform(F.sort_array(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return summary.species_map(_kept(spark, sf_dir)).select("media_id", text.alias("species_summary"))


def analysis_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.predictions(spark, sf_dir)
    return summary.messages(adapter.media(rows), det.kept(rows, THRESHOLD))


def analysis_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("detections", lambda d: F.format_string("%s@%.2f:%.3f", d["species_label"], d["frame_time"], d["confidence"]))
    return _analyses(spark, sf_dir).select("media_id", "media_type", "preview_url", F.size("detections").cast("long").alias("n_detections"), F.array_join(listed, ",").alias("detections"), F.size("species_summary").cast("long").alias("n_species"), "message")


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sampled_frames(adapter.videos(spark, sf_dir))


def frame_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sample_counts(adapter.videos(spark, sf_dir))


def knowledge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.knowledge_of(_analyses(spark, sf_dir), reference_data.animal_knowledge(spark)).select("media_id", "key", "latin", "title")


def knowledge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(spark, sf_dir)
    return rows.groupBy(knowledge_key(F.col("species_label")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def review_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = views.review_level(F.col("confidence"))
    return _kept(spark, sf_dir).groupBy(level["label"].alias("label"), level["class_name"].alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def headline_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.headline(_analyses(spark, sf_dir))


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.result_table(_analyses(spark, sf_dir))


def result_table_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.result_table(_analyses(spark, sf_dir), with_empty=True)
    return rows.select("media_id", "position", "species_label", "crop", "placeholder")


def media_type_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("media_type") == "video", "video/mp4").otherwise("image/jpeg")
    items = adapter.media(adapter.predictions(spark, sf_dir))
    return items.select("media_id", views.routed(mime).alias("route"))


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.record_counts(_listed(spark, sf_dir))


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.record_rows(_listed(spark, sf_dir))


def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.orderBy(F.desc("saved_at"), "media_id"))  # of 25 rows
    return _listed(spark, sf_dir).select("media_id", place.cast("long").alias("place"), "n_detections", "message")


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_hints(results.newest(_records(spark, sf_dir), "saved_at", "media_id", 1))


def latest_record_of_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record page tells where no record is: of all records none is of sound."""
    return views.latest_hints(results.newest(_records(spark, sf_dir).where("media_type = 'audio'"), "saved_at", "media_id", 1))


def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose printed digits end in a half, of which most lie above or below it, and their roundings to three and two places."""
    value = (F.col("l_partkey") * 5 % 20_000).cast("double") / 10_000
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", value.alias("value"))
    return rows.select("l_orderkey", "l_linenumber", rounded(F.col("value"), 3).alias("three"), rounded(F.col("value") / 3, 2).alias("two"))


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing after the oldest listed image was analysed again."""
    listed = _records(spark, sf_dir).select("media_id", "media_type", F.unix_micros(F.col("saved_at").cast("timestamp")).alias("seq"))
    again = listed.where("media_type = 'image'").orderBy("seq", "media_id").limit(1).withColumn("seq", F.lit(1 << 62).cast("long"))
    return results.upserted(listed, again).select("media_id", "media_type")


def preview_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapter.media(adapter.predictions(spark, sf_dir))
    stored = F.when(F.col("media_type") == "image", annotated_path(F.col("media_id")))
    return items.select("media_id", views.preview_source(stored, F.concat(F.lit("local:"), "source_name")).alias("preview"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(F.lit("detector"), F.lit(STATUS["detector"])).cast("map<string,string>")
    return views.session_summary(_records(spark, sf_dir).withColumn("model_status", status))


def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", props["k"].alias("k"), F.to_json(props).alias("props"))


def origin_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts between the commas of every text, as a list of origins is split."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", origin_list(F.coalesce("text", F.lit(""))).alias("parts"))
    return texts.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("parts_md5"))


def plant_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the plant entry that stands for their key."""
    entries = reference_data.plant_library(spark).select("priority", "title", "latin", F.array_join("tags", "/").alias("tags"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % len(reference_data.PLANTS)).cast("int").alias("priority"))
    counted = parts.groupBy("priority").agg(F.count(F.lit(1)).alias("n_parts"))
    return counted.join(F.broadcast(entries), "priority")  # entries: a fixed list


def demo_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo media by how many media items bear their file's name."""
    demo = reference_data.demo_media(spark).select("priority", "title", "label", "file_name")
    items = adapter.media(adapter.predictions(spark, sf_dir)).groupBy(F.lower("source_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_media"))
    return items.join(F.broadcast(demo), "file_name")  # demo: a fixed list


QUERIES = {
    f.__name__: f
    for f in (
        detector_gate, combined_gate, combined_gate_include_low, threshold_sweep, empty_scene_skip, demo_label_lookup, demo_override, detection_rows, clip_bbox,
        annotation_text, crop_names, upload_suffixes, species_summary, species_summary_map, analysis_message, analysis_response, frame_sampling, frame_cap,
        knowledge_lookup, knowledge_labels, review_level, headline_insight, result_table, result_table_outer, media_type_route, record_counts, record_rows,
        recent_results, latest_record, latest_record_of_none, history_upsert, exact_rounding, preview_source, session_summary, json_props_parse, origin_list_split, plant_library, demo_media,
    )
} | engine_queries.QUERIES

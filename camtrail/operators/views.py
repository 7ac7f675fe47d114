"""What the result and record pages show, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camtrail.functions.labels import knowledge_key
from camtrail.functions.text import shown_box, shown_percent, shown_seconds

# Fixed values.
API_BASE = "http://127.0.0.1:8000"
REVIEW_LEVELS = (
    (0.8, "可直接展示", "good", "当前结果可用于演示，但仍建议结合现场图像和知识库复核。"),
    (0.55, "建议复核", "warn", "这类结果适合作为候选项展示，不建议直接当作最终物种结论。"),
)
LOW_LEVEL = ("保守显示", "low", "当前置信度偏低，前端会倾向保守表达，以免把候选结果说成定论。")
NOT_STARTED = "未开始分析"
NOTHING_KEPT = "当前阈值下没有保留下来结果"
NO_CONFIDENCE, CONFIDENCE = "上传素材后会显示候选结果", " 置信度"
NO_RECORD = ("暂无最近结果", "上传素材后会自动出现在这里", "可作为演示回放入口")
NO_HISTORY, LATEST = "当前还没有历史记录，上传一张图就会出现这里。", "最新一条结果："
NOT_CHOSEN, NOT_ANALYSED = "未选择", "待分析"
VIDEO_TITLE, IMAGE_TITLE = "视频分析", "图片分析"


def _by_level(confidence: Column, part: int) -> Column:
    chain = F
    for level in REVIEW_LEVELS:
        chain = chain.when(confidence >= level[0], F.lit(level[part + 1]))
    return chain.otherwise(F.lit(LOW_LEVEL[part]))


def review_level(confidence: Column) -> Column:
    """label, class_name and note by confidence; the cut-offs belong to the higher level."""
    return F.struct(*(_by_level(confidence, i).alias(n) for i, n in enumerate(("label", "class_name", "note"))))


def headline(analyses: DataFrame) -> DataFrame:
    """The first detection's label and confidence, or defaults, as numbers and as shown; the review level, and the key of its knowledge entry."""
    first = F.get("detections", F.lit(0))
    shown = analyses.select("media_id", F.coalesce(first["species_label"], F.lit(NOT_STARTED)).alias("label"), F.coalesce(first["confidence"], F.lit(0.0)).alias("confidence"), F.size("detections").cast("long").alias("n_detections"), first["species_label"].alias("species"))
    return shown.select("media_id", "label", "confidence", "n_detections", review_level(F.col("confidence"))["label"].alias("level"), shown_percent(F.col("confidence")).alias("percent"), F.when(F.col("n_detections") > 0, F.concat(shown_percent(F.col("confidence")), F.lit(CONFIDENCE))).otherwise(NO_CONFIDENCE).alias("shown"), knowledge_key(F.col("species")).alias("knowledge_key"))


def knowledge_of(analyses: DataFrame, knowledge: DataFrame) -> DataFrame:
    """media_id with the knowledge entry that its first detection's label leads to. knowledge is the fixed list of entries."""
    key = knowledge_key(F.get("detections", F.lit(0))["species_label"])
    return analyses.select("media_id", key.alias("key")).join(F.broadcast(knowledge), "key")


def result_table(analyses: DataFrame, with_empty: bool = False) -> DataFrame:
    """A row for each detection; with_empty: one that says so where there are none."""
    explode = F.posexplode_outer if with_empty else F.posexplode
    rows = analyses.select("media_id", explode("detections").alias("position", "d"))
    none = F.col("d").isNull()
    columns = [
        F.col("media_id"), F.col("position"), F.col("d.species_label").alias("species_label"), F.col("d.detected_type").alias("detected_type"),
        F.when(~none, shown_seconds(F.col("d.frame_time"))).alias("seconds"), shown_percent(F.col("d.confidence")).alias("percent"),
        F.when(~none, shown_box(F.col("d.bbox"))).alias("box"), F.when(~none, crop_address(F.col("d.preview_crop_path"))).alias("crop"),
    ]
    return rows.select(*columns, F.when(none, F.lit(NOTHING_KEPT)).alias("placeholder")) if with_empty else rows.select(*columns)


def record_counts(records: DataFrame) -> DataFrame:
    """All records, images and videos of a listing; other types count in the total only."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("media_type") == "image").alias("images"), F.count_if(F.col("media_type") == "video").alias("videos"))


def record_rows(records: DataFrame) -> DataFrame:
    """Title, message and number of targets of each record (media_id, media_type, message, n_detections)."""
    title = F.when(F.col("media_type") == "video", F.lit(VIDEO_TITLE)).otherwise(F.lit(IMAGE_TITLE))
    return records.select("media_id", title.alias("title"), "message", F.concat(F.col("n_detections").cast("string"), F.lit(" 个目标")).alias("targets"))


def latest_hints(records: DataFrame) -> DataFrame:
    """The three lines about the newest record and the note of the overview; a listing without records has the texts for that. records: one row or none."""
    shown = records.select(
        F.concat(F.lit("最新媒体类型："), "media_type").alias("type_hint"),
        F.concat(F.lit("最新目标数："), F.col("n_detections").cast("string")).alias("target_hint"),
        F.concat(F.lit("最新结果："), "message").alias("message_hint"),
        F.concat(F.lit(LATEST), "message").alias("note"),
    )
    # an aggregate of no rows is a row of nulls
    defaults = dict(zip(shown.columns, (*NO_RECORD, NO_HISTORY)))
    return shown.agg(*(F.coalesce(F.first(name), F.lit(default)).alias(name) for name, default in defaults.items()))


def crop_address(path: Column, base: str = API_BASE) -> Column:
    return F.concat(F.lit(base), path)


def preview_source(preview_url: Column, local: Column, base: str = API_BASE) -> Column:
    """The stored preview if there is one; an empty address counts as none."""
    return F.when(F.coalesce(preview_url, F.lit("")) != "", F.concat(F.lit(base), preview_url)).otherwise(local)


def session_summary(sessions: DataFrame) -> DataFrame:
    """Shown name, targets and models of sessions (media_id, source_name, n_detections, model_status)."""
    model = lambda name: F.coalesce(F.try_element_at("model_status", F.lit(name)), F.lit(NOT_ANALYSED)).alias(name)
    return sessions.select("media_id", F.coalesce("source_name", F.lit(NOT_CHOSEN)).alias("input"), F.coalesce("n_detections", F.lit(0)).cast("string").alias("targets"), model("detector"), model("classifier"))


def routed(mime: Column) -> Column:
    """Endpoint for an upload's MIME type."""
    return F.when(F.startswith(mime, F.lit("video/")), F.lit("video")).otherwise(F.lit("image"))

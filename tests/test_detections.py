"""Gates, override, names and sampling against plain restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from camtrail.functions import labels, numbers, text
from camtrail.operators import detections as det
from camtrail.operators import frames, summary, views

SCHEMA = "media_id string, source_name string, frame_time double, det_index int, bbox struct<x:int,y:int,width:int,height:int>, detected_type string, det_conf double, species_label string, cls_conf double"


def row(det_conf, cls_conf, source="x.jpg", index=0, label="Canis lupus", media="m1", time=0.0, box=(1, 2, 3, 4)):
    return (media, source, time, index, box, "animal", det_conf, label, cls_conf)


def plain(rows, threshold, include_low, classifier):
    """What a frame loop would keep: (media, index, label, confidence)."""
    rules = [("empty", "empty"), ("deer", "梅花鹿"), ("boar", "野猪"), ("fox", "狐狸"), ("wolf", "狼")]
    out = []
    for media, source, _, index, _, _, detector, label, cls in rows:
        demo = next((v for k, v in rules if k in source.lower()), None)
        if demo == "empty" or (detector < threshold and not include_low):
            continue
        if demo and classifier == "fallback-classifier":
            label, cls = demo, 0.92
        both = round(min(detector, cls), 3)
        if both < threshold and not include_low:
            continue
        out.append((media, index, label, both))
    return out


ROWS = [
    row(0.3496, 0.9), row(0.9, 0.3496, index=1), row(0.35, 0.35, index=2), row(0.9, 0.1, "Demo-DEER.jpg"), row(0.2, 0.9, "deer.jpg", 1), row(0.9, 0.9, "empty-deer.png"),
    row(0.97, 0.9, "firefox.jpg"), row(0.5, 0.9, "board.png"), row(0.5, 0.9, "wolf-deer.jpg"), row(0.8, 0.81, ""), row(0.55, 0.7, index=7),
]


@pytest.mark.parametrize("include_low", [False, True])
@pytest.mark.parametrize("classifier", ["fallback-classifier", "real"])
@pytest.mark.parametrize("threshold", [0.0, 0.35, 0.9])
def test_kept(spark, threshold, include_low, classifier):
    found = det.kept(spark.createDataFrame(ROWS, SCHEMA), threshold, include_low, classifier)
    got = [tuple(r) for r in found.select("media_id", "det_index", "species_label", "confidence").collect()]
    assert sorted(got) == sorted(plain(ROWS, threshold, include_low, classifier))


def test_nan_is_kept(spark):
    found = det.detector_gate(spark.createDataFrame([row(math.nan, 0.5)], SCHEMA), 0.35)
    assert found.count() == 1


@pytest.mark.parametrize("name, suffix", [("A.B.JPG", ".jpg"), (".bashrc", ".bin"), ("x", ".bin"), ("", ".bin"), (None, ".bin"), ("a/b.C", ".c"), (".a.JPG", ".jpg")])
def test_suffix(spark, name, suffix):
    assert spark.createDataFrame([(name,)], "n string").select(text.upload_suffix(F.col("n"))).first()[0] == suffix


def test_shown_numbers(spark):
    one = spark.range(1)
    shown = one.select(text.annotation_label(F.lit("a"), F.lit(0.885)), text.shown_percent(F.lit(0.885)), text.crop_name(F.lit("m"), F.lit(2.01), F.lit(3)), text.shown_seconds(F.lit(1.5))).first()
    assert tuple(shown) == ("a 88%", "89%", "m_00002009_3.jpg", "1.50s")


def test_rounding_is_exact(spark):
    rng = random.Random(4)
    values = [2.675, 0.8845, 0.1235, 0.0005, 88.5, 0.5, 1.5, 2.5, 0.0, 1e300, 2.0**52, 2.0**53 + 2, 5e-324, 1e-9, math.inf, -2.675, -0.0005, 0.005, 1.005, 0.9995, 4503599627370.4965]
    values += [rng.random() for _ in range(20_000)] + [rng.randrange(10**7) / 10**4 + 0.0005 for _ in range(20_000)] + [rng.randrange(1 << 30) / 1024 for _ in range(5000)]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(numbers.rounded(F.col("v"), p).alias(f"p{p}") for p in (0, 2, 3))).collect()
    for r in found:
        assert [r["p0"], r["p2"], r["p3"]] == [v if math.isinf(v := r["v"]) else float(round(v, p)) for p in (0, 2, 3)], r
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(numbers.rounded(F.col("v"), 2)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] is None


def test_rounding_keeps_the_sign_of_zero_and_what_overflows(spark):
    values = [-0.0, 0.0, -0.001, 0.001, -0.005, -0.015, -math.inf, -1e300, -(2.0**52), 4503599627370.4965, -2.5]
    values += [-v for v in (2.675, 0.8845, 0.1235, 1.005, 0.5, 0.125, 0.375)] + [2.675, 0.125, 0.375, 1.005, 2.0**51 + 0.5]
    want = [0.0, *(v if math.isinf(v) else round(v, 2) for v in values[1:])]  # -0.0 becomes 0.0
    given = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for made in (numbers.rounded(F.col("v"), 2), F.transform(F.array("v"), lambda v: numbers.rounded(v, 2, in_lambda=True))[0]):
        found = [r[0] for r in given.select(made).collect()]
        assert [(f, math.copysign(1, f)) for f in found] == [(w, math.copysign(1, w)) for w in want]
    some = [random.Random(9).randrange(10**7) / 10**4 + 0.0005 for _ in range(3000)] + [n / 1024 for n in range(-3000, 3000)] + [n / 1000 + 0.0005 for n in range(2000)]
    both = spark.createDataFrame([(v,) for v in some], "v double").select(*(numbers.rounded(F.col("v"), p, short) for p in (0, 2, 3) for short in (False, True))).collect()
    assert all(r[i] == r[i + 1] for r in both for i in (0, 2, 4))
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(numbers.rounded(F.col("v"), 2, in_lambda=True)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] is None


def test_odd_crop_names(spark):
    rows = [("m", 2.01, 3), ("m", 0.0, 0), ("m", 99_999.999, 12), ("m", 100_000.0, 1), ("m", -1.5, 1), (None, 1.0, 1), ("m", None, 1), ("m", 1.0, None), ("", 1.0, -1)]
    found = spark.createDataFrame(rows, "m string, t double, d int").coalesce(1).select(text.crop_name(F.col("m"), F.col("t"), F.col("d"))).collect()
    assert [r[0] for r in found] == ["m_00002009_3.jpg", "m_00000000_0.jpg", "m_99999999_12.jpg", "m_100000000_1.jpg", "m_-0001500_1.jpg", "null_00001000_1.jpg", "m_    null_1.jpg", "m_00001000_null.jpg", "_00001000_-1.jpg"]


def test_frames_and_detections_are_made_by_short_expressions(spark):
    """Within a lambda nothing is shared: neither a video's rate nor a formatter's work belongs to each frame."""
    videos = spark.createDataFrame([("a", 25.0, 60, 1.0), ("b", None, 60, 1.0), ("c", 0.0, 0, 1.0), ("d", 25.0, None, 1.0)], "media_id string, reported_fps double, frame_count int, interval double")
    listed = frames.with_sampled_frames(videos)
    assert listed.columns == [*videos.columns, "frames"]
    assert {r["media_id"]: [tuple(f) for f in r["frames"]] for r in listed.collect()} == {m: [(0, 0.0), (25, 1.0), (50, 2.0)] if m in "ab" else [] for m in "abcd"}
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN (isnull(reported_fps") == 1 and "_fps#" in plan.split("transform(", 1)[1]


def test_hints_without_records(spark):
    records = spark.createDataFrame([("image", 2, "x")], "media_type string, n_detections long, message string")
    assert views.latest_hints(records).first()["target_hint"] == "最新目标数：2"
    assert tuple(views.latest_hints(records.limit(0)).first()) == (*views.NO_RECORD, views.NO_HISTORY)


@pytest.mark.parametrize("confidence, name", [(0.8, "good"), (0.7999, "warn"), (0.55, "warn"), (0.5499, "low")])
def test_review_level(spark, confidence, name):
    assert spark.range(1).select(views.review_level(F.lit(confidence))["class_name"]).first()[0] == name


@pytest.mark.parametrize("label, key", [("Canis lupus", "Canis"), ("未知动物", "Unknown"), (None, "Unknown"), ("canis", "Unknown"), ("狐狸和狼", "狐狸"), ("大狼", "狼")])
def test_knowledge_key(spark, label, key):
    assert spark.createDataFrame([(label,)], "l string").select(labels.knowledge_key(F.col("l"))).first()[0] == key


def test_sampling(spark):
    videos = [("a", 25.0, 60, 1.0), ("b", 0.0, 51, 1.0), ("c", 29.97, 0, 1.0), ("d", 30.0, 10_000, 0.1), ("e", 24.0, 7, 0.0), ("f", 0.5, 3, 1.0)]
    given = spark.createDataFrame(videos, "media_id string, reported_fps double, frame_count int, interval double")
    got = {(r["media_id"], r["frame_index"], r["frame_time"]) for r in frames.sampled_frames(given).collect()}
    want = set()
    for media, fps, n, interval in videos:
        fps = fps or 25
        step = max(1, int(fps * max(0.2, interval)))
        want |= {(media, i, round(i / fps, 2)) for i in list(range(0, n, step))[:90]}
    assert {(m, i) for m, i, _ in got} == {(m, i) for m, i, _ in want}
    assert got == want
    counts = {r["media_id"]: (r["n_frames"], r["capped"]) for r in frames.sample_counts(given).collect()}
    assert counts["d"] == (90, True) and counts["c"] == (0, False) and counts["a"] == (3, False)


def test_clip_outside(spark):
    box = F.struct(F.lit(700).alias("x"), F.lit(-50).alias("y"), F.lit(30).alias("width"), F.lit(20).alias("height"))
    assert tuple(spark.range(1).select(numbers.clipped(box, F.lit(640), F.lit(480))).first()[0]) == (700, 0, 640, -30)


def test_analyses(spark):
    media = spark.createDataFrame([("m1", "image"), ("m2", "video"), ("m3", "image")], "media_id string, media_type string")
    rows = spark.createDataFrame([row(0.9, 0.8, index=2), row(0.9, 0.8, index=0, label="狼"), row(0.9, 0.9, "deer.jpg", media="m3")], SCHEMA)
    found = {r["media_id"]: r for r in summary.analyses(media, det.detection_rows(det.kept(rows, 0.35)), {"detector": "d"}).collect()}
    assert [d["species_label"] for d in found["m1"]["detections"]] == ["狼", "Canis lupus"]
    assert found["m1"]["message"] == summary.NO_CLASSIFIER and found["m1"]["species_summary"] == {"狼": 1, "Canis lupus": 1}
    assert found["m2"]["detections"] == [] and found["m2"]["message"] == summary.NOTHING_FOUND and found["m2"]["preview_url"] is None
    assert found["m3"]["message"] == summary.DEMO_ONLY and found["m3"]["preview_url"] == "/media/uploads/m3_annotated.jpg"

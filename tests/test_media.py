"""Reading media, models in batches, and files after the gates."""

import json
import os
import struct
import subprocess
import sys
from dataclasses import dataclass

import pytest

from camtrail.config import EngineConfig
from camtrail.operators.frames import sampled_frames
from camtrail.plans import models
from camtrail.plans.analysis import Engine
from camtrail.plans.models import Models, Sized
from camtrail.plans.sinks import FolderSink, Sinks
from camtrail.sources import headers
from camtrail.sources.media import media_files

IMAGES = "media_id string, source_name string"
VIDEOS = "media_id string, source_name string, reported_fps double, frame_count long"


def sinks(folder):
    """Files that hold what was drawn."""
    put = FolderSink(str(folder))
    return Sinks(lambda crop: repr(crop.size).encode(), put, lambda image, marks: json.dumps(marks, ensure_ascii=False).encode(), put)


def engine(spark, folder, **more):
    config = EngineConfig(storage_dir=str(folder))
    return Engine(spark, config, lambda: Models.load(config), **more)


def test_files_are_those_that_results_name(spark, tmp_path):
    e = engine(spark, tmp_path, sinks=sinks(tmp_path / "files"))
    media = spark.createDataFrame([("d", "deer.jpg"), ("i", "IMG.jpg"), ("e", "empty.jpg"), ("n", "none.jpg")], IMAGES)
    found = {r["media_id"]: r for r in e.analyze_images(media, lambda row: None if row["media_id"] == "n" else Sized((640, 480)), threshold=0.6, with_status=True).collect()}
    assert {m: len(r["detections"]) for m, r in found.items()} == {"d": 1, "i": 0, "e": 0, "n": 0}
    assert {m: r["preview_url"] for m, r in found.items()} == {m: f"/media/uploads/{m}_annotated.jpg" if m != "n" else None for m in "dien"}
    assert {m: r["status"] for m, r in found.items()} == {"d": "opened", "i": "opened", "e": "empty scene", "n": "not opened"}
    crops = {d["preview_crop_path"].rsplit("/", 1)[1] for r in found.values() for d in r["detections"]}
    assert {f.name for f in (tmp_path / "files").iterdir()} == crops | {f"{m}_annotated.jpg" for m in "die"}
    marks = json.loads((tmp_path / "files" / "d_annotated.jpg").read_text())
    assert [m["label"] for m in marks] == ["梅花鹿 88%"] and marks[0]["x1"] == 160 and marks[0]["label_y"] == 96
    assert json.loads((tmp_path / "files" / "i_annotated.jpg").read_text()) == [] == json.loads((tmp_path / "files" / "e_annotated.jpg").read_text())


def test_a_sink_takes_paths_alone():
    with pytest.raises(ValueError, match="hdfs"):
        FolderSink("hdfs://store/crops")


def test_videos_have_crops_and_no_previews(spark, tmp_path):
    log = tmp_path / "opened"

    def opened(row):
        with log.open("a") as file:
            file.write(row["media_id"] + "\n")
        return None if row["media_id"] == "bad" else lambda index: Sized((64, 48 + index)) if index < 60 else None

    videos = [("v1", "v1.mp4", 25.0, 250), ("bad", "bad.mp4", 25.0, 250), ("short", "s.mp4", 25.0, 30), ("none", "n.mp4", 25.0, 0)]
    media = spark.createDataFrame(videos, VIDEOS)
    plain = engine(spark, tmp_path).analyze_videos(media, open_video=opened, with_status=True)
    first = {r["media_id"]: r for r in plain.collect()}
    assert plain.count() == 4 and sorted(log.read_text().split()) == ["bad", "none", "short", "v1"]
    assert {m: (r["status"], r["ended_at"]) for m, r in first.items()} == {"v1": ("ended early", 75), "bad": ("not opened", None), "short": ("opened", None), "none": ("opened", None)}
    found = engine(spark, tmp_path, sinks=sinks(tmp_path / "files")).analyze_videos(media, open_video=opened)
    for r in found.collect():
        assert r.asDict() == {k: v for k, v in first[r["media_id"]].asDict().items() if k not in ("status", "ended_at")}
    crops = {d["preview_crop_path"].rsplit("/", 1)[1] for r in first.values() for d in r["detections"]}
    assert {f.name for f in (tmp_path / "files").iterdir()} == crops and len(crops) == 5
    assert (tmp_path / "files" / "v1_00002000_0.jpg").read_text() == "(32, 49)"  # frame 50


RETRIED = """
import sys
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark import TaskContext
from pyspark.sql import SparkSession
from camtrail.plans.models import Sized
from test_media import IMAGES, engine, sinks
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
files = sinks({folder!r})
put = files.put_crop
def failing(name, data):
    if name.startswith("m07") and TaskContext.get().attemptNumber() == 0:
        open({folder!r} + "/.half", "w").close()
        raise OSError("lost")
    put(name, data)
files.put_crop = failing
media = spark.createDataFrame([(f"m{{i:02}}", "deer.jpg") for i in range(12)], IMAGES)
found = engine(spark, {folder!r}, sinks=files).analyze_images(media, lambda row: Sized((640, 480))).collect()
print(sorted(d["preview_crop_path"].rsplit("/", 1)[1] for r in found for d in r["detections"]))
"""


def test_a_retried_task_leaves_each_file_once(tmp_path):
    tests = os.path.dirname(__file__)
    script = RETRIED.format(repo=os.path.dirname(tests), tests=tests, folder=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert (tmp_path / ".half").exists(), out.stderr[-2000:]
    names = {f.name for f in tmp_path.iterdir() if f.name.endswith(".jpg")}
    crops = {n for n in names if "annotated" not in n}
    assert sorted(crops) == eval(out.stdout.strip().splitlines()[-1]) and len(crops) == 12 == len(names - crops)
    assert {f.name for f in tmp_path.iterdir()} - names == {".half"}


def test_models_load_once_a_worker_and_take_batches(spark, tmp_path):
    @dataclass
    class Counting:
        """A pair's half that tells of its calls."""

        folder: str
        name: str = "counting"

        def _tell(self, what, n):
            with open(os.path.join(self.folder, what), "a") as file:
                file.write(f"{os.getpid()} {n}\n")

        def predict(self, image):
            raise AssertionError("images come in batches")

        def predict_batch(self, images):
            self._tell("predict", len(images))
            return [[{"bbox": {"x": 0, "y": 0, "width": 8, "height": 8}, "detected_type": "animal", "confidence": 0.1 * k} for k in range(5, 8)] for _ in images]

        def classify_batch(self, crops):
            self._tell("classify", len(crops))
            return [{"species_label": f"size {c.size[0]}", "confidence": 0.9} for c in crops]

    log = tmp_path / "log"
    log.mkdir()

    def make():
        pair = Counting(str(log))
        pair._tell("load", 0)
        return Models(pair, pair)

    e = Engine(spark, EngineConfig(storage_dir=str(tmp_path)), make, batch_bytes=3 * 64 * 48 * 4)
    media = spark.createDataFrame([(f"m{i}", "a.jpg") for i in range(40)], IMAGES).repartition(4)
    for _ in range(2):
        found = e.analyze_images(media, lambda row: Sized((64, 48)), threshold=0.55).collect()
        assert len(found) == 40 and all([d["confidence"] for d in r["detections"]] == [0.6, 0.7] for r in found)
    lines = lambda name: [line.split() for line in (log / name).read_text().splitlines()]
    loads = [pid for pid, _ in lines("load") if pid != str(os.getpid())]
    assert len(loads) == len(set(loads))
    sizes = [int(n) for _, n in lines("predict")]
    assert sum(sizes) == 80 and max(sizes) <= 4 and len(sizes) < 40
    assert sum(int(n) for _, n in lines("classify")) == 160 and len(lines("classify")) < 80


def exif(orientation, order="<"):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(f"{order}IH", 8, 2) + struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(f"{order}HHIHH", headers.ORIENTATION_TAG, 3, 1, orientation, 0)


def jpeg(width, height, tiff=None, kind=0xC0):
    data = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    if tiff is not None:
        data += b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return data + b"\xff\xff" + bytes([kind]) + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9) + b"\xff\xda"


@pytest.mark.parametrize("orientation", range(1, 9))
@pytest.mark.parametrize("order", "<>")
def test_orientation(orientation, order):
    size = (480, 640) if orientation in (5, 6, 7, 8) else (640, 480)
    assert headers.image_header(jpeg(640, 480, exif(orientation, order))) == ("jpeg", *size, orientation, "read")


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def mp4(times, scale=30_000, version=0, handler=b"vide"):
    head = struct.pack(">IQQIQ", version << 24, 0, 0, scale, 0) if version else struct.pack(">IIIII", 0, 0, 0, scale, 0)
    table = box(b"stts", struct.pack(">II", 0, len(times)), *(struct.pack(">II", *t) for t in times))
    sound = box(b"trak", box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 8, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, b"soun"))))
    track = box(b"trak", box(b"mdia", box(b"mdhd", head), box(b"hdlr", struct.pack(">II4s", 0, 0, handler)), box(b"minf", box(b"stbl", table))))
    return box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + bytes(50) + box(b"moov", box(b"mvhd", bytes(20)), sound, track)


def avi(scale, rate, frames):
    strh = b"vids" + b"MJPG" + bytes(12) + struct.pack("<IIII", scale, rate, 0, frames)
    strl = b"strl" + b"strh" + struct.pack("<I", len(strh)) + strh
    hdrl = b"hdrl" + b"avih" + struct.pack("<I", 3) + bytes(4) + b"LIST" + struct.pack("<I", len(strl)) + strl
    return b"RIFF" + bytes(4) + b"AVI " + b"LIST" + struct.pack("<I", len(hdrl)) + hdrl


def test_headers(spark, tmp_path):
    png = headers.PNG_START + struct.pack(">I4sII", 13, b"IHDR", 320, 200) + bytes(9)
    files = {
        "a.png": png, "b.jpg": jpeg(640, 480), "c.jpg": jpeg(640, 480, exif(6), 0xC2), "d.jpg": jpeg(640, 480, exif(77)), "e.jpg": jpeg(640, 480, b"II*\0\xff\xff\0\0"),
        "f.jpg": jpeg(640, 480)[:27], "g.png": png[:18], "h.txt": b"text", "j.png": headers.PNG_START + struct.pack(">I4sII", 13, b"IHDR", 0, 9),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r["name"]: (r["image_format"], r["width"], r["height"], r["orientation"], r["header_status"]) for r in headers.with_image_headers(media_files(spark, str(tmp_path))).collect()}
    broken = (None, None, None, None, "broken")
    assert found == {
        "a.png": ("png", 320, 200, 1, "read"), "b.jpg": ("jpeg", 640, 480, 1, "read"), "c.jpg": ("jpeg", 480, 640, 6, "read"), "d.jpg": ("jpeg", 640, 480, 1, "read"), "e.jpg": ("jpeg", 640, 480, 1, "read"),
        "f.jpg": broken, "g.png": broken, "j.png": broken, "h.txt": (None, None, None, None, "unknown format"),
    }
    assert headers.image_header(b"")[4] == "unknown format" == headers.video_header(b"")[3]
    sizes = spark.createDataFrame([("c", 480, 640)], "media_id string, width int, height int")
    boxes = spark.createDataFrame([("c", (400, -5, 200, 700)), ("z", (1, 1, 1, 1))], "media_id string, bbox struct<x:int,y:int,width:int,height:int>")
    clips = {r["media_id"]: r["clip"] for r in headers.clipped_boxes(boxes, sizes).collect()}
    assert tuple(clips["c"]) == (400, 0, 480, 640)


def test_sampling_from_the_container(spark, tmp_path):
    given = {"a.mp4": (30_000 / 1001, 301), "b.mp4": (25.0, 51), "c.avi": (24.0, 100), "d.avi": (0.0, 60), "e.mp4": None, "f.mp4": None}
    files = {"a.mp4": mp4([(300, 1001), (1, 1001)]), "b.mp4": mp4([(51, 40)], 1000, 1), "c.avi": avi(1000, 24_000, 100), "d.avi": avi(0, 1, 60), "e.mp4": mp4([(1, 1)], handler=b"text"), "f.mp4": mp4([(9, 9)])[:90]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = headers.with_video_headers(media_files(spark, str(tmp_path))).selectExpr("name as media_id", "reported_fps", "frame_count", "header_status", "1.0D as interval").collect()
    assert {r["media_id"]: None if r["header_status"] == "broken" else (r["reported_fps"], r["frame_count"]) for r in read} == given
    schema = "media_id string, reported_fps double, frame_count long, interval double"
    want = sampled_frames(spark.createDataFrame([(m, *v, 1.0) for m, v in given.items() if v], schema)).collect()
    got = sampled_frames(spark.createDataFrame([(r["media_id"], r["reported_fps"], r["frame_count"], 1.0) for r in read], schema)).collect()
    assert sorted(got) == sorted(want) and len(got) > 15


def test_detections_never_leave_their_media(spark, tmp_path):
    """One split of videos is inferred by many tasks, and no shuffle moves detections."""
    media = spark.createDataFrame([(f"v{i}", "a.mp4", 0.0, 100 + i) for i in range(64)], VIDEOS).coalesce(1)
    found = engine(spark, tmp_path).analyze_videos(media, decode=lambda row: Sized((64, 48)), interval=1.0, with_status=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(found.inputFiles()) > 1
    assert {r["media_id"]: len(r["detections"]) for r in found.collect()} == {f"v{i}": -(-(100 + i) // 25) for i in range(64)}


def test_images_are_sized_once_before_each_model(spark, tmp_path):
    """An image's bytes are asked for once on its way to the detector, a crop's once on its way to the classifier."""

    class Seen(Sized):
        asked = 0

        @property
        def nbytes(self):
            Seen.asked += 1
            return 3 * self.size[0] * self.size[1]

        def crop(self, box):
            return Seen(super().crop(box).size)

    def images(index):
        return Seen((64, 48)) if index < 7 else None

    how = models.Inference(lambda: Models.load(EngineConfig()), 0.35, batch_most=3)
    row, status, ended_at, found = models._of_video({"media_id": "v"}, images, list(range(9)), how)
    assert (status, ended_at, len(found), Seen.asked) == (models.ENDED_EARLY, 7, 7, 14)
    assert models._of_video(row, None, [0], how)[1:] == (models.NOT_OPENED, None, []) and models._of_video(row, images, [], how)[1:] == (models.OPENED, None, [])


def test_a_model_answers_for_each_image():
    class Short(models.CentreBoxDetector):
        def predict_batch(self, images):
            return [self.predict(image) for image in images[1:]]

    with pytest.raises(ValueError):
        models.Inference(lambda: Models(Short(), models.UnknownClassifier()), 0.35).of_images([Sized((8, 8))] * 3)

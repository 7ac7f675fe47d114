"""What the bytes of media files tell without decoding them: size and orientation of images, rate and frames of videos.

The readers walk the containers' own structure and are small: JPEG segments with the EXIF orientation, PNG's first
chunk, MP4 and MOV boxes, AVI chunks. Files that are something else, or end too soon, have a status that says so and
nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from camtrail.functions.numbers import clipped

# Fixed values of the formats.
PNG_START = b"\x89PNG\r\n\x1a\n"
#: JPEG segments that hold a frame's size, and those without a length.
JPEG_SIZES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
JPEG_BARE = frozenset(range(0xD0, 0xDA)) | {0x01}
ORIENTATION_TAG = 0x0112
#: Orientations that turn an image by a quarter, so that width and height change places.
QUARTER_TURNS = (5, 6, 7, 8)
READ, UNKNOWN, BROKEN = "read", "unknown format", "broken"

_IMAGE = "image_format string, width int, height int, orientation int, header_status string"
_VIDEO = "video_format string, reported_fps double, frame_count long, header_status string"


def image_header(data: bytes) -> tuple[str | None, int | None, int | None, int | None, str]:
    """Format, width and height as shown, EXIF orientation (1 where none is told), status."""
    try:
        if data.startswith(PNG_START):
            if data[12:16] != b"IHDR":
                raise ValueError("no size")
            width, height = struct.unpack_from(">II", data, 16)
            return "png", *_sized(width, height), 1, READ
        if data.startswith(b"\xff\xd8"):
            width, height, orientation = _jpeg(data)
            return "jpeg", *_sized(*((height, width) if orientation in QUARTER_TURNS else (width, height))), orientation, READ
    except (struct.error, ValueError, IndexError):
        return None, None, None, None, BROKEN
    return None, None, None, None, UNKNOWN


def _sized(width: int, height: int) -> tuple[int, int]:
    if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
        raise ValueError("no size")
    return width, height


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at, orientation = 2, 1
    while True:
        if data[at] != 0xFF:
            raise ValueError("no segment")
        kind = data[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif kind in JPEG_BARE:
            at += 2
        else:
            (size,) = struct.unpack_from(">H", data, at + 2)
            if kind in JPEG_SIZES:
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height, orientation
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                orientation = _orientation(data[at + 10 : at + 2 + size])
            at += 2 + size


def _orientation(tiff: bytes) -> int:
    """1 where the block tells none, or nothing that an orientation can be."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if not order:
        return 1
    try:
        (first,) = struct.unpack_from(f"{order}I", tiff, 4)
        (n,) = struct.unpack_from(f"{order}H", tiff, first)
        for i in range(n):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * i)
            if tag == ORIENTATION_TAG and kind == 3:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def video_header(data: bytes) -> tuple[str | None, float | None, int | None, str]:
    """Format, frames a second (0 where the file tells none), frames, status."""
    try:
        if data[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            return "mp4", *_mp4(data), READ
        if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
            return "avi", *_avi(data), READ
    except (struct.error, ValueError, IndexError):
        return None, None, None, BROKEN
    return None, None, None, UNKNOWN


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the contents of each box."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start)
            start += 8
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            raise ValueError("a box that is cut off")
        yield kind, start, stop
        at = stop


def _inside(data: bytes, path: tuple[bytes, ...], at: int, end: int) -> Iterator[tuple[int, int]]:
    for kind, start, stop in _boxes(data, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield start, stop
            else:
                yield from _inside(data, path[1:], start, stop)


def _mp4(data: bytes) -> tuple[float, int]:
    """Of the first video track: samples of its time table, by the time that they take."""
    for start, stop in _inside(data, (b"moov", b"trak", b"mdia"), 0, len(data)):
        kinds = [data[a + 8 : a + 12] for a, _ in _inside(data, (b"hdlr",), start, stop)]
        if b"vide" not in kinds:
            continue
        (head, _) = next(_inside(data, (b"mdhd",), start, stop))
        (scale,) = struct.unpack_from(">I", data, head + (20 if data[head] == 1 else 12))
        frames = ticks = 0
        for a, _ in _inside(data, (b"minf", b"stbl", b"stts"), start, stop):
            (n,) = struct.unpack_from(">I", data, a + 4)
            for i in range(n):
                count, each = struct.unpack_from(">II", data, a + 8 + 8 * i)
                frames, ticks = frames + count, ticks + count * each
        return (frames * scale / ticks if ticks else 0.0), frames
    raise ValueError("no video track")


def _avi(data: bytes) -> tuple[float, int]:
    """Of the first video stream: scale, rate and length of its header."""
    at = 12
    while at + 12 <= len(data):
        kind, size, inner = struct.unpack_from("<4sI4s", data, at)
        if kind == b"LIST" and inner in (b"hdrl", b"strl"):
            at += 12  # its chunks come next
            continue
        if kind == b"strh" and inner == b"vids":
            scale, rate, _, length = struct.unpack_from("<IIII", data, at + 8 + 20)
            return (rate / scale if scale else 0.0), length
        at += 8 + size + size % 2
    raise ValueError("no video stream")


def _added(files: DataFrame, read: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """files (with content) with a reader's columns; content itself doesn't come back."""
    kept = [c for c in files.columns if c != "content"]
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x.as_py() or b"") for x in batch["content"]]  # one file at a time
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.record_batch([*(batch[c] for c in kept), *(pa.array(c, t) for c, t in zip(columns, types))], [*kept, *names])

    return files.mapInArrow(run, T.StructType([*files.select(*kept).schema.fields, *T.StructType.fromDDL(schema).fields]))


def with_image_headers(files: DataFrame) -> DataFrame:
    """files (media_files(): path, ..., content) with image_format, width, height, orientation and header_status, without content."""
    return _added(files, image_header, _IMAGE)


def with_video_headers(files: DataFrame) -> DataFrame:
    """files with video_format, reported_fps, frame_count and header_status, without content: what frame sampling needs."""
    return _added(files, video_header, _VIDEO)


def clipped_boxes(detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """detections (media_id, bbox, ...) with `clip`, the corners within the media's width and height, without decoding an image."""
    joined = detections.join(sizes.select("media_id", F.col("width").alias("_width"), F.col("height").alias("_height")), "media_id", "left")
    return joined.withColumn("clip", clipped(F.col("bbox"), F.col("_width"), F.col("_height"))).drop("_width", "_height")

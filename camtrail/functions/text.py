"""Names, paths and texts that views show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upload_suffix(name: Column) -> Column:
    """The last extension in lower case, or .bin; null and empty names count as `upload`."""
    found = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.][^/]*?([.][^./]+)$", 1))
    return F.when(found == "", ".bin").otherwise(found)


def crop_name(media_id: Column, frame_time: Column, det_index: Column) -> Column:
    """Milliseconds are cut, not rounded. A formatter, which is slow, makes the rare names that aren't plain parts: of nulls, or of times under 0 or with more than eight digits."""
    milliseconds = (frame_time * 1000).cast("int")
    plain = F.concat(media_id, F.lit("_"), F.lpad(milliseconds.cast("string"), 8, "0"), F.lit("_"), det_index.cast("string"), F.lit(".jpg"))
    return F.coalesce(F.when((milliseconds >= 0) & (milliseconds < 10**8), plain), F.format_string("%s_%08d_%d.jpg", media_id, milliseconds, det_index))


def crop_path(name: Column) -> Column:
    return F.concat(F.lit("/media/crops/"), name)


def annotated_path(media_id: Column) -> Column:
    return F.concat(F.lit("/media/uploads/"), media_id, F.lit("_annotated.jpg"))


def annotation_label(label: Column, confidence: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(label, F.lit(" "), F.rint(confidence * 100).cast("int").cast("string"), F.lit("%"))


def shown_percent(confidence: Column) -> Column:
    """Whole percent, halves up."""
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def shown_seconds(frame_time: Column) -> Column:
    return F.format_string("%.2fs", frame_time)


def shown_box(box: Column) -> Column:
    return F.format_string("%d,%d,%dx%d", box["x"], box["y"], box["width"], box["height"])


def origin_list(origins: Column) -> Column:
    """The parts between commas without white space around them, without empty ones."""
    return F.filter(F.transform(F.split(origins, ","), lambda part: F.regexp_replace(part, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), lambda part: part != "")


def new_media_id() -> Column:
    """32 hexadecimal characters; differs at each evaluation."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))

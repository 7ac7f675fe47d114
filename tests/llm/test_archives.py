"""Web archives against plain rules, and the formats byte by byte."""

import gzip
import hashlib
import random

import pytest
from samples import words

from camtrail.llm import web_archives as wa

SCHEMA = "page_id long, url string, html string, digest string, place string"


def pages(seed=3, n=60):
    rng = random.Random(seed)
    same = ["<p>" + words(rng, 40) for _ in range(3)]
    rows = [(i * 3 % 61, f"http://h{i % 4}/a b?{i}", rng.choice([*same, words(rng, rng.choice([1, 30, 900]))])) for i in range(n)]
    rows += [(200, None, None), (201, "", ""), (202, "dns:h", "short"), (203, "dns:i", "short"), (7, "http://x", same[0]), (None, "http://x", same[0]), (None, None, same[1]), (None, "u", None)]
    rows += [(300, "http://long", "\r\n\r\nWARC/1.1\r\n\r\n" + words(rng, 40_000)), (301, "http://ü/ \t", "ünï\x00\r\n\n\r" * 30), (302, "http://http", "HTTP/1.1 200\r\nX-Page-Id: 9\r\n\r\n" + "x" * 99), (-5, "http://minus", same[2])]
    rng.shuffle(rows)
    return [(*r, "clash", "clash") for r in rows]


def plain(rows):
    out, first = [], {}
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and data in first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(map(repr, out))


@pytest.mark.parametrize("version, broadcast", [(None, 10), (1, 0), (2, 10)])
def test_round_trip(spark, stored, tmp_path, version, broadcast):
    rows = pages()
    wa.write_arc(stored(rows, SCHEMA, 4, "pages"), f"{tmp_path}/arc", version)
    wa.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", most_broadcast=broadcast)
    found = wa.read_warc(spark, f"{tmp_path}/warc")
    kept = found.collect()
    assert sorted(repr(tuple(r)) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == plain(rows)
    ids = {r["record_id"]: r for r in kept}
    assert len(ids) == len(rows) and all(r["date"] == "2000-01-01T00:00:00Z" for r in kept)
    for r in kept:
        if r["record_type"] == "revisit":
            assert r["payload"] is None and ids[r["refers_to_id"]]["payload_digest"] == r["payload_digest"] and ids[r["refers_to_id"]]["record_type"] == "response"


def test_empty_table(spark, stored, tmp_path):
    wa.write_arc(stored([], SCHEMA, 1, "pages"), f"{tmp_path}/arc")
    wa.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert wa.read_warc(spark, f"{tmp_path}/warc").count() == 0


def test_files_follow_the_formats(spark, stored, tmp_path):
    rows = [(1, "http://a/b c", "x" * 120, "", ""), (2, "http://d", "x" * 120, "", "")]
    wa.write_arc(stored(rows, SCHEMA, 1, "pages"), f"{tmp_path}/arc", 2)
    data = gzip.open(next((tmp_path / "arc").glob("*.gz"))).read()
    first, about, fields, blank, line = data.split(b"\n")[:5]
    assert first.startswith(b"filedesc://part-0.arc 0.0.0.0 20000101000000 text/plain 200 ") and int(first.split()[-1]) == len(about + fields) + 2
    assert about.startswith(b"2 ") and fields.decode() == wa.ARC_FIELDS[2] and blank == b"" and line.startswith(b"http://a/b%20c 0.0.0.0 20000101000000 text/html 200 ")
    assert len(line.split(b" ")) == 10
    wa.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    data = gzip.open(next((tmp_path / "warc").glob("*.gz"))).read()
    kinds = [fields["warc-type"] for fields, _ in wa.warc_records([data[:50], data[50:51], data[51:]])]
    assert kinds == ["warcinfo", "response", "revisit"] and data.endswith(b"\r\n\r\n")


def put(tmp_path, data):
    (tmp_path / "old").mkdir()
    with gzip.open(tmp_path / "old" / "a.arc.gz", "wb") as file:
        file.write(data)
    return str(tmp_path / "old")


def test_archives_of_others(spark, tmp_path):
    """Binary payloads, blanks in addresses, other schemes, short stamps and both versions after one another."""
    one = b"1 1 Crawler\n" + wa.ARC_FIELDS[1].encode() + b"\n"
    two = b"2 0 Crawler\n" + wa.ARC_FIELDS[2].encode() + b"\n"
    image = b"HTTP/1.0 200 OK\nContent-Type: image/gif\n\n" + bytes(range(256)) + b"\r\n\r\n"
    name = b"20010203\n1.2.3.4\n"
    data = b"filedesc://x 0.0.0.0 19990101000000 text/plain %d\n%s\n" % (len(one), one)
    data += b"http://a/x y.gif 1.2.3.4 19990203040506 image/gif %d\n%s\n" % (len(image), image)
    data += b"\ndns:a 1.2.3.4 1999 text/dns %d\n%s\n" % (len(name), name)
    data += b"filedesc://y 0.0.0.0 19990101000000 text/plain 200 - - 0 y %d\n%s\n" % (len(two), two)
    data += b"http://b 1.2.3.4 20010203040506 image/gif 200 abc - 7 y.arc %d\n%s\n" % (len(image), image)
    folder = put(tmp_path, data)
    wa.convert(spark, folder, f"{tmp_path}/warc")
    found = {r["uri"]: r for r in wa.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert {u: r["record_type"] for u, r in found.items()} in ({"http://a/x y.gif": "response", "dns:a": "resource", "http://b": "revisit"}, {"http://a/x y.gif": "revisit", "dns:a": "resource", "http://b": "response"})
    whole = next(r for r in found.values() if r["record_type"] == "response")
    assert bytes(whole["payload"]) == bytes(range(256)) + b"\r\n\r\n" and bytes(found["dns:a"]["payload"]) == name
    assert found["dns:a"]["date"] == "1999-01-01T00:00:00Z" and found["http://b"]["date"] == "2001-02-03T04:05:06Z"


@pytest.mark.parametrize("data, problem", [(b"filedesc://x 0 1 text/plain 4\n9 0\n\n", "version 9"), (b"filedesc://x 0 1 text/plain 6\n1 0 x\n\nhttp://a 1 2 t 99\nabc\n", "shorter"), (b"filedesc://x 0 1 text/plain 6\n1 0 x\n\nhttp://a 7\n", "2 fields")])
def test_broken_archives_raise(spark, tmp_path, data, problem):
    with pytest.raises(Exception, match=problem):
        wa.read_arc(spark, put(tmp_path, data)).collect()

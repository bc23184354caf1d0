from __future__ import annotations

import base64
import gzip
import hashlib
import os

from lakemart.llm.warc import CaptureIndex, archive_round_trip, build_index, url_key, write_archives
from lakemart.llm.common import stored
from lakemart.session import work_folder

SCHEMA = "page_id long, url string, html string, key string, file string, offset int"


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and (h not in first or i < first[h]):
            first[h] = i
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = len(data) >= least and f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", 1) for r in rows], SCHEMA)


ROWS = [
    (5, "http://a.b/x", "same"), (3, "http://a.b/y", "same"), (9, None, "same"), (4, "https://u@A.B:8080/p?q#f", None), (6, "http://a.b/x", ""), (7, "", "é\r\n\r\nWARC/1.1\r\n"),
    (8, "bad url\r\nX: y", "x" * 300_000), (11, "http://a.b", "y" * 13), (12, "http://a.b", "y" * 13), (13, "😀", "\x00"),
]


def run(spark, rows, **options):
    got = archive_round_trip(pages(spark, rows), **options)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str)


def test_round_trip(spark):
    assert run(spark, ROWS) == expected(ROWS)
    assert run(spark, ROWS, least_bytes=5) == expected(ROWS, 5)
    assert run(spark, []) == []


def test_repeats_and_null_ids(spark):
    rows = ROWS + [(3, "http://a.b/y", "same"), (None, "http://n", "same"), (None, "http://n", "alone"), (3, "http://a.b/y", "z")]
    assert run(spark, rows) == expected(rows)


def test_hot_url_over_many_blocks(spark):
    rows = [(i % 90, "http://hot/", f"p{i % 7}") for i in range(600)]
    archives, index = work_folder(spark, "warc"), work_folder(spark, "cdx")
    captures = stored(write_archives(pages(spark, rows), archives), "captures")
    files = build_index(captures, index, block_lines=3)
    found = CaptureIndex(files, index, archives, keep=4)
    for i in range(90):
        payloads = sorted(found.read(c)["payload_digest"] for c in found.captures("hot)/", i))
        assert payloads == sorted(expected([r])[0][2] for r in rows if r[0] == i)
    assert not list(found.captures("hot)/", 90)) and not list(found.captures("a", 1)) and not list(found.captures("z", 1))


def test_archives_are_gzip_members_with_payloads(spark):
    folder = work_folder(spark, "warc")
    captures = write_archives(pages(spark, ROWS), folder).collect()
    path = folder.removeprefix("file:")
    for c in captures:
        with open(os.path.join(path, c["file"]), "rb") as f:
            f.seek(c["offset"])
            data = gzip.decompress(f.read(c["length"]))
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_keys():
    assert url_key("http://www.Example.com:80/a?b#c") == "com,example,www:80)/a?b"
    assert url_key("example.org") == "org,example)/"
    assert url_key(None) == "" and url_key("http://u:p@h/") == "h)/"

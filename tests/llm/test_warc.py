import hashlib
from collections import Counter

import pytest

from sensorloom.llm import warc
from sensorloom.session import ship_package

BIG = "<p>" + "é" * 90 + "</p>"
PAGES = [
    (1, "http://a", None, "k"), (2, None, "", "k"), (3, "http://c", BIG, "k"), (5, "http://d", BIG, "k"), (4, "http://e", "short", "k"),
    (6, "u\r\nv", "short", "k"), (None, "http://f", BIG, "k"), (None, "http://g", "only null ids " * 20, "k"), (None, "http://h", "only null ids " * 20, "k"),
    (3, "http://c", BIG, "k"), (9, "http://i", "WARC/1.1\r\n\r\n" * 40, "k"), (10, "x", "z" * 200_000, "k"),
]


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    out = Counter()
    for page, _, html, _ in rows:
        body = (html or "").encode()
        refers = first.get(body) if len(body) >= 100 and page != first.get(body) else None
        out[(page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    return out


@pytest.mark.parametrize("rows", [PAGES, []])
def test_round_trip(spark, rows):
    ship_package(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    found = warc.archive_round_trip(pages)
    assert found.where("gap_start is not null").count() == 0
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in found.select(*names).collect()) == expected(rows)


def archive(n=5, packed=True):
    records = [warc.record_bytes(i, "http://x", b"payload %d " % i * 50, hashlib.sha256(b"payload %d " % i * 50).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(n)]
    return [warc.gzip_member(r) if packed else r for r in records]


def outcome(data):
    found = list(warc.salvage(data))
    return [f["page_id"] for f in found if "page_id" in f], [(f["gap_start"], f["gap_end"]) for f in found if "gap_start" in f]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed):
    parts = archive(packed=packed)
    whole = b"".join(parts)
    ends = [sum(map(len, parts[: i + 1])) for i in range(5)]
    assert outcome(whole) == ([0, 1, 2, 3, 4], [])
    broken = bytearray(whole)
    broken[ends[1] + len(parts[2]) // 2] ^= 0xFF
    assert outcome(bytes(broken)) == ([0, 1, 3, 4], [(ends[1], ends[2])])
    assert outcome(whole[:-20]) == ([0, 1, 2, 3], [(ends[3], len(whole) - 20)])
    assert outcome(b"junk" + whole) == ([0, 1, 2, 3, 4], [(0, 4)])
    assert outcome(whole[: ends[0]] + b"\x1f\x8b\x08junk" + whole[ends[0] :]) == ([0, 1, 2, 3, 4], [(ends[0], ends[0] + 7)])
    assert outcome(b"") == ([], [])
    assert outcome(b"nothing here") == ([], [(0, 12)])


def test_salvage_mixes_packed_and_plain():
    assert outcome(archive(1)[0] + archive(2, False)[1] + archive(3)[2]) == ([0, 1, 2], [])

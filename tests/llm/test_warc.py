import hashlib
import random

from tidemark.llm import warc as m
from tidemark.llm.common import scratch_path


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, archive string")


BIG = "<p>é" + "a" * 1200
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/ x\r\ny", BIG), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "small"), (6, "http://e/", "small"),
    (None, "http://f/", BIG), (None, "http://g/", "q" * 2000), (7, "http://h/", "漢" * 5000), (2, "http://b/", BIG),
]


def test_round_trip(spark):
    folder = scratch_path(spark, "warc-test")
    manifest = m.write_archives(m.with_record_types(frame(spark, ROWS)), folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in m.read_archives(spark, folder, manifest).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        largest = max((j for j, _, g in ROWS if g == h and j is not None), default=None)
        revisit = len(b) >= 1000 and largest is not None and i != largest
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    assert got == sorted(want, key=str)


def test_files_of_lost_attempts_are_ignored(spark):
    folder = scratch_path(spark, "warc-test")
    manifest = m.write_archives(m.with_record_types(frame(spark, ROWS[:1])), folder)
    m.write_archives(m.with_record_types(frame(spark, ROWS[4:5])), folder)
    assert [r.page_id for r in m.read_archives(spark, folder, manifest).collect()] == [1]
    assert m.read_archives(spark, folder).count() == 2


def members(n=6, pack=m.gzip_member):
    return [pack(m.record_bytes(i, "http://x/", f"<p>{i} " + "abc " * 300, "response", None)) for i in range(n)]


def check(data, lost, n):
    found = list(m.salvage(data))
    assert sorted(f["page_id"] for f in found if f["kind"] == "record") == [i for i in range(n) if i not in lost]
    spans = sorted((f["start"], f["end"]) for f in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(f["reason"] for f in found if f["kind"] == "gap")
    return [f for f in found if f["kind"] == "gap"]


def test_salvage_of_damaged_members():
    parts = members()
    assert check(b"".join(parts), [], 6) == []
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    (gap,) = check(b"".join([*parts[:2], bytes(bad), *parts[3:]]), [2], 6)
    assert gap["start"] == len(parts[0]) + len(parts[1])
    check(b"junk" + b"".join(parts[:3]) + parts[3][:50] + b"".join(parts[4:]), [3], 6)
    check(b"".join(parts[:5]) + parts[5][:-9], [5], 6)
    check(b"".join(parts) + b"\x1f\x8b\x08tail", [], 6)


def test_salvage_of_plain_records_with_a_wrong_length_or_digest():
    parts = members(pack=bytes)
    cut = parts[1].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    flipped = parts[3].replace(b"abc abc", b"abd abc", 1)
    gaps = check(b"".join([parts[0], cut, parts[2], flipped, *parts[4:]]), [1, 3], 6)
    assert len(gaps) == 2 and gaps[1]["reason"] == "block digest"


def test_urls_of_any_length_come_back(spark, tmp_path):
    urls = ["http://x/" + "a" * 200_000, "http://x/" + "漢" * 8_000, "http://x/WARC/1.1"]
    frame(spark, [(i, u, BIG) for i, u in enumerate(urls)]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in m.op9_warc(spark, str(tmp_path)).collect()}
    assert got == {0: ("revisit", 2), 1: ("revisit", 2), 2: ("response", None)}
    (found,) = m.salvage(m.gzip_member(m.record_bytes(0, urls[0], "x", "response", None)))
    assert found["target_uri"] == urls[0]


def test_a_header_ends_before_the_next_version_line():
    good = m.record_bytes(1, "http://x/", "x", "response", None)
    gap, record = m.salvage(b"WARC/1.1\r\nWARC-Type: resp\r\n" + good)
    assert gap["kind"] == "gap" and record["page_id"] == 1


def test_records_that_are_not_read_back_fail_the_query(spark, tmp_path, monkeypatch):
    import pytest

    frame(spark, ROWS[:3]).write.parquet(f"{tmp_path}/pages.parquet")
    read = m.read_archives
    monkeypatch.setattr(m, "read_archives", lambda *a: read(*a).filter("page_id > 1"))
    with pytest.raises(RuntimeError, match="3 records were written, 2 read back"):
        m.op9_warc(spark, str(tmp_path))


def test_salvage_inside_a_member_of_many_records():
    parts = members(pack=bytes)
    found = list(m.salvage(m.gzip_member(b"".join(parts)) + m.gzip_member(parts[0])))
    assert [f["page_id"] for f in found] == [0, 1, 2, 3, 4, 5, 0]
    flipped = parts[1].replace(b"abc abc", b"abd abc", 1)
    cut = parts[1].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    for bad, reason in ((flipped, "block digest"), (cut, "record does not end where it says"), (b"junk", "no record header")):
        data = m.gzip_member(b"".join([parts[0], bad, *parts[2:]]))
        found = list(m.salvage(data))
        assert [f.get("page_id") for f in found] == [0, None, 2, 3, 4, 5]
        assert found[1]["reason"] == reason and found[1]["inner"] == len(parts[0]) and found[2]["inner"] == len(parts[0] + bad)
        assert {(f["start"], f["end"]) for f in found} == {(0, len(data))}


def test_salvage_keeps_what_a_broken_member_gave():
    import random

    rng = random.Random(0)
    parts = [m.record_bytes(i, "http://x/", "".join(rng.choices("abcdefgh", k=50_000)), "response", None) for i in range(6)]
    for level in (0, 6):
        whole = m.gzip_member(b"".join(parts), level)
        flipped = bytearray(whole)
        flipped[-6] ^= 0xFF  # the sum of the whole
        for data, n in ((whole[: len(whole) * 2 // 3], 3), (bytes(flipped), 6)):
            found = list(m.salvage(data + m.gzip_member(parts[5])))
            kept = [f["page_id"] for f in found if f["kind"] == "record"]
            assert kept[:n] == list(range(n)) and kept[-1] == 5 and len(kept) <= n + 2 and len(kept) == len(set(kept[:-1])) + 1
            assert [f["start"] for f in found if f["kind"] == "gap"] == [0]


def test_empty_table(spark):
    folder = scratch_path(spark, "warc-test")
    assert m.write_archives(m.with_record_types(frame(spark, [])), folder).collect() == []


def test_very_long_html_comes_back(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh é<>", k=3_000_000))
    folder = scratch_path(spark, "warc-long")
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "x")]
    manifest = m.write_archives(m.with_record_types(frame(spark, rows)), folder)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in m.read_archives(spark, folder, manifest).collect()}
    size = len(long.encode())
    assert got == {1: (size, "revisit", 2), 2: (size, "response", None), 3: (1, "response", None)}


def test_archives_are_written_where_spark_reads(spark, tmp_path):
    assert m.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert m.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://shared/")
    hadoop.set("fs.viewfs.mounttable.shared.link./archives", tmp_path.as_uri())
    try:
        assert m.qualified(spark, "/archives/warc") == "viewfs://shared/archives/warc"
    finally:
        hadoop.set("fs.defaultFS", before)

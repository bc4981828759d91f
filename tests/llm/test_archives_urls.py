import base64
import glob
import hashlib
import struct

import pytest

from kinweave.llm import url_filter, warc

PAGES = "page_id long, url string, html string, archive string, digest string"


def _archive(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    folder = f"file://{tmp_path}/a"
    index = warc.archive_pages(pages, folder=folder, **options)
    return index, {(r.page_id, r.url): r for r in warc.read_archives(spark, folder).collect()}


def test_round_trip_revisits_and_digests(spark, tmp_path):
    long = "<p>é</p>" * 200_000
    rows = [(5, "http://a/x y\r\n", "same"), (3, "http://b/", "same"), (7, None, None), (8, "http://c/", ""), (9, "http://d/", long), (9, "http://d/", long)]
    index, read = _archive(spark, rows, tmp_path)
    assert index.count() == len(rows)
    got = {k[0]: v for k, v in read.items()}
    assert got[3].record_type == "response" and bytes(got[3].payload) == b"same"
    assert (got[5].record_type, got[5].refers_to, got[5].payload, got[5].payload_bytes) == ("revisit", 3, None, 4)
    assert got[5].url == "http://a/x%20y%0D%0A"
    assert (got[7].record_type, got[8].refers_to, got[7].payload_bytes) == ("response", 7, 0)
    assert got[9].record_type == "response" and bytes(got[9].payload).decode() == long
    assert got[9].payload_digest == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()


def test_small_payloads_are_not_revisited(spark, tmp_path):
    _, read = _archive(spark, [(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], tmp_path, min_payload=3)
    assert {k[0]: v.record_type for k, v in read.items()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archive_starts_with_its_dictionary_and_records_stand_alone(spark, tmp_path):
    index, _ = _archive(spark, [(i, f"http://h/{i}", f"<html>page number {i} of many</html>" * 20) for i in range(300)], tmp_path)
    (path,) = glob.glob(f"{tmp_path}/a/*.warc.zst")[:1]
    raw = open(path, "rb").read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    name = path.rpartition("/")[2]
    one = index.filter(index.archive == name).orderBy("offset").collect()[-1]
    alone = raw[: 8 + size] + raw[one.offset: one.offset + one.length]
    (block,) = list(warc.frames(alone))
    assert warc.parse_record(block)[0] == one.page_id


def test_damaged_payload_is_noticed():
    block = warc.warc_record(1, "http://a/", b"payload", None)
    with pytest.raises(ValueError):
        warc.parse_record(block.replace(b"\r\n\r\npayload", b"\r\n\r\npayloae"))


def test_empty_table_gives_no_records(spark, tmp_path):
    index, read = _archive(spark, [], tmp_path)
    assert index.count() == 0 and not read


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def _brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com/", "HTTP://Example.COM/en/x?q#f", "http://www.example.com/en/", "http://a.www.example.com/en/b",
        "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://net/es/", "http://ÄB.com/é", "http://example.com?x=/en/", "a://b://c.com/",
        "http://.com/", "http://" + "a." * 500 + "net/es/" + "y" * 5000, "http://x.net\n/es/",
    ] + [f"http://h{i}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'es'}/{i}" for i in range(300)]
    rows = [(i, u, "r", "h") for i, u in enumerate(urls + urls[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, other string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, RULES).collect()}
    assert got == {i: _brute(u) for i, u, *_ in rows}
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = [f"k{i}" for i in range(3000)]
    listed = universe[::7]
    frame = spark.createDataFrame([(k,) for k in universe], "key string")
    cascade = url_filter.build_cascade(listed, frame)
    assert len(cascade.levels) > 1
    hashed = frame.select("key", *url_filter._hashed(frame.key))
    assert {r.key for r in cascade.filter(hashed).collect()} == set(listed)
    assert url_filter.build_cascade([], frame).levels == ()

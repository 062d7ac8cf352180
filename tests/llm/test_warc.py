import hashlib

import pytest
from pyspark.sql import functions as F

from marlpit.llm import warc
from marlpit.llm.warc import Gap, Record, build_record, compress, salvage


def _record(i, payload=b"<html>x</html>"):
    return build_record("response", f"urn:page:{i}", "1970-01-01T00:00:00Z", f"http://e/{i}", payload, hashlib.sha256(payload).hexdigest(), None)


def _ids(found):
    return [x.headers["warc-record-id"] for x in found if isinstance(x, Record)]


@pytest.mark.parametrize("wrap", [compress, lambda x: x])
def test_clean_archive(wrap):
    parts = [wrap(_record(i, b"p" * i)) for i in range(5)]
    found = list(salvage(b"".join(parts)))
    assert _ids(found) == [f"<urn:page:{i}>" for i in range(5)] and not any(isinstance(x, Gap) for x in found)
    assert [(x.offset, x.length) for x in found] == [(sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts)]


@pytest.mark.parametrize("wrap", [compress, lambda x: x])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "length", "head", "tail"])
def test_later_records_are_recovered_and_the_gap_is_exact(wrap, harm):
    parts = [wrap(_record(i, b"payload %d " % i * 20)) for i in range(4)]
    bad = parts[1]
    if harm == "flip":
        bad = bad[:-30] + bytes([bad[-30] ^ 1]) + bad[-29:]
    elif harm == "cut":
        bad = bad[: len(bad) // 2]
    elif harm == "junk":
        bad = b"\x00garbage WARC/9.9 \r\n" * 3
    elif harm == "length":
        bad = wrap(_record(1, b"z" * 50).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 2))
    elif harm == "head":
        bad = bad[3:]
    elif harm == "tail":
        parts, bad = parts[:2], bad[:-5]
    data = parts[0] + bad + b"".join(parts[2:])
    found = list(salvage(data))
    assert _ids(found) == ["<urn:page:0>", *([] if harm == "tail" else ["<urn:page:2>", "<urn:page:3>"])]
    gaps = [x for x in found if isinstance(x, Gap)]
    assert [(g.offset, g.length) for g in gaps] == [(len(parts[0]), len(bad))] and gaps[0].reason


def test_a_record_that_is_too_large_in_a_member_read_piece_by_piece():
    big = compress(_record(1, b"a" * 3_000_000) + _record(2))
    found = list(salvage(big + compress(_record(3)), most=50_000, held=1_000))
    assert [type(x) for x in found] == [Record] * 3 and _ids(found) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert found[0].payload is None and found[0].note == "payload not held"
    whole = list(salvage(big, held=1_000))
    assert [(x.size, x.sha256) for x in whole] == [(x.size, x.sha256) for x in found[:2]] and whole[0].payload == b"a" * 3_000_000
    assert found[0].sha256 == hashlib.sha256(b"a" * 3_000_000).hexdigest()


@pytest.mark.parametrize("harm", ["length", "digest", "cut"])
def test_bad_records_that_are_streamed_lose_no_record_inside_or_after(harm):
    inner = [_record(i, b"inner %d " % i * 9_000) for i in range(2, 6)]
    bad = _record(1, b"a" * 300_000)
    if harm == "length":
        bad = bad.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1) if bad.count(b"\r\nContent-Length: ") == 1 else bad.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9")
    elif harm == "digest":
        bad = bad.replace(b"aaaaaa", b"aabaaa", 1)
    else:
        bad = bad[:200_000]
    data = compress(_record(0) + bad + b"".join(inner)) + compress(_record(9))
    found = list(salvage(data, most=50_000, held=1_000))
    assert _ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5, 9)]
    assert [(x.inner_offset, x.inner_length) for x in found if isinstance(x, Gap)] == [(len(_record(0)), len(bad))]


def _made(head, body, http="HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", version="WARC/1.0"):
    block = http.encode() + body
    return f"{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


CHUNKED = b"5;x=1\r\nhello\r\nA\r\n, in parts\r\n0\r\n\r\n"


@pytest.mark.parametrize("wrap", [compress, lambda x: x])
def test_valid_records_that_others_write(wrap):
    plain = b"hello, in parts"
    sha1 = lambda x: hashlib.sha1(x).hexdigest()
    cases = [
        (_made(f"WARC-Payload-Digest: sha1:{sha1(plain)}\r\n", CHUNKED), plain, ""),  # of the decoded body
        (_made(f"WARC-Payload-Digest: sha1:{sha1(CHUNKED)}\r\n", CHUNKED), CHUNKED, ""),  # of the body as it came
        (_made("", CHUNKED), plain, ""),
        (_made("", b"zz not chunked"), b"zz not chunked", ""),
        (_made(f"WARC-Payload-Digest: sha1:{sha1(b'other')}\r\n", CHUNKED), CHUNKED, "payload digest differs"),
        (_made("WARC-Target-URI: http://e/\r\n a\r\n\tb\r\n", b"x", "HTTP/1.1 200 OK\r\n\r\n"), b"x", ""),
        (_made("", b"old", "HTTP/1.0 200 OK\r\n\r\n", "WARC/0.18"), b"old", ""),
        (_made("WARC-Payload-Digest: md9:abc\r\n", b"unknown", "HTTP/1.0 200 OK\r\n\r\n", "WARC/0.17"), b"unknown", ""),
    ]
    found = list(salvage(b"".join(wrap(r) for r, _, _ in cases)))
    assert [(x.payload, x.note) for x in found] == [(p, n) for _, p, n in cases]
    assert found[5].headers["warc-target-uri"] == "http://e/ a b"
    assert all((x.size, x.sha256) == (len(x.payload), hashlib.sha256(x.payload).hexdigest()) for x in found)
    one = compress(b"".join(r for r, _, _ in cases))
    assert [(x.payload, x.note) for x in salvage(one, held=0)] == [(p, n) for _, p, n in cases]


@pytest.mark.parametrize("harm", ["none", "digest", "cut", "flip", "junk", "version"])
def test_members_read_piece_by_piece_equal_held_ones(monkeypatch, harm):
    records = [_record(i, b"payload %d " % i * (40 * i + 1)) for i in range(5)]
    if harm == "digest":
        records[2] = records[2].replace(b"payload 2 p", b"payload x p")
    elif harm == "junk":
        records[2] = b"WARC/1.1\r\n" + b"no record at all " * 100
    elif harm == "version":
        records[2] = records[2].replace(b"WARC/1.1", b"WARC/0.1", 1)
    data = compress(b"".join(records))
    if harm == "cut":
        data = data[:-12]
    elif harm == "flip":
        data = data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 0x55]) + data[len(data) // 2 + 1 :]
    data += compress(_record(9))
    held = list(salvage(data))
    monkeypatch.setattr(warc, "_FEED", 37)
    monkeypatch.setattr(warc, "_EXPANDED", 101)
    assert [(x[:2] if isinstance(x, Record) else x) for x in salvage(data, held=0)] == [(x[:2] if isinstance(x, Record) else x) for x in held]
    assert _ids(salvage(data, held=0)) == _ids(held) and "<urn:page:9>" in _ids(held)
    if harm in ("digest", "junk", "version"):
        assert len(_ids(held)) == 5 and sum(isinstance(x, Gap) for x in held) == 1
    elif harm == "cut":
        assert len(_ids(held)) >= 5


@pytest.mark.parametrize("harm", ["record", "cut", "flip", "trailer"])
def test_good_records_of_a_member_of_several_are_kept(harm):
    import random

    rng = random.Random(1)
    parts = [_record(i, bytes(rng.choices(b"abcdefghij <>", k=9000))) for i in range(12)]
    starts = [sum(map(len, parts[:i])) for i in range(12)]
    if harm == "record":
        member = compress(b"".join([*parts[:5], parts[5].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 7"), *parts[6:]]))
    else:
        member = compress(b"".join(parts))
        member = {"cut": member[: len(member) // 2], "flip": member[: len(member) // 2] + b"\xff" * 9 + member[len(member) // 2 + 9 :], "trailer": member[:-3]}[harm]
    data = compress(_record(98)) + member + compress(_record(99))
    found = list(salvage(data))
    ids, inside = _ids(found), [x for x in found if isinstance(x, Gap) and x.inner_offset is not None]
    first = len(compress(_record(98)))
    name = lambda numbers: [f"<urn:page:{i}>" for i in (98, *numbers, 99)]
    if harm == "record":
        assert ids == name([i for i in range(12) if i != 5])
        assert [(x.offset, x.length, x.inner_offset) for x in found if isinstance(x, Gap)] == [(first, len(member), starts[5])] and inside[0].inner_length >= len(parts[5])
    elif harm == "trailer":
        assert ids == name(range(12)) and [(x.inner_offset, x.inner_length) for x in inside] == [(starts[-1] + len(parts[-1]), 0)]
    else:
        assert 4 <= len(ids) - 2 < 12 and ids == name(range(len(ids) - 2)) and inside[0].inner_offset == starts[len(ids) - 2]


def test_records_without_digests_are_not_taken_from_a_damaged_member():
    import re

    parts = [re.sub(rb"WARC-[A-Z][a-z]+-Digest: [^\r]*\r\n", b"", _record(i)) for i in range(3)]
    member = compress(b"".join(parts))
    assert len(_ids(salvage(member))) == 3
    assert [type(x) for x in salvage(member[:-8] + b"12345678")] == [Gap]


def test_empty():
    assert list(salvage(b"")) == [] and [type(x) for x in salvage(b"x")] == [Gap]


def _trip(spark, tmp_path, data, schema="page_id long, url string, html string"):
    df = spark.createDataFrame(data, schema)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, file_bytes=4000)
    return warc.read_archives(spark, path)


def test_round_trip_with_nulls_copies_and_clashing_columns(spark, tmp_path):
    long = "é" * 100
    data = [(3, "u", long, 1), (1, None, long, 1), (2, "a b\r\nX: y", long, 1), (1, None, long, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (None, "u", long, 1), (7, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 9, 1)]
    got = _trip(spark, tmp_path, data, "page_id long, url string, html string, digest int")
    assert got.where("gap_reason is not null").count() == 0
    rows = got.withColumn("id", warc.page_number("record_id")).withColumn("to", warc.page_number("refers_to")).collect()
    assert len(rows) == len(data)
    kinds = sorted((str(r["id"]), r["record_type"], r["to"]) for r in rows)
    assert kinds == sorted([("1", "response", None)] * 2 + [(x, "revisit", 1) for x in ("2", "3", "None")] + [(x, "response", None) for x in "4567"])
    for r in rows:
        want = next((h or "") for i, _, h, _ in data if i == r["id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
        assert r["payload"] == (b"" if r["record_type"] == "revisit" else want)
    assert {r["target_uri"] for r in rows if r["id"] == 2} == {"a%20b%0D%0AX:%20y"}


def test_empty_table(spark, tmp_path):
    assert _trip(spark, tmp_path, []).count() == 0


def test_query_equals_sql_shape(spark, tiny):
    from marlpit.llm.queries import queries

    got = queries()["op1_warc_roundtrip"](spark, tiny)
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    want = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"))
    assert got.select("page_id", "payload_digest").exceptAll(want).count() == 0 and got.count() == pages.count()


@pytest.mark.parametrize("most", [100_000, 0])
def test_nulls_ties_and_a_very_long_page(spark, tmp_path, most):
    rows = [(3, "u", "x" * 200, 1), (3, "u", "x" * 200, 1), (None, None, "x" * 200, 1), (5, "u", "x" * 200, 1), (7, "u", "y" * 99, 1), (8, "u", "y" * 99, 1), (9, "u", None, 1), (10, "u", None, 1), (11, "u", "é" * 3_000_000, 1), (None, "u", "z" * 100, 1), (None, "u", "z" * 100, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/{most}"
    warc.write_archives(df, path, broadcast_digests=most)
    got = warc.read_archives(spark, path, keep_payload=False).collect()
    assert all(r["gap_reason"] is None for r in got) and len(got) == len(rows)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert [k for k in kinds if k[0] == "urn:page:3"] == [("urn:page:3", "response", None)] * 2
    assert ("urn:page:5", "revisit", "urn:page:3") in kinds and sum(k[1] == "revisit" for k in kinds) == 2
    assert max(r["payload_bytes"] for r in got) == 6_000_000


def test_the_query_fails_on_a_gap(spark, tiny, monkeypatch):
    from marlpit.llm import queries

    built = warc.compress
    monkeypatch.setattr(warc, "compress", lambda x: built(x)[:-3] + b"xyz")
    with pytest.raises(Exception, match="gap in"):
        queries.op1_warc_roundtrip(spark, tiny).collect()

import base64
import hashlib
import random

from pyspark.sql import functions as F

from planmark.llm import warc


def record(payload, number=1, kind="response", digest=True):
    check = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{number}>\r\n"
    head += f"WARC-Payload-Digest: sha1:{check}\r\n" if digest else ""
    return (head + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def both(data):
    found = list(warc.salvage(data))
    spans = [(f["at"], f["after"]) for f in found]
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] if spans else not data
    assert not spans or spans[-1][1] == len(data)
    return [f["payload"] for f in found if f["kind"] == "record"], [f for f in found if f["kind"] == "gap"]


def test_clean_archives():
    payloads = [b"", b"one", b"WARC/1.0\r\n inside", b"\r\n\r\n", "ü".encode() * 900]
    plain = b"".join(record(p, i) for i, p in enumerate(payloads))
    packed = b"".join(warc.gzip_record(record(p, i)) for i, p in enumerate(payloads))
    for data in (plain, packed):
        assert both(data) == (payloads, [])
    assert both(b"") == ([], [])


def test_damage_costs_the_damaged_record_alone():
    draw = random.Random(6)
    payloads = [bytes(draw.randrange(256) for _ in range(draw.randrange(400))) for _ in range(30)]
    for pack in (lambda r: r, warc.gzip_record):
        parts = [pack(record(p, i)) for i, p in enumerate(payloads)]
        for _ in range(40):
            hit, broken = draw.randrange(30), list(parts)
            where = draw.randrange(len(broken[hit]))
            how = draw.randrange(3)
            part = broken[hit]
            if how == 0:
                part = part[:where] + bytes([part[where] ^ 0x5A]) + part[where + 1 :]
            elif how == 1:
                part = part[:where]
            else:
                part = part[:where] + b"WARC/1.0\r\nWARC/1.0\r\n\x1f\x8b\x08 noise" + part[where:]
            broken[hit] = part
            got, gaps = both(b"".join(broken))
            assert [p for i, p in enumerate(payloads) if i != hit] == [p for p in got if p in payloads[:hit] + payloads[hit + 1 :]]
            assert len(gaps) <= 2


def test_wrong_lengths_and_headers():
    good = record(b"good", 2)
    for bad in (
        record(b"abc").replace(b"Content-Length: 3", b"Content-Length: 999999"),
        record(b"abc").replace(b"Content-Length: 3", b"Content-Length: -3"),
        record(b"abc").replace(b"Content-Length: 3", b"Content-Length 3"),
        record(b"abc").replace(b"abc", b"abd"), b"junk before", b"WARC/1.0\r\n", record(b"abc")[:-2],
    ):
        got, gaps = both(bad + good)
        assert got == [b"good"] and len(gaps) == 1 and gaps[0]["after"] == len(bad)


def test_plain_and_packed_records_in_one_archive():
    damaged = record(b"x\x1f\x8b\x08y", 1).replace(b"WARC/1.0", b"WARC/1.x", 1)
    got, gaps = both(damaged + record(b"two", 2) + warc.gzip_record(record(b"three", 3)) + record(b"four", 4))
    assert got == [b"two", b"three", b"four"] and [g["after"] for g in gaps] == [len(damaged)]
    many = warc.gzip_record(record(b"a", 1) + record(b"b", 2))
    found = list(warc.salvage(b"junk" + many + record(b"c", 3)))
    assert [f["kind"] for f in found] == ["gap", "record", "record", "record"]
    assert [f["payload"] for f in found[1:]] == [b"a", b"b", b"c"]
    assert [(f["at"], f["after"]) for f in found[1:3]] == [(4, 4 + len(many))] * 2


def test_write_and_read_back(spark, tmp_path):
    rows = [
        (5, "http://a/x y", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b", None), (8, "u", ""), (7, "u", "é" * 50_000),
        (None, "u", "<p>same</p>"), (4, "u", "WARC/1.0\r\nWARC-Type: response\r\n\r\n"), (6, "u", "a\r\nb\n"), (5, "again", "<p>same</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("r_id", F.lit("clash"))
    path = str(tmp_path / "out")
    warc.write_archives(df, path, records_per_file=2)
    records = warc.read_archives(spark, path)
    assert records.filter("kind = 'gap'").count() == 0
    stored = {(r["record_id"], bytes(r["payload"])) for r in records.collect() if r["record_type"] == "response"}
    assert ("<urn:page:7>", ("é" * 50_000).encode()) in stored
    got = sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve(records).collect()),
        key=str,
    )
    wanted = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "").encode() == body and p is not None)
        kind = ("response", None) if page == first else ("revisit", first)
        wanted.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *kind))
    assert got == sorted(wanted, key=str)


def test_least_size_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], "page_id long, html string")
    kinds = {r["r_id"]: r["r_first"] for r in warc.assign_types(df, "page_id", "html", least=3).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}
    path = str(tmp_path / "none")
    warc.write_archives(df.filter("page_id > 9"), path)
    assert warc.read_archives(spark, path).count() == 0

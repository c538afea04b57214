"""Archives with damage: what the salvage reader brings back, and how files are bounded."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from newsloom.llm import warc


def record(i, payload):
    return warc.record(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, "d")


def ids(data):
    return [p[2]["fields"]["warc-record-id"][len("<urn:page:") : -1] for p in warc.salvage(data) if p[2]]


RECORDS = [record(i, b"payload %d " % i * 9) for i in range(6)]


def test_damage_inside_a_member_costs_one_record():
    bad = RECORDS[1].replace(b"payload 1", b"pAyload 1", 1)
    parts = list(warc.salvage(warc._member(RECORDS[0] + bad + RECORDS[2]) + warc._member(RECORDS[3])))
    assert [(p[2] is None, p[3]) for p in parts] == [(False, ""), (True, "payload digest"), (False, ""), (False, "")]
    assert ids(warc._member(bad + RECORDS[1])) == ["1"]


def test_a_cut_member_gives_what_inflates():
    whole = warc._member(b"".join(RECORDS[:5]))
    for cut in (8, 9, 60, 150):
        got = ids(whole[:-cut] + warc._member(RECORDS[5]))
        assert got[-1] == "5" and got[:-1] == [str(i) for i in range(len(got) - 1)]
    assert ids(whole[:-9] + warc._member(RECORDS[5])) == list("012345")


def test_flipped_bytes_lose_only_what_they_hit():
    rng = random.Random(1)
    big = [record(i, rng.randbytes(4000)) for i in range(8)]
    members = [warc._member(r) for r in big]
    edges = [sum(map(len, members[:i])) for i in range(9)]
    for _ in range(60):
        data = bytearray(b"".join(members))
        at = rng.randrange(len(data))
        data[at] ^= 1 << rng.randrange(8)
        hit = next(i for i in range(8) if edges[i] <= at < edges[i + 1])
        got = ids(bytes(data))
        assert [i for i in got if i != str(hit)] == [str(i) for i in range(8) if i != hit]
        parts = list(warc.salvage(bytes(data)))
        assert sum(p[1] for p in parts) == len(data)
        for offset, _, found, _ in parts:  # a record that is given is right
            if found:
                i = int(found["fields"]["warc-record-id"][len("<urn:page:") : -1])
                assert big[i].endswith(found["body"] + b"\r\n\r\n")


def test_a_record_without_digest_is_not_trusted_from_damaged_members():
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert len([p for p in warc.salvage(warc._member(bare)) if p[2]]) == 1
    assert not [p for p in warc.salvage(warc._member(bare)[:-8]) if p[2]]


def test_round_trip_of_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string")
    path = tmp_path / "w"
    warc.write_archives(pages.coalesce(1), str(path))
    (part,) = path.glob("part-*")
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 0xFF
    part.write_bytes(bytes(data))
    for crc in path.glob(".part-*.crc"):
        crc.unlink()
    rows = warc.read_archives(spark, str(path)).collect()
    assert sum(r["gap_reason"] is not None for r in rows) >= 1 and sum(r["gap_reason"] is None for r in rows) >= 19
    assert sum(r["n_bytes"] for r in rows) == len(data)


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4096 * 4)
    monkeypatch.setattr(warc, "LONG", 2000)
    html = [None, "", "x" * 100, "x" * 100, *(f"{i}" * 300 for i in range(10)), "y" * 9000, "y" * 9000]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("value", F.lit("old"))
    path = tmp_path / "w"
    back = warc.round_trip(pages.coalesce(1), str(path)).orderBy("page_id").collect()
    assert [r["payload_bytes"] for r in back] == [len(h or "") for h in html] and all(r["gap_reason"] is None for r in back)
    assert [(r["page_id"], r["refers_to"]) for r in back if r["record_type"] == "revisit"] == [(3, 2), (15, 14)]
    counts = [len(gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\n")) - 1 for f in path.glob("part-*")]
    assert len(counts) >= 5 and max(counts) <= 4
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0

"""The WARC source: round trips, foreign archives, push-down, odd rows."""

import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds

from regimespark.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def some_rows():
    rng, rows = random.Random(3), []
    for i in range(120):
        payload = bytes(rng.choice(b"ab\r\n <>WARC/1.1") for _ in range(rng.choice([0, 1, 5, 100, 20_000, 60_000])))
        kind = "response" if rng.random() < 0.7 else "revisit"
        rows.append({"record_id": f"urn:x:{i}", "record_type": kind, "target_uri": "http://a/ b\r\nc", "date": "d", "payload_digest": digest(payload), "refers_to": "urn:x:0" if kind == "revisit" else None, "payload_bytes": len(payload), "payload": payload if kind == "response" else None})
    return rows


def forms(rows):
    """The same records in our members, in plain ones, in one member, and not zipped."""
    parts = [warc.record_bytes(r) for r in rows]
    return {"own": b"".join(map(warc.member, parts)), "members": b"".join(map(gzip.compress, parts)), "one": gzip.compress(b"".join(parts)), "plain": b"".join(parts)}


def stream(form, data, file=pa.BufferReader):
    return (warc.Plain if form == "plain" else warc.Zipped)(file(data))


@pytest.mark.parametrize("form", ["own", "members", "one", "plain"])
@pytest.mark.parametrize("payload", [True, False])
def test_records(form, payload):
    rows = some_rows()
    data = forms(rows)[form]
    for kind in ("response", "revisit", None):
        got = list(warc.records(stream(form, data), lambda r, kind=kind: kind in (None, r["record_type"]), payload, True))
        want = [r for r in rows if kind in (None, r["record_type"])]
        assert [(r["record_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r.get("payload")) for r in got] == [(r["record_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] if payload else None) for r in want]
        assert {r["target_uri"] for r in got} == {"http://a/%20b%0D%0Ac"}


def test_members_are_gzip():
    rows = some_rows()[:20]
    assert gzip.decompress(forms(rows)["own"]) == forms(rows)["plain"]


@pytest.mark.parametrize("form", ["own", "members", "one", "plain"])
def test_cut_archives(form):
    data = forms(some_rows())[form][:-30]
    with pytest.raises((EOFError, ValueError)):
        list(warc.records(stream(form, data), lambda r: True, True, True))


def test_wrong_digest():
    row = some_rows()[0] | {"record_type": "response", "payload": b"changed"}
    data = forms([row])["own"]
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(stream("own", data), lambda r: True, True, True))
    assert len(list(warc.records(stream("own", data), lambda r: True, True, True, verify=False))) == 1


class Counting(io.BytesIO):
    read_bytes = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        out = super().read(n)
        Counting.read_bytes += len(out)
        return out


def test_unwanted_payloads_are_not_decompressed(monkeypatch):
    rng = random.Random(8)
    big = rng.randbytes(1 << 20)
    rows = [{"record_id": f"urn:x:{i}", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": digest(big), "refers_to": None, "payload": big} for i in range(4)]
    monkeypatch.setattr(warc, "READ", 1 << 14)
    data = forms(rows)["own"]
    Counting.read_bytes = 0
    assert not list(warc.records(stream("own", data, Counting), lambda r: False, True, True))
    assert Counting.read_bytes < 40 * (1 << 14) < len(data)
    Counting.read_bytes = 0
    got = list(warc.records(stream("own", data, Counting), lambda r: True, False, True))
    assert [r["payload_bytes"] for r in got] == [1 << 20] * 4 and Counting.read_bytes < 40 * (1 << 14)


def test_filters():
    row = {"record_type": "response", "target_uri": None, "content_length": 5, "date": "é"}
    held = lambda f: warc.holds(f, row)
    assert held(ds.EqualTo(("record_type",), "response")) and held(ds.In(("record_type",), ("x", "response")))
    assert held(ds.EqualTo(("target_uri",), "x")) is None and held(ds.Not(ds.EqualTo(("target_uri",), "x"))) is None
    assert held(ds.IsNull(("target_uri",))) and not held(ds.IsNotNull(("target_uri",))) and held(ds.EqualNullSafe(("target_uri",), None))
    assert held(ds.In(("record_type",), ("x", None))) is None
    assert held(ds.GreaterThan(("content_length",), 4)) and not held(ds.LessThanOrEqual(("content_length",), 4)) and held(ds.GreaterThan(("date",), "z"))
    assert held(ds.StringStartsWith(("record_type",), "resp")) and held(ds.Not(ds.StringContains(("record_type",), "visit")))
    reader = warc.WarcReader("x", None, 1, True)
    left = list(reader.pushFilters([ds.EqualTo(("record_type",), "a"), ds.EqualTo(("payload_bytes",), 3), ds.EqualTo(("payload",), b""), ds.Not(ds.IsNull(("date",)))]))
    assert [f.attribute for f in left] == [("payload_bytes",), ("payload",)] and len(reader.filters) == 2


SCHEMA = "page_id long, url string, html string, `key` string, rid string, keep string, n string, sha1 string, payload string"


def page_rows():
    html = ["<p>one</p>", None, "", "<p>é</p>", "\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>one</p>"]
    rows = [(i * 5 % 31, f"http://h/{i}", html[i % 7]) for i in range(31)]
    rows += [(None, None, "<p>one</p>"), (None, "http://n", "only null"), (7, "http://again", html[1]), rows[3], rows[3], (100, "bad\r\nurl: x", "<b>")]
    return [(*r, *["clash"] * 6) for r in rows]


def expected(rows, least=0):
    out, groups = [], {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    for payload, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for k, i in enumerate(ids):
            revisit = k > 0 and len(payload) >= least
            out.append((i, len(payload), digest(payload), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_pages(spark, tmp_path, least):
    rows = page_rows()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/w", least, file_bytes="2000")
    got = [tuple(r) for r in warc.read_pages(spark, f"{tmp_path}/w").collect()]
    assert sorted(map(repr, got)) == expected(rows, least)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 3
    spread = warc.archives(spark, f"{tmp_path}/w", split="1")
    assert spread.where("record_type <> 'warcinfo'").count() == len(rows) and spread.rdd.getNumPartitions() > 3


def test_shuffled_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    warc.write_archives(spark.createDataFrame(page_rows(), SCHEMA), f"{tmp_path}/w")
    assert sorted(repr(tuple(r)) for r in warc.read_pages(spark, f"{tmp_path}/w").collect()) == expected(page_rows())


def test_push_down_and_foreign_files(spark, tmp_path):
    rows = some_rows()
    for name, data in forms(rows).items():
        (tmp_path / f"{name}.warc{'' if name == 'plain' else '.gz'}").write_bytes(data)
    some = warc.archives(spark, str(tmp_path)).where("record_type = 'revisit' AND target_uri LIKE 'http://a%' AND payload_bytes >= 5")
    assert some.count() == 4 * sum(r["record_type"] == "revisit" and r["payload_bytes"] >= 5 for r in rows)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("Filter", 1)[1].split("\n")[0] and "payload_bytes" in plan.split("Filter", 1)[1].split("\n")[0]


def test_overwrite_and_uncommitted(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), SCHEMA)
    warc.write_archives(pages, f"{tmp_path}/w")
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_pages(spark, f"{tmp_path}/w").count() == len(page_rows())
    warc.page_records(pages.limit(2)).write.format("warc").mode("overwrite").save(f"{tmp_path}/w")
    assert warc.read_pages(spark, f"{tmp_path}/w").count() == 2


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert warc.read_pages(spark, f"{tmp_path}/w").count() == 0

"""Archives: exact round trips, pushed predicates, foreign files."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from corpusloom.llm import warc

HTML = ["<p>" + "é" * 60 + "</p>", None, "", "short", "x" * 99, "x" * 100, "y" * 5000, "a\r\n\r\nWARC/1.1\r\nb" * 30]
SCHEMA = "page_id long, url string, html string, record_type string, payload string, n long"


def pages() -> list[tuple]:
    rows = [(i, f"http://h/{i}\r\nX: y", HTML[i % len(HTML)], "a", "b", 1) for i in range(40)]
    return [*rows, (None, None, HTML[0], "a", "b", 1), (5, "u", HTML[5], "a", "b", 1)]


def wanted(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and page is not None and page != min(same)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = warc.round_trip(spark.createDataFrame(pages(), SCHEMA)).collect()
    assert sorted((tuple(r) for r in found), key=str) == wanted(pages())


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives") / "a")
    warc.archive(spark.createDataFrame(pages(), SCHEMA).repartition(3), path)
    return path


def test_predicates_are_pushed(spark, folder):
    read = spark.read.format("warc").load(folder)
    one = read.where("record_id = '<urn:page:6>' AND record_type = 'response' AND content_length > 10")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (((isnotnull" not in plan
    assert [bytes(r.payload) for r in one.collect()] == [HTML[6].encode()]
    assert read.where("record_type IN ('revisit') AND NOT target_uri LIKE '%/9 %'").count() == sum(
        w[3] == "revisit" for w in wanted(pages())
    ) - sum(w[3] == "revisit" and w[0] == 9 for w in wanted(pages()))
    assert read.where("refers_to IS NULL").count() == sum(w[3] == "response" for w in wanted(pages()))


def test_unwanted_payloads_are_not_inflated(monkeypatch, tmp_path):
    big = warc.record({"record_type": "response"}, b"z" * 5_000_000)
    small = warc.record({"record_type": "revisit"}, b"")
    (tmp_path / "a.warc.gz").write_bytes(warc.member(big) * 3 + warc.member(small))
    inflated = []
    more = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self: (inflated.append(1), more(self))[1])
    with open(tmp_path / "a.warc.gz", "rb") as raw:
        found = list(warc.records(raw, lambda h: h["warc-type"] == "revisit", True))
    assert [p for _, _, p in found] == [b""] and len(inflated) <= 6


@pytest.mark.parametrize("kind", ["plain", "members", "one stream"])
def test_foreign_files(spark, tmp_path, kind):
    records = [b"WARC/1.0\r\nwarc-type: response\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"q" * n) for n in (0, 7, 200_000)]
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "one stream": None}[kind]
    if data is None:
        data = gzip.compress(records[0]) + b"".join(map(warc.member, records[1:]))
    (tmp_path / "f.warc").write_bytes(data)
    rows = spark.read.format("warc").load(str(tmp_path)).orderBy("content_length").collect() if _registered(spark) else []
    assert [len(r.payload) for r in rows] == [0, 7, 200_000]
    assert {r.headers["x-long"] for r in rows} == {"a b"}
    assert [r.content_length for r in spark.read.format("warc").schema("content_length long").load(str(tmp_path)).collect()] == [0, 7, 200_000]


def _registered(spark) -> bool:
    warc.register(spark)
    return True


def test_only_committed_files_are_read(spark, folder):
    before = spark.read.format("warc").load(folder).count()
    open(f"{folder}/records-of-a-lost-attempt.warc.gz", "wb").write(warc.member(warc.record({"record_type": "response"}, b"x")))
    assert spark.read.format("warc").load(folder).count() == before


def test_broken_file_is_refused(spark, tmp_path):
    (tmp_path / "f.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 100\r\n\r\nshort")
    warc.register(spark)
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("warc").load(str(tmp_path)).collect()

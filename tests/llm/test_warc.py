import base64
import hashlib
import json

import pytest

from tabwright.llm import warc

PAGE = """<html lang="en-GB"><head><title>A &amp; b</title><style>x</style></head><body><script>var a = "<p>no</p>";</script><nav><a href="/x?a=1&amp;b=2">X</a></nav>
<p>One <b>two</b>
three</p><p>é 日本<br>next</p><img src='i.png'><!-- gone --></body></html>"""


def digest(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_response_and_its_derivatives():
    response = warc.response_of(PAGE, "http://a.example/b/", 7, "2020-01-02T03:04:05Z")
    fields = warc.header_fields(response["headers"])
    assert fields["warc-payload-digest"] == digest(PAGE) and fields["warc-block-digest"] == digest(response["block"])
    assert int(fields["content-length"]) == len(response["block"].encode())
    meta, text = warc.derive_one(response)
    assert meta["refers_to"] == text["refers_to"] == response["record_id"] and len({meta["record_id"], text["record_id"], response["record_id"]}) == 3
    for record in (meta, text):
        own = warc.header_fields(record["headers"])
        assert own["warc-target-uri"] == "http://a.example/b/" and own["warc-date"] == "2020-01-02T03:04:05Z" and own["warc-refers-to"] == response["record_id"]
        assert own["warc-source-payload-digest"] == digest(PAGE) and own["warc-block-digest"] == digest(record["block"]) and int(own["content-length"]) == len(record["block"].encode())
    found = json.loads(meta["block"])
    assert [f"{k}: {v}" for k, v in found["source"]["warc-headers"]] == response["headers"].split("\r\n") and found["source"]["http-status"] == "HTTP/1.1 200 OK" and found["source"]["payload-verified"]
    assert found["source"]["http-headers"] == [["Content-Type", "text/html; charset=utf-8"], ["Content-Length", str(len(PAGE.encode()))]]
    assert found["html"] == {"title": "A & b", "lang": "en-gb", "links": [{"path": "a@/href", "url": "http://a.example/x?a=1&b=2"}, {"path": "img@/src", "url": "http://a.example/b/i.png"}]}
    assert text["block"] == "X\nOne two three\né 日本\nnext"


def test_records_repeat():
    assert warc.derive_one(warc.response_of(PAGE, "u", 1, warc.DATE)) == warc.derive_one(warc.response_of(PAGE, "u", 1, warc.DATE))


def test_foreign_responses():
    broken = warc.finished("response", "<urn:x>", "", "t", warc.DATE, "application/http", "HTTP/1.0 500 No", [])
    image = warc.finished("response", "<urn:y>", "", "t", warc.DATE, "application/http", "HTTP/1.0 200 OK\r\nContent-Type: image/png\r\nX-A: 1\r\n  folded\r\n\r\n<p>x", [])
    assert [r["block"] for r in (warc.derive_one(broken)[1], warc.derive_one(image)[1])] == ["", ""]
    assert json.loads(warc.derive_one(image)[0]["block"])["source"]["http-headers"] == [["Content-Type", "image/png"], ["X-A", "1 folded"]]


def test_repeated_headers_and_script_links_stay():
    block = 'HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nset-cookie: b=2\r\n\r\n<p>x</p><script src="/s.js">var t = \'<a href="/no">\';</script><!-- <a href="/no2"> --><a href=/y>y</a>'
    response = warc.finished("response", "<urn:z>", "", "http://h/", warc.DATE, "application/http", block, [("WARC-Concurrent-To", "<urn:1>"), ("WARC-Concurrent-To", "<urn:2>")])
    found = json.loads(warc.derive_one(response)[0]["block"])
    assert found["source"]["http-headers"] == [["Set-Cookie", "a=1"], ["Content-Type", "text/html"], ["set-cookie", "b=2"]]
    assert [v for k, v in found["source"]["warc-headers"] if k == "WARC-Concurrent-To"] == ["<urn:1>", "<urn:2>"]
    assert found["html"]["links"] == [{"path": "script@/src", "url": "http://h/s.js"}, {"path": "a@/href", "url": "http://h/y"}]


def test_format_round_trip_and_breaks():
    records = [warc.response_of(p, "u", k, warc.DATE) for k, p in enumerate([PAGE, "", None, "\r\n\r\nWARC/1.1\r\n", "é\n\n"])]
    records += [d for r in records for d in warc.derive_one(r)]
    data = b"".join(map(warc.serialise, records))
    assert list(warc.parse(data)) == records
    for bad in (data[:-3], b"x" + data, data.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_spark(spark, tmp_path):
    rows = [(1, "http://a/b", PAGE), (1, "http://a/b", PAGE), (2, None, None), (None, "u", ""), (3, "w", PAGE * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, headers string").repartition(2)
    source = warc.responses(pages)
    got = warc.derive(source)
    want = [(i, *d.values()) for i, u, h in rows for d in warc.derive_one(warc.response_of(h, u, i, warc.DATE))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert warc.derive(got).count() == 0
    every = source.unionByName(got)
    warc.write_archive(every.coalesce(1), str(tmp_path / "a"), "none")
    back = warc.read_archive(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, every.drop("page_id").collect()))
    warc.write_archive(every.repartition(3), str(tmp_path / "b"))
    assert sorted(map(tuple, warc.read_archive(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, back.collect()))
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0

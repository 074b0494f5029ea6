import hashlib
from collections import defaultdict

from lagscope.llm.warc import captures, parse, record_id, report, transaction

LONG = "é" * 600


def plain(rows):
    best = defaultdict(lambda: None)
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None and (best[body] is None or page > best[body]):
            best[body] = page
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        keeper = best[body] if len(body) >= 1000 else None
        again = keeper is not None and keeper != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (9, None, LONG), (3, "x\r\ny", "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (None, "u", LONG), (None, "u", None), (7, "u", "WARC/1.1\r\n\r\n" + "z" * 30000), (8, "u", "a" * 999), (10, "u", "a" * 999),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as archive", "'x' as _keeper", "2 as kind")
    whole = captures(pages, str(tmp_path)).cache()
    assert sorted(map(tuple, report(whole).collect()), key=str) == plain(ROWS)
    for row in whole.collect():
        assert row.request.record_id and row.metadata.record_id
        if row.capture.kind == "response":
            assert hashlib.sha1(bytes(row.capture.payload)).hexdigest() == row.capture.payload_digest


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert report(captures(pages)).collect() == []


def test_records_of_a_transaction():
    own = record_id(5)
    records = list(parse(transaction(own, 5, "http://a", b"\r\n\r\nWARC/1.1", None, False)))
    assert [h["warc-type"] for h, _ in records] == ["response", "request", "metadata"]
    assert {h.get("warc-concurrent-to") for h, _ in records[1:]} == {own}

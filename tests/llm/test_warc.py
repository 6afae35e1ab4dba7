import hashlib
import heapq
import random

import pytest

from keystrata.llm import warc
from keystrata.llm.warc import LoserTree, Run, archive_pages, decode_record, encode_record, url_key, write_run

PAGE = "<p>" + "content " * 40
ROWS = [
    (1, "http://a.example/x?y=1#z", PAGE), (2, "https://www.A.example:8080/x?y=1", PAGE), (3, None, None), (4, "http://b.example", ""), (5, "http://b.example", ""),
    (6, "http://b.example/long", "é" * 300_000), (7, "not a url at all", "short"), (7, "not a url at all", "short"), (8, "http://[bad", PAGE), (None, "http://n.example", PAGE), (9, "http://c.example", "y" * 99), (10, "http://c.example", "y" * 99),
    (11, "http://c.example", "z" * 100), (12, "http://c.example", "z" * 100), (12, "http://c.example", "z" * 100),
]


def brute(rows, least=100):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        owner = first.get(body)
        again = owner is not None and page != owner
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"run_rows": 2, "fan_in": 2, "range_rows": 3}])
def test_edges(spark, make_pages, options):
    got = archive_pages(spark, make_pages(ROWS), **options)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(ROWS)


def test_histories_are_in_global_order(spark, make_pages):
    rng = random.Random(3)
    rows = [(k, f"http://h{rng.randint(0, 9)}.example/p{rng.randint(0, 3)}", f"{PAGE}{rng.randint(0, 50)}") for k in range(3000)]
    got = sorted(archive_pages(spark, make_pages(rows, 5), run_rows=100, fan_in=3, range_rows=500).select("place", "url_key", "captured", "page_id").collect())
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 3000


def test_a_page_that_repeats_spreads_over_ranges(spark, make_pages):
    rows = [(None if k % 2 else 7, "http://hot.example", PAGE) for k in range(9000)] + [(k, "http://a.example", "x") for k in range(100, 200)]
    got = archive_pages(spark, make_pages(rows), range_rows=1000).select("place", "page_id").collect()
    assert sorted(r.page_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    assert len({r.place >> 40 for r in got}) > 3 and len({r.place for r in got}) == len(rows)


@pytest.mark.parametrize("part", [1, 2, 512])
def test_runs_are_read_by_range(tmp_path, monkeypatch, part):
    monkeypatch.setattr(warc, "PART", part)
    monkeypatch.setattr(warc, "BLOCK", 3)
    captures = sorted((f"k{n // 40}", "d", n // 10, 0, n, 1) for n in range(100))
    address = f"file://{tmp_path}/run"
    assert write_run(address, iter(captures)) == 100
    run = Run(address)
    assert list(run.captures()) == captures and len(list(run.firsts(1))) == run.blocks == 34
    cuts = [None, *(c[:5] for c in captures[::7]), ("k9",), None]
    for a, b in zip(cuts, cuts[1:]):
        assert list(run.captures(a, b)) == [c for c in captures if (a is None or c[:5] >= a) and (b is None or c[:5] < b)]


def test_empty_table(spark, make_pages):
    assert archive_pages(spark, make_pages([])).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 40) for _ in range(rng.randint(0, 30))) for _ in range(k)]
    assert list(LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_record_round_trip():
    body = b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    fields, http, got = decode_record(encode_record(5, "http://x/ y", "2024-01-01T00:00:00Z", body, "d", None, False))
    assert got == body and fields["warc-type"] == "response" and http["content-length"] == str(len(body))


def test_url_key():
    assert url_key("https://www.Example.com:80/a/b?c=d#e") == "com,example)/a/b?c=d"

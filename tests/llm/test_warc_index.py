import base64
import hashlib
import random

import pytest

from gaugework.llm.warc_index import capture_history, loser_tree, members, page_of, parse, record, record_id, url_key


def brute(rows, least=0):
    first, out = {}, []
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= least and i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, h in rows:
        body = (h or "").encode()
        to = first.get(body, i)
        name = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), name, *(("response", None) if to == i else ("revisit", to))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    rows = [(i * 37 % 211, f"http://www.h{i % 3}.example.com/p{i % 7}?b=1&a=2#x", f"<p>{rng.randrange(60)}</p>") for i in range(200)]
    return rows + [(1000, None, None), (1001, "", ""), (None, "http://x.org", "<p>1</p>"), (None, "http://x.org", "only here"),
                   (1002, "http://x.org/a\r\nb c", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9), (1003, "x", "é" * 200_000),
                   (1004, "twice", "twice"), (1004, "twice", "twice"), (-5, "http://[bad", "<p>2</p>")]


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 2000, "run_rows": 7}, {"min_payload": 9}])
def test_round_trip(spark, pages, sizes):
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, sha1 string, run int")
    history = capture_history(df.repartition(4), **sizes)
    got = history.collect()
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    answers = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(answers, key=str) == brute(pages, sizes.get("min_payload", 0))


def test_empty(spark):
    assert capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        merged = list(loser_tree([[(x, (x, i)) for x in run] for i, run in enumerate(runs)]))
        assert [x for x, _ in merged] == sorted(x for run in runs for x in run)
        assert merged == sorted(merged)


def test_records():
    import gzip
    import io

    body = b"<p>x</p>"
    sha = hashlib.sha1(body).digest()
    packed = gzip.compress(record(3, "http://a.org", body, sha, None)) + gzip.compress(record(9, "http://a.org", body, sha, 3))
    read = list(members(io.BytesIO(packed)))
    assert sum(n for _, n, _ in read) == len(packed) and [parse(c)[2:] for _, _, c in read] == [
        (3, 8, base64.b32encode(sha).decode(), "response", None), (9, 8, base64.b32encode(sha).decode(), "revisit", 3)]
    with pytest.raises(EOFError):
        list(members(io.BytesIO(packed[:-4])))
    for i in (0, 5, -1, 2**63 - 1, -(2**63)):
        assert page_of(record_id(i)) == i
    assert page_of(record_id(None)) is None
    assert url_key("HTTPS://www.Blog.Example.com:443/A?z=1&b=2#f") == "com,example,blog)/a?b=2&z=1"

"""URL automaton (2), exact search (3) and archives (4)."""

import fnmatch
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from epochal.llm import arc, registry, storage, topk, urlglob


# -- 2 ------------------------------------------------------------------------
def test_automaton_equals_fnmatch():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?/.") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    found = urlglob.Automaton([urlglob.glob_steps(g) for g in globs])
    assert found.words > 4
    names = ["", "é", "a" * 300] + ["".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    want = [[re.fullmatch(fnmatch.translate(g), n, re.S) is not None for g in globs] for n in names]
    assert found.matches(names).tolist() == want
    assert found.matches([]).shape == (0, 60)


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/1", "http://a.example.net/en/1", "http://example.net/fr/", "http://badexample.net/en/", "http://x.org/fr", "http://x.org/fr/1?q=/de/",
    "http://example.com/de/", "http://example.com/des", "http://example.com/x.net/", "http://net", "http://net/", "http://É.net/", "http://a.net?x", "a://b://c/d#e", "http://h/ads/x", "http://ads.h/x", "http://h/f.exe", "http://h/f.exe?x=1", "http://EXAMPLE.com\n/de/",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in urlglob.RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    glob = any(re.fullmatch(fnmatch.translate(g), f".{host}{path}", re.S) for g in urlglob.GLOBS)
    return host, path, best and best[0], best[1] if best else "block" if glob else "allow"


def test_verdicts(spark):
    df = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlglob.judge(df).collect()}
    assert got == {n: judged(u) for n, u in enumerate(URLS)}
    assert urlglob.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urlglob.judge(df, rules=(), globs=()).collect()} == {"allow"}


# -- 3 ------------------------------------------------------------------------
def brute(rows, k):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if q % 50:
            continue
        scores = sorted((-int(sum(a * b for a, b in zip(x.tolist(), y.tolist(), strict=False))), i) for i, y in good if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2) * (rng.random(6) > 0.4)]) for i in rng.permutation(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf"), 1.0]), (None, [1.0]), (550, [1.0, 2.0]), (551, []), (600, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, block string")
    found = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert set(found) == brute(rows, 5) and len(found) == len(set(found))


def test_search_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_repeated_query_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 2.0]), (2, [0.5, 2.0]), (3, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k=3).collect())
    one = 256 * 256
    assert found == [(0, 1, 3, 3 * one), (0, 2, 2, 2 * one), (0, 3, 2, 2 * one)]


def test_sparse_postings():
    rows = np.array([[0, 2, 0], [1, 0, 0], [0, 3, 5]], np.int64)
    lists = topk.postings(rows)
    assert lists[0][0].tolist() == [1] and lists[1][1].tolist() == [2, 3]
    assert topk.accumulate(np.array([[0, 4, 1]], np.int64), lists, 3).tolist() == [[8, 0, 17]]


# -- 4 ------------------------------------------------------------------------
PAGES = [
    (1, "http://a/", "x" * 150), (2, "http://b/ c\n", "x" * 150), (3, None, "short"), (4, "http://d/", "short"), (5, "http://e/", None), (6, "http://f/", "é\r\n\r\nWARC/1.1\r\n" * 30), (7, "http://g/", ""),
    (8, "http://h/", "filedesc://x 0 0 0 3\nabc\n" * 9), (9, "http://i/", "x" * 150), (10, "http://j/", "y" * 99), (11, "http://k/", "y" * 99), (None, "http://l/", "x" * 150), (12, "http://m/", "é" * 50), (13, "http://n/", "é" * 50),
]


def want(pages):
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        refers = first.get(body) if first.get(body) != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def archived(spark, pages, version=None):
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, path string").repartition(3)
    old, new = storage.new_path(spark, "arc"), storage.new_path(spark, "warc")
    arc.write_arc(df, old, version=version)
    arcs = arc.archives(spark, old)
    arc.to_warc(arcs, arc.revisits(arc.arc_payloads(arcs)), new)
    return arc.warc_records(arc.archives(spark, new))


def test_archives_both_versions(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 700)
    for version in (None, 1, 2):
        got = archived(spark, PAGES, version).select("source", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == want(PAGES)


def test_record_ids_are_unique_and_named_by_revisits(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 900)
    body, other = "x" * 150, "z" * 300
    pages = [(n % 4 or None, f"http://a/{n}", body) for n in range(12)] + [(n, "http://b/", other) for n in (9, 8, 8, 9)] + [(None, "u", "n" * 200)] * 2 + [(5, "v", "short"), (5, "v", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    old, new = storage.new_path(spark, "arc"), storage.new_path(spark, "warc")
    arc.write_arc(df, old)
    arcs = arc.archives(spark, old)
    arc.to_warc(arcs, arc.revisits(arc.arc_payloads(arcs)), new)
    ids, named, kinds = [], [], []
    for row in arc.archives(spark, new).collect():
        raw = arc.unpacked(row.content)
        for headers, _ in arc.read_warc(raw):
            ids.append(headers["WARC-Record-ID"])
            kinds.append(headers["WARC-Type"])
            if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"].endswith(hashlib.sha256(other.encode()).hexdigest()):
                assert f"{arc.ID_HEADER.decode()}: 8" in raw.decode()
            if "WARC-Refers-To" in headers:
                named.append(headers["WARC-Refers-To"])
        # every record is a member of its own
        assert row.content.count(b"\x1f\x8b\x08") >= raw.count(b"WARC/1.1\r\n")
    assert len(ids) == len(set(ids)) and set(named) <= set(ids) and len(set(named)) == 2
    assert kinds.count("revisit") == 9 + 2 and kinds.count("response") == 3 + 2 + 2 + 2


def test_an_archive_that_ends_with_a_huge_record(spark):
    page = (1, "http://a/", "é" * (9 << 20))
    got = archived(spark, [page]).select("payload_bytes", "record_type").collect()
    assert [tuple(r) for r in got] == [(18 << 20, "response")]


def test_no_pages(spark):
    assert archived(spark, []).count() == 0


def test_arc_headers():
    one = b"filedesc://x 0.0.0.0 19970101 text/plain 70\n1 0 Origin\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = one.split(b"\n", 1)[1][:-1]
    raw = b"filedesc://x 0.0.0.0 19970101 text/plain %d\n%s\nhttp://a b/ 1.2.3.4 19970203040506 text/html 4\nab\ncde" % (len(body), body)
    got = list(arc.read_arc(raw.replace(b"ab\ncde", b"ab\nc\n")))
    assert [r.version for r in got] == [1, 1] and got[1].fields["url"] == "http://a b/" and got[1].content == b"ab\nc"
    assert arc.iso_date("19970203040506") == "1997-02-03T04:05:06Z" and arc.iso_date("1997") == "1997-01-01T00:00:00Z" and arc.iso_date("") == "1970-01-01T00:00:00Z"
    warc = arc.convert(got[1])
    headers, block = next(arc.read_warc(warc + b"\r\n\r\n"))
    assert headers["WARC-Type"] == "resource" and block == b"ab\nc" and headers["WARC-Target-URI"] == "http://a b/"
    for bad in (b"http://a 1 2 3 4\n", b"filedesc://x 0.0.0.0 1 text/plain 3\n9 0\n", raw[:-5] + b"x"):
        try:
            list(arc.read_arc(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())

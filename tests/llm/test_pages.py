import fnmatch
import glob
import gzip
import hashlib
import io
import random
import re

import pytest

from codeloom.llm import queries as Q
from codeloom.llm.url_filter import Rule, ShiftAnd, filter_urls
from codeloom.llm import warc as W
from codeloom.llm.warc import read_archives, write_archives
from tests.oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    same_rows(Q.queries()[name](spark, SF), connect(SF), Q.oracle_sql()[name])


def judged(url, rules, default="allow"):
    """The rules one by one."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for r in rules:
        fits = host == r.host or host.endswith("." + r.host)
        if fits and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best.name if best else None, best.verdict if best else default


def test_op6_odd_urls(spark):
    rng = random.Random(3)
    parts = ["http://", "https://", "", "com", "example.com", "EXAMPLE.net", "a.org", ".", "/en/", "/de/8", "/es/", "/en/7", "?q=/en/", "#x", "://", "org.com/en/", ":80", "é", "\n"]
    urls = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for i in range(3000)] + [(-1, None), (-2, ""), (-3, "http://x.com/en/" + "y" * 20000), (-3, "http://x.com/en/")]
    rows = filter_urls(spark.createDataFrame([(*u, "x") for u in urls], "page_id bigint, url string, host string"), Q.URL_RULES).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows))) == sorted(map(str, ((i, *judged(u, Q.URL_RULES)) for i, u in urls)))
    assert filter_urls(spark.createDataFrame([], "page_id bigint, url string"), Q.URL_RULES).count() == 0


def test_op6_rules_are_those_of_its_contract(spark):
    contract = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert sorted((r.name, r.verdict) for r in Q.URL_RULES) == sorted(contract)
    urls = [(k, f"http://a.{name}x") for k, (name, _) in enumerate(contract)] + [(9, "http://a.org/en/")]
    found = {r.page_id: (r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(urls, "page_id bigint, url string"), Q.URL_RULES, default="other").collect()}
    assert found == {**dict(enumerate(contract)), 9: (None, "other")}


def test_globs_and_many_words():
    rules = [Rule(f"h{i}.x", f"/p{i}", "block") for i in range(80)] + [Rule("a*z.x", "/q?/*end", "allow")]
    auto = ShiftAnd(rules)
    assert auto.words > 10
    urls = [b".h7.x/p7", b".h7.x/p8", b".s.h79.x/p79/more", b".abcz.x/q1/some/end", b".a/z.x/q1/end", b".abcz.x/q/end"]
    names = [auto.rules[k].name if k >= 0 else None for k in auto.first_fit(urls)]
    assert names == ["h7.x/p7", None, "h79.x/p79", "a*z.x/q?/*end", None, None]
    assert fnmatch.fnmatchcase("abcz.x", "a*z.x")


def test_warc_round_trip(spark, tmp_path):
    long, other = "é" * 600, "WARC/1.1\r\n\r\nx" * 100
    rows = [(1, "http://a", long), (2, None, long), (3, "u v\r\n", long), (4, "b", "short"), (5, "c", "short"), (6, "d", None), (7, "e", ""), (8, "f", other), (9, "g", "x" * 1000), (10, "h", "x" * 1000), (11, "i", "x" * 999), (12, "j", "x" * 999)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "page_id bigint, url string, html string, payload string")
    write_archives(df, f"file://{tmp_path}/w")
    found = {int(r.page): r for r in read_archives(spark, f"file://{tmp_path}/w", payloads=True).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        original = {1: 3, 2: 3, 9: 10}.get(i)
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if original else "response", str(original) if original else None)
        assert bytes(r.payload) == (b"" if original else raw)
    # Any reader of gzip files finds the records one after another, and one by itself at the place where it begins.
    files = [open(f, "rb").read() for f in glob.glob(f"{tmp_path}/w/part-*")]
    whole = [h for f in files for h, _ in W.parse(gzip.GzipFile(fileobj=io.BytesIO(f)))]
    assert sorted(h["warc-record-id"] for h in whole) == sorted(f"<urn:page:{i}>" for i, _, _ in rows)
    by = {h["warc-record-id"]: h for h in whole}
    assert by["<urn:page:1>"]["warc-refers-to-target-uri"] == "u%20v%20%20" and by["<urn:page:9>"]["warc-refers-to-target-uri"] == "h"
    assert len({h["warc-date"] for h in whole}) == 1 and all(re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) for h in whole)
    assert by["<urn:page:1>"]["warc-refers-to-date"] == by["<urn:page:3>"]["warc-date"]
    members = [m for f in files for m in f.split(W.EMPTY) if m]
    assert len(members) == len(rows) and all(len(list(W.parse(io.BytesIO(gzip.decompress(m))))) == 1 for m in members)
    write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert read_archives(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("hot", [10_000, 2])
def test_warc_copies_and_long_payloads(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(W, "HOT_COPIES", hot)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))
    rows = [(9, "a", "z" * 2000), (9, "b", "z" * 2000), (1, "c", "z" * 2000), (None, "d", "z" * 2000), (None, "e", "y" * 1500), (None, "f", "y" * 1500), (20, "g", long), (21, "h", long), (22, "i", long[:-1] + "x"), (30, None, "q" * 1200), (31, None, "q" * 1200)]
    rows += [(100 + i, f"u{i}", W.EMPTY.decode("latin-1") * 60) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        write_archives(df.coalesce(1), f"file://{tmp_path}/w", date="2001-02-03T04:05:06Z")
        found = read_archives(spark, f"file://{tmp_path}/w", payloads=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for i, _, html in rows:
        raw = html.encode()
        last = max((j for j, _, other in rows if other == html and j is not None), default=None)
        refers = last if len(raw) >= 1000 and last is not None and last != i else None
        want.append((None if i is None else str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", None if refers is None else str(refers), b"" if refers else raw))
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str) and {r.date for r in found} == {"2001-02-03T04:05:06Z"}


def test_a_member_never_holds_what_stands_between():
    data = b"a" + W.EMPTY * 3 + b"b"
    assert W.EMPTY not in W.member(data, 0) and gzip.decompress(W.member(data, 0)) == data

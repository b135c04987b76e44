import hashlib
import io
import os
import re

import pytest

from dugout.llm import warc
from dugout.llm.queries import URL_RULES
from dugout.llm.url_filters import aliases, judged

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def by_rule(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_alone(spark):
    urls = ["http://a.net/x", "http://A.EXAMPLE.net/en/1", "https://example.com/de/2?x", "http://examplexcom/de/", "http://x.org/fr/#f", "http://net", None, "", "nothing", "http://b.net?x/", "a://b://c.net/", "http://x.example.com/de", "HTTP://Ünet/ä"]
    rows = judged(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string"), URL_RULES).collect()
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = by_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert len(rows) == len(urls)


def test_blocks_spread_over_aliases(spark):
    link = '<html><LINK href="{}" rel=canonical>'
    pages = [
        (1, "http://a.org/1", link.format("http://bad.net/x")),  # blocked by its canonical
        (2, "http://b.org/2", '<meta http-equiv="Refresh" content="0; url=http://a.org/1#part">'),  # through page 1
        (3, "http://c.org/fr/3", link.format("http://a.org/1")),  # explicitly allowed
        (4, "http://d.org/4", link.format("/5")),
        (5, "http://d.org/5", None),
        (6, "http://D.org/dir/6", "<link rel='canonical' href='../x&amp;y'>"),
        (7, "http://e.org/7", '<a href="http://bad.net/x">'),  # a plain link is no alias
        (8, "http://a.org/1", None),
        (8, "http://a.org/1", None),
        (None, None, link.format("http://bad.net/x")),
    ]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, verdict string")
    rows = sorted(((r.page_id, r.verdict) for r in judged(frame, URL_RULES).collect()), key=str)
    assert rows == sorted([(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (None, "allow")], key=str)
    more = spark.createDataFrame([("http://d.org/4", "http://q.net/"), ("http://zz.org/", "http://zz.org/")], "u string, v string")
    assert {r.page_id for r in judged(frame, URL_RULES, more).collect() if r.verdict == "block"} == {1, 2, 4, 5, 8}
    assert judged(frame.limit(0), URL_RULES).count() == 0
    assert aliases(frame).filter("u = 'http://d.org/4'").first().v == "http://d.org/5"


def test_long_chains_and_hubs(spark):
    chain = [(i, f"http://x.org/{i}", f'<link rel="canonical" href="http://x.org/{i + 1}">') for i in range(40)]
    hub = [(100 + i, f"http://y.org/{i}", '<link rel="canonical" href="http://hub.net/">') for i in range(300)]
    frame = spark.createDataFrame([*chain, (40, "http://x.org/40", '<meta http-equiv=refresh content="1;URL=http://far.net/">'), *hub], "page_id long, url string, html string")
    assert {r.verdict for r in judged(frame, URL_RULES).collect()} == {"block"}


@pytest.fixture
def pages(spark):
    long = "<p>" + "x" * 200
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (3, "http://a/3", long), (1, "http://a b\r\nc/é", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "n", "y" * 150), (None, "n", "y" * 150)]
    rows += [(100 + i, f"http://p/{i}", f"<html><body>page {i} " + "common words of every page " * 30) for i in range(60)]
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        if len((html or "").encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        target = first.get(html)
        again = len(raw) >= 100 and target is not None and page != target
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(pages.repartition(3), folder)
    back = warc.read_archives(spark, folder, archives)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(rows, key=str) == expected([tuple(r) for r in pages.collect()])
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back.collect() if r.record_type == "response")
    heads = [open(f"{tmp_path}/warc/{a.name}", "rb").read(4) for a in archives.collect()]
    assert heads and all(h == bytes.fromhex("5d2a4d18") for h in heads)
    assert sum(a.records for a in archives.collect()) == pages.count()
    assert not [f for f in os.listdir(f"{tmp_path}/warc") if f.startswith("_")]


def test_records_stand_alone(spark, pages, tmp_path):
    """Any frame can be decompressed by itself with the archive's dictionary, and damage is noticed."""
    archives = warc.write_archives(pages.coalesce(1), str(tmp_path))
    raw = open(f"{tmp_path}/{archives.first().name}", "rb").read()
    assert len(list(warc.frames(io.BytesIO(raw), limit=7))) == pages.count()
    with pytest.raises(Exception):
        list(warc.frames(io.BytesIO(raw[:-5])))


def test_few_and_no_pages(spark, pages, tmp_path):
    few = warc.write_archives(pages.limit(3), f"{tmp_path}/few")
    assert warc.read_archives(spark, f"{tmp_path}/few", few).count() == 3
    none = warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert none.count() == 0 and warc.read_archives(spark, f"{tmp_path}/none", none).count() == 0

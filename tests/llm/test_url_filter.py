import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import registry, url_filter

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("Example.ORG", "", "block"), ("example.org", "", "allow"), (None, "/x", "block"),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain(url):
    host, path = split(url)
    return re.sub("/$", "", re.sub(r"^www\.", "", host) + path) if host else ""


def expected(rows, rules, listed):
    names = {plain(u) for u in listed} - {""}
    out = []
    for i, url in rows:
        host, path = split(url)
        fits = [
            (len(h) + len(p), h.lower() + p, v)
            for h, p, v in rules
            if h is not None and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
        ]
        if fits:
            _, rule, verdict = max(fits)
        else:
            rule, verdict = None, "block" if host and plain(url) in names else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=repr)


def urls(n=1500):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "a.WWW.Example.com", "example.net", "x.example.net", "example.org", "b.c.example.org", "other.info", "www.other.info", "com", "", "notexample.dev"]
    paths = ["", "/", "/en/", "/en/1", "/en", "/es/2", "/fr/", "/a/b/", "/a/b", "?q=/en/", "#/en/", "/a//b?x=1"]
    rows = [(k, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}") for k in range(n)]
    rows += [(1, "http://other.info/a/b"), (1, "http://other.info/a/b"), (None, "http://other.info/z"), (2, None), (3, "no scheme"), (4, ""), (5, "a://b://c/d"), (6, "http://" + "s." * 300 + "example.net/es/"), (7, "http://e.dev/" + "p/" * 20_000)]
    return rows


LISTED = ["http://www.other.info/a/b/", "https://other.info/a/b?again", "ftp://example.net/en/1#x", "", None, "http://e.dev/" + "p/" * 20_000]


@pytest.mark.parametrize(("bits", "broadcast", "absent"), [(12, 200_000, 0), (12, 0, 3000), (0.02, 200_000, 3000)])
def test_against_brute_force(spark, monkeypatch, bits, broadcast, absent):
    """With a roomy filter, with joins by shuffle, and with a filter so full that nearly all it passes is false."""
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", bits)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    rows, listed = urls(), LISTED + [f"http://gone.example.net/{k}" for k in range(absent)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, verdict string, rule int").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.url_filter(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, RULES, listed)


def test_the_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("key"))
    bloom = url_filter.BlockedBloom(keys)
    assert bloom.blocks > 100
    asked = spark.range(40_000).select("id", F.size(bloom.passing(F.array(F.concat(F.lit("key "), "id")))).alias("n"))
    assert asked.where("id < 20000 AND n = 0").count() == 0
    assert asked.where("id >= 20000 AND n = 1").count() < 600


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(urls(40), "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    assert url_filter.url_filter(pages.limit(0), rules, listed).count() == 0
    got = url_filter.url_filter(pages, rules.limit(0), listed).collect()
    assert len(got) == pages.count() and {r.verdict for r in got} == {"allow"}
    assert url_filter.url_filter(pages, rules).count() == pages.count()


def test_query_blocks_listed_pages(spark):
    path = "/root/testdata/sf0.01"
    got = registry.op2_url_filter(spark, path)
    assert got.where("rule IS NULL AND verdict = 'block'").count() > 0
    pages = [tuple(r) for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url").collect()]
    listed = [r.url for r in registry.listed_urls(spark.read.parquet(f"{path}/pages.parquet")).collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(pages, registry.URL_RULES, listed)

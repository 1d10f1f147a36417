"""Url rules against a plain loop, and the digest list with colliding digests."""

import random

import numpy as np

from meterline.llm import url_filter

SCHEMA = "page_id long, url string"


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    h, p, v = max(fits, key=lambda r: len(r[0] + r[1]))
    return host, path, h + p, v


def test_same_as_plain(spark):
    rnd = random.Random(11)
    hosts = ["example.com", "WWW.Example.com", "m.www.example.com", "a.net", "net", "xnet", "example.com.", "com", "é.com", "", "b.org:80", ".net"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/x", "/fr/", "/EN/", "//en/", "/en/é"]
    tails = ["", "?q=/en/", "#x", "?a#b", "://x"]
    urls = [rnd.choice(["http://", "://", "x", "ftp://"]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(tails) for _ in range(600)]
    urls += [None, "", "://", "http://net/fr/" + "x" * 100_000, urls[0], urls[0]]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], SCHEMA + ", verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(spark, df).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(spark, df.filter("false")).collect() == []


def test_listed_addresses(spark):
    df = spark.createDataFrame([(1, "http://A.org/x?y"), (2, "http://a.org/"), (3, None), (None, "http://a.com/z")], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark, df, listed=["a.org/x", "a.com/z"]).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), None: ("com/", "allow")}
    assert {r.verdict for r in url_filter.judge(spark, df, rules=[], default="block").collect()} == {"block"}


def test_collisions_are_told_apart(tmp_path):
    digest = lambda s: len(s) % 3
    entries = {f"{i:x}" * (1 + i % 5): i for i in range(40)}
    paths = {}
    for name, content in url_filter.DigestList.files(entries, digest).items():
        (tmp_path / name).write_bytes(content)
        paths[name] = str(tmp_path / name)
    found = url_filter.DigestList.opened(paths)
    assert isinstance(found.keys, np.memmap)
    asked = [*entries, "no", "such", ""]
    assert found.probe([s.encode() for s in asked], digest).tolist() == [entries.get(s, -1) for s in asked]

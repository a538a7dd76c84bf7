from __future__ import annotations

import re

from sluice.llm import urlfilter as UF

URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1", "http://a.example.org/es/", "http://example.org/ES/1", "http://example.org/en/12",
    "http://example.org/en/2", "http://notexample.org/es/1", "http://org/x", "http://x.org", "http://x.org?u=a.com/de/", "http://a.com/fr/1", "http://a.com/de/",
    "http://a.com/de", "ftp://b.c.com/de/x#y", "http://net/?page=2&ref=x", "http://n.net/a?utm_source=f", "http://ads1.net/a", "http://n.net/casino/", "http://n.net/x.zip",
    "http://n.net/login", "http://example.com:80/de/1", "http://user@a.com/de/1", "x://y://z.org/q", "http://é.org/\u212a", "http://a.net/\n/casino/x",
]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    after = rest[len(raw) :]
    path = re.match(r"[^?#]*", after)[0]
    fits = []
    for r in UF.SITE_RULES:
        rhost, rpath = r.rule.split("/", 1)
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath):
            fits.append(r)
    if fits:
        best = max(fits, key=lambda r: len(r.rule))
        return host, path, best.rule, "allow" if best.allow else "block"
    return host, path, None, "block" if any(re.search(r.regex, host + after) for r in UF.PATTERNS) else "allow"


def test_against_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[4], "again"), (None, URLS[5], None)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in UF.judge(d).collect()), key=str)
    assert out == sorted(((str(i), *brute(u)) for i, u, _ in rows), key=str)


def test_empty_table(spark):
    assert UF.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0

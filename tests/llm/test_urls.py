from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import op6_urls as op6
from lodestream.llm.op6_urls import op6_urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fit = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


def check(rows, got):
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    urls = {}
    for page_id, url, *_ in rows:
        urls.setdefault(page_id, set()).add(url)
    for r in got:
        assert (r.host, r.path, r.rule) in {brute(u) for u in urls[r.page_id]}
        assert r.verdict == RULES.get(r.rule, r.verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (r.rule is not None)


AWKWARD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/ES/x", "http://Ünï.ORG/", "http://example.org", "http://example.org/en/1?x", "http://notexample.org/en/1", "x://a.com/de/://b.org/", "http://u:p@a.com:80/fr/#", "http://com/fr/", "http://org?/", "http://a.b/" + "z" * 100_000, "ftp://a.com/fr", "http://net/a\nb"]


def test_rules_on_awkward_urls(spark, write):
    rows = [(i, u, None) for i, u in enumerate(AWKWARD)] + [(None, "http://a.net/", "x"), (3, "http://", None), (3, "http://", None)]
    schema = "page_id long, url string, html string"
    check(rows, op6_urls(spark, write(rows, schema, "pages")).collect())
    assert op6_urls(spark, write([], schema, "pages")).count() == 0


def test_query(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check(rows, op6_urls(spark, sf).collect())


def test_model_learns_what_rules_show(spark, write):
    """Words of blocked and allowed paths decide urls on hosts without a rule, whatever stands beside them."""
    rows = [(i, f"http://h{i % 7}.com/de/casino-bets-{i}", None) for i in range(300)] + [(1000 + i, f"http://h{i % 7}.com/fr/garden-books-{i}", None) for i in range(300)]
    new = [(5000 + i, f"http://x{i}.net/casino-bets-{i}", None) for i in range(50)] + [(6000 + i, f"http://x{i}.net/garden-books-{i}", None) for i in range(50)]
    schema = "page_id long, url string, html string"
    verdicts = {r.page_id: (r.verdict, r.score) for r in op6_urls(spark, write(rows + new, schema, "pages")).collect()}
    right = sum(verdicts[p][0] == ("block" if p < 6000 else "allow") for p, *_ in new)
    assert right >= 95
    again = {r.page_id: (r.verdict, r.score) for r in op6_urls(spark, write((rows + new)[::-1], schema, "pages")).collect()}
    assert verdicts == again


def expected(labelled, url):
    """The score from counts of the n-grams themselves; labelled: (url, blocked). A context counts at a url's end too."""
    counts = Counter(), Counter()
    each = lambda u: ((tuple(([None] * 4 + list(u))[i + 4 - o : i + 5])) for i in range(len(u)) for o in range(5))
    for u, blocked in labelled:
        counts[blocked].update(each(u.encode()))
        counts[blocked][()] += len(u.encode())
        counts[blocked].update((None,) * o for o in range(1, 5))
    total, data = 0.0, url.encode()
    for i in range(len(data)):
        for kind, sign in ((0, 1), (1, -1)):
            p = 1 / 256
            for o in range(5):
                g = tuple(([None] * 4 + list(data))[i + 4 - o : i + 5])
                p = (counts[kind][g] + op6.PRIOR * p) / (counts[kind][g[:-1]] + op6.PRIOR)
            total += sign * math.log(p)
    return total / len(data)


def test_scores_are_of_exact_counts_of_all_labelled_urls(spark, write):
    """More n-grams than 2**17, each counted for itself, those of held out urls too."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in row) for row in rng.integers(0, 26, (12000, 14))]
    labelled = [(f"http://a.com/{'de' if i % 2 else 'fr'}/{w}", i % 2) for i, w in enumerate(words)]
    open_ = [f"http://x.net/{w}" for w in words[:60]] + [f"http://y.net/{w[::-1]}" for w in words[:20]]
    assert len(np.unique(op6.grams(pa.array([u for u, _ in labelled]))[0][4])) > 1 << 17
    rows = [(i, u, None) for i, u in enumerate([*(u for u, _ in labelled), *open_])]
    got = {r.page_id: r for r in op6_urls(spark, write(rows, "page_id long, url string, html string", "pages")).collect()}
    assert len(got) == len(rows)
    counted = [(u, b) for u, b in labelled]
    for i, u in list(enumerate(open_))[::8]:
        assert got[len(labelled) + i].score == pytest.approx(expected(counted, u), abs=1e-9)

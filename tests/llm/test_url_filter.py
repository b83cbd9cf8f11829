"""URL filters against trying every rule on every page."""

import random

import pytest

from lexiloom.llm import queries
from lexiloom.llm.url_filter import RULES, Sweep, rule_ranges, url_rules, url_verdicts


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    stop = min([rest.index(c, end) for c in "?#" if c in rest[end:]], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, default))
    return host, path, rule, verdict


def random_case(seed):
    rng = random.Random(seed)
    names = ["a", "b", "a-", "-b", "xn--é", "com", "net", "", "a:80"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "/xy", "y", "/é", "/-", "/."]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), "/" + path() if rng.random() < 0.8 else path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("a", "/x", "allow"), ("a", "/x", "block"), (None, "/", "block"), ("a", None, "block"), ("b", "/", None)]
    hosts = [host() for _ in range(20)]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}{path()}{rng.choice(['', '?q=/x', '#f', '?#'])}" for _ in range(400)]
    # a third of all rows is one URL of one id
    pages = [(k if k % 5 else None, u) for k, u in enumerate(urls)] + [(None, "http://a.com/x")] * 250 + [(7, None), (8, ""), (9, "a.com/x"), (10, "http://"), (11, "http:///x"), (12, "x://a\n.net/x\ny?z"), (13, "a://b://c/d"), (14, "http://a.com/" + "x" * 100_000)]
    return rules, pages


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 7), (3, 40)])
def test_against_every_rule(spark, seed, ranges):
    rules, pages = random_case(seed)
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in pages], "page_id long, url string, rule string, key string")
    got = url_verdicts(df, spark.createDataFrame(rules, RULES), ranges=ranges)
    want = []
    for i, u in pages:
        ties = {}
        for h, p, v in rules:
            if None not in (h, p, v):
                ties[h, p] = max(v, ties.get((h, p), v))
        want.append((i, *brute(u, [(h, p, v) for (h, p), v in ties.items()])))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_frequent_key_is_dealt_over_its_ranges(spark):
    """Borders that are equal share the pages of their key among the ranges between them."""
    pages = spark.range(900).selectExpr("id AS page_id", "IF(id < 600, 'http://hot.net/x', concat('http://', id, '.org/')) AS url")
    got = url_verdicts(pages, url_rules(spark, ["block net/"]), ranges=30)
    assert got.where("verdict = 'block'").count() == 600 and got.count() == 900
    assert rule_ranges(["b.", "b.", "b.", "d."], "b.", "/") == {0, 1, 2, 3}
    assert rule_ranges(["b./a", "b./m", "b./z", "b.c./x"], "b.", "/n") == {0, 2, 3, 4}  # 0: hosts such as -.b


def test_sweep_keeps_open_rules_only():
    sweep = Sweep()
    sweep.rule("ten.", "net", "/", "block")
    sweep.rule("ten.a.", "a.net", "/x", "allow")
    assert sweep.page("ten.a./x1", "/x1") == ("a.net/x", "allow") and len(sweep.stack) == 2
    assert sweep.page("ten.b./x1", "/x1") == ("net/", "block") and len(sweep.stack) == 1
    assert sweep.page("gro.b./x1", "/x1") is None and not sweep.stack


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id int, url string")
    rules = url_rules(spark, ["block net/"])
    assert url_verdicts(pages.where("false"), rules).collect() == []
    got = url_verdicts(pages, rules.where("false"), default="block")
    assert sorted(map(tuple, got.collect())) == [(1, "a.net", "/", None, "block"), (2, "", "", None, "block")]
    assert got.schema["page_id"].dataType.simpleString() == "int"


def test_rules_from_lines(spark):
    got = url_rules(spark, ["block NET/", "allow example.net/en/", " block a.b "])
    assert [tuple(r) for r in got.collect()] == [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "", "block")]


def test_query_against_every_rule(spark, sf_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls = dict(map(tuple, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op13_url_filter(spark, sf_dir).collect()}
    assert got == {k: brute(u, rules) for k, u in urls.items()}

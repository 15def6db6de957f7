"""The url model on sites it has not seen, its table against the judged pages, and ties of rules."""

import re

import numpy as np

from floodspark.llm import url_filter

PAGES = "/root/testdata/sf0.01/pages.parquet"


def stems(host: str, path: str) -> set[str]:
    return set(re.findall("[a-z]{3,}", f"{host.rpartition('.')[0]} {path}"))


def test_held_out_words():
    """Sites with a word that no learnt url has: their own urls, and their hosts at paths that tell nothing."""
    sites, whole, plain, precision = url_filter.site_urls(), [], [], []
    words = sorted(set().union(*(stems(h, p) for h, p, _ in sites)))
    for seed in range(8):
        rng = np.random.default_rng(seed)
        held = {w for w in words if rng.random() < 0.08}
        learnt = [s for s in sites if not stems(*s[:2]) & held]
        base = [s for s in sites if stems(*s[:2]) & held]
        tested = url_filter.with_plain_forms(base)
        model = url_filter.fit(url_filter.with_plain_forms(learnt) + url_filter.plain_urls())
        blocked = np.array(url_filter.block_scores(model, [t[:2] for t in tested])) >= 0.5
        label = np.array([t[2] for t in tested]) == 1
        n = len(base)
        whole.append((blocked & label)[:n].sum() / label[:n].sum())
        plain.append((blocked & label)[n:].sum() / label[n:].sum())
        precision.append((blocked & label).sum() / blocked.sum())
    assert np.mean(whole) >= 0.85 and np.mean(precision) >= 0.95 and np.mean(plain) >= 0.5


def test_words_of_the_table_are_found_in_other_names():
    hosts = ("m.bets-win.example.com", "casinonight.example.org", "pills.example.net")
    assert min(url_filter.block_scores(url_filter.fit(), [(h, "/en/27") for h in hosts])) >= 0.5


def test_names_without_meaning_are_allowed():
    rng = np.random.default_rng(77)
    names = ["".join("aeioubcdfghklmnprst"[i] for i in rng.integers(19, size=8)) for _ in range(400)]
    scores = np.array(url_filter.block_scores(url_filter.fit(), [(f"{n}.net", f"/{n}/3") for n in names]))
    assert (scores < 0.5).mean() >= 0.95


def test_no_site_of_the_table_is_judged(spark):
    judged = {r["host"] for r in url_filter.judge(spark.read.parquet(PAGES)).select("host").distinct().collect()}
    assert not judged & {host for host, _, _ in url_filter.labelled_urls()}


def test_of_equal_rules_the_first_counts(spark):
    rules = (("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("b.a.org", "/", "block"), ("a.org", "/yz", "allow"))
    pages = spark.createDataFrame([(1, "http://a.org/x1"), (2, "http://b.a.org/yz")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("a.org/x", "allow"), 2: ("b.a.org/", "block")}

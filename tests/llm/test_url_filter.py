"""Host reputation against plain sums in Python, and what one bad page may decide."""

import math
import random

import pytest

from arborlake.llm.url_filter import filter_urls, host_reputation

HOST = "host string, x int"


def plain(pages, outcomes, weakest=1.0, strongest=200.0):
    """Mean and variance of each host's rate, level by level."""

    def cut(host):
        labels = host.split(".")
        two = len(labels) > 1 and labels[-2] in ("ac", "co", "com", "edu", "gov", "net", "org") and len(labels[-1]) == 2
        return ".".join(labels[-3 if two else -2 :]), ".".join(labels[-2 if two else -1 :])

    of = {h: (h, *cut(h)) for h in [*pages, *(h for h, _ in outcomes)]}
    count = [{}, {}, {}]
    for h in of:
        for level, name in zip(count, of[h], strict=True):
            level.setdefault(name, [0, 0])
    for h, bad in outcomes:
        for level, name in zip(count, of[h], strict=True):
            level[name][0] += 1
            level[name][1] += bad

    def strength(level):
        groups = [(n, b) for n, b in level.values() if n]
        total, k = sum(n for n, _ in groups), len(groups)
        if not total:
            return weakest
        p = sum(b for _, b in groups) / total
        within = total - sum(n * n for n, _ in groups) / total - (k - 1)
        if p * (1 - p) * within == 0:
            return weakest
        between = sum(n * (b / n - p) ** 2 for n, b in groups)
        rho = (between - p * (1 - p) * (k - 1)) / (p * (1 - p) * within)
        return max(weakest, min(1 / max(rho, 1e-9) - 1, k - 1, strongest))

    ks, raw = [strength(level) for level in count], count[0]
    parent = lambda level, name: None if level == 2 else next(v[level + 1] for v in of.values() if v[level] == name)
    told = [raw, {}, {}, {}]
    for level in (0, 1, 2):
        for name, (n, b) in told[level].items():
            up = told[level + 1].setdefault(parent(level, name), [0, 0])
            share = (ks[level] + 1) / (n + ks[level])
            up[0] += n * share
            up[1] += b * share
    n, bad = told[3][None]
    mean = (bad + 1) / (n + 2)
    above = {None: (mean, mean * (1 - mean) / (n + 3))}
    for level in (2, 1, 0):
        k, here = ks[level], {}
        for name, (n, b) in told[level].items():
            m, v = above[parent(level, name)]
            r = (b + k * m) / (n + k)
            here[name] = (r, r * (1 - r) / (n + k + 1) + (k / (n + k)) ** 2 * v)
        above = here
    return above


def reputation(spark, pages, outcomes):
    df = host_reputation(spark.createDataFrame([(h, 1) for h in pages], HOST), spark.createDataFrame(outcomes, "host string, bad int"))
    return {r.host: r for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_sums(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.d{i % 9}.{['com', 'net', 'co.uk', 'org', 'de'][i % 5]}" for i in range(40)] + ["", "localhost", "d1.net"]
    rate = {h: rng.random() for h in hosts}
    seen = [h for h in hosts if not h.endswith("org")][:: seed + 1]
    outcomes = [(h, int(rng.random() < rate[h])) for h in rng.choices(seen, k=300 if seed else 12)]
    found, want = reputation(spark, hosts, outcomes), plain(hosts, outcomes)
    assert set(found) == set(want)
    for h, (m, v) in want.items():
        assert math.isclose(found[h].rate, m, rel_tol=1e-9)
        assert math.isclose(found[h].low, max(0, m - 1.64 * v**0.5), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(found[h].high, min(1, m + 1.64 * v**0.5), rel_tol=1e-9)


def test_one_bad_page_blocks_its_own_host_only(spark):
    hosts = ["bad.a.com", "next.a.com", "b.com", "c.net", "d.org", "x.co.uk", "y.co.uk"]
    found = reputation(spark, hosts, [("bad.a.com", 1)])
    assert {h for h, r in found.items() if r.low > 0.5} == {"bad.a.com"}
    lows = [found[h].low for h in ("bad.a.com", "next.a.com", "b.com", "c.net")]
    assert lows == sorted(lows, reverse=True)


def test_a_suffix_without_outcomes_is_allowed(spark):
    """However many bad pages others have; and with enough of its own a host is blocked."""
    outcomes = [(f"h{i % 50}.d{i % 7}.com", 1) for i in range(900)] + [(f"h{i % 50}.e{i % 7}.net", i % 3 == 0) for i in range(900)]
    found = reputation(spark, ["a.org", "new.e1.net", "h1.d1.com"], [(h, int(b)) for h, b in outcomes])
    assert found["a.org"].low < 0.5 and found["new.e1.net"].low < 0.5 and found["h1.d1.com"].low > 0.5


def test_names_under_two_labels_are_domains_of_their_own(spark):
    found = reputation(spark, ["a.x.co.uk", "y.co.uk"], [("b.x.co.uk", 1)] * 8 + [("z.co.uk", 0)] * 8)
    assert found["a.x.co.uk"].rate > 0.6 > found["y.co.uk"].rate


def test_labelled_outcomes_and_long_urls(spark):
    """Given outcomes decide where no rule fits; a url of megabytes and a host that holds most pages."""
    rows = [(i, f"http://hot.net/{i}") for i in range(3000)] + [(9001, "http://bad.org/x"), (9002, "http://" + "a." * 500_000 + "org/" + "p" * 1_000_000), (9003, None)]
    pages = spark.createDataFrame([(*r, "clash", 1, 1.0) for r in rows], "page_id long, url string, host string, pages int, low double")
    outcomes = spark.createDataFrame([("bad.org", 1)] * 9 + [("hot.net", 0)] * 9, "host string, bad int")
    found = {r.page_id: r for r in filter_urls(pages, outcomes=outcomes).collect()}
    assert len(found) == len(rows)
    assert found[9001].verdict == "block" and {found[i].verdict for i in (0, 2999, 9002, 9003)} == {"allow"}
    assert found[9003].host == "" and len(found[9002].host) == 1_000_003

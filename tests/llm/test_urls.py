"""Shrinkage from suffix to domain to host, by hand."""

import math
import random

import pytest

from assayer.llm import urls


def strength(children, rate):
    known = [(n, bad) for n, bad in children if n]
    total, spread = sum(n for n, _ in known), rate * (1 - rate)
    if not known or total <= len(known) or spread <= 0:
        return 1 / urls.MOST_RHO - 1
    vary = sum(n * (bad / n - rate) ** 2 for n, bad in known)
    rho = (vary / spread - len(known)) / (total - len(known))
    return 1 / min(urls.MOST_RHO, max(urls.LEAST_RHO, rho)) - 1


def by_hand(pages):
    hosts = {}
    for host, bad in pages:
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), b + (bad or 0))

    def level(key):
        out = {}
        for host, (n, bad) in hosts.items():
            a, b = out.get(key(host), (0, 0))
            out[key(host)] = (a + n, b + bad)
        return out

    domains, suffixes = level(lambda h: ".".join(h.split(".")[-2:])), level(lambda h: h.split(".")[-1])
    n, bad = (sum(x) for x in zip(*hosts.values(), strict=True))
    rate = (bad + 1) / (n + 2)
    ks, kd, kh = (strength(x.values(), rate) for x in (suffixes, domains, hosts))
    out = {}
    for host, (n, bad) in hosts.items():
        (sn, sb), (dn, db) = suffixes[host.split(".")[-1]], domains[".".join(host.split(".")[-2:])]
        above = (db + kd * (sb + ks * rate) / (sn + ks)) / (dn + kd)
        mean = (bad + kh * above) / (n + kh)
        out[host] = (n, bad, mean, mean - urls.SIGMAS * math.sqrt(mean * (1 - mean) / (n + kh + 1)))
    return out


def test_hosts_are_shrunk_towards_their_domain_and_suffix(spark):
    rng = random.Random(11)
    names = [f"{h}.{d}.{s}" for h in "abc" for d in ("good", "bad", "new") for s in ("org", "net")] + ["", "org", "one.org"]
    share = lambda host: 0.8 if ".bad." in host else 0.1
    pages = [(h, None if ".new." in h or rng.random() < 0.3 else int(rng.random() < share(h))) for h in names for _ in range(rng.randrange(1, 30))]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(pages, "host string, bad int")).collect()}
    want = by_hand(pages)
    assert got.keys() == want.keys()
    for host, (n, bad, rate, low) in want.items():
        row = got[host]
        assert (row.n, row.bad) == (n, bad)
        assert row.rate == pytest.approx(rate) and row.low == pytest.approx(low)
        assert row.verdict == ("block" if low > urls.LIMIT else "allow")
    assert {row.verdict for row in got.values()} == {"block", "allow"}
    # without a label of its own a host takes the rate of what stands above it
    assert got["a.new.org"].n == 0 and got["a.new.org"].rate == pytest.approx(got["b.new.org"].rate)


def test_without_labels_nobody_is_blocked(spark):
    pages = spark.createDataFrame([("a.org", None), ("b.org", None), ("", None)], "host string, bad int")
    assert {r.verdict for r in urls.reputations(pages).collect()} == {"allow"}
    assert urls.reputations(pages.limit(0)).collect() == []


def test_a_table_of_suffixes_tells_sites_apart(spark):
    """Below co.uk every site has a domain of its own: the bad one's hosts are blocked, the good one's are not."""
    labelled = [(f"h{i}.bad.co.uk", 1) for i in range(20)] * 4 + [(f"h{i}.good.co.uk:8080", 0) for i in range(20)] * 4
    fresh = [("new.bad.co.uk", None), ("new.good.co.uk", None), ("co.uk", None), ("x.org", None), ("", None)]
    pages = spark.createDataFrame(labelled + fresh, "host string, bad int")
    table = spark.createDataFrame([("CO.UK",), ("uk",), ("uk",), (None,)], "suffix string")
    placed = {r.host: (r.domain, r.suffix) for r in urls._placed(pages.select("host").distinct(), table).collect()}
    assert placed["h1.good.co.uk:8080"] == ("good.co.uk", "co.uk") and placed["co.uk"] == ("co.uk", "co.uk")
    assert placed["x.org"] == ("x.org", "org") and placed[""] == ("", "") and len(placed) == 45
    told = {r.host: r for r in urls.reputations(pages, suffixes=table).collect()}
    plain = {r.host: r for r in urls.reputations(pages).collect()}
    assert told["new.bad.co.uk"].rate > 0.6 > 0.4 > told["new.good.co.uk"].rate
    assert plain["new.bad.co.uk"].rate == pytest.approx(plain["new.good.co.uk"].rate)
    assert urls.reputations(pages, suffixes=table.limit(0)).count() == 45

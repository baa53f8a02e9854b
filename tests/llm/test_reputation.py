"""Host reputation against a plain computation, hand-made cases, and its SQL on other rows than the driver's."""

from __future__ import annotations

import math
import random

import pytest

from prosemill.llm import oracles, urlfilter
from prosemill.llm.urlfilter import ReputationRules, host_reputation, judge_urls

SCHEMA = "page_id bigint, url string, host string, path string, rule string, verdict string, domain string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, "c", "c", "c", "c", "c") for i, u in rows], SCHEMA)


def levels(host):
    parts = host.split(".")
    two = ".".join(parts[-2:])
    return (".".join(parts[-3:]), two) if two in urlfilter.TWO_LABEL_SUFFIXES else (two, parts[-1])


def plain(hosts, rules):
    """The same estimate with dictionaries."""

    def grouped(groups, parent):
        out = {}
        for g, nk in groups.items():
            out.setdefault(parent(g), {})[g] = nk
        return out

    def total(children):
        return {p: tuple(map(sum, zip(*own.values(), strict=True))) for p, own in children.items()}

    def strength(children):
        excess = room = 0.0
        for own in children.values():
            seen = [(n, k) for n, k in own.values() if n]
            big, bad, g = sum(n for n, _ in seen), sum(k for _, k in seen), len(seen)
            if g > 1:
                p = bad / big
                excess += sum(n * (k / n - p) ** 2 for n, k in seen) - p * (1 - p) * (g - 1)
                room += p * (1 - p) * (big - sum(n * n for n, _ in seen) / big - (g - 1))
        return rules.max_strength if room <= 0 or excess <= 0 else min(max(room / excess - 1, rules.min_strength), rules.max_strength)

    by_domain = grouped({h: (n, k) for h, n, k in hosts}, lambda h: levels(h))
    by_suffix = grouped(total(by_domain), lambda d: d[1])
    by_all = grouped(total(by_suffix), lambda _: "")
    whole = total(by_all)[""]
    above = {"": ((whole[1] + 1) / (whole[0] + 2), whole[0] + 2.0)}
    for children in (by_all, by_suffix, by_domain):
        s, below = strength(children), {}
        for parent, own in children.items():
            mean, weight = above[parent]
            for g, (n, k) in own.items():
                only = n > 0 and sum(1 for x in own.values() if x[0]) == 1
                prior = min(s, weight - n)
                below[g] = (mean, weight) if only else ((k + prior * mean) / (n + prior), n + prior)
        above = below
    return {h: (m, m - rules.width * math.sqrt(m * (1 - m) / (w + 1))) for h, (m, w) in above.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reputation_equals_a_plain_computation(spark, seed):
    rng = random.Random(seed)
    hosts = []
    for d in range(12):
        rate = rng.random()
        for h in range(rng.randrange(1, 5)):
            n = rng.choice([0, 1, 3, 20, 300])
            hosts.append((f"h{h}.d{d}.{rng.choice(['com', 'org', 'co.uk'])}", n, sum(rng.random() < rate for _ in range(n))))
    hosts = list({h: (h, n, k) for h, n, k in hosts}.values())
    got = {r.host: (r.mean, r.bound) for r in host_reputation(spark.createDataFrame(hosts, "host string, n bigint, k bigint")).collect()}
    expected = plain(hosts, ReputationRules())
    assert got.keys() == expected.keys()
    for h, v in expected.items():
        assert got[h] == pytest.approx(v, abs=1e-12), h


def test_by_hand(spark):
    # one domain of two hosts: rates 1/2 and 3/4 about 5/8; no spread beyond chance, so the strength is the largest
    got = {r.host: r for r in host_reputation(spark.createDataFrame([("a.x.com", 4, 2), ("b.x.com", 4, 3)], "host string, n bigint, k bigint")).collect()}
    base = 6 / 10  # the only domain and the only suffix take it, with the weight 10
    assert got["a.x.com"].mean == pytest.approx((2 + 6 * base) / 10)
    assert got["b.x.com"].mean == pytest.approx((3 + 6 * base) / 10)


def test_without_outcomes_nothing_is_blocked(spark):
    pages = pages_of(spark, [(1, "http://a.example.info/x"), (2, None), (3, "http://a.example.info/y")])
    none = spark.createDataFrame([], "p bigint, bad boolean")
    assert {r.verdict for r in judge_urls(pages, none).collect()} == {"allow"}
    one = spark.createDataFrame([(1, True)], "p bigint, bad boolean")
    assert {r.verdict for r in judge_urls(pages, one).collect()} == {"allow"}  # one outcome is too little


def test_blocked_by_reputation_only(spark):
    rows = [(k, f"http://spam{k % 3}.bad.info/{k}") for k in range(60)] + [(100 + k, f"http://www.good.info/{k}") for k in range(60)] + [(300, "http://new.bad.info/"), (301, "http://new.good.info/"), (301, "http://new.good.info/"), (None, "http://new.bad.info/z")]
    outcomes = spark.createDataFrame([(k, True) for k in range(60)] + [(100 + k, k == 7) for k in range(60)] + [(107, False), (None, True)], "p bigint, bad boolean")
    got = judge_urls(pages_of(spark, rows), outcomes).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.verdict for r in got if r.page_id in (0, 100, 107, 300, 301, None)} == {0: "block", 100: "allow", 107: "allow", 300: "block", 301: "allow", None: "block"}
    assert {r.rule for r in got} == {None}


def test_sql_on_planted_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from prosemill.llm import queries

    rng = random.Random(5)
    pages = [(k, f"http://h{rng.randrange(4)}.{rng.choice(['bad', 'good', 'mixed'])}.{rng.choice(['info', 'co.uk', 'de'])}/{k}.html", "") for k in range(300)] + [(900, None, ""), (901, "x", "")]
    labels = [(k, int(("bad" not in pages[k][1]) and rng.random() < 0.9), 0) for k in range(0, 300, 2)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    rel = con.sql(oracles.ORACLES["op7_url_reputation"])
    got = queries.QUERIES["op7_url_reputation"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioloom.llm import reputation

URLS = {
    "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
    "https://example.net": ("example.net", "", None, None),
    "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "x://myexample.com/de/": ("myexample.com", "/de/", None, None),
    "x://a.org/fr/#/?": ("a.org", "/fr/", "org/fr/", "allow"),
    "x://org?/fr/": ("org", "", None, None),
    "a/b://c/d://e": ("c", "/d://e", None, None),
    "://": ("", "", None, None),
    "no scheme": ("", "", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
    "h://İ.NET/\n/x": ("İ.net", "/\n/x", "net/", "block"),
}


def judged(spark, pages, outcomes, **more):
    pages = spark.createDataFrame([(k, u, 1, "h") for k, u in pages], "page_id long, url string, n long, host string")
    return reputation.judged(pages, spark.createDataFrame(outcomes, "host string, n long, bad long"), **more)


def test_parts_and_rules(spark):
    got = judged(spark, enumerate(URLS), []).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: (*v[:3], v[3] or "allow") for k, v in enumerate(URLS.values())}


def test_empty_and_repeated(spark):
    assert judged(spark, [], [("a", 3, 1)]).count() == 0
    assert judged(spark, [(1, "x://a.b/c")] * 3 + [(None, None)] * 2, []).count() == 5


def slow_blocked(hosts):
    """Three levels of shrinking, in plain Python."""
    def inside(m):
        return min(max(m, 1e-6), 1 - 1e-6)

    def weight(units):
        units = [(n, bad, inside(m)) for n, bad, m in units if n]
        z, k, total = sum(n * (bad / n - m) ** 2 / (m * (1 - m)) for n, bad, m in units), len(units), sum(n for n, _, _ in units)
        rho = min(0.5, max(0.001, (z - k) / (total - k))) if total > k else 0.5
        return (1 - rho) / rho

    def level(parents, key):
        groups = {}
        for host, (n, bad) in hosts.items():
            a, b = groups.get(key(host), (0, 0))
            groups[key(host)] = a + n, b + bad
        units = {u: (n, bad, *parents(u)) for u, (n, bad) in groups.items()}
        w = weight((n, bad, m) for n, bad, m, _ in units.values())
        out = {}
        for u, (n, bad, m, behind) in units.items():
            prior = 1 / (1 / w + 1 / behind) if behind else 0
            out[u] = (bad + prior * inside(m)) / (n + prior) if n + prior else inside(m), min(n + prior, total), n + prior
        return out

    total = sum(n for n, _ in hosts.values())
    overall = sum(b for _, b in hosts.values()) / total if total else 0.0
    suffixes = level(lambda _: (overall, total), lambda h: h.split(".")[-1])
    domains = level(lambda d: suffixes[d.split(".")[-1]][:2], lambda h: ".".join(h.split(".")[-2:]))
    found = level(lambda h: domains[".".join(h.split(".")[-2:])][:2], lambda h: h)
    return {h for h, (m, _, w) in found.items() if m - 1.645 * (m * (1 - m) / (w + 1)) ** 0.5 > 0.25}


@pytest.mark.parametrize("seed", range(3))
def test_shrinking(spark, seed):
    rng = random.Random(seed)
    hosts = {}
    for s in "abc":
        for d in range(6):
            rate = rng.choice([0.02, 0.1, 0.6])
            for h in range(5):
                n = rng.choice([0, 1, 4, 60])
                hosts[f"h{h}.d{d}.{s}"] = n, sum(rng.random() < rate for _ in range(n))
    got = judged(spark, [(k, f"x://{h}/") for k, h in enumerate(hosts)], [(h, *v) for h, v in hosts.items()], rules=()).where(F.col("verdict") == "block").collect()
    want = slow_blocked(hosts)
    assert {r.host for r in got} == want and want


def test_a_host_without_labels_has_the_rate_of_its_domain(spark):
    outcomes = [(f"h{k}.bad.com", 40, 39) for k in range(8)] + [(f"h{k}.good.com", 40, 0) for k in range(8)]
    got = judged(spark, [(1, "x://new.bad.com/"), (2, "x://new.good.com/"), *[(9 + k, f"x://h{k}.{d}.com/") for k in range(8) for d in ("bad", "good")]], outcomes, rules=())
    assert {r.page_id: r.verdict for r in got.collect() if r.page_id < 3} == {1: "block", 2: "allow"}


def test_outcomes_count_pages_by_document(spark):
    pages = spark.createDataFrame([(1, "x://A/en/5"), (2, "x://a/en/5?q"), (3, "x://a/de/6.html"), (4, "x://b/en/7"), (5, None), (6, "x://a/en/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (6, 1, 1), (7, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in reputation.page_outcomes(pages, labels).collect()] == [("a", 5, 3)]


def test_few_labels_are_weak_evidence(spark):
    def verdicts(outcomes):
        pages = [(k, f"x://h{k}.d{k}.com/") for k in range(30)]
        return {r.verdict for r in judged(spark, pages, outcomes, rules=()).where("page_id >= 3").collect()}

    few = [(f"h{k}.d{k}.com", 1, int(k == 0)) for k in range(3)]
    many = [(f"h{k}.d{k}.com", 100, 33) for k in range(3)]
    assert [verdicts(v) for v in ([], few, many)] == [{"allow"}, {"allow"}, {"block"}]


def test_double_suffixes(spark):
    outcomes = [(f"h{k}.bad.co.uk", 60, 59) for k in range(4)] + [(f"h{k}.good{d}.co.uk", 60, 0) for k in range(4) for d in range(6)]
    pages = [(1, "x://new.bad.co.uk/"), *[(9 + k, f"x://{h}/") for k, (h, _, _) in enumerate(outcomes)]]
    assert {judged(spark, pages, outcomes, rules=(), double_suffixes=more).where("page_id = 1").first().verdict for more in [("co.uk",)]} == {"block"}
    assert judged(spark, pages, outcomes, rules=()).where("page_id = 1").first().verdict == "allow"


def test_query_where_some_hosts_are_blocked(spark, tmp_path):
    rng = random.Random(6)
    pages, labels = [], []
    for h in range(40):
        rate = 0.9 if h % 5 == 0 else 0.05
        for k in range(rng.choice([0, 1, 3, 25])):
            labels.append((len(pages), int(rng.random() >= rate), 0))
            pages.append((len(pages), f"https://h{h}.site{h % 10}.{'com' if h % 2 else 'info'}/en/{len(pages)}", 5))
        pages += [(len(pages) + 1000, f"https://h{h}.site{h % 10}.{'com' if h % 2 else 'info'}/other", 5)]
    spark.createDataFrame(pages, "page_id long, url string, n long").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r) for r in reputation.op6_url_reputation(spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(db.execute(reputation.SQL).fetchall(), key=repr)
    hosts = {v: {r[1] for r in got if r[3] is None and r[4] == v} for v in ("allow", "block")}
    assert len(hosts["block"]) >= 5 and len(hosts["allow"]) >= 20

import pytest
from lexiweave.llm import urls
from lexiweave.llm.queries import URL_RULES
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/", "https://example.com/en", "https://www.example.com/en/1?x#y", "http://a.b.example.com/en/9", "http://notexample.com/en/",
    "http://x.net/es/", "http://net/fr/", "http://x.NET/ES/", "http://x.net/fr?/fr/", "http://com", "http://com/", "http://.com/", "a://b://c.com/", "http://example.com:80/en/", "http://user@example.com/en/",
    "http://ünï.com/", "http://x.com" + "/a" * 5000, "http://" + "a." * 2000 + "net/es/", "http://x.com/en/\nz", "http://EXAMPLE.com?/en/", "http://x.org/#com/",
]


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else otherwise


def frame(spark, found):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(found)], PAGES)


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


MANY = [(f"h{i}.org", f"/{i % 7}/", "block") for i in range(500)] + [("org", "/", "allow"), ("org", "/", "allow")]


@pytest.mark.parametrize("rules", [URL_RULES, MANY, [*URL_RULES, (None, "/", "block"), ("x.org", None, "block"), ("", "/", "block")]], ids=["given", "many", "nulls"])
@pytest.mark.parametrize("joins", [16, 0], ids=["a join for each hit", "hits in rows"])
def test_against_brute_force(spark, rules, joins):
    found = URLS + [f"http://s.h{i}.org/{i % 5}/x" for i in range(60)]
    df = frame(spark, found).withColumn("rule", F.lit("own")).withColumn("key", F.lit("k")).withColumn("__h0", F.lit(1))
    out = urls.judge(df, rules_of(spark, rules), joins=joins)
    assert out.columns == ["page_id", "url", "html", "key", "__h0", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    good = [r for r in rules if r[0] and r[1] is not None]
    assert [got[i] for i in range(len(found))] == [brute(u, good) for u in found]


def test_long_lists_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 10)
    monkeypatch.setattr(urls, "MOST_BLOCKS", 2)  # a filter that lets everything through
    found = [f"http://s.h{i}.org/{i % 5}/x" for i in range(60)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame(spark, found), rules_of(spark, MANY)).collect()}
    assert [got[i] for i in range(60)] == [brute(u, MANY)[3] for u in found]


def test_no_shuffle_where_shapes_are_few(spark):
    plan = urls.judge(frame(spark, URLS), rules_of(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan.split("BroadcastExchange")[0]


def test_filter_loses_no_key(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    bits = urls.bloom(keys, 40)
    probed = spark.range(3000).select(F.array(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("keys"), "id")
    hit = {r["id"] for r in urls._with_hits(probed, "keys", bits, 40).where(F.size("hits") > 0).collect()}
    assert hit >= set(range(300)) and len(hit) < 600


def test_no_rules_no_pages_and_repeats(spark):
    assert {r["verdict"] for r in urls.judge(frame(spark, URLS), rules_of(spark, [])).collect()} == {"allow"}
    assert urls.judge(frame(spark, []), rules_of(spark, URL_RULES)).count() == 0
    same = spark.createDataFrame([(None, "http://x.com/", None)] * 3, PAGES)
    assert [r["rule"] for r in urls.judge(same, rules_of(spark, URL_RULES)).collect()] == ["com/"] * 3


def test_no_python_in_the_plan(spark):
    plan = urls.judge(spark.range(5).select(F.col("id").alias("page_id"), F.lit("http://x.com/").alias("url")), rules_of(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

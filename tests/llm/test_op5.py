from pyspark.sql import functions as F

from gradeframe.llm import url_rules as U

from .helpers import same_as_sql

CASES = [
    ("http://a.example.net/en/x", "example.net/en/", "allow"),
    ("http://example.net/en", "net/", "block"),
    ("http://EXAMPLE.NET/fr/", "net/", "block"),
    ("http://net/", "net/", "block"),
    ("http://net", None, "allow"),
    ("http://xnet/", None, "allow"),
    ("http://a.example.com/de/q?x#y", "example.com/de/", "block"),
    ("http://notexample.com/de/", None, "allow"),
    ("http://w.org/fr/a", "org/fr/", "allow"),
    ("http://w.org/frx/a", None, "allow"),
    ("http://w.com/Login?next=1", None, "block"),
    ("http://w.com/a/search?p=1&q=x", None, "block"),
    ("http://w.com/wp-admin/x", None, "block"),
    ("http://w.com/x#/wp-admin/", None, "allow"),
    ("mailto:x@y.net/", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
    ("http://", None, "allow"),
    ("http://" + "a" * 100000 + ".net/", "net/", "block"),
]


def test_cases(spark):
    rows = [(i % 7, u) for i, (u, _, _) in enumerate(CASES)]
    df = (spark.createDataFrame(rows, "page_id long, url string")
          .withColumn("rule", F.lit("old")).withColumn("token", F.lit("t")).withColumn("rank_no", F.lit(1)))
    df = df.union(df)
    got = sorted({(r.url, r.rule, r.verdict) for r in U.judge(df).collect()}, key=repr)
    assert got == sorted(set(CASES), key=repr)
    out = U.judge(df)
    assert out.count() == 2 * len(rows) and set(out.columns) == {*df.columns, "host", "path", "verdict", "pattern_rule"}
    assert U.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(df, rules=()).collect()} == {"allow"}


def test_index_takes_rarest_token(spark):
    df = spark.createDataFrame([("a.example.net/en/",), ("b.example.net/fr/",), ("c.net/en/",)], "subject string")
    got = {r.rank_no: r.token for r in U.rule_index(df, U.LISTED).collect()}
    order = sorted(U.LISTED, key=lambda r: (r.rank, r.name))
    assert {order[k].name: t for k, t in got.items()} == {
        "net/": "net", "example.net/en/": "en", "example.com/de/": "com", "org/fr/": "org"}


def test_sql(spark):
    same_as_sql(spark, U, "op5_url_rules")
    same_as_sql(spark, U, "op5_url_rules", "/root/testdata/sf0.01")


def test_query_without_a_path_stays_out_of_the_host(spark):
    cases = [("http://example.com?next=foo.net/", None, "allow"), ("http://a.com?u=b.org/fr/", None, "allow"),
             ("http://example.com?u=example.com/de/", None, "allow"), ("http://a.com?u=x.example.net/en/", None, "allow"),
             ("http://foo.net?next=a.org/fr/", None, "allow"), ("http://foo.net/?next=a.org/fr/", "net/", "block")]
    df = spark.createDataFrame([(u,) for u, _, _ in cases], "url string")
    assert sorted(((r.url, r.rule, r.verdict) for r in U.judge(df).collect()), key=repr) == sorted(cases, key=repr)
    host = (U.host_rule("foo.net", "block"),)
    got = {r.url: r.rule for r in U.judge(df, rules=host).collect()}
    assert {u for u, rule in got.items() if rule} == {"http://foo.net?next=a.org/fr/", "http://foo.net/?next=a.org/fr/"}


def test_every_rule_has_a_token_and_few_expressions_run(spark):
    """With two thousand rules a URL runs the expressions of the few whose rarest token it holds."""
    assert all(r.tokens for r in U.LISTED + U.PATTERNS)
    rules = [U.Rule(f"trap {k}", "block", rf"(?i)/trap{k}/page", (f"trap{k}", "page"), 1) for k in range(1000)]
    rules += [U.host_rule(f"host{k}.example.org/page/", "block") for k in range(1000)]
    urls = [f"http://host{k}.example.org/{'page' if k % 2 else 'other'}/x{k}" for k in range(400)] + [f"http://www.a.com/trap{k}/page" for k in range(400)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    subjects = df.select("url", U.url_parts(F.col("url"))[2].alias("subject"))
    ran = U.fetched(subjects, U.rule_index(subjects, rules + list(U.PATTERNS))).count()
    assert ran / len(urls) <= 1.0                              # of 2,010 rules
    got = {r.url: (r.rule, r.pattern_rule) for r in U.judge(df, rules=rules + list(U.PATTERNS)).collect()}
    assert all(got[u] == ((f"host{k}.example.org/page/", None) if k % 2 else (None, None)) for k, u in enumerate(urls[:400]))
    assert all(got[u] == (None, f"trap {k}") for k, u in enumerate(urls[400:]))


def test_each_alternative_is_found(spark):
    blocked = ["/login", "/Login/", "/signin?x", "/wp-login.php", "/a?PHPSESSID=1", "/a;jsessionid=2", "/cart", "/CHECKOUT/x", "/a/login?next=/"]
    free = ["/logins", "/xsignin", "/wp-loginxphp", "/a?xphpsessid=1", "/cartoon", "/check-out", "/a#/login"]
    df = spark.createDataFrame([("http://w.com" + p,) for p in blocked + free], "url string")
    got = {r.url: r.verdict for r in U.judge(df).collect()}
    assert got == {"http://w.com" + p: "block" for p in blocked} | {"http://w.com" + p: "allow" for p in free}

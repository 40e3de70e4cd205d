from tallyforge.llm import urls as U

CASES = {
    "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
    "https://X.Example.COM/en/7?q#f": ("x.example.com", "/en/7", "example.com/en/7", "allow"),
    "http://example.net/de/8x": ("example.net", "/de/8x", "example.net/de/8", "block"),
    "http://example.net/de/7": ("example.net", "/de/7", "net/de/", "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "ftp://casino-win.org?x=/es/": ("casino-win.org", "", None, "block"),
    "http://a.b/c://d": ("a.b", "/c://d", None, "allow"),
    "nothing": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://h": ("h", "", None, "allow"),
}


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", True) for i, u in enumerate(urls)], "page_id long, url string, host string, is_listed boolean")


def judged(spark, urls, **more):
    pages = frame(spark, urls)
    return U.judge(pages, U.named(pages), **more)


def test_rules_and_listed_hosts(spark):
    urls = [*CASES, *CASES]  # repeated rows are each judged
    for r in judged(spark, urls).collect():
        assert (r.host, r.path, r.rule, r.verdict) == CASES[urls[r.page_id]]
    assert U.judge(frame(spark, urls).limit(0), U.named(frame(spark, urls))).count() == 0
    assert judged(spark, [None]).count() == 1


def test_listed_keys_are_a_table(spark):
    urls = ["http://one.org/x", "http://TWO.org/x", "http://three.org/es/", None, "http://" + "long" * 50_000 + ".org/" + "p" * 100_000]
    keys = spark.createDataFrame([("two.org", 1), ("two.org", 2), (None, 3), ("absent.org", 4), ("three.org", 5), ("", 6), ("long" * 50_000 + ".org", 7)], "key string, host long")
    for most in (U.MOST_BYTES, 1):
        got = [r.verdict for r in U.judge(frame(spark, urls), keys, most_bytes=most).orderBy("page_id").collect()]
        assert got == ["allow", "block", "block", "block", "block"]
    assert [r.verdict for r in U.judge(frame(spark, urls), keys.limit(0)).orderBy("page_id").collect()] == ["allow", "allow", "block", "allow", "allow"]


def test_cascade_is_exact_and_the_join_agrees(spark):
    urls = [f"http://{'ads' if i % 7 == 0 else 'h'}.n{i}.org/x" for i in range(20_000)]
    a = {(r.page_id, r.verdict) for r in judged(spark, urls).collect()}
    assert a == {(i, "block" if i % 7 == 0 else "allow") for i in range(20_000)}
    assert a == {(r.page_id, r.verdict) for r in judged(spark, urls, most_bytes=10).collect()}
    universe = spark.range(20_000).selectExpr("cast(id as string) key", "id % 7 = 0 is_listed")
    levels = U.cascade(universe)
    assert len(levels) > 1 and sum(len(x.words) for x in levels) * 64 < 20_000 * 5

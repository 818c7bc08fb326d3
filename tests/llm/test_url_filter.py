import re

from codeloom.llm import url_filter as u
from tests.llm.helpers import PAGES


def judge(spark, urls, rules=None):
    df = spark.createDataFrame([(i, x, "") for i, x in enumerate(urls)], PAGES).withColumnRenamed("html", "host")
    table = u.rule_table(spark, u.default_rules() if rules is None else rules)
    return {r.id: r for r in u.url_filter(df, table).collect()}


def test_contract_cases(spark):
    urls = [
        "https://WWW.Example.ORG/en/14?x", "http://example.org/es/", "http://notexample.org/en/1", "http://a.com/fr/9", "http://a.com/de/9#t", "http://com/fr/", None, "",
        "no scheme.org/", "http://org/?q", "http://org", "http://org:80/x", "x://y://z.org/a", "http://casino-win.example.net/en/1", "http://mycasinos.net/", "http://example.org/EN/1", "http://ÉX.ORG/Ä",
    ]
    got = judge(spark, urls)
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.org/en/1", "block"), ("example.org/es/", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("org/", "allow"), ("org/", "allow")]
    assert (got[0].host, got[0].path) == ("www.example.org", "/en/14")
    assert (got[12].host, got[12].path) == ("y:", "//z.org/a")
    assert (got[16].host, got[16].path) == ("Éx.org", "/Ä")
    assert (got[6].host, got[6].path, got[8].host) == ("", "", "")


def test_index_finds_what_all_rules_would(spark):
    rules = u.default_rules() + [u.Rule("a.*z", "block", ()), u.Rule("/x/[0-9]+$", "allow", ("x",))]
    urls = [f"http://{h}.example.{t}/{p}" for h in ("adult-x", "m.spam-farm", "abz", "casino") for t in ("net", "org", "com") for p in ("de/1", "x/33", "cart/", "en/1", "tag/de/", "")] * 2
    got = judge(spark, urls, rules)
    for i, url in enumerate(urls):
        target = url.split("://")[1]
        fits = [r for r in rules if re.search(r.pattern, target)]
        base = max((r for r in fits if r.rule), key=lambda r: len(r.rule), default=None)
        want = base.action if base else "block" if any(r.action == "block" for r in fits) else "allow"
        assert (got[i].rule, got[i].verdict) == (base and base.rule, want), url


def test_no_rules_no_pages_and_a_very_long_url(spark):
    assert judge(spark, [])  == {}
    got = judge(spark, ["http://x.org/" + "a/" * 100_000], [])
    assert got[0].verdict == "allow" and got[0].rule is None


def test_literals_are_whole_tokens_of_what_fits():
    assert u.host_rule("example.org/en/1", "block").literals == ("example", "org", "en")
    for rule in u.default_rules():
        assert rule.literals


def test_verdicts_do_not_depend_on_the_table(spark):
    urls = ["http://a.net/wp-login.php5", "http://a.net/pornStars", "http://a.net/CASINO/", "http://a.net/xwp-login.php"]
    padding = [f"http://b.net/{w}" for w in ("wp", "login", "wp-login", "porn") for _ in range(5)]
    alone, among = judge(spark, urls), judge(spark, urls + padding)
    assert [alone[i].verdict for i in range(4)] == [among[i].verdict for i in range(4)] == ["block", "block", "allow", "allow"]

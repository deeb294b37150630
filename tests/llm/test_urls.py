"""URL rules by hand, the trees on held-out URLs, and edge cases."""

import pytest

from tandem.llm.url_filter import RULES, judge_urls

CASES = [
    ("http://a.net/x", "a.net", "/x", "net/"), ("https://WWW.Example.NET/en/1?q=/de/#f", "www.example.net", "/en/1", "example.net/en/"),
    ("http://example.net/en", "example.net", "/en", "net/"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("http://x.y.example.com/de/", "x.y.example.com", "/de/", "example.com/de/"),
    ("http://myexample.com/de/1", "myexample.com", "/de/1", None), ("ftp://b.org/fr/a", "b.org", "/fr/a", "org/fr/"),
    ("http://b.org/FR/a", "b.org", "/FR/a", None), ("http://a.net", "a.net", "", None), ("http://a.net?x=/", "a.net", "", None),
    ("http://net/", "net", "/", "net/"), ("a.net/x", "", "", None), (None, "", "", None), ("", "", "", None), ("://", "", "", None),
    ("x://a.net/b://c", "a.net", "/b://c", "net/"), ("http://É.org#/fr/", "É.org", "", None), ("http://a.b/c?d://e.net/", "a.b", "/c", None),
]


def test_rules_and_edges(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(CASES)]
    rows += [(100 + i, f"http://h{i}.net/p{i}") for i in range(30)] + [(200 + i, f"http://shop{i}.org/fr/{i}") for i in range(30)]
    rows += [(300, "http://l.com/" + "a/" * 20000), (None, "http://a.net/x"), (None, "http://a.net/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict", "3 as suffix", "4 as probability")
    got = judge_urls(df, trees=3).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), CASES[i]
        assert by[i].verdict == dict(RULES).get(rule, by[i].verdict) and by[i].verdict in ("allow", "block")
        assert (by[i].p_block is None) == (rule is not None)
    assert judge_urls(df.limit(0)).count() == 0


def test_one_label_or_none(spark):
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.com/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(one).collect()} == {1: "block", 2: "block"}
    none = one.where("page_id = 2")
    assert [(r.verdict, r.p_block) for r in judge_urls(none).collect()] == [("allow", 0.0)]


@pytest.mark.parametrize("hide", [0, 1])
def test_held_out_accuracy(spark, hide):
    """Every second labelled URL is hidden from the rules by a changed host ending and judged by the trees alone."""
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        host = f"buy-now-{i}-{i * 7919 % 1000}" if bad else f"news{'abcde'[i % 5]}"
        path = f"/p{i}?id={i * 31}&ref={i}&s={i * 17}" if bad else f"/story/{'xyz'[i % 3]}"
        rows.append((i, f"http://{host}.{'hidden' if i % 2 == hide else 'bad' if bad else 'good'}{path}"))
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(("bad/", "block"), ("good/", "allow"))).collect()
    judged = [r for r in got if r.rule is None]
    assert len(judged) == 300
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in judged) / 300 > 0.95


def test_suffix_statistics_count_hosts_of_the_whole_table(spark):
    """Distinct hosts of every row count, a training row's own fold does not, and one rule alone gives no value."""
    from tandem.llm import url_filter
    rows = [(f"a{i % 40}.net", "net/", "block") for i in range(400)] + [(f"a{i}.net", "x.net/en/", "allow") for i in range(10)]
    rows += [(f"b{i}.org", "org/fr/", "allow") for i in range(59)] + [(f"c{i}.info", None, None) for i in range(2)]
    df = spark.createDataFrame(rows, "host string, rule string, ruled string").repartition(4)
    counts = url_filter.suffix_counts(df)
    by_fold, whole, base = url_filter.suffix_statistics(counts)
    assert base == 40 / 109
    assert {r.suffix: (r.suffix_size, round(r.suffix_block, 9)) for r in whole.collect()} == {
        "net": (-1, round((40 + 8 * base) / 58, 9)), "org": (-1, round(base, 9)), "info": (-2, round(base, 9))}
    own = {(r.suffix, r.fold): r for r in counts.collect()}
    seen = by_fold.where("suffix = 'net'").collect()
    assert sum(own["net", r.fold].blocked for r in seen) == 40
    for r in seen:
        b, a = 40 - own["net", r.fold].blocked, 10 - own["net", r.fold].allowed
        assert abs(r.suffix_block - (b + 8 * base) / (a + b + 8)) < 1e-12


def test_whole_table_against_brute_force(spark):
    """Host, path, rule and its verdict of every page by string methods; without a rule the form decides, not the suffix."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    rows = pages.select("page_id", "url").collect()
    assert len(rows) == len(got)
    inside = {}
    for r in rows:
        _, sep, rest = (r.url or "").partition("://")
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("#")[0].split("?")[0]
        fits = [x for x, _ in RULES for d, p in [x.split("/", 1)] if ("." + host).endswith("." + d) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        if rule:
            assert g.verdict == dict(RULES)[rule]
        else:
            assert g.verdict == ("block" if g.p_block > 0.5 else "allow")
            inside.setdefault(host.rsplit(".")[-1], set()).add(g.verdict)
    assert inside and all(v == {"allow", "block"} for v in inside.values())


def test_form_decides_inside_a_suffix(spark):
    """The form of the URLs that rules label is learnt; a suffix that no rule labels holds both forms and gets both verdicts."""
    bad, good = "http://win-{0}-now-{1}.{2}/?id={1}&ref={0}&s={1}", "http://news.site{0}.{2}/story/a"
    rules = (("com/", "allow"), ("org/", "allow"), ("net/", "block"), ("info/", "block"))
    rows = []
    for i in range(300):
        rows += [bad.format(i, i * 31, ("net", "info")[i % 2]), good.format("abcde"[i % 5] * (1 + i % 3), i, ("com", "org")[i % 2])]
        rows += [bad.format(i, i * 17, "dev"), good.format("fghij"[i % 5] * (1 + i % 3), i, "dev")]
    got = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules).where("rule is null").collect()
    assert len(got) == 600
    assert sum((r.verdict == "block") == (r.page_id % 4 == 2) for r in got) / 600 > 0.95

"""URL rules and alias classes against a plain union-find."""

from affinity.llm import urls
from affinity.llm.queries import URL_RULES


def page(url, canonical=None, refresh=None):
    head = f'<link rel="canonical" href="{canonical}">' if canonical else ""
    head += f'<META http-equiv=refresh content="0; URL={refresh}">' if refresh else ""
    return url, f"<html><head>{head}</head></html>"


def run(make, pages, **more):
    rows = [(i, *p) for i, p in enumerate(pages)]
    got = urls.judge_urls(make(rows, "page_id long, url string, html string"), URL_RULES, **more)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return [tuple(r)[1:] for r in sorted(got.collect())]


def test_rules_and_parts(make):
    pages = [page("http://A.Example.NET/en/1?x#y"), page("https://b.example.net/de/1"), page("https://example.com/de/x"),
             page("https://notexample.com/de/x"), page("http://x.org/fr/"), page("http://x.org/en/"), page("http://a.net"), page("no url"),
             page(None), page("http://ÄB.net:80/a://b"), page("x://net/"), (None, None), page("http://h.net?q=/en/"), page("http://" + "p" * 40000 + ".net/")]
    got = run(make, pages)
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("b.example.net", "/de/1", "net/", "block")
    assert got[2] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[3] == ("notexample.com", "/de/x", None, "allow")
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("x.org", "/en/", None, "allow")
    assert got[6] == ("a.net", "", None, "allow")
    assert got[7] == got[8] == got[11] == ("", "", None, "allow")
    assert got[9] == ("Äb.net:80", "/a://b", None, "allow")
    assert got[10] == ("net", "/", "net/", "block")
    assert got[12] == ("h.net", "", None, "allow")
    assert got[13][2:] == ("net/", "block")


def test_blocks_reach_aliases_and_allows_win(make):
    pages = [page("http://spam.net/1"),
             page("http://alias.io/a", canonical="http://spam.net/1"),
             page("http://far.io/b", refresh="https://ALIAS.io/a#top"),
             page("http://good.org/fr/x", canonical="http://far2.io/c"),
             page("http://far2.io/c", canonical="http://bad.net/2"),
             page("http://alone.io/", canonical="/home"), page("http://alone.io/home"),
             page("https://other.io/1", canonical="//spam.net/1"), page("http://rel.io/d/e", canonical="f"), page("http://rel.io/d/f"),
             page("http://alias.io/a")]
    verdicts = [v for *_, v in run(make, pages)]
    assert verdicts == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "block"]


def test_redirect_table_and_long_chain(make, spark):
    n = 60
    pages = [page(f"http://c{i}.io/") for i in range(n)]
    hops = spark.createDataFrame([(f"http://c{i}.io/", f"http://c{i + 1}.io/") for i in range(n - 1)] + [(f"http://c{n - 1}.io/", "http://end.net/"), (None, "x")],
                                 "src string, dst string")
    assert {v for *_, v in run(make, pages, redirects=hops)} == {"block"}


def test_empty_table(make):
    assert run(make, []) == []

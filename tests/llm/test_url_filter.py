from stowage.llm import url_filter


def test_rules(spark):
    urls = ["http://x.ORG/a", "https://example.org/es/1", "https://a.example.org/en/17", "http://example.org/en/2", "http://b.com/fr/x?y", "http://b.com/de/", "http://b.com", "http://org", "nothing", None, "http://notexample.org/es/?q#f", "http://b.net/a#x"]
    want = [("x.org", "/a", "org/", "allow"), ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/17", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("b.com", "/fr/x", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"),
            ("b.com", "", None, "allow"), ("org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("b.net", "/a", None, "allow")]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, HOST string")
    out = sorted(url_filter.filter_urls(df).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_links_carry_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/a", link("bad.com")), (3, "http://good.org/a", link("fine.net", "fine.net")), (4, "http://fine.net/a", ""), (5, "http://far.net/a", link("farm.net"))]
    out = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i]["verdict"] for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert out[4]["trust"] > 0 and out[2]["distrust"] > out[5]["distrust"] > 0


PAGES = "page_id long, url string, html string"


def test_links_of_every_form(spark):
    rows = [
        (1, "http://a.net/x", "<a href='http://B.net/y'>", {"b.net"}), (2, "http://a.net/x", '<A class="x"\n HREF  =   "  //c.net/y?z">', {"c.net"}), (3, "http://a.net/x", "<a href=/y><a href=mailto:m@d.net><a href='y://'>", set()),
        (4, "http://a.net/x", "<base href='http://e.net/b/'><a href=rel/x>", {"e.net"}), (5, "http://a.net/x", "<area href=git+ssh-longer.scheme://f.net#x><link href='http://no.net/s.css'>", {"f.net"}),
        (6, "http://a.net/x", "<a " + "x=1 " * 50 + "href" + " " * 20 + "=" + " " * 20 + "'http://g.net'>", {"g.net"}), (9, "http://a.net/x", '<a data-href="http://bad.com/x" href="/y"><a title="a > b" href="http://h.org/">', {"h.org"}),
        (10, "http://a.net/x", "<!-- <a href='http://old.org/'> --><a href=http://i.net><script>'<a href=http://j.net>'</script><style> <a href=http://k.net>", {"i.net"}),
        (11, "http://a.net/x", "<a title=\"<a href='http://l.net'>\" hidden href='http://m.net'><abbr href='http://n.net'>", {"m.net"}), (7, None, "<a href='http://b.net'>", set()), (8, "http://a.net", None, set()),
    ]
    for i, url, html, want in rows:
        out = url_filter.host_edges(spark.createDataFrame([(i, url, html)], PAGES), "url", "html").collect()
        assert {r["dst"] for r in out} == want, i


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Against the same sums in Python, run until nothing changes; rows that repeat are judged alike."""
    rows = [(0, "http://bad.com/de/1", "")] + [(i, f"http://f{i}.net/a", f"<a href='http://{'bad.com' if i == 1 else f'f{i - 1}.net'}/'><a href='http://side{i}.net'>") for i in range(1, 26)]
    rows += [(i, url, html) for i, url, html in rows if i % 5 == 0]
    out = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    want, score = {}, 0.15
    for i in range(1, 26):
        score *= 0.85
        want[i] = score
    assert all(abs(out[i]["distrust"] - want[i]) < 1e-5 and out[i]["verdict"] == "block" for i in want)

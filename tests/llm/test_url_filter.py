import pytest

from rheolake.llm.url_filter import RuleBook, RULES, read_vocabulary, split_url, term_counter, url_verdicts


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""),
        ("", "", ""),
        ("no-scheme.com/x", "", ""),
        ("HTTP://WWW.Example.COM/En/A?b=/c#d", "www.example.com", "/En/A"),
        ("http://a.net#x/y", "a.net", ""),
        ("x://a://b/c", "a:", "//b/c"),
    ],
)
def test_split(url, host, path):
    assert split_url(url) == (host, path)


def test_rules_longest_wins():
    book = RuleBook(RULES)
    assert book.find("www.example.com", "/en/1") == ("www.example.com/en/", "allow")
    assert book.find("blog.example.com", "/en/1") == ("example.com/en/", "block")
    assert book.find("notexample.com", "/en/1") == ("com/", "allow")
    assert book.find("a.net", "/es/") == ("net/es/", "block")
    assert book.find("a.net", "/es") == (None, None)
    assert book.find("com", "") == (None, None)


def test_terms_need_boundaries_and_distinct_soft_hits():
    count = term_counter({"xxx": 1.0, "bet": 0.5, "win": 0.5})
    assert count("bet/bet/bet") == (1, 0.5)
    assert count("a-bet_win.") == (2, 1.0)
    assert count("alphabet winner xxxx") == (0, 0)
    assert count("éxxxé") == (1, 1.0)


def test_vocabulary_from_a_table(spark):
    rows = [("Bad", 0.3), ("bad", 0.7), ("sad", 0.4), ("", 9.0), (None, 1.0), ("free", 0.0)] + [(f"term{i}", 0.01) for i in range(3_000)]
    weights = read_vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert len(weights) == 3_002 and weights["bad"] == 0.7
    pages = spark.createDataFrame([(1, "http://a.org/bad/sad"), (2, "http://a.org/bad/free"), (3, "http://a.org/sad?term7")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_verdicts(pages, weights=weights).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert {r.verdict for r in url_verdicts(pages, weights={}).collect()} == {"allow"}
    with pytest.raises(ValueError):
        read_vocabulary(spark.createDataFrame(rows, "term string, weight double"), max_terms=100)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "http://x.org/" + "a/" * 50_000 + "xxx"), (4, "http://q.org/bet?win"), (4, "http://q.org/bet?win"), (None, "http://a.com/")]
    df = spark.createDataFrame([(*r, "h", 7) for r in rows], "page_id long, url string, host string, verdict int")
    got = sorted((r.page_id or -1, r.verdict) for r in url_verdicts(df).collect())
    assert got == [(-1, "allow"), (1, "allow"), (2, "allow"), (3, "block"), (4, "block"), (4, "block")]
    assert url_verdicts(df.limit(0)).count() == 0


def test_ordinary_urls_pass_and_planted_ones_do_not(spark):
    """Query strings, tracking and shop words are harmless; strict terms, or two soft ones, are not."""
    fine = ["https://shop.org/bread?ref=mail&track=7", "https://charity.org/free-click-here", "https://a.org/?utm_source=x&click=1&free=1", "https://essex.org/sussex/win", "https://betting.org/betting?betting", "https://lab.org/analysis/assessment"]
    bad = ["https://a.org/casino/poker", "https://sexy.org/nude", "https://a.org/free-PORN", "https://xxx.org", "http://a.org/?q=payday+loans", "http://viagra-pills.org/"]
    pages = spark.createDataFrame(list(enumerate(fine + bad)), "page_id long, url string")
    found = {r.url: r.verdict for r in url_verdicts(pages).collect()}
    assert {u for u, v in found.items() if v == "block"} == set(bad)


def test_sql_agrees_where_terms_decide(spark):
    """Pages of the tables with terms put into their urls, so that the method and not a rule decides."""
    import duckdb

    from rheolake.llm.url_filter import SOFT_TERMS, SQL, STRICT_TERMS

    words = [*STRICT_TERMS, *SOFT_TERMS]
    rows = [(i, f"http://site{i}.org/{words[i % len(words)]}{'-/x_'[i % 4]}{words[i * 7 % len(words)]}?{words[i * 3 % len(words)].upper()}") for i in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT page_id, verdict FROM ({SQL})").fetchall())
    got = sorted((r.page_id, r.verdict) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == want and {v for _, v in got} == {"allow", "block"}

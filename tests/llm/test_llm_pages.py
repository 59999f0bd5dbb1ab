"""Main text and URL verdicts."""

import os
import re
from html import unescape

import pytest

from tagspark.llm import labelled_pages, pages, queries, urls

SF = os.environ.get("TAGSPARK_TEST_SF", "/root/testdata/sf0.001")
URLS = [
    "http://Ex.Example.NET/en/1?x", "https://example.net/de/1", "http://example.com/de/", "http://a.example.com/de/x/y#z", "http://org/fr/1", "http://x.org/fr", "http://x.org/en/",
    "no scheme", None, "", "://", "http://", "x://h?p/q", "http://badexample.net/en/", "http://a://b/c", "HTTP://ÄB.Example.com:80/P",
]


def test_every_article_of_the_table(spark):
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in pages.main_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article))
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_held_out_labelled_pages():
    model, wrong, runs = pages.trained(), 0, 0
    for seed in range(5000, 5200):
        tree = pages.parse(labelled_pages.page(seed))
        want = [s for s, y, n in zip(tree.text, tree.label, tree.never) if s is not None and y and not n]
        got = model.content([tree])[0].split("\n")
        runs += sum(s is not None for s in tree.text)
        wrong += len(set(want) ^ set(got))
    assert wrong / runs < 0.05


def test_odd_pages(spark):
    html = [
        None, "", "plain text", "<p>" * 3000 + "deep", "<div>" * 2000 + "<p>deep text here.</p>", "<!-- never closed <p>x</p>", "<p>a<script>var x='</p>'", "<a href='x", "&amp;&lt;&copy &notanentity; &#x41;",
        "<article><h1>T &amp; U</h1><p>First  one<br>two.<p>Second\n\tone.</article><nav><ul><li><a href=/>Home</a></li></ul></nav>", "<article><p>Same.</p><p>Same.</p></article>",
    ]
    df = spark.createDataFrame([(i, None, h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert len(got) == len(html) and got[0] == "" and got[1] == "" and "x" not in got[5]
    assert got[9] == "T & U\nFirst one two.\nSecond one." and got[10] == "Same.\nSame."
    assert pages.main_text(df.limit(0)).count() == 0


PARTS = ["The river rose in the night and the lower town was flooded by morning.", "People carried what they could up the hill, and waited for boats.", "By noon the water had begun to fall again, slowly, street by street."]


@pytest.mark.parametrize("extra", ["<button>Share</button>", '<noscript><img src="a.png"></noscript>', '<div aria-hidden="true"></div>', '<div aria-hidden="true">x</div>', "<div hidden>Some hidden words.</div>", "<select><option>A</option></select>"])
def test_buttons_and_hidden_parts_leave_the_article_whole(extra):
    model = pages.trained()
    for n in (0, 1, 3, 4, 12, 20):
        body = "<h2>The flood of the year</h2>" + "".join(f"<p>{p}</p>" for p in PARTS) + extra * n
        html = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article>{body}</article><footer>&copy; 2020 Us</footer></body></html>'
        got = model.content([pages.parse(html)])[0].split("\n")
        assert got[:4] == ["The flood of the year", *PARTS] and "Home" not in got and "Share" not in got and "A" not in got


def test_embedded_elements_are_read_as_markup():
    held = lambda html: [t for t in pages.parse(html).text if t]
    assert held("<p>Sum <math><mi>x</mi></math> here.</p>") == ["Sum x here."]
    for tag in ("svg", "math", "object", "video", "audio", "canvas", "template"):
        assert held(f"<p>One.</p><{tag}><p>Instead.</p></{tag}><p>Two.</p>") == ["One.", "Instead.", "Two."]
        assert held(f"<p>One.</p><{tag}><p>Two.</p>") == ["One.", "Two."]
    assert held("<svg><style>p {}</style><title>no</title></svg><p>One.</p>") == ["One."]


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.split("[?#]", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, 3, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], 3, "x"), (None, URLS[6], 3, "x")], "page_id long, url string, host int, verdict string")
    none = spark.createDataFrame([], "page_id long, bad long")
    found = urls.judged(df, none).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url = URLS[6] if r["page_id"] is None else URLS[r["page_id"]]
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judged(df.limit(0), none).count() == 0


def test_reputation_shrinks_few_labels_and_blocks_bad_hosts(spark):
    rows, outcomes, i = [], [], 0
    hosts = [(f"good{k}.site{k}.com", 20, 1) for k in range(30)] + [("spam.bad.com", 40, 39), ("new.bad.com", 0, 0), ("one.fresh.com", 1, 1), ("none.other.com", 0, 0)]
    for host, n, bad in hosts:
        for k in range(n + 1):
            rows.append((i, f"http://{host}/p/{i}"))
            if k < n:
                outcomes.append((i, int(k < bad)))
            i += 1
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad long")).collect()
    verdict = {r["host"]: r["verdict"] for r in got}
    assert verdict["spam.bad.com"] == "block" and verdict["one.fresh.com"] == "allow" and verdict["good3.site3.com"] == "allow" and verdict["none.other.com"] == "allow"
    share = {r["host"]: r["bad_share"] for r in got}
    assert share["good3.site3.com"] < share["one.fresh.com"] < share["spam.bad.com"]


def test_repeated_rows_give_the_same_verdicts(spark):
    pages_ = [(i, f"http://h{i % 4}.example.com/p{i}") for i in range(40)] + [(100 + i, f"http://bad.other.org/{i}") for i in range(3)]
    outcomes = [(i, int(i % 4 == 0 and i < 8)) for i in range(40)] + [(100 + i, 1) for i in range(3)]
    frame = lambda k: (spark.createDataFrame(pages_ * k, "page_id long, url string"), spark.createDataFrame(outcomes * k, "page_id long, bad long"))
    once, often = (sorted(set(map(tuple, urls.judged(*frame(k)).collect()))) for k in (1, 6))
    assert once == often


def test_suffixes(spark):
    df = spark.createDataFrame([("a.b.example.co.uk",), ("example.com",), ("com",), ("x.y.de",), ("co.uk",)], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in urls.levels(df).collect()}
    assert got == {"a.b.example.co.uk": ("co.uk", "example.co.uk"), "example.com": ("com", "example.com"), "com": ("com", "com"), "x.y.de": ("de", "y.de"), "co.uk": ("uk", "co.uk")}


def test_registered_queries_over_whole_tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    for name in ("op6_main_text", "op9_url_filter"):
        assert queries.QUERIES[name](spark, SF).count() == n

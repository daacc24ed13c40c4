import pytest
from pyspark.sql import functions as F

from sediment.functions import terms, text, urls


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


#: Urls and the spelling that each must get.
URLS = [
    ("http://example.com/a", "https://example.com/a"),
    ("https://WWW.Example.com/a", "https://example.com/a"),
    ("https://example.com/a/", "https://example.com/a"),
    ("https://example.com/a#section", "https://example.com/a"),
    ("https://example.com/a?utm_source=x&fbclid=y", "https://example.com/a"),
    ("https://example.com/a?v=7", "https://example.com/a?v=7"),
    ("https://youtu.be/W3aieHjyNvw", "https://youtube.com/watch?v=W3aieHjyNvw"),
    ("https://www.youtube.com/watch?v=W3aieHjyNvw&list=PL&index=3", "https://youtube.com/watch?v=W3aieHjyNvw"),
    ("https://youtube.com/watch?v=W3aieHjyNvw&t=30", "https://youtube.com/watch?v=W3aieHjyNvw&t=30"),
    ("http://example.com", "https://example.com/"),
    ("http://example.com:8080/x?q=b&id=a&Ref=1", "https://example.com:8080/x?id=a&q=b"),
]


#: Cases of this engine's own: codes, parameters of a segment, names in capitals, repeated and empty values.
MORE = [
    ("https://a.org/x?q=a%20b&q=a+c", "https://a.org/x?q=a+b&q=a+c"),
    ("https://a.org/x?q=%7Eme%2a&id=%C3%A9", "https://a.org/x?id=%C3%A9&q=~me%2A"),
    ("https://a.org/x;session=1?page=2", "https://a.org/x?page=2"),
    ("https://a.org/x?q=100%&v", "https://a.org/x?q=100%25&v="),
    ("https://a.org/x?q=a=b", "https://a.org/x?q=a%3Db"),
]


def test_spellings_of_parameters(spark):
    got = values(spark, [u for u, _ in MORE], urls.canonical_url)
    assert got == [v for _, v in MORE]
    assert values(spark, got, urls.canonical_url) == got


def test_canonical_url_and_idempotence(spark):
    got = values(spark, [u for u, _ in URLS], urls.canonical_url)
    assert got == [v for _, v in URLS]
    assert values(spark, got, urls.canonical_url) == got


def test_hosts_are_compared_whole(spark):
    assert values(spark, ["https://www.gdcvault.com/x", "https://notgdcvault.com/x"], urls.is_denied) == [True, False]


def test_kinds_and_index_pages(spark):
    given = ["https://youtube.com/playlist?list=1", "https://youtu.be/abc", "https://github.com/a/b", "https://x.org/"]
    assert values(spark, given, urls.kind_of) == ["talk", "talk", "repo", "blog"]
    assert values(spark, given, urls.is_index_page) == [True, False, False, False]


def test_raw_urls(spark):
    got = values(spark, ["https://github.com/o/r", "https://github.com/o/r/blob/main/docs/a.md", "https://github.com/o", "https://x.org/o/r"], urls.github_raw_urls)
    assert len(got[0]) == 12 and got[0][0] == "https://raw.githubusercontent.com/o/r/HEAD/README.md"
    assert got[1] == ["https://raw.githubusercontent.com/o/r/main/docs/a.md"]
    assert got[2] == got[3] == []


def test_clean_text_is_idempotent(spark):
    got = values(spark, ["  Hello [Music]  world.\n", "[a much longer aside than twenty] stays", ""], text.clean_text)
    assert got == ["Hello world.", "[a much longer aside than twenty] stays", ""]
    assert values(spark, got, text.clean_text) == got


def test_html_to_text(spark):
    page = '<html><script>var a="</p>";</script><nav>menu</nav><p>One &amp; two</p><div>three<br/>four &#8212;</div><!-- x --></html>'
    assert values(spark, [page], text.html_to_text) == ["One & two\nthree\nfour &#8212;"]
    pages = spark.createDataFrame([(0, page), (1, None), (2, "a &lt;b&gt;")], "i int, p string")
    assert [r.t for r in text.page_text(pages, "p", "t").orderBy("i").collect()] == ["One & two\nthree\nfour —", None, "a <b>"]
    given = ["&amp;lt;", "&copy &eacute;", "&nbsp;&hearts;x", "R&D", "&#39;&#x27;", "no & reference", None]
    assert values(spark, given, text.unescape_any) == ["&lt;", "© é", " ♥x", "R&D", "''", "no & reference", None]


def test_challenge_marker_is_looked_for_at_the_top(spark):
    given = ["Please: VERIFY you are human", "x" * 700 + "verify you are human", "Just a moment... verify you are human"]
    assert values(spark, given, text.challenge_marker) == ["verify you are human", None, "verify you are human"]


def test_pseudo_cues(spark):
    long = "First one is here. " * 30 + 'Then (this)! "Quoted" end?'
    got = values(spark, ["a\n\n [Music] \nb", long], text.pseudo_cues)
    assert got[0] == ["a", "b"]
    assert got[1][0] == "First one is here." and got[1][-1] == '"Quoted" end?'


def test_labels(spark):
    df = spark.createDataFrame([(421.0,), (59.4,), (None,), (3600.0,)], "s double")
    assert [r[0] for r in df.select(text.timestamp_label(F.col("s"))).collect()] == ["7:01", "0:59", "-", "60:00"]
    link = lambda u, s: df.limit(1).select(text.deep_link(F.lit(u), F.lit(s))).first()[0]
    assert link("https://youtube.com/watch?v=a", 12.9) == "https://youtube.com/watch?v=a&t=12s"
    assert link("https://youtu.be/a", 12.9) == "https://youtu.be/a?t=12s"
    assert link("https://x.org/a", 12.9) == "https://x.org/a"
    assert values(spark, ["manual", "auto", None], text.provenance) == ["human-verified", "auto-caption", ""]


@pytest.mark.parametrize("question,expected", [("What is ECS and why use C++ in game_loops? ecs!", ["ecs", "c++", "game_loops"]), ("the of", []), ("3D C#", [])])
def test_query_terms(spark, question, expected):
    assert terms.terms_of(question) == expected
    assert values(spark, [question], terms.query_terms) == [expected]


def test_question_key(spark):
    assert values(spark, ["  Should I   use\nECS? "], text.question_key) == ["should i use ecs?"]


def test_pages_that_are_made_to_take_long(spark):
    """Begins without ends, tags without ends, ends without begins: linear, and as the plain patterns say."""
    import re
    import time

    def plain(page):
        for names, ends in ((text.DROPPED, ""), (text.BOILERPLATE, r"\b")):
            page = re.sub(rf"(?is)<({'|'.join(names)}){ends}[^>]*>.*?</\1>", " ", page)
        return re.sub(r"(?s)<[^>]+>", " ", re.sub(text.LINE_ENDS, "\n", page))

    parts = ["<script>", "</script>", "<style", ">", "</STYLE>", "<nav x>", "</nav>", "<navy>", "<formula>", "</form>", "a", " b ", "<", "<p>", "</p>", "<svg></svg>"]
    import random

    rng = random.Random(8)
    pages = ["".join(rng.choice(parts) for _ in range(rng.choice([12, 60, 400]))) for _ in range(150)]
    assert values(spark, pages, text.stripped) == [plain(p) for p in pages]
    hostile = ["<" * 1_000_000, "<script>" * 50_000, "<script " * 50_000 + "</script>", "<script></style>" * 30_000, "<nav>" * 50_000 + "</nav", "<br " * 90_000, "&" * 300_000]
    began = time.perf_counter()
    spark.createDataFrame([(p,) for p in hostile], "p string").repartition(8).select(text.stripped(F.col("p"))).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 20

import random
from html.parser import HTMLParser

import pytest

from tessera.llm.html import extract_pages, render

CASES = [
    ("<p>One<p>Two<br>three", "One\n\nTwo\nthree"),
    ("<title>T</title><body>a <b>b</b>c<script>x</script> d", "a bc d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>Name<th>N<tr><td>a<td>1<tr><td>longer<td>22</table>", "Name    N\na       1\nlonger  22"),
    ("<table><td>x<td>y</table>after", "x  y\n\nafter"),
    ("<div hidden>no</div><div style='display: none'>no<p>no</div>yes", "yes"),
    ("<details><summary>s</summary>hidden<p>hidden</details>x", "s\nx"),
    ("<details open><summary>s</summary>seen</details>", "s\nseen"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("a &lt; b &amp;amp; &copy;", "a < b &amp; ©"),
    ("<p title='a > b'>x</p><!-- <p>no</p> -->y", "x\n\ny"),
    ("<p title=\"open>x</p><p>y", "x\n\ny"),
    ("a < b <3", "a < b <3"),
    ("<template><p>no</template><noscript>no</noscript>k", "k"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<h1>H</h1>text", "H\n\ntext"),
    ("<table><tr><td colspan=2>ab<tr><td>1<td>2</table>", "ab\n1  2"),
    ("<div style='backface-visibility: hidden'>a</div><p style='content: \"display:none\"'>b</p>", "a\n\nb"),
    ("<div style='color:red;DISPLAY : None !important'>no</div>a", "a"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<i>no</i></div>a", "yes\na"),
    ("<p style='display:none;display:block'>a", "a"),
    ("<p style='background:url(a;display:none)'>a", "a"),
    ("<table><tr><td>" + "x" * 60 + "<td>b<tr><td>c<td>d</table>", "x" * 60 + "  b\nc" + " " * 61 + "d"),
    ("<ul><li>" * 40 + "deep" + "<li>next", "\n".join([" " * 62 + "- deep", " " * 62 + "- next"])),
    ("<table><tr><td colspan=300>a<td>b</table>", "a  b"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cases(source, text):
    assert render(source)[0] == text


class Words(HTMLParser):
    """All words outside hidden elements, for sources whose hidden elements are closed."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "title") or ("hidden", None) in attrs

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "title", "x-hidden")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_no_visible_word_is_lost():
    rng = random.Random(4)
    for _ in range(300):
        out = []
        for i in range(rng.randrange(1, 60)):
            out.append(rng.choice(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<ul><li>", "<li>", "</ul>", "<br>", "<h2>", "</h2>", "<a href='x'>", "</a>", "<script>var no</script>", "<x-hidden hidden>no</x-hidden>", "<span>", "</span>", "<blockquote>", "</blockquote>"]))
            out.append(f" w{i} ")
        source = "".join(out)
        want = Words()
        want.feed(source)
        got = [w for w in render(source)[0].split() if w != "-"]
        assert got == want.words, source


def test_depth_and_size():
    assert render("<div>" * 20000 + "deep")[0] == "deep"
    assert render("<table><tr><td>" * 300 + "deep")[0] == "deep"
    assert len(render('<a "' * 20000)[0]) >= 0
    assert render("<p>word " * 30000)[0].count("word") == 30000


def test_frame(spark):
    rows = [(1, "u", "<title>T</title><p>a", 5), (1, "u", "<title>T</title><p>a", 5), (None, None, None, None), (2, "v", "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").select("page_id", "url", "html")
    got = sorted((tuple(r) for r in extract_pages(df, "page_id", "url").collect()), key=str)
    assert got == sorted([(1, "u", "T", "a"), (1, "u", "T", "a"), (None, None, "", ""), (2, "v", "", "")], key=str)
    assert extract_pages(df.limit(0), "page_id").collect() == []


MISPLACED = [
    ("<table><form><tr><td>a<td>b</tr></form></table>", "a  b"),
    ("<table><tr><form><td>a</td></form></tr></table>", "a"),
    ("<form><table><tr><td>a</td></tr></form></table>b", "a\n\nb"),
    ("<table><div>text</div><tr><td>a</table>", "text\n\na"),
    ("<table><div>text<tr><td>a<td>b</table>c", "text\n\na  b\n\nc"),
    ("<table><tr><b>bold</b><td>a</table>", "bold\n\na"),
    ("<table><tr><td>a<tr><table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<table><tbody><p>x<br>y</p><tr><td>a</table>", "x\ny\n\na"),
    ("<table>a<br>b<tr><td>c</table>", "a\nb\n\nc"),
    ("<table><colgroup><td>a<td>b</table>", "a  b"),
    ("<table><caption>t<td>a</table>", "t\na"),
    ("<table><div hidden>no</div><tr><td>a<table><tr><td>b</table></table>", "a\n\nb"),
    ("<table><tr><td>a</td><script>no</script><td>b</table>", "a  b"),
]


@pytest.mark.parametrize(("source", "text"), MISPLACED)
def test_misplaced_in_tables(source, text):
    assert render(source)[0] == text


def test_no_word_of_a_table_is_lost():
    rng = random.Random(8)
    tags = "table tr td th tbody thead caption colgroup form div b p ul li span table tr td".split()
    for _ in range(2000):
        out = ["<table>"]
        for i in range(rng.randrange(1, 30)):
            out.append(f"<{'/' * (rng.random() < 0.3)}{rng.choice(tags)}>")
            if rng.random() < 0.6:
                out.append(f" word{i} ")
        source = "".join(out)
        reader = Words()
        reader.feed(source)
        assert sorted(render(source)[0].replace("- ", " ").split()) == sorted(reader.words), source

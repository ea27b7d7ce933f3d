import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.operators import adapters
from inkfold.sources import html, parsers, readers


def found(page):
    return [(e["kind"], e["text"], e["section"]) for e in html.elements(page.encode())]


def test_a_page():
    page = """<!doctype html><html><head><title>A &amp; B</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
    <nav><ul><li><a href="/x?a=1&amp;b=2">Home</a></li><li>Next<p>inner</ul></nav><!-- <p>no</p> --><h1>First
    part</h1>loose<p>one <b>two</b><br>three<p>four &copy; 5<h2>Second</h2><div>in a div<p>last</div>after
    <table><tr><td>1<td>2</tr></table><img src=x alt="a picture"><p>end"""
    assert found(page) == [
        ("title", "A & B", None), ("link", "/x?a=1&b=2", None), ("item", "Home", None), ("item", "Next", None), ("text", "inner", None),
        ("heading", "First part", "First part"), ("loose", "loose", "First part"), ("text", "one two three", "First part"), ("text", "four © 5", "First part"),
        ("heading", "Second", "Second"), ("loose", "in a div", "Second"), ("text", "last", "Second"), ("loose", "after", "Second"), ("cell", "1", "Second"),
        ("cell", "2", "Second"), ("image", "a picture", "Second"), ("text", "end", "Second"),
    ]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>cut off <b", [("text", "cut off", None)]), ("<", []), ("<p>", []), ("  <p> \n </p>", []), ("<p>a</b></i>b", [("text", "ab", None)]),
        ("<p>&am", [("text", "&am", None)]), ("<h1>x</h1></h1></div><p>y", [("heading", "x", "x"), ("text", "y", "x")]), ("<a>no href</a>", [("loose", "no href", None)]),
        ("<li>a<ul><li>b</ul>c", [("item", "a", None), ("item", "b", None), ("item", "c", None)]),
    ],
)
def test_odd_pages(page, want):
    assert found(page) == want


@pytest.mark.parametrize("content, error", [(b"plain", ValueError), (b"", ValueError), (b"\xff\xfe<p>", UnicodeDecodeError)])
def test_what_is_no_page(content, error):
    with pytest.raises(error):
        list(html.elements(content))


TAGS = st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<div>", "</div>", "<h1>", "</h1>", "<b>", "<br>", "<!-- c -->", "word ", "&amp;", " x\n", "<script>s</script>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(TAGS, max_size=40).map("".join))
def test_pieces_give_what_the_whole_gives(page, ):
    whole, before = found("<html>" + page), html.PIECE
    html.PIECE = 7
    try:
        assert found("<html>" + page) == whole
    finally:
        html.PIECE = before
    words = "".join(t for _, t, _ in whole).replace(" ", "")
    assert words == page.translate({10: None, 32: None}).replace("&amp;", "&").replace("<script>s</script>", "").replace("<!--c-->", "") \
        .replace("<br>", "").replace("<p>", "").replace("</p>", "").replace("<li>", "").replace("<ul>", "").replace("</ul>", "") \
        .replace("<div>", "").replace("</div>", "").replace("<h1>", "").replace("</h1>", "").replace("<b>", "")


def test_pages_through_parser_and_adapter(spark):
    rows = [("/a", "a", b"<h1>S</h1><p>one<p>two<img alt=z>"), ("/b", "b", b"# M\n\nplain"), ("/c", "c", b"\xff"), ("/d", "d", b"<p></p>")]
    files = spark.createDataFrame(rows, "path string, paper_id string, content binary")
    parsed = readers.parse_documents(files, "html")
    e = adapters.adapt(parsers.records(parsed)).select("parser", "paper_id", "kind", "ord", "element_id", "text", "section").collect()
    assert sorted(tuple(r) for r in e if r.parser == "html") == [
        ("html", "a", "figure", 0, "fig0", "z", "S"), ("html", "a", "text", 0, "c0", "one", "S"), ("html", "a", "text", 1, "c1", "two", "S"),
    ]
    assert [(r.paper_id, r.text, r.section) for r in e if r.parser == "mineru"] == [("b", "plain", "M")]
    raw = parsers.extract_pages(files, html.raw_rows).collect()
    assert sorted((r.paper_id, r.kind) for r in raw) == [("a", "image"), ("a", "span"), ("a", "span"), ("a", "span"), ("b", "error"), ("c", "error")]


def test_rows_of_a_file_are_handed_on_as_they_come(spark):
    files = spark.createDataFrame([("/a", "a", b"<p>x" * 2500 + b"</p>")], "path string, paper_id string, content binary")
    raw = parsers.extract_pages(files, html.raw_rows)
    assert raw.count() == 2500 and raw.select("block_no").distinct().count() == 2500


CUT_OFF = '<title>a token = &quot</title><h1>a token = &quot</h1><p>one &quot;two&quot; R&amp;D &copy<p>Q&amp<li><a href="/x&quot">y&amp;quot; &middot;</a>'


def differing(spark, tmp_path, name):
    """Rows of a query that its SQL doesn't give, and the other way round, where references are cut off."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    made = {"pages": ([(1, CUT_OFF)], "page_id long, html string"), "documents": ([(1, "# H\n\nR&amp", "en"), (2, "é", "fr")], "doc_id long, text string, lang string")}
    db = duckdb.connect()
    for t, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = [tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()]
    want = db.execute(oracle_sql()[name]).fetchall()
    assert len(ours) == len(want) > 2
    return set(ours) ^ set(want)


def test_adapted_elements_with_references_cut_off(spark, tmp_path):
    assert not differing(spark, tmp_path, "adapted_elements")


def test_embedded_pages_with_references_cut_off(spark, tmp_path):
    assert not differing(spark, tmp_path, "embedded_pages")


def test_html_elements_with_references_cut_off(spark, tmp_path):
    assert not differing(spark, tmp_path, "html_elements")


@pytest.mark.parametrize(
    "text, want",
    [
        ("a &quot", "a &quot"), ("&copy 2026", "&copy 2026"), ("R&amp", "R&"), ("R&amp D", "R&amp D"), ("&amp;quot;", "&quot;"), ("&lt;&eacute;&#233;&#xE9;", "<ééé"),
        ("&nothing;", "&nothing;"), ("&notit;", "&notit;"), ("&", "&"), ("&;&#;&#x;", "&;&#;&#x;"), ("&am<b>p;</b>x", "&x"),
    ],
)
def test_references_count_with_their_semicolon(text, want, monkeypatch):
    monkeypatch.setattr(html, "PIECE", 3)
    assert found(f"<p>{text}</p>") == [("text", want, None)]
    if "<b>" not in text:
        assert found(f'<img alt="{text}">') == [("image", want, None)] and found(f'<a href="{text}">') == [("link", want, None)]

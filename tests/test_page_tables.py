"""Rows of page tables against a tree that the standard library's parser makes."""

import random
from html.parser import HTMLParser

from gaugeflow.sources import html_tables, tables

VOID = {"br", "img", "hr", "input", "meta", "link"}


class Tree(HTMLParser):
    """Nested lists of (name, children): an end tag closes the last open element of its name."""

    def __init__(self):
        super().__init__()
        self.stack = [("page", [])]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        if tag in ("table", "tr", "td"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        places = [i for i, n in enumerate(self.stack) if i and n[0] == tag]
        if places:
            del self.stack[places[-1]:]

    def handle_data(self, data):
        if getattr(self, "cdata_elem", None) is None:
            self.stack[-1][1].append(data)


def below(node, name):
    return [x for c in node[1] if not isinstance(c, str) for x in ([c] if c[0] == name else []) + below(c, name)]


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node[1])


def expected(html):
    tree = Tree()
    tree.feed(html)
    tree.close()
    return [(t, r, [text(c).strip() for c in below(row, "td")])
            for t, table in enumerate(below(tree.stack[0], "table")) for r, row in enumerate(below(table, "tr")) if r]


PAGES = [
    "<table><tr><td>head</td></tr><tr><td>a<table><tr><td>in</td></tr><tr><td>ner</td><td>2</td></tr></table>b</td><td>c</td></tr></table><p>x",
    "<TABLE a='x>y'><tr><th>h</th><tr><td>1<td>2</tr><tr><td>3</td><td>4</table>after<table><tr><td>9</td></tr><tr><td>10</td></tr></table>",
    "<table><tr></tr><!-- <table><tr><td>no</td></tr> --><tr><td title=\"a>b\">x &amp; y &lt;</td><td/><td >z<br>w</td></tr></table>",
    "<table><tr></tr><tr><td>A<table><tr><td>x</table>B</td><td>C</td></tr></table></td></table>",
    "<table><tr></tr><tr><td><script>var a = '<td>';</script>s</td><tdx>5</tdx><td><b>bold</b> 1 < 2</td></tr>",
    "</td></table><tr><td>out</td></tr><table>", "", "plain", "<table", "<!DOCTYPE html><table><tr><tr><td>é ü</td></table>",
]


def rows_of(spark, pages):
    got = {i: [] for i in range(len(pages))}
    table = spark.createDataFrame(list(enumerate(pages)) + [(len(pages), None)], "page_id int, html string")
    for r in html_tables.table_rows(table).collect():
        got[r.page_id].append((r.table_no, r.row_no, r.cells))
    return {i: sorted(v) for i, v in got.items()}


def test_nested_and_unclosed_tables(spark):
    assert rows_of(spark, PAGES) == {i: expected(p) for i, p in enumerate(PAGES)}


def test_any_order_of_tags(spark):
    rng = random.Random(4)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td class='x'>", "1", " two ", "<b>", "</b>", "<!-- <td> -->", "</TR >"]
    pages = ["<table><tr>" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    assert rows_of(spark, pages) == {i: expected(p) for i, p in enumerate(pages)}


def test_long_page(spark):
    row = "<tr>" + "".join(f"<td>{i}</td>" for i in range(10)) + "</tr>"
    page = "<table>" + row * 300 + "<tr><td>" + "long " * 300_000 + "</table>"
    (got,) = [v for k, v in rows_of(spark, [page]).items() if k == 0]
    assert len(got) == 300 and got[0][2] == [str(i) for i in range(10)] and len(got[-1][2][0]) == 5 * 300_000 - 1


def test_a_task_gets_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """The longest task doesn't grow with the input, also when there is one file only."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert tables.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    assert tables.spread(rows).rdd.getNumPartitions() == 10


def test_bytes_that_are_no_text_are_read_as_marks(spark):
    page = "concat('<table><tr><tr><td>a', unhex('FF'), 'b<td>&lt;</table>')"
    read = html_tables.table_rows(spark.range(1).selectExpr("id AS page_id", f"CAST({page} AS STRING) AS html"))
    assert [r.cells for r in read.collect()] == [["a\ufffdb", "<"]]

"""Filing tables, text and headings. Tables come from a builder that knows the columns they should have."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tallyforge.operators import filings as L
from tallyforge.operators import markup as M

FERRIES = [["Crossings", "North", "South"], ["Passengers", "48,210", "7,305"], ["Subsidy", "(96)", "$1,204"], ["Seats taken", "61%", "8.5%"]]


def built(rng: random.Random, rows: list[list[str]]) -> str:
    """HTML that sets a table out over many grid columns.

    A column has three grid columns, a gutter, its own and one for signs behind, and empty ones
    after it. A figure's sign stands in front of it, in a cell of its own in the gutter, or with it.
    In the second row signs of every other column stand in the gutter, in the third those of the
    rest, so that each two neighbouring columns are told apart.
    """
    empty = [rng.randint(0, 3) for _ in rows[0]]
    out = ""
    for r, row in enumerate(rows):
        cells = ""
        for k, (value, pad) in enumerate(zip(row, empty)):
            m = re.fullmatch(r"([$(]?)([\d,.]+)([)%]?)", value)
            before, core, after = m.groups() if m else ("", value, "")
            style = (0 if (k + r) % 2 else 2) if r in (1, 2) else rng.randrange(3) if m else 2
            if style == 0:  # signs in cells of their own
                cells += f"<td>{before}</td><td>{core}</td><td>{after}</td>"
            elif style == 1:  # apart, in one cell over both
                cells += f"<td colspan='2'>{before} {core}</td><td>&nbsp;{after} </td>"
            else:
                cells += f"<td></td><td colspan=2>{value}</td>"
            cells += rng.choice(["<td></td>" * pad, f'<td colspan="{pad}"></td>' if pad else ""])
        out += f"<tr>{cells}</tr>{rng.choice(['', '<tr><td></td></tr>'])}"
    return f"<table><tbody>{out}</tbody></table>"


class Grid(HTMLParser):
    """Rows of (text, columns) of a rendered table."""

    def __init__(self, html):
        super().__init__()
        self.rows = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.rows[-1].append(["", int(dict(attrs).get("colspan", 1))])

    def handle_data(self, data):
        self.rows[-1][-1][0] += data


def grid(html):
    return [[tuple(c) for c in r] for r in Grid(html).rows]


def test_tables_keep_their_columns_however_they_are_set_out():
    rng = random.Random(11)
    for _ in range(300):
        width, height = rng.randint(2, 6), rng.randint(3, 7)
        rows = [["ports", *(f"pier {k}" for k in range(1, width))]]
        for r in range(height):
            figure = lambda: rng.choice(["{}", "${}", "({})", "{}%"]).format(rng.choice([f"{rng.randint(1, 99)},{rng.randint(100, 999)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", "7"]))
            rows.append([f"quay {r}", *(f"${k}{r}" if r < 2 else figure() for k in range(1, width))])
        (html,) = M.tables(built(rng, rows))
        assert grid(html) == [[(v, 1) for v in row] for row in rows]


def brute_columns(rows):
    """Column of each start, by the definition: neighbouring starts are one column unless some row has both."""
    starts = sorted({c.start for row in rows for c in row})
    column, out = 0, {}
    for k, s in enumerate(starts):
        if k and any({starts[k - 1], s} <= {c.start for c in row} for row in rows):
            column += 1
        out[s] = column
    return out


def test_columns_by_definition():
    rng = random.Random(5)
    cell = M.Cell("td", 1, 1, True)
    for _ in range(500):
        rows = []
        for _ in range(rng.randint(1, 6)):
            cuts = sorted(rng.sample(range(14), rng.randint(2, 8)))
            rows.append([M.Placed("x", a, b, cell) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.7])
        starts, number = M.columns(rows)
        assert dict(zip(starts, number.tolist())) == brute_columns(rows)


def test_headers_over_several_columns_keep_their_span():
    html = f"""<table><tr><td colspan=2></td><th colspan="7">Tonnes of grain</th></tr>
    <tr><td>Silo</td><td></td><td colspan="3">Wheat</td><td></td><td colspan=3>Barley</td></tr>
    <tr><td rowspan="2">East</td><td></td><td>410</td><td colspan="3"></td><td>88</td></tr></table>"""
    (got,) = M.tables(html)
    assert got == '<table><tr><td></td><th colspan="2">Tonnes of grain</th></tr><tr><td>Silo</td><td>Wheat</td><td>Barley</td></tr><tr><td rowspan="2">East</td><td>410</td><td>88</td></tr></table>'


def test_signs_join_their_figures():
    row = lambda *texts: [M.Cell("td", 1, 1, True, text=[t]) for t in texts]
    joined = lambda *texts: [(c.text, c.start, c.end) for c in M.placed(row(*texts))]
    assert joined("Toll", "$", "", "15") == [("Toll", 0, 1), ("$15", 1, 4)]
    assert joined("(", "15", "", ")", "%", "x") == [("(15)%", 0, 5), ("x", 5, 6)]
    assert joined(")", "9", "$") == [(")", 0, 1), ("9", 1, 2), ("$", 2, 3)]
    assert joined("$", "(", "3", ")") == [("$(", 0, 2), ("3)", 2, 4)]
    assert joined("", " ", "\xa0") == []
    assert [M.tidy(t) for t in ("( 12 )", "$ 3", "$ in thousands", "( $ 4 % )", "a  \xa0b", "“x’ <b>")] == ["(12)", "$3", "$ in thousands", "($4 %)", "a b", "\"x' &lt;b&gt;"]
    assert [M.is_figure(t) for t in ("1", "$ (3.5)%", "-", "", "12 km", "1" * 39, "1" * 40)] == [True, True, False, False, False, True, False]


def test_statements_with_definitions():
    html = """<table class="report"><tr><th>Harbour dues</th><th>Q1</th></tr>
    <tr><td><a href="#" onclick="open('defref_port-fees_Dues')">Dues</a></td><td>$ 9,120</td></tr>
    <tr><td>Rents &amp; leases<td>( 77 )
    <tr><td class="x hide">Unseen</td><td><a onclick="none">Other</a></td><td>4</td></tr>
    <tr><td><table class="authRefData"><tr><td>What dues are: 1</td></tr><tr><td>2</td><td>3</td></tr></table></td></tr></table>"""
    (got,) = M.tables(html, " Dues  by quarter ")
    assert got.startswith("<table><caption>Dues by quarter</caption><tr><th>Harbour dues</th><th>Q1</th></tr>")
    assert '<td c="port-fees:Dues">Dues</td><td>$9,120</td>' in got and "<td>Rents & leases</td><td>(77)</td>" in got
    assert "Unseen" not in got and "What dues" not in got and got.endswith("<tr><td>Other</td><td>4</td></tr></table>")


def test_what_holds_no_data_is_no_table():
    text = "<table><tr><td>Boats leave at dawn.</td></tr><tr><td>They return at dusk.</td></tr></table>"
    one_row = "<table><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>"
    words = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    three = "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert [M.tables(t) for t in (text, one_row, words, three, None, "", "<table>", "<table><tr><td>1")] == [[]] * 8
    assert len(M.tables(words.replace("d<", "5<"))) == 1


def table_of(rows):
    return built(random.Random(2), rows)


def test_text_has_tables_as_paragraphs():
    ferries = table_of(FERRIES)
    layout = "<table><tr><td>Fares rise in May.</td></tr><tr><td><p>Dogs go free.</p></td></tr></table>"
    raw = f"<html><head><title>No</title><style>p</style></head><body><p>Traffic  by\tport:</p>{ferries}<div>First<br>second</div>{layout}<script>if (a<b) x()</script></body></html>"
    assert M.plain_text(raw) == f"Traffic by port:\n\n{M.tables(ferries)[0]}\n\nFirst\nsecond\nFares rise in May.\nDogs go free.\n\n"
    assert M.plain_text("a\r\n\n\n\n  b\tc ") == "a\n\nb c\n" and M.plain_text(None) is None and M.plain_text("") == "\n"
    inside = f"<table><tr><td>Left</td></tr><tr><td>{ferries}</td></tr></table>"
    assert len(M.tables(inside)) == 1  # the outer one: its rows are the inner one's too


def test_a_stray_end_tag_ends_nothing_outside_its_table():
    html = f"<div><p><b>Bold <table><tr><td></p></b>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table> still</b></div><p>after"
    lines = M.visual_lines(html)
    assert lines == [("Bold", True), ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", False), ("still", True), ("after", False)]


def test_bold_lines():
    html = f"<body><p><strong>Routes</strong></p><p><b>Some</b> words</p><div style='FONT-WEIGHT:700'>Of <i>either</i> kind</div>plain<br><b>Piers</b><ul><li>x<li><b>Berths</b></ul><table><tr><td><b>Set apart</b></td></tr></table>{table_of(FERRIES)}<p/>end<b> </b></body>"
    lines = M.visual_lines(html)
    assert [t for t, bold in lines if bold] == ["Routes", "Of either kind", "Piers", "Berths", "Set apart"]
    assert [t for t, bold in lines if not bold] == ["Some words", "plain", "x", M.tables(table_of(FERRIES))[0], "end"]
    assert M.visual_lines("") == []


def test_long_documents_are_scanned_in_one_go():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert M.visual_lines(deep) == [("x", False)]
    wide = "<p>word</p>" * 60_000
    assert M.plain_text(wide).count("word\n") == 60_000


def test_rows_of_documents(spark):
    df = spark.createDataFrame([(1, "k", table_of(FERRIES)), (2, "k", None), (3, "k", "<p><b>Head</b></p>")], "id long, other string, html string")
    assert [(r.id, r.other, r.place) for r in M.with_tables(df).collect()] == [(1, "k", 0)]
    assert {r.id: r.text for r in M.with_text(df).collect()}[2] is None
    assert [(r.id, r.line, r.bold) for r in M.with_lines(df.where("id = 3")).collect()] == [(3, "Head", True)]
    assert M.with_text(df.limit(0)).count() == 0


def test_a_table_takes_its_caption_along(spark):
    filler = "\n\n".join(f"Paragraph {i} says what it says at some length." for i in range(12))
    text = f"{filler}\n\nThe table shows tides (in metres):\n\n<table><tr><td>{'x' * 80}</td></tr></table>\n\n{'y' * 700}\n\n<table>{'z' * 700}</table>"
    chunks = [r.text for r in L.pack(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 620).orderBy("chunk").collect()]
    held = [c for c in chunks if "x" * 80 in c]
    assert len(held) == 1 and held[0].startswith("The table shows tides (in metres):\n\n<table>")
    assert "y" * 620 in chunks and chunks[-1] == f"<table>{'z' * 700}</table>"  # clipped, whole


def test_titles_stand_for_items(spark):
    lines = ["Item 2.02 Results", "## ITEM 7a. Risk", "## Risk Factors  ", "see Risk Factors above", "Management’s Discussion and Analysis of Financial Condition and Results", "Financial Statements and Supplementary Data:", "Items 3"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(L.item_of(F.col("line")).alias("i")).collect()
    assert [r.i for r in got] == ["2.02", "7A", "1A", None, "7", "8", None]


def test_cut_references_in_sql_and_query(spark, tmp_path):
    """A reference cut before its semicolon is decoded by html_to_text and by its SQL alike."""
    import duckdb

    from tallyforge import registry

    con = duckdb.connect()
    con.sql("CREATE TABLE pages AS SELECT 1 AS page_id, 'u' AS url, '<html><body><p>fish &amp; chips&amp</p><p>a &amp;lt; b &lt 3 &copy 2001 &middot&nbsp;x</p></body></html>' AS html")
    con.sql("CREATE TABLE documents AS SELECT 1 AS doc_id, 'plain &amp text' AS text, 'en' AS lang, 's' AS source, 15 AS n_chars")
    for t in ("pages", "documents"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = {r.id: r.text for r in registry.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    assert found == dict(con.sql(registry.oracle_sql()["html_to_text"]).fetchall())
    assert found[1].startswith("fish & chips&\n")

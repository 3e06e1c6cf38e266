import datetime

from pyspark.sql import functions as F

from docketry.operators import answers, directory, entities, facts, segmentation
from docketry.sources import artifacts, html

STAFF = """<h2>Head Office</h2><table><tr><th>Name</th><th>Designation</th><th>Email ID</th><th>Tel. No</th><th>Staff No</th></tr>
<tr><td>ASHA RAO</td><td>Manager</td><td>asha [at] example [dot] org</td><td>022-123 45</td><td>7</td></tr>
<tr><td>ASHA RAO</td><td>Manager</td><td>asha [at] example [dot] org</td><td>022-123 45</td><td>7</td></tr>
<tr><td> </td><td>Manager</td></tr><tr><td>Li<br>Wei<td>Officer</table><h2>Branch</h2><table><caption>Desk</caption><tr><td>x<table><tr><td>inner</td></tr></table></td><td>y</td></tr></table>"""
LIST = """<table><tr><th>Date</th><th>Title</th></tr><tr><td>Jan 05, 2024</td><td><a href="/orders/jan-2024/a_771.html" title="Order in the matter of A">A</a></td></tr>
<tr><td>05-02-2024</td><td><a href="files/b.pdf?x=1">Final order of B</a></td></tr><tr><td>none</td><td><a href="https://o.example.org/v?id=9">C order</a></td></tr><tr><td>plain</td></tr></table>
<input type='hidden' name='nextValue' value='3'/><input type='hidden' name="totalpage" value="12"><a title='Next'>n</a>#@#<table><tr><td><a href="/z">Z</a></td></tr></table>"""


def pages(spark, *html_texts):
    return spark.createDataFrame([(i, "https://w.example.org/list/index.html", h) for i, h in enumerate(html_texts)], "page_id long, url string, html string")


def test_tables_and_people(spark):
    rows = html.tables(pages(spark, STAFF, None, "", "<table><tr><td>open")).cache()
    got = [(r.page_id, r.table_no, r.row_no, r.heading, r.cells) for r in rows.orderBy("page_id", "table_no", "row_no").collect()]
    assert (0, 0, 4, "Head Office", ["Li Wei", "Officer"]) in got and (3, 0, 0, None, ["open"]) in got
    assert (0, 1, 0, "Desk", ["x", "y"]) in got and any(g[4] == ["inner"] for g in got)
    people = html.people(rows, "page_id").orderBy("name").collect()
    assert [(p.name, p.office, p.email, p.phone, p.staff_no) for p in people] == [("Asha Rao", "Head Office", "asha@example.org", "02212345", "7"), ("Li Wei", "Head Office", None, None, None)]


def test_listing_and_paging(spark):
    source = pages(spark, LIST, None)
    got = [(r.title, r.day, r.link, r.link_kind, r.external_id) for r in html.listing(source).orderBy("row_no").collect()]
    assert got == [
        ("Order in the matter of A", datetime.date(2024, 1, 5), "https://w.example.org/orders/jan-2024/a_771.html", "detail", "771"),
        ("Final order of B", datetime.date(2024, 2, 5), "https://w.example.org/list/files/b.pdf?x=1", "direct_file", None),
        ("C order", None, "https://o.example.org/v?id=9", "detail", "9"),
    ]
    assert [tuple(r) for r in html.paging(source).orderBy("page_id").collect()] == [(0, "3", 12, True), (1, "1", None, False)]
    page = pages(spark, "<title>T</title><h1>The <b>order</b></h1>Mar 3, 2021 <iframe src='/a/b.PDF'></iframe>", "<title>Only</title>", None)
    got = [tuple(r)[1:] for r in html.details(page).orderBy("page_id").collect()]
    assert got == [("The order", datetime.date(2021, 3, 3), "/a/b.PDF"), ("Only", None, None), (None, None, None)]


def test_artifacts(spark, tmp_path):
    cases = spark.createDataFrame([("c1", "q", ["a"]), ("c2", None, None)], "case_id string, query string, tags array<string>")
    summary = spark.createDataFrame([(2, 0.5)], "cases int, pass_rate double")
    artifacts.write_run(str(tmp_path / "run"), cases, {"by_case": cases}, summary)
    back = artifacts.read_cases(spark, str(tmp_path / "run/cases"), "case_id string, query string, tags array<string>").cache()
    assert sorted(r.case_id for r in back.collect()) == ["c1", "c2"] and back.where("bad_line is not null").count() == 0
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "run/cases")).collect())
    assert lines.splitlines()[0].startswith('{"case_id"') and '"query":null' in lines
    assert "- pass_rate: 0.5" in [r.value for r in spark.read.text(str(tmp_path / "run/summary.md")).collect()]
    assert spark.read.csv(str(tmp_path / "run/by_case"), header=True).count() == 2


def decided(spark, rows, **more):
    df = spark.createDataFrame(rows, "q int, c string, s double, e boolean, r int")
    return {x.q: (x.selected, x.clarify) for x in answers.decide(df, "q", "c", "s", "e", **more).collect()}


def test_decisions(spark):
    rows = [(1, "a", 0.5, False, 0), (2, "a", 0.3, False, 0), (3, "a", 0.8, False, 0), (3, "b", 0.79, False, 0), (4, "a", 0.8, True, 0), (4, "b", 0.74, False, 0)]
    rows += [(5, "b", 0.95, False, 0), (5, "a", 0.95, False, 0), (6, "a", 0.7, False, 0), (6, "b", 0.65, False, 1)]
    got = decided(spark, rows)
    assert got == {1: ("a", False), 2: (None, False), 3: (None, True), 4: ("a", False), 5: ("a", False), 6: (None, True)}
    assert decided(spark, rows, court=F.col("q") == 6, bucket_rank="r")[6] == ("a", False)
    assert decided(spark, []) == {}


def test_crawl_and_votes(spark):
    df = spark.createDataFrame([("a", p, p <= 4) for p in range(1, 15)] + [("b", p, True) for p in range(1, 4)], "k string, p int, changed boolean")
    assert sorted(map(tuple, answers.crawl_end(df, "k", "p", "changed").collect())) == [("a", 10, True), ("b", 3, False)]
    votes = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (1, None, 9.0), (2, "z", None)], "k int, c string, w double")
    assert sorted(map(tuple, answers.weighted_vote(votes, "k", "c", "w").collect())) == [(1, "x", 1.0), (2, "z", None)]
    said = spark.createDataFrame([("It may be so, and I do not know",), (None,), ("one two three four five six seven eight nine ten eleven twelve",)], "t string")
    assert [r[0] for r in said.select(answers.direct_confidence(F.col("t"))).collect()] == [0.25, 0.57, 0.62]


def test_tags(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "i int, t array<string>")
    ids = lambda **k: sorted(r.i for r in answers.with_tags(df, "t", **k).collect())
    assert ids() == [1, 2, 3] and ids(include=("a", "b")) == [1] and ids(exclude=("b",)) == [2, 3] and ids(include=(" ",)) == [1, 2, 3]


def test_names(spark):
    t = spark.createDataFrame([("M/s Foo & Co Ltd. v. Bar",), ("Appeal filed by Ann Lee.",), ("Order in the matter of X Y",), ("",), (None,)], "t string")
    got = [r[0] for r in t.select(directory.title_entities(F.col("t"))).collect()]
    assert got == [["M/s Foo & Co Ltd", "Bar"], ["Ann Lee"], ["X Y"], [], []]
    variants = t.select(directory.alias_variants(F.col("t"))).first()[0]
    assert variants[:5] == ["foo and co ltd v bar", "foo and co ltd", "bar", "foo and co ltd vs bar", "bar vs foo and co ltd"] and "foo and co limited" in variants


def test_offices(spark):
    offices = spark.createDataFrame([(1, "Northern Regional Office", "Delhi", ["nro"]), (2, "Head Office", "Mumbai", ["ho"])], "id int, name string, city string, aliases array<string>")
    keys = directory.office_keys(offices, "id", "name", city="city", aliases="aliases")
    hints = spark.createDataFrame([(1, "Delhi"), (2, "call the delhi nro"), (3, ""), (4, "head office")], "h int, hint string")
    got = {(r.h, r.office): r.score for r in directory.office_scores(hints, keys, "h", "hint").collect()}
    assert got == {(1, 1): 170, (2, 1): 145, (4, 2): 110}
    label = offices.select(directory.office_label(F.col("name"), F.col("city"), F.lit("branch"), {"nro": ("northern regional",)})).collect()
    assert [r[0] for r in label] == ["nro", "mumbai branch"]


def test_tidy():
    def chunk(heading, body):
        return {"heading": heading, "chunk_text": body, "token_count": segmentation.count_tokens(body)}

    body = "word " * 200
    got = segmentation.tidy([chunk("1. Facts", "1. Facts"), chunk("1. Facts", body), chunk("2. Order", "so ordered"), chunk("3. End", body), chunk(None, "Page 3 of 3")])
    assert [c["heading"] for c in got] == ["1. Facts", "3. End"] and [c["chunk_index"] for c in got] == [0, 1]
    assert got[0]["chunk_text"].startswith("1. Facts word") and got[0]["chunk_text"].endswith("so ordered") and got[1]["chunk_text"].endswith("Page 3 of 3")
    assert segmentation.tidy([]) == [] and len(segmentation.tidy([chunk(None, "alone")])) == 1
    full = chunk("A", "word " * 1000)
    assert len(segmentation.tidy([full, chunk("B", "word " * 79)])) == 2


def test_price_rows(spark):
    body = "Period table\n1. 01-02-2020 to 28.02.2020 10.50 20 25.5 9 95.2% slow rise 2) 1/3/2020 - 31/3/2020 1,200 900 -25% fell on news"
    df = spark.createDataFrame([(1, 1, body), (1, 2, body), (2, 1, None), (3, 1, "no table")], "doc int, page int, body string")
    got = [tuple(r) for r in facts.price_rows(df, "doc", "page", "body").orderBy("period_no").select("doc", "period_no", "from_day", "to_day", "first_price", "last_price", "high", "low", "percentage", "rationale").collect()]
    day = datetime.date
    assert got == [(1, 1, day(2020, 2, 1), day(2020, 2, 28), 10.5, 20.0, 25.5, 9.0, 95.2, "slow rise"), (1, 2, day(2020, 3, 1), day(2020, 3, 31), 1200.0, 900.0, 1200.0, 900.0, -25.0, "fell on news")]
    labels = spark.createDataFrame([("x\nPlace: New Delhi\nDate: March 3, 2021",), ("Dated: 03.04.2021",), (None,)], "t string")
    assert [tuple(r) for r in labels.select(facts.place_label(F.col("t")), facts.date_label(F.col("t"))).collect()] == [("New Delhi", day(2021, 3, 3)), (None, day(2021, 4, 3)), (None, None)]
    stated = spark.createDataFrame([("paid 1,000.5 in all", 1000.0), ("none", 1.0), (None, 1.0), ("5", None)], "t string, v double")
    assert [r[0] for r in stated.select(facts.states_value(F.col("t"), F.col("v"))).collect()] == [True, False, False, False]


def test_choose(spark):
    replies = ["the second one", "3", "option 1", "9", "beta", "order", "", None]
    df = spark.createDataFrame([(i, r, ["Order of Alpha", "Order of Beta", "Gamma"]) for i, r in enumerate(replies)], "i int, r string, t array<string>")
    assert [r[0] for r in df.select(answers.choose(F.col("r"), F.col("t"))).collect()] == [2, 3, 1, None, 2, None, None, None]


def test_chunks_hold_every_word():
    body = "INTRODUCTION\n" + " ".join(f"Word{i} is here now." for i in range(300)) + "\n1. Findings\n" + " ".join(f"Later{i} stands alone;" for i in range(100)) + "\n1.1 Reasons\n" + "x" * 30 + " " + "run " * 500
    plain = segmentation.chunk_text(body, 80, 100, 0)
    said = " ".join(c["chunk_text"] for c in plain).split()
    lines = body.split("\n")
    assert said == " ".join((lines[1], lines[3], lines[5])).split()
    assert all(c["token_count"] <= 100 for c in plain) and [c["chunk_index"] for c in plain] == list(range(len(plain)))
    assert {c["heading"] for c in plain} == {"INTRODUCTION", "1. Findings", "1. Findings > 1.1 Reasons"}
    lapped = [c["chunk_text"] for c in segmentation.chunk_text(body, 80, 100, 10) if c["heading"] == "INTRODUCTION"]
    assert len(lapped) > 3 and all(b.startswith(a[a.rfind("Word") :]) or a[a.rfind("Word") :] in b for a, b in zip(lapped, lapped[1:], strict=False))
    assert segmentation.chunk_text("") == [] and segmentation.chunk_text("one") == [{"chunk_index": 0, "heading": None, "chunk_text": "one", "token_count": 1}]

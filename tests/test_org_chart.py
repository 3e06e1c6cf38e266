"""Organisation charts by the structure of their pages."""

from pyspark.sql import functions as F

from docketry.operators import people
from docketry.sources import html

PAGE = """
<body><h1>Organisation</h1><div class=chart><div class=info><h3>ANITA RAO</h3><h4>Chairperson</h4><h5>anita[at]office[dot]org</h5></div>
<div><h3>B. Sen<br>Gupta</h3><h4>Whole-Time Member</h4></div><div><h3>Nobody</h3></div><p><div><h3>Unclosed Name<h4>Member</div></div></section>
<div><h2>ANITA RAO, Chairperson</h2><table><thead><tr><th>Department<th>Executive Director<th>Contact</thead><tbody>
<tr><td>Legal</td><td>C. Iyer, Executive Director</td><td>022-2644 9000 c.iyer[at]office[dot]org</td></tr>
<tr><td>Legal</td><td>C. Iyer, Executive Director</td><td>022-2644 9000 c.iyer[at]office[dot]org</td></tr><tr><td>Finance</td><td></td><td></td></tr><tr><td></td><td>X</td></tr></tbody></table></div>
<div><h2>D. Shah</h2><table><tr><td>Enquiries<td>E. Nair</table></div>
"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "</div><div><h3>A B</h3><h4>C</h4>")], "page_id int, html string")
    got = {(r.page_id, r.under, tuple(sorted(r.headings.items()))) for r in html.cards(pages).collect()}
    assert got == {
        (1, "Organisation", (("h3", "ANITA RAO"), ("h4", "Chairperson"), ("h5", "anita[at]office[dot]org"))), (1, "Organisation", (("h3", "B. Sen Gupta"), ("h4", "Whole-Time Member"))),
        (1, "Organisation", (("h3", "Unclosed Name"), ("h4", "Member"))), (4, None, (("h3", "A B"), ("h4", "C"))),
    }
    found = {(r.name, r.designation, r.email) for r in html.chart_people(html.cards(pages), "page_id").where("page_id = 1").collect()}
    assert found == {("Anita Rao", "Chairperson", "anita@office.org"), ("B. Sen Gupta", "Whole-Time Member", None), ("Unclosed Name", "Member", None)}


def test_rows_under_their_leaders(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    rows = html.org_rows(html.tables(pages), "page_id")
    got = {(r.leader_name, r.leader_role, r.department, r.director_name, r.director_role, r.director_email, r.director_phone) for r in rows.collect()}
    assert got == {
        ("Anita Rao", "Chairperson", "Legal", "C. Iyer", "Executive Director", "c.iyer@office.org", "02226449000"), ("Anita Rao", "Chairperson", "Finance", None, None, None, None), ("D. Shah", None, "Enquiries", "E. Nair", None, None, None),
    }
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    org = rows.select(F.lit("orgchart").alias("source_type"), F.lit("u").alias("source_url"), "row_key", "leader_name", "leader_role", "department", "director_name", "director_email", "director_phone")
    nobody = spark.range(0).select(*text(*people.SHAPE))
    board = spark.range(0).select(*text("source_type", "source_url", "row_key", "name", "board_role", "board_category"))
    found = {(r["name"], r.group) for r in people.keyed(people.source_rows(nobody, board, org)).collect()}
    assert found == {("Anita Rao", "chairperson"), ("D. Shah", "other"), ("C. Iyer", "executive_director"), ("E. Nair", "executive_director")}

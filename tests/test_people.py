"""Names, groups and people against plain versions that compare every pair."""

import difflib
import itertools

from pyspark.sql import functions as F

from docketry.operators import entities, people
from docketry.plans import people as plans


def like(a, b):
    return difflib.SequenceMatcher(a=a, b=b).ratio()


def plain_score(q, c):
    """The description of the name score, for folded names."""
    if not q or not c:
        return 0.0, "none"
    if q == c:
        return 1.0, "exact"
    qw, cw = q.split(), c.split()
    together = like("".join(qw), "".join(cw))
    common = len(set(qw).intersection(cw)) / max(len(set(qw)), len(set(cw)))
    if (c.find(q) >= 0 or q.find(c) >= 0) and (len(qw) >= 2 or len(q) >= 5):
        return min(0.97, 0.79 + 0.12 * together + (0.05 if qw[-1] == cw[-1] else 0)), "partial"
    if len(qw) >= 2 and qw[-1] == cw[-1] and like(qw[0], cw[0]) >= 0.72:
        return min(0.96, 0.58 + 0.22 * like(qw[0], cw[0]) + 0.16 * common + 0.08 * together), "name_tokens"
    score = 0.42 * like(q, c) + 0.33 * together + 0.25 * common + (0.05 if qw[-1] == cw[-1] else 0)
    return min(0.95, score - (0.08 if len(qw) == 1 and len(q) < 4 else 0)), "fuzzy"


NAMES = ["Shri Anil Kumar", "Anil Kumar", "Anil Kumara", "Kumar", "kumar", "Sunil Kumaran", "Annil Kumar", "José Pérez", "Jose Perez", "Öğüt", "Ogut", "A & B Traders", "A and B Traders", "M/s Traders", "Prof Traders", "Zed", "ze", "", None, "a b", "xa by"]


def test_fuzzy_against_all_pairs(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id int, name string")
    found = entities.fuzzy_candidates(rows.toDF("query_id", "query"), rows.toDF("value_id", "value"), 0.55)
    got = {(r.query_id, r.value_id): (r.score, r.how) for r in found.collect()}
    folded = [entities.normalize_fuzzy(n) for n in NAMES]
    assert folded[0] == "anil kumar" and folded[9] == folded[10] == "ogut" and folded[13] == "traders" and folded[14] == "prof traders"
    want = {}
    for (i, a), (j, b) in itertools.product(enumerate(folded), repeat=2):
        score, how = plain_score(a, b)
        if score >= 0.55:
            want[i, j] = (round(score, 4), how)
    assert got == want
    assert got[9, 10] == (1.0, "exact") and got[3, 5][1] == "partial" and round(got[3, 5][0], 2) == 0.86 and got[1, 6][1] == "name_tokens"


def test_fuzzy_query_against_all_parts(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.query_id, r.value_id): (r.score, r.how) for r in plans.fuzzy_match(spark, sf).collect()}
    want = {}
    for r in plans.part_names(spark, sf).collect():
        for i, name in enumerate(plans.NAMES):
            score, how = plain_score(entities.normalize_fuzzy(name), entities.normalize_fuzzy(r.value))
            if score >= 0.72:
                want[i, r.value_id] = (round(score, 4), how)
    assert got == want and len(got) > 20


def plain_band(words, how, score, shared, first, last, second):
    gap = second is None or second <= round(score - 0.05, 6)
    if how == "exact":
        return "high"
    if words == 1:
        return "high" if gap and score >= 0.92 else "medium" if gap and score >= 0.82 else "low"
    if gap and score >= 0.84 and first >= 0.86 and shared >= 0.5:
        return "high"
    if gap and (score >= 0.82 and last >= 0.995 and first >= 0.45 or score >= 0.88 and shared >= 0.5):
        return "medium"
    return "low"


def test_bands(spark):
    queries = ["anil kumar", "anill kumar", "anil kumr", "kumar", "sunil", "ravi sharma", "ravi sharme", "x", "priya nair", "pria nair"]
    values = ["Anil Kumar", "Anil Kumaran", "Sunil Kumar", "Ravi Sharma", "Ravi Sharman", "Priya Nair", "Priyanka Nair", "Ravikant Sharma"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    names = spark.createDataFrame(list(enumerate(values)), "value_id int, value string")
    got = {r.query_id: (r.value, r.band, r.ambiguous) for r in entities.ranked_matches(entities.fuzzy_candidates(asked, names)).where("rank = 1").collect()}
    want = {}
    for i, q in enumerate(queries):
        scored = []
        for v in values:
            c = entities.normalize_fuzzy(v)
            score, how = plain_score(q, c)
            if score >= 0.72:
                qw, cw = q.split(), c.split()
                scored.append((-round(score, 4), v, how, round(len({*qw} & {*cw}) / max(len(qw), len(cw)), 4), round(like(qw[0], cw[0]), 4), round(like(qw[-1], cw[-1]), 4)))
        if scored:
            scored.sort()
            top, second = scored[0], -scored[1][0] if len(scored) > 1 else None
            band = plain_band(len(q.split()), top[2], -top[0], *top[3:], second)
            close = second is not None and -top[0] < 0.84 and second >= round(-top[0] - 0.05, 6)
            want[i] = (top[1], band, band == "medium" or close)
    assert got == want and {b for _, b, _ in got.values()} == {"high", "medium", "low"} and {a for _, _, a in got.values()} == {True, False}


def test_designation_groups(spark):
    cases = [("Assistant Manager", None, None, None, "assistant_manager"), ("assistant  manager (IT)", None, None, None, "assistant_manager"), ("Deputy Manager", None, None, None, "staff"), ("Manager", None, None, None, "manager"),
             ("Dy. General Manager", None, None, None, "staff"), ("General Manager", None, None, None, "general_manager"), ("Officer, CGM", None, None, None, "chief_general_manager"), ("Chairman", None, None, None, "staff"),
             (None, "chairperson", None, None, "chairperson"), ("Manager", "WTM", None, None, "whole_time_member"), ("x", None, "RBI-nominee", None, "board_member"), (None, None, None, "Member", "board_member"), (None, None, None, None, "other"),
             ("  ", "office contact", None, None, "office_contact"), (None, "department-head", None, None, "staff"), ("Regional Director (North)", "staff", None, None, "regional_director"), ("Executive Director", "regional_director", None, None, "regional_director")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, r string, c string, b string, want string")
    got = df.select("k", "want", entities.designation_group(*map(F.col, "trcb")).alias("got")).orderBy("k").collect()
    assert [(r.k, r.got) for r in got] == [(r.k, r.want) for r in got]


def plain_clusters(rows):
    """Greedy clusters by their description, holding whole rows."""
    scores = {"same_staff_no": 100, "same_email": 100, "same_phone": 100, "same_board_role": 60, "same_designation_group_and_department": 60, "same_designation_group_and_office": 45, "same_leadership_designation_group": 45, "same_designation_group_with_missing_context": 25}
    found = []
    for r in rows:
        options = []
        for k, held in enumerate(found):
            any_of = lambda c, held=held: bool(r[c]) and any(x[c] == r[c] for x in held)
            why = [n for n, c in (("same_staff_no", "staff_key"), ("same_email", "email_key"), ("same_phone", "phone_key")) if any_of(c)]
            sure = bool(why)
            if any_of("group"):
                why += ["same_designation_group_and_department"] * any_of("department_key") + ["same_designation_group_and_office"] * any_of("office_key")
                why += ["same_leadership_designation_group"] * (r["group"] in ("chairperson", "whole_time_member", "board_member", "executive_director"))
                why += ["same_designation_group_with_missing_context"] * (not r["department_key"] and not r["office_key"])
            why += ["same_board_role"] * any_of("board_key")
            against = lambda c, held=held: bool(r[c]) and any(x[c] for x in held) and all(x[c] != r[c] for x in held)
            if why and (sure or not against("group") and not (against("department_key") and against("office_key"))):
                options.append((-sum(scores[w] for w in why), k))
        if options:
            found[min(options)[1]].append(r)
        else:
            found.append([r])
    return {(x["source_type"], x["row_key"]): k + 1 for k, held in enumerate(found) for x in held}


def test_clusters_and_merged_people(spark):
    rows = plans.directory_rows(spark, "/root/testdata/sf0.01")
    held = [r.asDict() for r in rows.collect()]
    held.sort(key=lambda r: (r["name_key"], -r["source_rank"], -r["role_rank"], -r["richness"], r["name"].lower(), r["row_key"]))
    want = {}
    for name, group in itertools.groupby(held, key=lambda r: r["name_key"]):
        want |= {(name, *k): v for k, v in plain_clusters(list(group)).items()}
    found = people.clusters(rows).collect()
    assert {(r.name_key, r.source_type, r.row_key): r.cluster for r in found} == want and len(found) == len(held)
    assert max(want.values()) > 3
    out = people.merged(rows, people.clusters(rows)).collect()
    assert len(out) == len({(k[0], v) for k, v in want.items()}) and sum(r.source_rows for r in out) == len(held)
    assert len({r.person_id for r in out}) == len(out)
    by_row = {(r["source_type"], r["row_key"]): r for r in held}
    for r in out:
        own = [by_row[k[1:]] for k, v in want.items() if (k[0], v) == (r.name_key, r.cluster)]
        emails = [(x["source_rank"], len(x["email"]), x["email_key"]) for x in own if x["email_key"]]
        assert (r.email is None) == (not emails) and (not emails or r.email in {e for a, b, e in emails if (a, b) == max(emails)[:2]})
        assert set(r.source_types) == {x["source_type"] for x in own} and r.aliases[0] == r["name"] and r.reasons[0].startswith("seed:")
    assert people.clusters(rows.limit(0)).count() == 0


def test_three_sources_give_one_shape(spark):
    shape = "source_type string, source_url string, row_key string, name string, designation string, role_group string, department string, office string, email string, phone string, joined string, staff_no string"
    directory = spark.createDataFrame([("directory", "u", "1", "ANIL K. KUMAR", "Manager", "staff", "Legal", "HQ", None, None, None, "7")], shape)
    board = spark.createDataFrame([("board_members", "u", "2", "Smt Rao", "Chairperson, Board", "Chairperson"), ("board_members", "u", "3", "B", "Member (RBI)", "RBI nominee")], "source_type string, source_url string, row_key string, name string, board_role string, board_category string")
    org = spark.createDataFrame([("orgchart", "u", "4", "Lead Er", "Head, Legal", "Legal", "", None, None), ("orgchart", "u", "5", " ", "Head", "IT", "EX DIR", "ed[at]x[dot]org", "1")], "source_type string, source_url string, row_key string, leader_name string, leader_role string, department string, director_name string, director_email string, director_phone string")
    got = {r.row_key: r for r in people.source_rows(directory, board, org).collect()}
    assert set(got) == {"1", "2", "3", "4:leader", "5:executive_director"}
    assert (got["2"].designation, got["2"].role_group, got["3"].designation, got["3"].role_group) == ("Chairperson", "chairperson", "Member", "board_member")
    assert got["4:leader"].role_group == "department_head" and got["5:executive_director"].email == "ed[at]x[dot]org"
    keys = {r.row_key: (r.name_key, r.group, r.email_key) for r in people.keyed(people.source_rows(directory, board, org)).collect()}
    assert keys["2"] == ("rao", "chairperson", "") and keys["5:executive_director"] == ("ex dir", "executive_director", "ed@x.org")


def test_generated_code_compiles(spark):
    """Without a fall-back to interpreted rows: a projection whose code is too long fails here."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = plans.directory_rows(spark, "/root/testdata/sf0.001")
        assert people.merged(rows, people.clusters(rows)).count() > 0 and rows.count() > 0
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)

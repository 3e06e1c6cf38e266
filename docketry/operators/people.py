"""People from several directories: rows of one shape, clusters of rows that are one person, and a record a person.

Rows of one name are taken in the order of their sources; each joins the cluster with the strongest reasons, if it may, else it
starts one. A cluster is held as sets of values, not as rows, so a task's memory follows the different values of a name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import entities

#: How much a source and a role are trusted.
SOURCE_PRIORITY = {"directory": 140, "orgchart": 120, "regional_offices": 110, "board_members": 105, "contact_us": 60}
ROLE_PRIORITY = {"chairperson": 120, "wtm": 110, "executive_director": 100, "regional_director": 95, "department_head": 80, "chief_vigilance_officer": 75, "office_contact": 70, "staff": 60}
LEADERSHIP = ("chairperson", "whole_time_member", "board_member", "executive_director")
#: What a reason to merge counts.
REASON_SCORE = {
    "same_staff_no": 100, "same_email": 100, "same_phone": 100, "same_board_role": 60, "same_designation_group_and_department": 60,
    "same_designation_group_and_office": 45, "same_leadership_designation_group": 45, "same_designation_group_with_missing_context": 25,
}
IDENTITY = ("same_staff_no", "same_email", "same_phone")
SHAPE = ("source_type", "source_url", "row_key", "name", "designation", "role_group", "department", "office", "email", "phone", "joined", "staff_no", "board_role", "board_category")


def title_role(title: Column) -> Column:
    """The role group that a title names, or null."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(low.contains("chair"), "chairperson").when(low.rlike("whole[- ]time member"), "wtm").when(low.contains("executive director"), "executive_director")
        .when(low.contains("regional director"), "regional_director").when(low.contains("head"), "department_head")
    )


def source_rows(people: DataFrame, board: DataFrame, org: DataFrame) -> DataFrame:
    """One shape for directory people (SHAPE's columns but the board's), board members (source_type, source_url, row_key, name,
    board_role, board_category) and organisation rows (source_type, source_url, row_key, leader_name, leader_role, department,
    director_name, director_email, director_phone), which give their leader and their executive director."""
    category = F.regexp_replace(F.lower(F.trim("board_category")), "[- ]", "_")
    role = F.when(category == "chairperson", "chairperson").when(category == "whole_time_member", "wtm").when(category.isin("part_time_member", "government_nominee", "rbi_nominee"), "board_member")
    said = text.whitespace_or_null(F.col("board_role"))
    members = board.withColumns({"designation": F.when(said.contains(","), F.split(said, ",", 2)[0]).otherwise(F.trim(F.split(said, r"\(", 2)[0])), "role_group": role})
    named = lambda c: text.person_name(text.whitespace_or_null(F.col(c)))
    leaders = org.select("source_type", "source_url", F.concat("row_key", F.lit(":leader")).alias("row_key"), named("leader_name").alias("name"), F.col("leader_role").alias("designation"), title_role(F.col("leader_role")).alias("role_group"), "department")
    directors = org.select("source_type", "source_url", F.concat("row_key", F.lit(":executive_director")).alias("row_key"), named("director_name").alias("name"), F.lit("Executive Director").alias("designation"), F.lit("executive_director").alias("role_group"), "department", F.col("director_email").alias("email"), F.col("director_phone").alias("phone"))
    out = people
    for more in (members, *(x.where("name is not null") for x in (leaders, directors))):
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*SHAPE)


def keyed(rows: DataFrame, office_key: Column | None = None) -> DataFrame:
    """rows with what they are compared by: name_key, group and keys of values; rows without a name go. office_key: see directory.office_label."""
    # a projection for each step: in one, their generated code is too long to compile
    # bound, as the filter on the key is pushed down with all that it is made of
    name = text.bound(text.whitespace_or_null(F.col("name")), text.person_name)
    rows = rows.withColumn("clean", F.btrim(F.regexp_replace(name, r"(?i)^\s*(?:shri|smt|mrs|mr|ms|dr)\.?\s+", ""), F.lit(" ,.")))
    rows = rows.withColumn("name_key", text.lookup_key(F.col("clean"))).where(F.coalesce("name_key", F.lit("")) != "")
    rank = lambda c, table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(0))
    held = ("designation", "department", "office", "email", "phone", "joined", "staff_no", "board_role", "board_category")
    rows = rows.withColumn("__full", F.transform(F.array(*[F.col(c) for c in held]), lambda v: F.coalesce(text.whitespace_or_null(v), F.lit(""))))
    rows = rows.withColumn("__keys", F.transform(F.array(*[F.col("__full")[held.index(c)] for c in ("department", "office", "board_role")]), text.lookup_key))
    at = {c: F.col("__full")[k] for k, c in enumerate(held)}
    rows = rows.withColumns({
        "department_key": F.col("__keys")[0], "office_key": F.col("__keys")[1] if office_key is None else F.coalesce(office_key, F.lit("")),
        "email_key": F.coalesce(text.email(F.col("email")), F.lit("")), "phone_key": at["phone"], "staff_key": at["staff_no"], "board_key": F.col("__keys")[2],
        "source_rank": rank("source_type", SOURCE_PRIORITY), "role_rank": rank("role_group", ROLE_PRIORITY), "richness": F.size(F.filter("__full", lambda v: v != "")),
    }).drop("__full", "__keys")
    return entities.with_group(rows, "group", "designation", "role_group", "board_category", "board_role")


@dataclass
class Cluster:
    """The values of the rows merged so far."""

    staff: set = field(default_factory=set)
    emails: set = field(default_factory=set)
    phones: set = field(default_factory=set)
    groups: set = field(default_factory=set)
    departments: set = field(default_factory=set)
    offices: set = field(default_factory=set)
    boards: set = field(default_factory=set)

    def add(self, r: dict) -> bool:
        """True if the row has a value that is new here."""
        new = False
        for held, c in ((self.staff, "staff_key"), (self.emails, "email_key"), (self.phones, "phone_key"), (self.groups, "group"), (self.departments, "department_key"), (self.offices, "office_key"), (self.boards, "board_key")):
            if r[c] and r[c] not in held:
                held.add(r[c])
                new = True
        return new

    def reasons(self, r: dict) -> dict[str, str]:
        """Why the row may be this person: the reason and the value that it rests on."""
        group, department, office = r["group"], r["department_key"], r["office_key"]
        out = {name: r[c] for name, held, c in (("same_staff_no", self.staff, "staff_key"), ("same_email", self.emails, "email_key"), ("same_phone", self.phones, "phone_key")) if r[c] in held}
        if group in self.groups:
            if department in self.departments:
                out["same_designation_group_and_department"] = f"{group}:{department}"
            if office in self.offices:
                out["same_designation_group_and_office"] = f"{group}:{office}"
            if group in LEADERSHIP:
                out["same_leadership_designation_group"] = group
            if not department and not office:
                out["same_designation_group_with_missing_context"] = group
        if r["board_key"] in self.boards:
            out["same_board_role"] = r["board_key"]
        return out

    def marks(self) -> set:
        """What a row must share to have a reason for this cluster: a number, an address, a board role, or a group with a department, an office or alone."""
        out = {(c, v) for c, held in (("staff_key", self.staff), ("email_key", self.emails), ("phone_key", self.phones), ("board_key", self.boards)) for v in held}
        return out | {("group", g) for g in self.groups} | {(g, c, v) for g in self.groups for c, held in (("department_key", self.departments), ("office_key", self.offices)) for v in held}

    def takes(self, r: dict, reasons: dict[str, str]) -> bool:
        """Equal numbers or addresses settle it; else group, or department and office together, must not speak against it."""
        if any(name in reasons for name in IDENTITY):
            return True
        other = lambda value, held: bool(value and held and value not in held)
        against = other(r["group"], self.groups) or other(r["department_key"], self.departments) and other(r["office_key"], self.offices)
        return bool(reasons) and not against


def wanted(r: dict) -> list:
    """The marks that a row may share with a cluster."""
    group, bare = r["group"], not r["department_key"] and not r["office_key"]
    out = [(c, r[c]) for c in ("staff_key", "email_key", "phone_key", "board_key") if r[c]] + [(group, c, r[c]) for c in ("department_key", "office_key") if r[c]]
    return out + ([("group", group)] if bare or group in LEADERSHIP else [])


_COMPARED = ("name_key", "group", "department_key", "office_key", "email_key", "phone_key", "staff_key", "board_key", "source_type", "row_key")


def clusters(rows: DataFrame) -> DataFrame:
    """name_key, row_key, source_type, cluster (from 1 within the name), place (in the name's order) and reasons for each row of keyed()."""
    schema = pa.schema([("name_key", pa.string()), ("row_key", pa.string()), ("source_type", pa.string()), ("cluster", pa.int32()), ("place", pa.int64()), ("reasons", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found, place, marked = None, [], 0, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["name_key"] != name:
                    name, found, place, marked = r["name_key"], [], 0, {}
                place += 1
                best, best_score, why = None, -1, {}
                for k in sorted(set().union(*(marked.get(m, ()) for m in wanted(r)))):
                    reasons = found[k].reasons(r)
                    score = sum(REASON_SCORE[x] for x in reasons)
                    if score > best_score and found[k].takes(r, reasons):
                        best, best_score, why = k, score, reasons
                if best is None:
                    found.append(Cluster())
                    best, why = len(found) - 1, {"seed": f"{r['source_type']}:{r['row_key']}"}
                if found[best].add(r):
                    for m in found[best].marks():
                        marked.setdefault(m, set()).add(best)
                out.append({"name_key": name, "row_key": r["row_key"], "source_type": r["source_type"], "cluster": best + 1, "place": place, "reasons": [f"{k}:{v}" for k, v in why.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    order = ["name_key", F.desc("source_rank"), F.desc("role_rank"), F.desc("richness"), F.lower("name"), "row_key"]
    dealt = rows.repartition("name_key").sortWithinPartitions(*order).select(*_COMPARED)
    return dealt.mapInArrow(run, "name_key string, row_key string, source_type string, cluster int, place long, reasons array<string>")


def merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A record for each cluster of keyed() rows: the best value of each field, group, aliases, sources, reasons and an id.

    A field's best value is the one of the most trusted source, then the longest, then the first; row_key names a row."""
    by = ["name_key", "cluster"]
    all_rows = rows.join(found.select("name_key", "row_key", "source_type", "cluster", "place"), ["name_key", "row_key", "source_type"])

    def best(c: str, *rank: Column) -> Column:
        value = text.whitespace_or_null(F.col(c))
        rank = rank or (F.col("source_rank"), F.length(value))
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*rank, -F.col("place"))))

    picks = {c: best(c) for c in ("department", "office", "phone", "joined", "staff_no", "board_role", "board_category")}
    picks |= {"email": F.max_by(text.email(F.col("email")), F.when(text.email(F.col("email")).isNotNull(), F.struct("source_rank", F.length("email"), -F.col("place"))))}
    picks |= {"designation": best("designation", F.col("source_rank"), F.col("role_rank")), "role_group": best("role_group", F.col("role_rank"), F.col("source_rank"))}
    people = all_rows.groupBy(*by).agg(F.min_by("clean", "place").alias("name"), *[v.alias(k) for k, v in picks.items()], F.count("*").alias("source_rows"))
    # distinct values with their first place, so that no list grows with the rows of a person
    sources = all_rows.groupBy(*by, "source_type").agg(F.min("place").alias("at")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "source_type"))).alias("s"))
    why = found.select(*by, "place", F.posexplode("reasons").alias("k", "reason")).groupBy(*by, "reason").agg(F.min(F.struct("place", "k")).alias("at")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("w"))
    out = people.join(sources, by).join(why, by)
    words = F.split("name", " ")
    first, last = words[0], F.element_at(words, -1)
    aliases = F.when(F.size(words) > 1, F.array(F.col("name"), first, last, F.concat_ws(" ", first, words[1]), F.concat_ws(" ", first, last))).otherwise(F.array(F.col("name"), first))
    out = entities.with_group(out, "designation_group", "designation", "role_group", "board_category", "board_role").withColumns({
        "aliases": F.array_distinct(aliases), "source_types": F.transform("s", lambda x: x["source_type"]), "reasons": F.transform("w", lambda x: x["reason"]),
    }).drop("s", "w")
    parts = ("name_key", "designation_group", "department", "office", "staff_no", "email", "cluster")
    signature = F.array_join(F.filter(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), lambda x: x != ""), "|")
    return out.withColumn("person_id", F.concat(F.lit("person:"), F.substring(F.sha1(signature), 1, 16)))

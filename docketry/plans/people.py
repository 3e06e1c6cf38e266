"""Queries of people and names: groups, counts, fuzzy names, people from several directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import entities, people
from docketry.plans.catalog import query
from docketry.session import table

TITLES = ["Chairman", "Whole-Time Member", "Executive Director", "Senior General Manager", "Deputy General Manager", "General Manager (Legal)", "Regional Director", "Assistant Manager", "Deputy Manager", "Manager", "AGM", "CGM", "AM, Surveillance", "Clerk", None]
ROLES = ["chairperson", "wtm", "office_contact", "regional_director", "executive_director", None, None, None, None, None, "department_head"]
CATEGORIES = ["Part-Time Member", "Chairperson", "whole time member", *[None] * 14]
DEPARTMENTS = ["Legal", "Surveillance", "", None, "Finance"]


def picked(values: list, key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def staff(spark, d):
    rows = table(spark, d, "customer").withColumns({"designation": picked(TITLES, "c_custkey"), "role_group": picked(ROLES, "c_custkey"), "board_category": picked(CATEGORIES, "c_custkey"), "department_name": picked(DEPARTMENTS, "c_custkey")})
    rows = rows.withColumn("board_role", F.when(F.col("c_custkey") % 2 == 0, "Member, nominated")).withColumn("office_name", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("NATION_"), "c_nationkey")))
    return rows.withColumn("designation_group", entities.designation_group(F.col("designation"), F.col("role_group"), F.col("board_category"), F.col("board_role")))


def offices(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").alias("canonical_office_id"), F.col("n_name").alias("office_name"), F.lower("n_name").alias("city"), F.col("r_name").alias("region"))


#: The groups of the titles, by hand: a title counts by its words, a short form by what it stands for.
_STAFF = """p as (select c_custkey, c_nationkey, ['staff', 'staff', 'executive_director', 'staff', 'deputy_general_manager', 'general_manager', 'regional_director', 'assistant_manager', 'staff', 'manager', 'staff', 'chief_general_manager', 'assistant_manager', 'staff', null][c_custkey % 15 + 1] as t,
 case c_custkey % 11 when 0 then 'chairperson' when 1 then 'wtm' when 2 then 'office_contact' when 3 then 'regional_director' when 4 then 'executive_director' when 10 then 'department_head' end as role,
 case c_custkey % 17 when 0 then 'board' when 1 then 'chair' when 2 then 'whole' end as cat, c_custkey % 2 = 0 as on_board,
 ['Legal', 'Surveillance', '', null, 'Finance'][c_custkey % 5 + 1] as department_name, case when c_custkey % 7 <> 0 then 'NATION_' || c_nationkey end as office_name from customer),
g as (select *, case when cat = 'chair' or role = 'chairperson' then 'chairperson' when cat = 'whole' or role = 'wtm' then 'whole_time_member' when cat = 'board' then 'board_member'
 when role = 'regional_director' or t = 'regional_director' then 'regional_director' when role = 'executive_director' or t = 'executive_director' then 'executive_director'
 when t <> 'staff' then t when role = 'office_contact' then 'office_contact' when role = 'department_head' or t = 'staff' then 'staff' when on_board then 'board_member' else 'other' end as designation_group from p)"""


@query(f"""with {_STAFF} select designation_group, count(*) as n, count(distinct c_nationkey) as offices from g group by 1""")
def designation_counts(spark, d):
    return staff(spark, d).groupBy("designation_group").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("offices"))


@query(f"""with {_STAFF}, n as (select *, case designation_group when 'chairperson' then 'Chairperson' when 'whole_time_member' then 'Whole-Time Member' when 'board_member' then 'Board Member' when 'executive_director' then 'Executive Director'
 when 'chief_general_manager' then 'Chief General Manager' when 'general_manager' then 'General Manager' when 'deputy_general_manager' then 'Deputy General Manager' when 'manager' then 'Manager' when 'assistant_manager' then 'Assistant Manager'
 when 'regional_director' then 'Regional Director' when 'office_contact' then 'Office Contact' when 'staff' then 'Staff' when 'other' then 'Other' end as designation_label from g)
select designation_group, designation_label, count(*) as people_count from n group by 1, 2""")
def people_by_designation(spark, d):
    return entities.people_counts(staff(spark, d), offices(spark, d))["designation"]


@query(f"""with {_STAFF}, n as (select office_name, count(*) as k from g where office_name is not null group by 1) select n_nationkey as canonical_office_id, n_name as office_name, lower(n_name) as city, r_name as region, coalesce(k, 0) as people_count, 1 as office_count
from nation join region on n_regionkey = r_regionkey left join n on n.office_name = n_name""")
def people_by_office(spark, d):
    return entities.people_counts(staff(spark, d), offices(spark, d))["office"]


@query(f"with {_STAFF} select department_name, count(*) as people_count from g where department_name <> '' group by 1")
def people_by_department(spark, d):
    return entities.people_counts(staff(spark, d), offices(spark, d))["department"]


@query(f"""with {_STAFF} select 'whole_time_member' as role_key, 'Whole-Time Members' as role_label, count(*) filter (where designation_group = 'whole_time_member') as people_count from g
union all select 'executive_director', 'Executive Directors', count(*) filter (where designation_group = 'executive_director') from g
union all select 'board_member', 'Board Members', count(*) filter (where designation_group in ('chairperson', 'whole_time_member', 'board_member')) from g""")
def people_by_role(spark, d):
    return entities.people_counts(staff(spark, d), offices(spark, d))["role"]


NAMES = ["small rng", "red widgit", "bleu bolt", "hot gears", "Mr. Red Widget", "widget", "blue  ANVIL", "gz", "", None]


def asked_names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "query_id int, query string")


def part_names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("value_id"), F.col("p_name").alias("value"))


@query()
def fuzzy_match(spark, d):
    return entities.fuzzy_candidates(asked_names(spark), part_names(spark, d)).drop("words")


@query()
def fuzzy_decisions(spark, d):
    """The best name of each query, its band, and whether it is ambiguous; names count once, however many parts have them."""
    names = part_names(spark, d).groupBy("value").agg(F.min("value_id").alias("value_id"))
    return entities.ranked_matches(entities.fuzzy_candidates(asked_names(spark), names)).where("rank = 1").select("query_id", "value", "score", "how", "band", "ambiguous")


def directory_rows(spark, d):
    """Directory people, board members and organisation rows made from customers, suppliers and nations."""
    n = F.col("c_custkey")
    directory = table(spark, d, "customer").select(
        F.element_at(F.array(*map(F.lit, ("directory", "contact_us", "regional_offices"))), (n % 3 + 1).cast("int")).alias("source_type"), F.lit("list").alias("source_url"), F.concat(F.lit("c"), n).alias("row_key"),
        F.concat(F.lit("Shri Person "), F.chr(65 + n % 23)).alias("name"), picked(TITLES, "c_custkey").alias("designation"), picked(["staff", None, "office_contact"], "c_custkey").alias("role_group"), picked(DEPARTMENTS, "c_custkey").alias("department"),
        F.when(n % 4 != 0, F.concat(F.lit("NATION_"), "c_nationkey")).alias("office"), F.when(n % 6 == 0, F.concat(F.lit("p"), n % 46, F.lit(" [at] office [dot] org"))).alias("email"), F.when(n % 10 == 0, F.concat(F.lit("022 "), n % 69)).alias("phone"),
        F.lit(None).cast("string").alias("joined"), F.when(n % 9 == 0, (n % 92).cast("string")).alias("staff_no"), F.lit(None).cast("string").alias("board_role"), F.lit(None).cast("string").alias("board_category"))
    s = F.col("s_suppkey")
    board = table(spark, d, "supplier").select(F.lit("board_members").alias("source_type"), F.lit("board").alias("source_url"), F.concat(F.lit("s"), s).alias("row_key"), F.concat(F.lit("PERSON "), F.chr(65 + s % 23)).alias("name"), F.when(s % 3 == 0, "Chairman, Board").otherwise("Member (nominee)").alias("board_role"), F.when(s % 3 == 0, "chairperson").when(s % 3 == 1, "part-time member").alias("board_category"))
    k = F.col("n_nationkey")
    org = table(spark, d, "nation").select(F.lit("orgchart").alias("source_type"), F.lit("org").alias("source_url"), F.concat(F.lit("n"), k).alias("row_key"), F.concat(F.lit("Dr. Person "), F.chr(65 + k)).alias("leader_name"), F.lit("Head of Department").alias("leader_role"), F.lit("Legal").alias("department"), F.when(k % 2 == 0, F.concat(F.lit("Person "), F.chr(65 + k % 5))).alias("director_name"), F.lit("ed[at]office[dot]org").alias("director_email"), F.lit(None).cast("string").alias("director_phone"))
    return people.keyed(people.source_rows(directory, board, org))


@query()
def people_clusters(spark, d):
    found = people.clusters(directory_rows(spark, d))
    return found.select("name_key", "row_key", "source_type", "cluster", F.array_join("reasons", "; ").alias("reasons"))


@query()
def merged_people(spark, d):
    rows = directory_rows(spark, d)
    out = people.merged(rows, people.clusters(rows))
    return out.select("person_id", "name_key", "cluster", "name", "designation", "designation_group", "department", "office", "email", "phone", "staff_no", "role_group", "board_role", "source_rows", F.array_join("source_types", "; ").alias("source_types"), F.array_join("reasons", "; ").alias("reasons"), F.array_join("aliases", "; ").alias("aliases"))

"""Cases as JSON lines, and the folder of files that an evaluation run leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed cases; lines that are no JSON have their text in bad_line."""
    return spark.read.schema(schema + ", bad_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """JSON lines with the keys in order of name; nulls are written."""
    cases.select(*sorted(cases.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_run(path: str, cases: DataFrame, tables: dict[str, DataFrame], summary: DataFrame) -> None:
    """cases/ as JSON lines, a CSV folder for each table, summary.json/ and, from its one row, summary.md/."""
    write_cases(cases, f"{path}/cases")
    for name, table in tables.items():
        flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in table.dtypes]
        table.select(*flat).write.mode("overwrite").csv(f"{path}/{name}", header=True)
    one = summary.limit(1)
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary.json")
    lines = F.concat(*[F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit("\n")) for c in summary.columns])
    one.select(F.concat(F.lit("# Run\n\n"), lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary.md")


#: The router mode that logs keep beside a route; others are written as abstain.
ROUTER_MODES = {
    "smalltalk": "direct_llm", "general_knowledge": "direct_llm", "structured_current_info": "direct_llm", "current_official_lookup": "direct_llm", "current_news_lookup": "direct_llm",
    "historical_official_lookup": "direct_llm", "direct_llm": "direct_llm", "exact_lookup": "db_search", "hierarchical_rag": "db_search", "memory_scoped_rag": "memory_scoped_db_search",
    "corpus_metadata": "direct_llm", "clarify": "direct_llm", "abstain": "abstain",
}


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log of Parquet files, arrays and structs as JSON; rows with a route_mode also get its router_mode."""
    if "route_mode" in rows.columns:
        known = F.create_map(*[F.lit(x) for kv in ROUTER_MODES.items() for x in kv])
        rows = rows.withColumn("router_mode", F.coalesce(F.try_element_at(known, F.col("route_mode")), F.lit("abstain")))
    rows.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes]).write.mode("append").parquet(path)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under its name; a snapshot that is there is replaced."""
    for name, rows in tables.items():
        write_cases(rows, f"{path}/{name}")


def write_report(chunks: DataFrame, path: str, scope: str, only_flagged: bool = False) -> None:
    """One JSON object a document: scope, counts of chunks and of flags, and the chunks (only flagged ones on request). chunks: document, place, flags (array), preview."""
    rows = chunks.where(F.size("flags") > 0) if only_flagged else chunks
    flags = chunks.select("document", F.explode("flags").alias("flag")).groupBy("document", "flag").agg(F.count("*").alias("n")).groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    totals = chunks.groupBy("document").agg(F.count("*").alias("chunk_count"))
    listed = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("place", "flags", "preview"))).alias("chunks"))
    out = totals.join(flags, "document", "left").join(listed, "document", "left").withColumn("scope", F.lit(scope))
    out.select("chunk_count", "chunks", "document", "flags", "scope").write.mode("overwrite").json(path)

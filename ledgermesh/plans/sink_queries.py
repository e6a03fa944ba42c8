"""Queries that write tables, files and output sets, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgermesh.operators import answers as a
from ledgermesh.operators import projection as p
from ledgermesh.plans import answer_queries, filing_queries
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.people_queries import relationships
from ledgermesh.plans.registry import query
from ledgermesh.session import run_folder
from ledgermesh.sinks import files
from ledgermesh.sources.tables import read_csv_table


def folder(i: Inputs, label: str) -> str:
    """A new folder of this run, cleared with its staged tables."""
    return f"{run_folder(i.spark)}/{label}-{uuid.uuid4().hex}"


@query("replaced_tables", """
    select 'published' as way, p_partkey, p_name from part where p_size>10 union all
    select 'replaced', p_partkey, p_name from part where p_size<=10""")
def _(i):
    parts, one, other = i.table("part"), folder(i, "published"), folder(i, "replaced")
    files.publish(parts, one)
    files.publish(files.read_published(i.spark, one).filter("p_size > 10"), one)
    files.replace_table(parts, other)
    files.replace_table(i.spark.read.parquet(other).filter("p_size <= 10"), other)
    rows = files.read_published(i.spark, one).withColumn("way", F.lit("published")).unionByName(
        i.spark.read.parquet(other).withColumn("way", F.lit("replaced"))
    )
    return rows.select("way", "p_partkey", "p_name")


@query("exported_tables", """
    select cast(p_partkey as varchar) as key, '  "'||p_name||'",'||chr(10)||p_type||chr(13)||' ' as name, case when p_size%5=0 then '' else p_type end as kind from part""")
def _(i):
    path = folder(i, "exported")
    name = F.concat(F.lit('  "'), "p_name", F.lit('",\n'), "p_type", F.lit("\r "))
    rows = i.table("part").select(F.col("p_partkey").alias("key"), name.alias("name"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("kind"))
    files.export_csv(rows, path, ["key", "name", "kind"], ["key"])
    return read_csv_table(i.spark, path, ["key", "name"])


@query("appended_missing", "select unnest(missing) as ticker, batch_id, 'missing_from_response' as reason, '2024-01-01' as created_at from o_status where status='partial'")
def _(i):
    path = folder(i, "missing")
    rows = a.missing_rows(a.answer_status(answer_queries.answers(i)), answer_queries.STAMP)
    even = F.pmod(F.xxhash64("batch_id"), F.lit(2)) == 0
    for some in (rows.filter(even), rows.filter(~even)):
        files.append_missing(some, path)
    return read_csv_table(i.spark, path, ["ticker"])


@query("report_distribution", "select * from o_dist")
def _(i):
    path = folder(i, "reports")
    rel = relationships(i)
    files.write_reports(rel, path)
    kinds = p.company_distribution(p.projection(p.person_companies(rel)), p.company_names(rel)).dtypes
    read = read_csv_table(i.spark, f"{path}/company_degree_distribution", [name for name, _ in kinds])
    return read.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds])


@query("filing_output_edges", filing_queries.EDGE_SQL)
def _(i):
    path = folder(i, "filings")
    files.write_filing_outputs(filing_queries.companies(i), filing_queries.edges(i), filing_queries.log(i), path)
    return read_csv_table(i.spark, f"{path}/edges", [])

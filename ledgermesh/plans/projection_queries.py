"""Queries over the company-to-company projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import numbers as n
from ledgermesh.functions.text import person_id_for
from ledgermesh.operators import components as k
from ledgermesh.operators import projection as p
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.people_queries import relationships, stored_relationships
from ledgermesh.plans.registry import query
from ledgermesh.session import stage

_BUCKET_SHARE = "coalesce(round(100.0*edge_count/nullif(total,0),6),0.0)"


def pairs(i: Inputs) -> DataFrame:
    return p.person_companies(relationships(i))


def links(edges: DataFrame, *others: str) -> DataFrame:
    return edges.select(F.col("source_ticker").alias("a"), F.col("target_ticker").alias("b"), *others)


@query("strongest_company_pairs", "select * from o_proj order by shared_person_count desc, 1, 2 limit 100")
def _(i):
    return p.strongest_edges(p.projection(pairs(i)))


@query("company_projection", "select * from o_proj")
def _(i):
    return p.projection(pairs(i))


@query(
    "company_projection_people",
    """select a.ticker as source_ticker, b.ticker as target_ticker, a.person_id
       from o_pt a join o_pt b on a.person_id=b.person_id and a.ticker<b.ticker""",
)
def _(i):
    return p.shared_pairs(pairs(i))


@query(
    "company_projection_all_years",
    """select a.ticker as source_ticker, b.ticker as target_ticker, count(*) as shared_person_count
       from (select distinct ticker, person_id from v_raw join o_pid using (person_name)) a
       join (select distinct ticker, person_id from v_raw join o_pid using (person_name)) b
         on a.person_id=b.person_id and a.ticker<b.ticker group by 1,2""",
)
def _(i):
    everyone = i.view("v_raw").select(person_id_for(F.col("person_name")).alias("person_id"), "ticker")
    return p.projection(p.person_companies(everyone), block=16)


@query("person_companies", "select * from o_pt")
def _(i):
    return pairs(i)


@query("company_names", "select * from o_names")
def _(i):
    return p.company_names(relationships(i))


@query(
    "duplicate_relationship_rows",
    """select cast(sum(n-1) as bigint) as duplicate_rows from (
         select count(*) as n from v_raw group by ticker, person_name, role, role_category, created_at)""",
)
def _(i):
    return p.duplicate_rows(i.view("v_raw").select("ticker", "person_name", "role", "role_category", "created_at"))


@query(
    "person_names",
    """select person_id, coalesce(arg_min(nullif(person_name,''),
         (ticker, company_name, person_name, role, role_category, extraction_time)),'') as person_name
       from o_canon group by person_id""",
)
def _(i):
    return p.person_names(relationships(i))


@query(
    "person_profiles",
    """select person_id, ticker, string_agg(distinct nullif(role,''),'|' order by nullif(role,'')) as roles,
         string_agg(distinct nullif(role_category,''),'|' order by nullif(role_category,'')) as role_categories
       from o_canon group by 1,2""",
)
def _(i):
    return p.profiles(relationships(i)).select(
        "person_id", "ticker", F.array_join("roles", "|").alias("roles"),
        F.array_join("role_categories", "|").alias("role_categories"),
    )


@query("person_degrees", "select * from o_deg")
def _(i):
    return p.person_degrees(pairs(i))


@query("company_distribution", "select * from o_dist")
def _(i):
    rel = stored_relationships(i)
    return p.company_distribution(p.projection(p.person_companies(rel)), p.company_names(rel))


@query("top_companies", "select * from o_dist order by company_projected_degree desc, ticker limit 50")
def _(i):
    rel = stored_relationships(i)
    return p.top_companies(p.company_distribution(p.projection(p.person_companies(rel)), p.company_names(rel)))


@query(
    "top_people",
    """select d.person_id, person_name, degree as person_company_degree, company_tickers
       from (select * from o_deg order by degree desc, person_id limit 50) d
       join (select person_id, string_agg(ticker,';' order by ticker) as company_tickers from o_pt group by 1) using (person_id)
       join (select person_id, coalesce(arg_min(nullif(person_name,''),
         (ticker, company_name, person_name, role, role_category, extraction_time)),'') as person_name
         from o_canon group by 1) using (person_id)""",
)
def _(i):
    rel = stored_relationships(i)
    pt = stage(p.person_companies(rel), "person-companies")
    return p.top_people(p.person_degrees(pt), pt, rel)


@query(
    "top_edges_with_evidence",
    """select source_ticker, a.company_name as source_company_name, target_ticker, b.company_name as target_company_name,
         shared_person_count from (select * from o_proj order by shared_person_count desc, 1, 2 limit 100)
       join o_names a on a.ticker=source_ticker join o_names b on b.ticker=target_ticker""",
)
def _(i):
    rel = stored_relationships(i)
    return p.top_edges(p.projection(p.person_companies(rel)), rel).drop("shared_people_evidence")


@query(
    "top_edge_evidence_json",
    """select source_ticker, target_ticker, '['||string_agg('{"person_id":"'||person_id||'","person_name":"'||person_name
           ||'","source_role_categories":'||sc||',"source_roles":'||sr||',"target_role_categories":'||tc
           ||',"target_roles":'||tr||'}', ',' order by person_id)||']' as shared_people_evidence
       from (
         select e.source_ticker, e.target_ticker, s.person_id, nm.person_name, s.c as sc, s.r as sr, t.c as tc, t.r as tr
         from (select * from o_proj order by shared_person_count desc, 1, 2 limit 100) e
         join o_sets s on s.ticker=e.source_ticker join o_sets t on t.ticker=e.target_ticker and t.person_id=s.person_id
         join (select person_id, arg_min(nullif(person_name,''),
           (ticker, company_name, person_name, role, role_category, extraction_time)) as person_name
           from o_canon group by 1) nm on nm.person_id=s.person_id)
       group by 1,2""",
)
def _(i):
    rel = stored_relationships(i)
    return p.top_edges(p.projection(p.person_companies(rel)), rel).select(
        "source_ticker", "target_ticker", "shared_people_evidence"
    )


@query(
    "top_edge_evidence_chunks",
    """select source_ticker, target_ticker, chunk, '['||string_agg('{"person_id":"'||person_id||'","person_name":"'||person_name
           ||'","source_role_categories":'||sc||',"source_roles":'||sr||',"target_role_categories":'||tc
           ||',"target_roles":'||tr||'}', ',' order by person_id)||']' as people
       from (select *, (row_number() over (partition by source_ticker, target_ticker order by person_id)-1)//2 as chunk from (
         select e.source_ticker, e.target_ticker, s.person_id, nm.person_name, s.c as sc, s.r as sr, t.c as tc, t.r as tr
         from (select * from o_proj order by shared_person_count desc, 1, 2 limit 100) e
         join o_sets s on s.ticker=e.source_ticker join o_sets t on t.ticker=e.target_ticker and t.person_id=s.person_id
         join (select person_id, arg_min(nullif(person_name,''),
           (ticker, company_name, person_name, role, role_category, extraction_time)) as person_name
           from o_canon group by 1) nm on nm.person_id=s.person_id))
       group by 1,2,3""",
)
def _(i):
    rel = stored_relationships(i)
    kept = stage(p.strongest_edges(p.projection(p.person_companies(rel))), "strongest-edges")
    return p.evidence_chunks(kept, rel, size=2).select("source_ticker", "target_ticker", "chunk", F.to_json("people").alias("people"))


@query(
    "top_people_company_chunks",
    """select person_id, chunk, string_agg(ticker,';' order by ticker) as tickers from (
         select person_id, ticker, (row_number() over (partition by person_id order by ticker)-1)//3 as chunk
         from (select * from o_deg order by degree desc, person_id limit 50) join o_pt using (person_id))
       group by 1,2""",
)
def _(i):
    held = stage(pairs(i), "person-companies")
    kept = p.most_connected(p.person_degrees(held))
    return p.company_chunks(kept, held, size=3).withColumn("tickers", F.array_join("tickers", ";"))


@query(
    "shared_person_distribution",
    f"""select label as shared_person_count, edge_count, {_BUCKET_SHARE} as edge_percentage from (
         select label, (select count(*) from o_proj) as total,
           (select count(*) from o_proj where shared_person_count between lo and hi) as edge_count
         from (values ('=1',1,1),('=2',2,2),('=3',3,3),('=4',4,4),('=5',5,5),('>=6',6,1000000000),('>=2',2,1000000000),
           ('>=3',3,1000000000),('>=5',5,1000000000),('>=10',10,1000000000)) b(label,lo,hi))""",
)
def _(i):
    return p.shared_distribution(p.projection(pairs(i)))


@query(
    "person_degree_distribution",
    f"""select label as person_company_degree, edge_count as person_count, {_BUCKET_SHARE} as person_percentage from (
         select label, (select count(*) from o_deg) as total,
           (select count(*) from o_deg where degree between lo and hi) as edge_count
         from (values ('=1',1,1),('=2',2,2),('=3',3,3),('=4',4,4),('=5',5,5),('6-10',6,10),('11-20',11,20),
           ('>20',21,1000000000)) b(label,lo,hi))""",
)
def _(i):
    return p.degree_buckets(p.person_degrees(pairs(i)))


def _share(expr: str) -> str:
    return f"coalesce(round(100.0*({expr})/nullif((select sum(c) from r),0),6),0.0)"


@query(
    "projection_concentration",
    f"""select cast((select sum(c) from r) as bigint) as total_person_pair_contributions_before_deduplication,
         {_share('select sum(c) from r where rk<=1')} as top_1_person_percentage,
         {_share('select sum(c) from r where rk<=5')} as top_5_people_percentage,
         {_share('select sum(c) from r where rk<=10')} as top_10_people_percentage,
         {_share('select sum(c) from r where rk<=50')} as top_50_people_percentage,
         {_share('select sum(c) from r where degree>=5')} as degree_at_least_5_percentage,
         {_share('select sum(c) from r where degree>=10')} as degree_at_least_10_percentage,
         {_share('select coalesce(sum(c),0) from r where degree>=20')} as degree_at_least_20_percentage
       from (select 1)""".replace("from r", "from o_contrib"),
)
def _(i):
    return p.concentration(p.person_degrees(pairs(i)))


_TOTALS = """
    select (select count(*) from o_canon) as total_relationship_rows,
      cast(0 as bigint) as duplicate_exact_relationship_rows,
      (select count(*) from o_deg) as unique_people,
      (select count(*) from o_deg where degree=1) as people_with_exactly_1_distinct_company,
      (select count(*) from o_deg where degree>1) as people_with_more_than_1_distinct_company,
      (select count(*) from o_dist) as unique_companies,
      (select count(*) from o_dist where company_projected_degree>0) as companies_with_cross_company_connections,
      (select count(*) from o_dist where company_projected_degree=0) as companies_without_cross_company_connections,
      (select count(*) from o_proj) as total_unique_unordered_company_edges,
      (select min(shared_person_count) from o_proj) as minimum_shared_person_count,
      (select max(shared_person_count) from o_proj) as maximum_shared_person_count,
      (select round(avg(shared_person_count),6) from o_proj) as mean_shared_person_count,
      (select median(shared_person_count) from o_proj) as median_shared_person_count,
      (select max(degree) from o_deg) as person_company_degree_maximum,
      (select round(avg(degree),6) from o_deg) as person_company_degree_mean,
      (select median(degree) from o_deg) as person_company_degree_median,
      (select round(quantile_cont(degree,0.90),6) from o_deg) as person_company_degree_p90,
      (select round(quantile_cont(degree,0.95),6) from o_deg) as person_company_degree_p95,
      (select round(quantile_cont(degree,0.99),6) from o_deg) as person_company_degree_p99,
      (select min(company_projected_degree) from o_dist) as company_projected_degree_minimum,
      (select max(company_projected_degree) from o_dist) as company_projected_degree_maximum,
      (select round(avg(company_projected_degree),6) from o_dist) as company_projected_degree_mean,
      (select median(company_projected_degree) from o_dist) as company_projected_degree_median,
      (select round(quantile_cont(company_projected_degree,0.90),6) from o_dist) as company_projected_degree_p90,
      (select round(quantile_cont(company_projected_degree,0.95),6) from o_dist) as company_projected_degree_p95,
      (select round(quantile_cont(company_projected_degree,0.99),6) from o_dist) as company_projected_degree_p99,
      (select count(distinct component) from o_proj_label) as total_connected_components_companies_in_projection,
      (select max(n) from (select count(*) as n from o_proj_label group by component)) as largest_connected_component_company_count,
      (select round(100.0*max(n)/(select count(*) from o_dist),6) from (select count(*) as n from o_proj_label group by component))
        as largest_connected_component_percentage_of_all_companies,
      (select count(*) from o_dist where company_projected_degree=0) as singleton_companies_with_no_cross_company_edge
"""


@query("projection_summary", _TOTALS)
def _(i):
    rel = stored_relationships(i)
    pt = stage(p.person_companies(rel), "person-companies")
    edges = stage(p.projection(pt), "edges")
    distribution = p.company_distribution(edges, p.company_names(rel))
    return p.projection_summary(rel, pt, edges, distribution, p.projection_components(pt))


@query("projection_components", "select node, component from o_proj_label")
def _(i):
    return p.projection_components(stage(pairs(i), "person-companies"))


@query(
    "top_edges_per_company",
    """select ticker, neighbour, source_ticker, target_ticker, shared_person_count from o_ends
       qualify row_number() over (partition by ticker order by shared_person_count desc, neighbour)<=3""",
)
def _(i):
    return p.topk_edges(p.projection(pairs(i)), 3)


def stored_edges(i: Inputs, view: str) -> tuple[DataFrame, DataFrame]:
    """Edges over company numbers, for reports that name no company, and the companies; the view is worked out once."""
    held = stage(i.view(view), "person-companies")
    return stage(p.numbered_projection(held)[0], "edges"), held.select("ticker").distinct()


def solved(i: Inputs, view: str) -> DataFrame:
    """Components of the projection; its edges are folded where they are made."""
    edges, companies = p.numbered_projection(i.view(view))
    return p.labels_by_ticker(k.components(k.spanning_links(links(edges))), companies)


def _retention(kept: str, label: str, variant: str, values: str, column: str, edges: str = "o_isl", view: str = "v_islands") -> str:
    return f"""
        select s.v as {variant}, coalesce(n,0) as {column},
          coalesce(round(100.0*coalesce(n,0)/nullif((select count(*) from {edges}),0),6),0.0) as retained_edge_percentage,
          coalesce(nodes,0) as companies_with_at_least_one_retained_edge,
          (select count(distinct ticker) from {view})-coalesce(nodes,0) as companies_with_zero_retained_edges,
          coalesce(parts,0) as connected_component_count, coalesce(largest,0) as largest_connected_component_size
        from (values {values}) s(v)
        left join (select {variant} as v, count(*) as n from {kept} group by 1) c on c.v=s.v
        left join (select v, cast(sum(size) as bigint) as nodes, count(*) as parts, max(size) as largest from (
          select v, component, count(*) as size from {label} group by 1,2) group by 1) l on l.v=s.v"""


@query(
    "threshold_retention",
    _retention("o_thr", "o_thr_label", "threshold", "(1),(2),(3),(5),(10)", "retained_edge_count"),
)
def _(i):
    return p.threshold_report(*stored_edges(i, "v_islands"))


@query(
    "threshold_retention_of_ragged_links",
    _retention("o_rag_thr", "o_rag_thr_label", "threshold", "(1),(2),(3),(5),(10)", "retained_edge_count", "o_rag", "v_ragged"),
)
def _(i):
    return p.threshold_report(*stored_edges(i, "v_ragged"))


@query(
    "topk_retention",
    _retention("o_topk", "o_topk_label", "top_k", "(3),(5),(10)", "retained_unique_edge_count"),
)
def _(i):
    return p.topk_report(*stored_edges(i, "v_islands"))


@query("components_of_islands", "select node, component from o_thr_label where v=1")
def _(i):
    return solved(i, "v_islands")


@query("components_of_ragged_links", "select node, component from o_rag_label")
def _(i):
    return solved(i, "v_ragged")


@query(
    "component_edges",
    """select a, b, component from (select source_ticker as a, target_ticker as b from o_rag)
       join o_rag_label on node=a""",
)
def _(i):
    packed, companies, ranges, tasks = p.edge_chunks(i.view("v_ragged"))
    packed = stage(packed, "edge-chunks")
    labels = k.components(k.spanning_links(links(p.chunk_edges(packed))))
    # Both ends of an edge are in one component: it comes with the ticker of the end that is named last.
    heads = companies.select(F.col("number").alias("component"), F.col("ticker").alias("head"))
    ends = k.component_edges(companies.withColumnRenamed("number", "a"), labels).join(heads, "component").select(
        F.col("a").alias("number"), "ticker", F.col("head").alias("component")
    )
    return links(p.named(packed, ends, ranges, tasks), "component")


@query(
    "component_report",
    """select component_rank, company_count, edge_count, tickers, ticker_list_truncated from (
         select component, row_number() over (order by company_count desc, component) as component_rank, company_count,
           company_count>100 as ticker_list_truncated from (
           select component, count(*) as company_count from o_rag_label group by 1)) c
       join (select component, count(*) as edge_count from o_rag join o_rag_label on node=source_ticker group by 1) using (component)
       join (select component, '['||string_agg('"'||node||'"',',' order by node)||']' as tickers from (
         select *, row_number() over (partition by component order by node) as rn from o_rag_label) where rn<=100 group by 1) using (component)
       where component_rank<=20""",
)
def _(i):
    held = stage(i.view("v_ragged"), "person-companies")
    return p.component_report(p.edges_by_source(held), p.projection_components(held))


@query(
    "supplier_price_percentiles",
    """select l_suppkey, round(quantile_cont(l_quantity,0.9),6) as p90, round(quantile_cont(l_quantity,0.5),6) as p50
       from lineitem group by 1""",
)
def _(i):
    histogram = i.table("lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    q, w = F.col("l_quantity"), F.col("n")
    return histogram.groupBy("l_suppkey").agg(
        n.percentile_of_counts(q, 0.9, w).alias("p90"), n.percentile_of_counts(q, 0.5, w).alias("p50")
    )


@query(
    "order_status_share",
    """select o_custkey, coalesce(round(100.0*sum(case when o_orderstatus='F' then 1 else 0 end)/count(*),6),0.0) as share,
         cast(count(*)*(count(*)-1)/2 as bigint) as order_pairs from orders group by 1""",
)
def _(i):
    counts = i.table("orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n")
    )
    return counts.select("o_custkey", n.pct(F.col("done"), F.col("n")).alias("share"), n.pair_count(F.col("n")).alias("order_pairs"))

"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import canonical as c
from ledgermesh.operators import graph as g
from ledgermesh.operators.merge import duplicate_keys
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.company_queries import master
from ledgermesh.plans.people_queries import relationships, stored_relationships
from ledgermesh.plans.registry import query
from ledgermesh.session import stage

EDGE = "person_id, ticker, relationship_type, role, role_category, extraction_time"
PERSON = "CUSTOMER_1"


def graph(i: Inputs) -> g.Graph:
    rel = stored_relationships(i)
    return g.Graph(g.graph_companies(master(i)), c.derive_people(rel), g.build_edges(rel))


_NODES = """
    select 'company:'||ticker as id, 'Company' as type, ticker as label, ticker, coalesce(company_name,'') as company_name, universe,
      coalesce(sector,'') as sector, coalesce(industry,'') as industry, coalesce(description_short,'') as description_short,
      null as person_id, null as person_name from o_companies
    union all select 'person:'||person_id, 'Person', coalesce(nullif(person_name,''),person_id), null, null, null, null, null, null,
      person_id, person_name from o_people"""
_ELEMENTS = """
    select 'edge:'||sha256(person_id||chr(31)||ticker||chr(31)||relationship_type||chr(31)||role||chr(31)||role_category) as id,
      'person:'||person_id as source, 'company:'||ticker as target, relationship_type as relationship, role, role_category, extraction_time
    from o_edges where person_id in (select person_id from o_people) and ticker in (select ticker from o_companies)"""


@query("typed_edges", f"select {EDGE} from o_edges")
def _(i):
    return g.build_edges(relationships(i))


@query("graph_companies", """select ticker, coalesce(company_name,'') as company_name, universe, coalesce(sector,'') as sector,
    coalesce(industry,'') as industry, coalesce(description_short,'') as description_short from o_companies""")
def _(i):
    return g.graph_companies(master(i))


@query("graph_nodes", _NODES)
def _(i):
    return g.full_graph(graph(i))[0]


@query("graph_edges", _ELEMENTS)
def _(i):
    return g.full_graph(graph(i))[1]


@query("edge_view", f"""select {EDGE}, person_name, coalesce(company_name,'') as company_name, universe, coalesce(sector,'') as sector,
    coalesce(industry,'') as industry, coalesce(description_short,'') as description_short
    from o_edges join o_people using (person_id) join o_companies using (ticker)""")
def _(i):
    return g.edge_view(graph(i))


@query("company_neighbourhood_1", f"select {EDGE} from o_edges where ticker='S000001'")
def _(i):
    return g.company_graph(graph(i), "s000001", 1)


@query("company_neighbourhood_2", f"select {EDGE} from o_edges where person_id in (select person_id from o_edges where ticker='S000001')")
def _(i):
    return g.company_graph(graph(i), "s000001", 2)


@query("person_neighbourhood_1", f"select {EDGE} from o_edges where person_id=(select min(person_id) from o_edges where person_id>='{PERSON}')")
def _(i):
    found = graph(i)
    person = found.edges.filter(F.col("person_id") >= PERSON).agg(F.min("person_id")).scalar()
    return g.person_graph(found, person, 1)


@query("person_neighbourhood_2", f"""select {EDGE} from o_edges where ticker in (
    select ticker from o_edges where person_id=(select min(person_id) from o_edges where person_id>='{PERSON}'))""")
def _(i):
    found = graph(i)
    person = found.edges.filter(F.col("person_id") >= PERSON).agg(F.min("person_id")).scalar()
    return g.person_graph(found, person, 2)


@query("cross_company_edges", f"select {EDGE} from o_edges where person_id in (select person_id from o_edges group by 1 having count(distinct ticker)>1)")
def _(i):
    return g.cross_company(graph(i))


@query("company_subgraph_nodes", f"""select id, type, label from ({_NODES}) where ticker in (select ticker from o_edges where person_id in (
    select person_id from o_edges where ticker='S000001')) or person_id in (select person_id from o_edges where ticker='S000001')""")
def _(i):
    found = graph(i)
    return g.subgraph(found, g.company_graph(found, "S000001", 2))[0].select("id", "type", "label")


@query("closed_neighbourhood", f"""select id, type, label from ({_NODES}) where id='company:S000001'
    or id in (select source from ({_ELEMENTS}) where target='company:S000001')""")
def _(i):
    nodes, edges = g.full_graph(graph(i))
    return g.neighborhood(nodes, edges, "company:S000001")[0].select("id", "type", "label")


@query("filtered_edges", f"select id, relationship from ({_ELEMENTS}) where relationship not in ('BOARD_OF','CEO_OF')")
def _(i):
    nodes, edges = g.full_graph(graph(i))
    return g.filter_graph(nodes, edges, ["BOARD_OF", "CEO_OF"])[1].select("id", "relationship")


@query("filtered_nodes", f"select id, type from ({_NODES}) where type<>'Person'")
def _(i):
    nodes, edges = g.full_graph(graph(i))
    return g.filter_graph(nodes, edges, ["Person"])[0].select("id", "type")


_SEARCH = """
    select id, type, label, ticker, company_name, person_id, person_name, rank from (
      select 'company:'||ticker as id, 'Company' as type, ticker as label, ticker, company_name, null as person_id, null as person_name,
        case when lower(ticker)='{q}' then 0 when starts_with(lower(ticker),'{q}') then 1
          when contains(lower(company_name),'{q}') then 2 end as rank, ticker as k
      from (select ticker, coalesce(company_name,'') as company_name from o_companies)
      union all select 'person:'||person_id, 'Person', coalesce(nullif(person_name,''),person_id), null, null, person_id, person_name, 3,
        coalesce(person_name,person_id) from o_people where contains(lower(person_name),'{q}') or contains(lower(person_id),'{q}'))
    where rank is not null and '{q}'<>'' order by rank, k, id limit 25"""


@query("search_ticker", _SEARCH.replace("{q}", "s00001"))
def _(i):
    return g.search(graph(i), " S00001 ")


@query("search_name", _SEARCH.replace("{q}", "customer 1"))
def _(i):
    return g.search(graph(i), "Customer 1")


@query("search_company_name", _SEARCH.replace("{q}", "r#00000001"))
def _(i):
    return g.search(graph(i), "r#00000001")


@query("search_blank", _SEARCH.replace("{q}", ""))
def _(i):
    return g.search(graph(i), "  ")


@query("graph_counts", """select (select count(*) from o_companies) as companies, (select count(*) from o_people) as people,
    (select count(*) from o_edges) as relationships""")
def _(i):
    return g.graph_counts(graph(i))


@query("edge_counts_by_type", """select relationship_type, coalesce(n,0) as edge_count from (values ('CEO_OF'),('CFO_OF'),('CHAIRMAN_OF'),
    ('BOARD_OF'),('EXECUTIVE_OF')) t(relationship_type) left join (select relationship_type, count(*) as n from o_edges group by 1) using (relationship_type)""")
def _(i):
    return g.counts_by_type(g.build_edges(relationships(i)))


@query("orphan_edges", f"""select {EDGE}, 'company' as missing from o_edges where ticker not in (select ticker from o_companies)
    union all select {EDGE}, 'person' from o_edges where person_id not in (select person_id from o_people where person_id not like '%7')""")
def _(i):
    found = graph(i)
    return g.orphan_edges(found.edges, found.companies, found.people.filter("person_id not like '%7'"))


@query("graph_reconciliation", """
    select *, expected=actual as ok from (
      select 'companies' as "check", (select count(*) from o_companies) as expected, (select count(*) from o_companies) as actual
      union all select 'people', (select count(*) from o_people), (select count(*) from o_people)
      union all select 'relationships', (select count(*) from o_canon), (select count(*) from o_edges)
      union all select 'missing_endpoints', 0, (select count(*) from o_edges where ticker not in (select ticker from o_companies))
        +(select count(*) from o_edges where person_id not in (select person_id from o_people))
      union all select 'duplicate_companies', 0, 0
      union all select 'duplicate_people', 0, 0
      union all select 'type_count_sum', (select count(*) from o_edges), (select count(*) from o_edges where relationship_type is not null))""")
def _(i):
    rel = stored_relationships(i)
    companies, people = master(i), c.derive_people(rel)
    return g.reconcile(companies, people, rel, g.Graph(g.graph_companies(companies), people, g.build_edges(rel)))


@query("merge_edges", f"""select person_id, ticker, relationship_type, role, role_category,
    case when ticker<'S000050' then '2099' else extraction_time end as extraction_time from o_edges""")
def _(i):
    edges = g.build_edges(stored_relationships(i))  # read three times
    late = edges.filter("ticker < 'S000050'")
    first = late.withColumn("extraction_time", F.lit("2098")).withColumn("seq", F.lit(1))
    second = late.withColumn("extraction_time", F.lit("2099")).withColumn("seq", F.lit(2))
    return g.merge_edges(edges, first.unionByName(second), "seq")


@query("merge_nodes", """select person_id, case when person_id like '%7' then 'New Name' else person_name end as person_name from o_people
    union all select 'X_'||person_id, 'New Name' from o_people where person_id like '%8'""")
def _(i):
    people = stage(c.derive_people(relationships(i)), "people")  # read three times
    renamed = people.filter("person_id like '%7'").withColumn("person_name", F.lit("New Name"))
    added = people.filter("person_id like '%8'").select(F.concat(F.lit("X_"), "person_id").alias("person_id"), F.lit("New Name").alias("person_name"))
    return g.merge_nodes(people, renamed.unionByName(added), "person_id")


@query("bad_categories", "select id, role_category from (select id, case when ticker<'S000020' then 'ADVISOR' when ticker<'S000030' then '' else role_category end as role_category from v_raw) where role_category not in ('BOARD','EXECUTIVE')")
def _(i):
    category = F.when(F.col("ticker") < "S000020", "ADVISOR").when(F.col("ticker") < "S000030", "").otherwise(F.col("role_category"))
    return g.bad_categories(i.view("v_raw").withColumn("role_category", category)).select("id", "role_category")


@query("check_people", """select 'blank_person_id' as "check", '' as value, count(*) as row_count from v_raw where ticker<'S000010' having count(*)>0
    union all select 'duplicate_person_id', p, count(*) from (select case when ticker<'S000010' then '' else person_name end as p from v_raw) group by p having count(*)>1""")
def _(i):
    pid = F.when(F.col("ticker") < "S000010", "").otherwise(F.col("person_name"))
    return g.check_people(i.view("v_raw").select(pid.alias("person_id"), "person_name"))


@query("duplicate_keys", "select ticker, person_name, count(*) as row_count from v_raw group by 1,2 having count(*)>1")
def _(i):
    return duplicate_keys(i.view("v_raw"), ["ticker", "person_name"])


@query("graph_document_lines", f"""
    select case when kind='edge' then 'edge' else 'node' end as element, id, document from (
      select 'edge' as kind, id, '{{"data":{{"id":"'||id||'","source":"'||source||'","target":"'||target||'","relationship":"'||relationship
        ||'","role":"'||role||'","role_category":"'||role_category||'","extraction_time":"'||extraction_time||'"}}}}' as document from ({_ELEMENTS})
      union all select 'person', id, '{{"data":{{"id":"'||id||'","type":"Person","person_id":"'||person_id||'","person_name":"'||person_name
        ||'","label":"'||label||'"}}}}' from ({_NODES}) where type='Person')""")
def _(i):
    nodes, edges = g.full_graph(graph(i))
    return g.graph_document(nodes.filter("type = 'Person'"), edges)


@query("graph_document_companies", f"""
    select 'node' as element, id, '{{"data":{{"id":'||to_json(id)||',"type":"Company","ticker":'||to_json(ticker)||',"company_name":'||to_json(company_name)
      ||',"universe":'||to_json(coalesce(universe,''))||',"sector":'||to_json(sector)||',"industry":'||to_json(industry)
      ||',"description_short":'||to_json(description_short)||',"label":'||to_json(label)||'}}}}' as document from ({_NODES}) where type='Company'""")
def _(i):
    nodes, edges = g.full_graph(graph(i))
    return g.graph_document(nodes.filter("type = 'Company'"), edges.limit(0))


@query("person_ids", "select person_name, person_id from o_pid")
def _(i):
    names = i.view("v_raw").select("person_name").distinct()
    return names.select("person_name", t.person_id_for(F.col("person_name")).alias("person_id"))


@query("person_keys", "select distinct person_name, regexp_replace(trim(regexp_replace(upper(person_name),'[^A-Z0-9\\s]','','g')),'\\s+','_','g') as person_key from v_raw")
def _(i):
    names = i.view("v_raw").select("person_name").distinct()
    return names.select("person_name", t.person_key(F.col("person_name")).alias("person_key"))


@query("title_relationship_types", """
    select p_partkey, string_agg(e,',' order by k) as types from (
      select p_partkey, t, unnest([1,2,3]) as k, unnest([
        case when regexp_matches(t,'chief executive officer|\\bceo\\b') then 'CEO_OF' end,
        case when regexp_matches(t,'chief financial officer|\\bcfo\\b') then 'CFO_OF' end,
        case when regexp_matches(t,'executive officer|chief |president|principal accounting officer|general counsel|corporate secretary|treasurer') then 'EXECUTIVE_OFFICER_OF' end]) as e
      from (select p_partkey, lower(case p_size%7 when 0 then 'Chief Executive Officer and CFO' when 1 then 'Vice President' when 2 then 'General Counsel'
        when 3 then 'Group CEO' when 4 then 'Chief Financial Officer' when 5 then 'Director' else 'Head of '||p_name end) as t from part))
    where e is not null group by 1""")
def _(i):
    size = F.col("p_size") % 7
    title = (
        F.when(size == 0, "Chief Executive Officer and CFO").when(size == 1, "Vice President").when(size == 2, "General Counsel")
        .when(size == 3, "Group CEO").when(size == 4, "Chief Financial Officer").when(size == 5, "Director")
        .otherwise(F.concat(F.lit("Head of "), "p_name"))
    )
    rows = i.table("part").select("p_partkey", F.array_join(t.title_relationships(title), ",").alias("types"))
    return rows.filter("types <> ''")

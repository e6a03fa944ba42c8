"""Property graph of people and companies: edges, neighbourhoods, search, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.text import (
    company_node_id, edge_id, graph_person_id, has_relationship_type, person_label, py_strip, relationship_type,
    text_or_empty,
)
from ledgermesh.operators.canonical import beside
from ledgermesh.operators.merge import duplicate_keys, latest_per_key
from ledgermesh.session import stage

EDGE_KEY = ["person_id", "ticker", "relationship_type", "role", "role_category"]
COMPANY_FIELDS = ["ticker", "company_name", "universe", "sector", "industry", "description_short"]


@dataclass(frozen=True)
class Graph:
    """Node and edge tables; edges run from a person to a company."""

    companies: DataFrame
    people: DataFrame
    edges: DataFrame


def graph_companies(df: DataFrame) -> DataFrame:
    """Company nodes: optional fields default to blank, the long description is left out."""
    return df.select("ticker", *[text_or_empty(F.col(c)).alias(c) for c in COMPANY_FIELDS[1:]])


def build_edges(rel: DataFrame) -> DataFrame:
    """Typed edges; rows of an unsupported category are left to ``bad_categories``."""
    role, category = F.col("role"), F.col("role_category")
    typed = rel.filter(has_relationship_type(role, category)).withColumn("relationship_type", relationship_type(role, category))
    return typed.select(*EDGE_KEY, "extraction_time")


def bad_categories(rel: DataFrame) -> DataFrame:
    return rel.filter(relationship_type(text_or_empty(F.col("role")), text_or_empty(F.col("role_category"))).isNull())


def orphan_edges(rel: DataFrame, companies: DataFrame, people: DataFrame) -> DataFrame:
    """Rows that name a company or a person the node tables do not have."""
    no_company = rel.join(companies.select("ticker"), "ticker", "left_anti")
    no_person = rel.join(people.select("person_id"), "person_id", "left_anti")
    return no_company.withColumn("missing", F.lit("company")).unionByName(no_person.withColumn("missing", F.lit("person")))


def merge_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Nodes merged on their key; incoming properties win."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return latest_per_key(both, [key], F.desc("_turn")).drop("_turn")


def merge_edges(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """Edges merged on their identity; the last extraction time wins."""
    both = old.withColumn("_turn", F.lit(0)).withColumn(seq, F.lit(0).cast("long")).unionByName(
        new.withColumn("_turn", F.lit(1)).withColumn(seq, F.col(seq).cast("long"))
    )
    return latest_per_key(both, EDGE_KEY, F.desc("_turn"), F.desc(seq)).drop("_turn", seq)


def edge_view(g: Graph) -> DataFrame:
    """Edges with both nodes' properties; edges lacking a node drop out."""
    return g.edges.join(g.people, "person_id").join(g.companies, "ticker")


def _radius(radius: int) -> int:
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    return radius


def company_graph(g: Graph, ticker: str, radius: int = 1) -> DataFrame:
    """Edges into a company, or all edges of the people attached to it."""
    direct = g.edges.filter(F.col("ticker") == ticker.upper())
    if _radius(radius) == 1:
        return direct
    people = direct.select("person_id").distinct()
    return g.edges.join(people, "person_id", "left_semi")


def person_graph(g: Graph, person_id: str, radius: int = 1) -> DataFrame:
    """Edges of a person, or all edges into the companies they are attached to."""
    direct = g.edges.filter(F.col("person_id") == person_id)
    if _radius(radius) == 1:
        return direct
    companies = direct.select("ticker").distinct()
    return g.edges.join(companies, "ticker", "left_semi")


def cross_company(g: Graph) -> DataFrame:
    """All edges of people attached to more than one company."""
    spread = g.edges.groupBy("person_id").agg(F.min("ticker").alias("first"), F.max("ticker").alias("last"))
    people = spread.filter("first <> last").select("person_id")
    return g.edges.join(people, "person_id", "left_semi")


def company_nodes(companies: DataFrame) -> DataFrame:
    return companies.select(
        company_node_id(F.col("ticker")).alias("id"), F.lit("Company").alias("type"), F.col("ticker").alias("label"),
        *COMPANY_FIELDS, F.lit(None).cast("string").alias("person_id"), F.lit(None).cast("string").alias("person_name"),
    )


def person_nodes(people: DataFrame) -> DataFrame:
    blank = [F.lit(None).cast("string").alias(c) for c in COMPANY_FIELDS]
    return people.select(
        graph_person_id(F.col("person_id")).alias("id"), F.lit("Person").alias("type"),
        person_label(F.col("person_name"), F.col("person_id")).alias("label"), *blank, "person_id", "person_name",
    )


def edge_elements(edges: DataFrame) -> DataFrame:
    """Edges with stable ids and node ids at both ends."""
    return edges.select(
        edge_id(*[F.col(c) for c in EDGE_KEY]).alias("id"),
        graph_person_id(F.col("person_id")).alias("source"),
        company_node_id(F.col("ticker")).alias("target"),
        F.col("relationship_type").alias("relationship"),
        "role", "role_category", "extraction_time",
    )


def full_graph(g: Graph) -> tuple[DataFrame, DataFrame]:
    """All nodes, isolated ones too, and all edges between existing nodes."""
    nodes = company_nodes(g.companies).unionByName(person_nodes(g.people))
    present = g.edges.join(g.people.select("person_id"), "person_id", "left_semi").join(
        g.companies.select("ticker"), "ticker", "left_semi"
    )
    return nodes, edge_elements(present)


def subgraph(g: Graph, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes at the ends of some edges, and the edges as elements."""
    companies = g.companies.join(edges.select("ticker").distinct(), "ticker", "left_semi")
    people = g.people.join(edges.select("person_id").distinct(), "person_id", "left_semi")
    return full_graph(Graph(companies, people, edges))


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line ``{"data": {...}}`` per node and edge, unique by id.

    The document stays a table of lines, so it is written in parallel and
    never gathered into one value.
    """
    company_cols = ["id", "type", *COMPANY_FIELDS, "label"]
    person_cols = ["id", "type", "person_id", "person_name", "label"]
    edge_cols = ["id", "source", "target", "relationship", "role", "role_category", "extraction_time"]

    def lines(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
        unique = df.dropDuplicates(["id"])
        return unique.select(
            F.lit(kind).alias("element"), "id", F.to_json(F.struct(F.struct(*columns).alias("data"))).alias("document")
        )

    companies = lines(nodes.filter("type = 'Company'"), company_cols, "node")
    people = lines(nodes.filter("type = 'Person'"), person_cols, "node")
    return companies.unionByName(people).unionByName(lines(edges, edge_cols, "edge"))


def filter_graph(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Elements left when node types and edge types are hidden.

    An edge is also hidden when the node at one of its ends is.
    """
    kept_nodes = nodes.filter(~F.col("type").isin(hidden))
    kept_edges = edges.filter(~F.col("relationship").isin(hidden))
    if {"Person", "Company"} & set(hidden):
        kept_edges = kept_edges.filter(F.lit(False))
    return kept_nodes, kept_edges


def neighborhood(nodes: DataFrame, edges: DataFrame, element: str) -> tuple[DataFrame, DataFrame]:
    """A node with its edges and neighbours, or an edge with both its ends."""
    near = edges.filter((F.col("source") == element) | (F.col("target") == element) | (F.col("id") == element))
    ends = near.select(F.explode(F.array("source", "target")).alias("id")).unionByName(
        nodes.filter(F.col("id") == element).select("id")
    )
    return nodes.join(ends.distinct(), "id", "left_semi"), near


def search(g: Graph, query: str, limit: int = fixed.SEARCH_ROWS) -> DataFrame:
    """Ranked companies and people; a blank query finds nothing."""
    q = F.lower(py_strip(F.lit(query)))
    ticker, name = F.lower("ticker"), F.lower("company_name")
    pid, pname = F.lower("person_id"), F.lower("person_name")
    rank = F.when(ticker == q, 0).when(ticker.startswith(q), 1).when(name.contains(q), 2)
    none = F.lit(None).cast("string")
    companies = g.companies.select(
        company_node_id(F.col("ticker")).alias("id"), F.lit("Company").alias("type"), F.col("ticker").alias("label"),
        "ticker", "company_name", none.alias("person_id"), none.alias("person_name"),
        rank.alias("rank"), F.col("ticker").alias("sort_key"),
    ).filter("rank is not null")
    people = g.people.filter(text_or_empty(pname).contains(q) | pid.contains(q)).select(
        graph_person_id(F.col("person_id")).alias("id"), F.lit("Person").alias("type"),
        person_label(F.col("person_name"), F.col("person_id")).alias("label"),
        none.alias("ticker"), none.alias("company_name"), "person_id", "person_name",
        F.lit(3).alias("rank"), F.coalesce("person_name", "person_id").alias("sort_key"),
    )
    found = companies.unionByName(people).filter(q != "")
    return found.orderBy("rank", "sort_key", "id").limit(limit).drop("sort_key")


def graph_counts(g: Graph) -> DataFrame:
    """Companies, people and edges; zeros where there are none."""
    return beside([
        g.companies.agg(F.count("*").alias("companies")),
        g.people.agg(F.count("*").alias("people")),
        g.edges.agg(F.count("*").alias("relationships")),
    ])


def counts_by_type(edges: DataFrame) -> DataFrame:
    """Edge count of each of the five types, zero included."""
    kind = F.col("relationship_type")
    row = edges.agg(*[F.count_if(kind == t).alias(t) for t in fixed.EDGE_TYPES])
    entries = F.array(
        *[F.struct(F.lit(t).alias("relationship_type"), F.col(t).alias("edge_count")) for t in fixed.EDGE_TYPES]
    )
    return row.select(F.inline(entries))


def reconcile(companies: DataFrame, people: DataFrame, rel: DataFrame, g: Graph) -> DataFrame:
    """Input and graph counts side by side, one row per check."""
    g = Graph(*[stage(df, "reconcile") for df in (g.companies, g.people, g.edges)])
    types = [F.count_if(F.col("relationship_type") == t) for t in fixed.EDGE_TYPES]
    typed = types[0]
    for t in types[1:]:
        typed = typed + t
    row = beside([
        companies.agg(F.count("*").alias("in_companies")),
        people.agg(F.count("*").alias("in_people")),
        rel.agg(F.count("*").alias("in_edges")),
        g.companies.agg(F.count("*").alias("companies")),
        g.people.agg(F.count("*").alias("people")),
        g.edges.agg(F.count("*").alias("edges"), typed.alias("typed_edges")),
        orphan_edges(g.edges, g.companies, g.people).agg(F.count("*").alias("orphans")),
        duplicate_keys(g.companies, ["ticker"]).agg(F.count("*").alias("duplicate_companies")),
        duplicate_keys(g.people, ["person_id"]).agg(F.count("*").alias("duplicate_people")),
    ])
    zero = F.lit(0)
    checks = [
        ("companies", "in_companies", "companies"), ("people", "in_people", "people"),
        ("relationships", "in_edges", "edges"), ("missing_endpoints", zero, "orphans"),
        ("duplicate_companies", zero, "duplicate_companies"), ("duplicate_people", zero, "duplicate_people"),
        ("type_count_sum", "edges", "typed_edges"),
    ]
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("check"),
            (F.col(expected) if isinstance(expected, str) else expected).cast("long").alias("expected"),
            F.col(actual).cast("long").alias("actual"),
        )
        for name, expected, actual in checks
    ])
    return row.select(F.inline(entries)).withColumn("ok", F.col("expected") == F.col("actual"))


def check_people(people: DataFrame) -> DataFrame:
    """Blank and duplicate person ids as (check, value, row_count)."""
    pid = text_or_empty(F.col("person_id"))
    blank = people.filter(py_strip(pid) == "").groupBy(F.lit("blank_person_id").alias("check"), pid.alias("value")).agg(
        F.count("*").alias("row_count")
    )
    repeated = duplicate_keys(people.select(pid.alias("value")), ["value"]).select(
        F.lit("duplicate_person_id").alias("check"), "value", "row_count"
    )
    return blank.unionByName(repeated)

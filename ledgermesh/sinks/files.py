"""Writers: full replace, ordered CSV, appends, and the report sets.

Ordered files are written as range-partitioned parts whose names sort in data
order, so no result passes through one task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.operators import projection as p
from ledgermesh.operators.extraction import gate_edges
from ledgermesh.operators.filings import filing_company_nodes, filing_person_nodes
from ledgermesh.schemas import FILING_EDGES, MISSING_COMPANIES, PARSE_LOG, RELATIONSHIPS
from ledgermesh.session import stage

_POINTER, _NEXT, _OLD = "CURRENT", ".next", ".old"
#: Doubled quotes, and cells as they are: the writer would strip blanks and line breaks at their ends.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as the whole table at a plain path; it may be computed from the old one.

    The rows are written aside first, then take the place of the old table by two renames,
    so at any time either the old or the new table is whole: a run that breaks off before
    them leaves the old one, and one that breaks off between them is made good by
    ``recover_table`` or by the next replacement. ``publish`` has no such gap.
    """
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}{_NEXT}", f"{path.rstrip('/')}{_OLD}"
    recover_table(spark, path)
    df.write.mode("overwrite").parquet(fresh)
    files, place = _at(spark, path)
    if files.exists(place):
        _rename(spark, path, old)
    _rename(spark, fresh, path)
    files.delete(_at(spark, old)[1], True)


def recover_table(spark: SparkSession, path: str) -> None:
    """Put the old table back where a replacement broke off between its renames."""
    old = f"{path.rstrip('/')}{_OLD}"
    files, place = _at(spark, path)
    if files.exists(_at(spark, old)[1]):
        if files.exists(place):
            files.delete(_at(spark, old)[1], True)
        else:
            _rename(spark, old, path)


def publish(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write ``df`` as the next version of the table at ``root``, and point readers to it last; its number.

    Versions are folders of their own, and the pointer is one small file that is replaced by
    a rename over it, so readers see the old table or the new one, whatever fails in between.
    ``df`` may be computed from the current version. The last ``keep`` versions stay for
    readers that hold them.
    """
    spark = df.sparkSession
    files, place = _at(spark, root)
    known = [int(n[2:]) for s in (files.listStatus(place) if files.exists(place) else []) if (n := s.getPath().getName()).startswith("v-")]
    current = current_version(spark, root)
    number = max([*known, current if current is not None else 0]) + 1
    df.write.parquet(f"{root}/v-{number:08d}")
    _write_small(spark, f"{root}/{_POINTER}", str(number))
    for version in sorted(known)[: max(0, len(known) + 1 - keep)]:
        if version != current:
            files.delete(_at(spark, f"{root}/v-{version:08d}")[1], True)
    return number


def current_version(spark: SparkSession, root: str) -> int | None:
    """Number of the version that readers see, None before the first."""
    files, pointer = _at(spark, f"{root}/{_POINTER}")
    return int(spark.read.text(f"{root}/{_POINTER}").first().value) if files.exists(pointer) else None


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    number = current_version(spark, root)
    if number is None:
        raise FileNotFoundError(f"{root} has no published version")
    return spark.read.parquet(f"{root}/v-{number:08d}")


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in the place of an older one by a rename over it."""
    fs = spark._jvm.org.apache.hadoop.fs
    files, place = _at(spark, path)
    place = files.makeQualified(place)
    fresh = files.makeQualified(_at(spark, f"{path}{_NEXT}")[1])
    out = files.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, place, options)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    files, place = _at(spark, source)
    if not files.rename(place, _at(spark, target)[1]):
        raise OSError(f"{source} could not take the place of {target}")


def export_csv(df: DataFrame, path: str, columns: list[str], order: list) -> None:
    """CSV with exactly these columns, in this order of rows."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, **CSV)


def append_missing(df: DataFrame, path: str) -> None:
    """Append tickers that an answer left out."""
    df.select(*MISSING_COMPANIES.names).write.mode("append").csv(path, **CSV)


def write_manifest(spark: SparkSession, folder: str, files: dict[str, DataFrame]) -> None:
    """``manifest.json``: the rows of every file of an output set, counted as read back, and its columns in order."""
    counts = None
    for name, df in files.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("file"), "rows", F.lit(",".join(df.columns)).alias("columns"))
        counts = one if counts is None else counts.unionByName(one)
    rows = {r.file: {"rows": r.rows, "columns": r.columns.split(",")} for r in counts.collect()}  # one row per file
    _write_small(spark, f"{folder}/manifest.json", json.dumps(rows, indent=1, sort_keys=True))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(lines: DataFrame, path: str) -> None:
    """Graph document as JSON lines, one element per line."""
    lines.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_edges_by_type(edges: DataFrame, path: str) -> None:
    """Edges in one folder per type."""
    edges.write.mode("overwrite").partitionBy("relationship_type").parquet(path)


def write_reports(rel: DataFrame, folder: str, top: tuple[int, int, int] = (50, 50, 100), complete: bool = False) -> None:
    """The projection reports: a summary, the concentration, and the tables."""
    rel = stage(rel.select(*RELATIONSHIPS.names), "relationships")
    pairs = stage(p.person_companies(rel), "person-companies")
    edges = stage(p.projection(pairs), "edges")
    names = p.company_names(rel)
    degrees = p.person_degrees(pairs)
    distribution = stage(p.company_distribution(edges, names), "distribution")
    labels = p.projection_components(pairs)
    people, companies, strongest = top
    write_json(p.projection_summary(rel, pairs, edges, distribution, labels), f"{folder}/summary")
    write_json(p.concentration(degrees), f"{folder}/projection_concentration")
    reports = {
        "shared_person_distribution": (p.shared_distribution(edges), []),
        "person_degree_distribution": (p.degree_buckets(degrees), []),
        "top_people_by_company_degree": (
            p.top_people(degrees, pairs, rel, people), [F.desc("person_company_degree"), F.asc("person_id")]
        ),
        "company_degree_distribution": (distribution, ["ticker"]),
        "top_companies_by_projected_degree": (
            p.top_companies(distribution, companies), [F.desc("company_projected_degree"), F.asc("ticker")]
        ),
        "top_company_edges": (
            p.top_edges(edges, rel, strongest),
            [F.desc("shared_person_count"), F.asc("source_ticker"), F.asc("target_ticker")],
        ),
        "connected_components": (p.component_report(edges, labels), ["component_rank"]),
        "threshold_simulation": (p.threshold_report(edges, names), ["threshold"]),
        "topk_simulation": (p.topk_report(edges, names), ["top_k"]),
    }
    if complete:
        reports["complete_company_projection"] = (edges, ["source_ticker", "target_ticker"])
    for name, (df, order) in reports.items():
        ordered = df.orderBy(*order) if order else df
        ordered.write.mode("overwrite").csv(f"{folder}/{name}", **CSV)
    spark = rel.sparkSession
    written = {name: _csv(spark, f"{folder}/{name}") for name in reports}
    written |= {name: spark.read.json(f"{folder}/{name}") for name in ("summary", "projection_concentration")}
    write_manifest(spark, folder, written)


def write_filing_outputs(companies: DataFrame, edges: DataFrame, log: DataFrame, folder: str) -> None:
    """Company and person nodes, edges and the parse log of a filing run."""
    kept = stage(gate_edges(edges), "edges")
    export_csv(filing_company_nodes(companies), f"{folder}/company_nodes", ["node_id", "node_type", "ticker", "cik", "company_name"], ["node_id"])
    export_csv(filing_person_nodes(kept), f"{folder}/person_nodes", ["node_id", "node_type", "name", "normalized_name"], ["node_id"])
    export_csv(kept, f"{folder}/edges", FILING_EDGES, ["ticker", "relationship_type", "source_person"])
    export_csv(log, f"{folder}/parse_log", PARSE_LOG, ["ticker"])
    spark = log.sparkSession
    write_manifest(spark, folder, {name: _csv(spark, f"{folder}/{name}") for name in ("company_nodes", "person_nodes", "edges", "parse_log")})

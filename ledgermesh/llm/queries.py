"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.llm import (
    exact_dedup, language_model, line_dedup, merkle, mixing, near_duplicates, packing, periodic_runs, quality, repeats, token_files, toxicity,
    warc,
)
from ledgermesh.llm.common import documents, stage
from ledgermesh.llm.tokens import public_path


def op1_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(documents(spark, folder).select("doc_id", "text"), with_bytes=False)
    return kept.drop("kept")


def op2_tokenizer_fertility(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(
        documents(spark, folder).select("doc_id", "lang", "text"), public_path("piece_bpe_32k.model"), public_path("byte_bpe_50k.json")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *quality.BANDED, "failed_measure",
    )


def op3_salvaged_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.new_folder(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{folder.rstrip('/')}/pages.parquet"), path)
    read = stage(warc.read_archives(spark, path, payloads=False), "archive-records")
    warc.log_gaps(read, token_files.new_folder(spark, "archive-gaps"))
    return read.filter("kind = 'record'").select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"),
    )


def op4_packed_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.new_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, folder).select("doc_id", "text"), path, public_path("byte_bpe_50k.json"))
    read = token_files.read_token_files(token_files.token_blocks(spark, path))
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op5_mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder).select("doc_id", "text", "source"), carry=[])
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op6_near_duplicate_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, folder).select("doc_id", "text"))


def op7_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_sequences(documents(spark, folder).select("doc_id", "text"), public_path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups_of_equal_texts(documents(spark, folder).select("doc_id", "text"))


def op9_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return language_model.cross_entropy_difference(
        documents(spark, folder).select("doc_id", "text"), labels.filter("quality = 1"), public_path("piece_bpe_32k.model")
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return toxicity.scored(documents(spark, folder).select("doc_id", "text"), labels)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    tampered = periodic_runs.with_periodic_tails(documents(spark, folder).select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(tampered))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verification(documents(spark, folder))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.without_shared_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_strings": op1_repeated_strings,
    "op2_tokenizer_fertility": op2_tokenizer_fertility,
    "op3_salvaged_archives": op3_salvaged_archives,
    "op4_packed_token_files": op4_packed_token_files,
    "op5_mixing_to_weights": op5_mixing_to_weights,
    "op6_near_duplicate_classes": op6_near_duplicate_classes,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FOUR = "||".join(f"substr('{_LETTERS}', 1 + (c // {d}) % 32, 1)" for d in (32768, 1024, 32, 1))

CHECKS: dict[str, str] = {
    "op3_salvaged_archives": f"""
        with payloads as (select page_id, coalesce(html, '') as html from pages),
        coded as (select page_id, html, strlen(html) as payload_bytes, sha1(html) as code, max(page_id) over (partition by html) as kept from payloads)
        select page_id, payload_bytes,
               array_to_string(list_transform(list_transform(range(0, 8), lambda k: ('0x' || substr(code, 1 + 5 * k, 5))::int), lambda c: {_FOUR}), '') as payload_digest,
               case when page_id = kept then 'response' else 'revisit' end as record_type,
               case when page_id < kept then kept end as refers_to
        from coded
    """,
    "op8_exact_dedup": r"""
        with texts as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id is not distinct from min(doc_id) over w as kept, sha256(norm) as text_sha256
        from texts window w as (partition by norm)
    """,
    "op12_merkle_manifest": r"""
        with recursive coded as (
            select doc_id, lang, crc % 3 = 0 as hit,
                   coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head, text
            from documents, lateral (
                select xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, k: xor(x // 2, 3988292384 * (x % 2))))) as crc
            )
        ),
        hashed as (
            select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
                   case when hit then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
                   else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as shown
            from coded
        ),
        leaves as (
            select *, dense_rank() over (order by lang nulls first) - 1 as tree,
                   row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank
            from hashed
        ),
        low(tree, height, nodes) as (
            select tree, 0, list(leaf order by rank) from leaves group by tree
            union all
            select tree, height + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
            from low where len(nodes) > 1
        ),
        subroots as (select tree, nodes[1] as subroot, height as steps from low where len(nodes) = 1),
        high(height, nodes) as (
            select 0, list(subroot order by tree) from subroots
            union all
            select height + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
            from high where len(nodes) > 1
        ),
        folds(doc_id, leaf, shown, tree, steps, place, height, acc, siblings) as (
            select doc_id, leaf, shown, tree, steps, case when steps = 0 then tree else rank end, 0, shown, '' from leaves join subroots using (tree)
            union all
            select f.doc_id, f.leaf, f.shown, f.tree, f.steps, case when f.height + 1 = f.steps then f.tree else f.place // 8 end, f.height + 1,
                   sha256(array_to_string(n.nodes[f.place // 8 * 8 + 1 : f.place], '') || f.acc || array_to_string(n.nodes[f.place + 2 : f.place // 8 * 8 + 8], '')),
                   f.siblings || array_to_string(n.nodes[f.place // 8 * 8 + 1 : f.place], '') || array_to_string(n.nodes[f.place + 2 : f.place // 8 * 8 + 8], '')
            from folds f
            join (select tree, height, nodes from low where len(nodes) > 1
                  union all select tree, steps + height, nodes from high, subroots where len(nodes) > 1) n
              on n.tree = f.tree and n.height = f.height
        ),
        ends as (select * from folds qualify height = max(height) over (partition by tree)),
        top as (select nodes[1] as root from high where len(nodes) = 1)
        select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, acc as folded_root, acc = root as verified
        from ends join subroots using (tree) cross join top
    """,
    "op13_line_dedup": r"""
        with texts as (select row_number() over () as id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        lines as (select id, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from texts),
        keyed as (
            select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines
        ),
        judged as (
            select *, length(key) >= 10 and doc_id is distinct from first_value(doc_id) over (partition by key order by doc_id nulls last) as lost
            from keyed
        )
        select doc_id, count(*) as n_lines, count_if(lost) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by place) filter (not lost), '')) as kept_sha256
        from judged group by id, doc_id
    """,
}

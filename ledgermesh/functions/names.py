"""Person-name expressions for filings: clean-up, validity and capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.text import any_word, clean_text, let

_WORD_EDGE_MARKS = r"(?:(?<=^)|(?<= ))[,.;:()\[\]]+|[,.;:()\[\]]+(?= |$)"
_LABEL_EDGES = r"^[ .:\-–—]+|[ .:\-–—]+$"
_PREFIXES = f"(?i)^(?:(?:{any_word(fixed.HONORIFIC_PREFIXES)})(?: |$))++"
_SUFFIXES = f"(?i)(?:(?:^| )(?:{any_word(fixed.HONORIFIC_SUFFIXES)})(?= |$))++$"
_VOCABULARY = sorted({word for label in fixed.FILING_LABELS for word in label.split()})
NAMES = rf"(?U)\b({fixed.NAME_CAPTURE})\b"


def _has_word(words: list[str]) -> str:
    return rf"(?:^| )\.*(?:{any_word(words)})\.*(?: |$)"


def _only_words(words: list[str]) -> str:
    return rf"^(?:\.*+(?:{any_word(words)})\.*+(?: |$))++$"


def normalize_name(c: Column) -> Column:
    """A name without bullets, trailing remarks, honorifics or odd characters."""
    name = clean_text(c)
    name = F.regexp_replace(name, r"^[•*\-–—\d.\s]+", "")
    name = F.regexp_replace(name, r"(?i)\s*,?\s*(?:Age|Director|Class|Independent).*$", "")
    name = F.regexp_replace(clean_text(name), _WORD_EDGE_MARKS, "")
    name = F.regexp_replace(F.regexp_replace(name, _PREFIXES, ""), _SUFFIXES, "")
    return clean_text(F.regexp_replace(name, "[^A-Za-z'’ .-]", ""))


def canonical_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_name(c)), "[^a-z0-9]", "")


def is_taxonomy_tag(c: Column) -> Column:
    text = clean_text(c)
    return text.rlike(fixed.TAXONOMY_TAG) | text.rlike("^[A-Za-z]+(?:[A-Z][a-z0-9]++)++$")


def is_filing_label(c: Column) -> Column:
    """True for a section heading, an item label or a taxonomy tag."""
    bare = F.regexp_replace(F.lower(clean_text(c)), _LABEL_EDGES, "")
    return (
        bare.isin(fixed.FILING_LABELS)
        | F.lower(normalize_name(c)).isin(fixed.FILING_LABELS)
        | bare.rlike(r"^item\s+\d{1,2}[a-z]?\b")
        | is_taxonomy_tag(c)
    )


def _phrases() -> str:
    return rf"\b(?:{any_word(fixed.DOCUMENT_PHRASES)})\b"


def name_rejection_reason(c: Column) -> Column:
    """Why a text is no person name, null when it is one; the first reason counts."""

    def reason(s: Column) -> Column:
        name, raw, bare = s["name"], s["raw"], s["bare"]
        lowered = F.lower(name)
        pair = F.lit(False)
        for left, right in fixed.BOILERPLATE_PAIRS:
            pair = pair | (lowered.rlike(f"(?:^| ){left}(?: |$)") & lowered.rlike(f"(?:^| ){right}(?: |$)"))
        tokens = F.size(F.split(name, " "))
        return (
            F.when(name == "", "empty_after_normalization")
            .when(
                lowered.isin(fixed.NAME_STOPWORDS)
                | bare.isin(fixed.FILING_LABELS)
                | lowered.isin(fixed.FILING_LABELS)
                | bare.rlike(r"^item\s+\d{1,2}[a-z]?\b")
                | is_taxonomy_tag(raw),
                "sec_section_or_stopword",
            )
            .when(pair, "legal_boilerplate_phrase")
            .when(lowered.rlike(_phrases()) | bare.rlike(_phrases()), "document_name_phrase")
            .when(tokens < 2, "too_few_tokens")
            .when(tokens > 5, "too_many_tokens")
            .when(~name.rlike("[A-Za-z][^ ]* .*[A-Za-z]"), "too_few_alpha_tokens")
            .when(lowered.isin(fixed.TITLE_ONLY_PHRASES), "title_only_phrase")
            .when(lowered.rlike(_only_words(fixed.TITLE_WORDS)), "all_title_words")
            .when(lowered.rlike(_has_word(fixed.DOCUMENT_TERMS)), "document_name_term")
            .when(lowered.rlike(_has_word(fixed.CONNECTOR_WORDS)), "blocked_connector_token")
            .when(lowered.rlike(_has_word(fixed.ORGANIZATION_TERMS)), "organization_term")
            .when(~name.rlike("^(?:[A-Z][a-zA-Z'’.-]*+(?: |$))++$"), "invalid_name_casing_or_characters")
            .when(lowered.rlike(_only_words(_VOCABULARY)), "all_filing_vocabulary")
        )

    raw = clean_text(c)
    parts = F.struct(
        raw.alias("raw"),
        normalize_name(c).alias("name"),
        F.regexp_replace(F.lower(raw), _LABEL_EDGES, "").alias("bare"),
    )
    return let(parts, reason)


def is_person_name(c: Column) -> Column:
    return name_rejection_reason(c).isNull()


def _title_case(name: Column) -> Column:
    """First letter after every non-letter in capitals, the others small."""
    chunks = F.split(name, r"(?<=[^A-Za-z])")
    cased = F.transform(chunks, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2)))))
    return F.array_join(cased, "")


def signature_name(c: Column) -> Column:
    """Signer name: doubled names halved, titles cut off, capitals title-cased."""
    titled = rf"(?s) \.*(?i:{any_word(fixed.SIGNER_TITLE_STARTERS)})\.*(?: .*)?$"

    def halved(name: Column) -> Column:
        at = F.floor(F.length(name) / 2).cast("int")  # the blank between two equal halves
        first = F.substring(name, F.lit(1), at)
        return F.when(name == F.concat(first, F.lit(" "), first), first).otherwise(name)

    def untitled(name: Column) -> Column:
        two = F.regexp_extract(name, r"^\S+ \S+", 0)
        return F.concat(two, F.regexp_replace(F.substr(name, F.length(two) + 1), titled, ""))

    name = let(let(normalize_name(c), halved), untitled)
    return let(name, lambda n: F.when(n.rlike("[A-Z]") & ~n.rlike("[a-z]"), _title_case(n)).otherwise(n))


def signature_candidate(c: Column) -> Column:
    """Valid signer name, or ``""``; one trailing table label is dropped."""
    labels = any_word(fixed.SIGNATURE_LABELS)
    bare = F.regexp_replace(signature_name(c), rf"(?i)(?:^| )\.*(?:{labels})\.*$", "")

    def check(name: Column) -> Column:
        embedded = name.rlike(rf"(?i)(?:^| )\.*(?:{labels})\.*(?: |$)")
        return F.when(~embedded & is_person_name(name), name).otherwise("")

    return let(bare, check)


def names_in(c: Column) -> Column:
    """Runs of two to five capitalised words."""
    return F.regexp_extract_all(c, F.lit(NAMES), F.lit(1))


def name_candidates(c: Column) -> Column:
    """Texts of a fragment that may be names: those after ``/s/`` first, then all others."""
    signed = F.regexp_extract_all(c, F.lit(rf"(?iU)/s/\s*({fixed.NAME_CAPTURE})"), F.lit(1))
    return F.concat(signed, names_in(c))


def signature_names(c: Column) -> Column:
    """Valid names in a fragment, in the order of its candidates."""
    return F.filter(F.transform(name_candidates(c), signature_candidate), lambda n: n != "")


def signer_title_edges(title: Column) -> Column:
    """Edge types a signer's title stands for; no broad executive edge."""
    lowered = F.lower(title)
    ceo = lowered.rlike(r"chief executive officer|(?U)\bceo\b|principal executive officer")
    cfo = lowered.rlike(r"chief financial officer|(?U)\bcfo\b|principal financial officer")
    board = title.rlike(r"(?iU)\bdirector\b")
    return F.array_compact(F.array(F.when(ceo, "CEO_OF"), F.when(cfo, "CFO_OF"), F.when(board, "BOARD_OF")))


def person_node_id(c: Column) -> Column:
    """Node id of a filing person: readable part plus a digest of the canonical name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(normalize_name(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    digest = F.substring(F.sha1(canonical_name(c)), 1, 10)
    return F.concat(F.lit("person:"), slug, F.lit(":"), digest)

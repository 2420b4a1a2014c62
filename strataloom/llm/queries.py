"""One thin query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .encoding import round_trip
from .exact_dedup import exact_dedup
from .minhash import near_duplicates
from .packing import packed
from .quality import judged, learn
from .secrets import scanned
from .substring_dedup import digested
from .token_counts import counted
from .toxicity import held_out, scored
from .toxicity import learn as learn_toxicity
from .warc import dedup_archives, read_headers, write_archives


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    folder = dedup_archives(spark, write_archives(spark, pages), least_bytes=0)
    return read_headers(spark, folder).select(
        F.col("row_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def vocabulary_file(name: str) -> str:
    """Where the public vocabularies are: STRATALOOM_VOCABULARIES, else the installed package."""
    folder = os.environ.get("STRATALOOM_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from flat token files."""
    return counted(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), end=50256)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return scored(docs, learn_toxicity(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learn(docs, table(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

#: The contract's three kinds and what this operator adds to them, in the order in which spans of one start are listed:
#: kind, pattern, group whose length counts, its least length.
_SECRET_KINDS = [
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{20,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", 0, 0),
    ("pem", "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----", 0, 0),
]


def _secrets_of(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """The spans of a kind: matches and the gaps between them tell where each begins."""
    return f"""
        SELECT doc_id, {place} AS place, '{kind}' AS kind, list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT
            + coalesce(list_sum(list_transform(found[:i - 1], lambda f: length(f))), 0)::BIGINT AS start, found[i] AS match
        FROM (SELECT doc_id, found, gaps, unnest(list_filter(range(1, len(found) + 1), lambda i: length(regexp_extract(found[i], '{pattern}', {group})) >= {least})) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM d))"""


_SECRETS_SQL = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({" UNION ALL ".join(_secrets_of(i, *k) for i, k in enumerate(_SECRET_KINDS))}),
        t AS (SELECT doc_id, place, kind, start, concat(kind, ':', start, ':', start + length(match)) AS span FROM s),
        g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM t GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
        five AS (SELECT page_id, n, first_id, list_transform(range(8), lambda i: ('0x' || x[1 + 5 * i : 5 + 5 * i])::BIGINT) AS v FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes,
            array_to_string(list_transform(v, lambda a: array_to_string(list_transform([32768, 1024, 32, 1],
                lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (a // s) % 32]), '')), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM five""",
    "op3_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(len(w) - 19)) AS start, w FROM d WHERE len(w) >= 20),
        k AS (SELECT doc_id, start, array_to_string(w[start + 1 : start + 20], ' ') AS win FROM s),
        l AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS n FROM k),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(start, start + 20)))) AS gone FROM l WHERE n > 1 GROUP BY doc_id),
        r AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM d LEFT JOIN g USING (doc_id)),
        u AS (SELECT doc_id, n_words, n_removed, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM r),
        t AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept FROM u
            LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM g) x ON u.doc_id = x.doc_id AND u.i = x.i WHERE x.i IS NULL GROUP BY u.doc_id)
        SELECT r.doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM r LEFT JOIN t USING (doc_id)""",
    "op8_near_duplicates": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT min(doc_id) AS node, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d GROUP BY text),
        s AS (SELECT node, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS shingle FROM n),
        m AS (SELECT node, shingle, row_number() OVER (PARTITION BY node, shingle) AS nth FROM s),
        t AS (SELECT node, count(*) AS total FROM m GROUP BY node),
        p AS (SELECT x.node AS a, y.node AS b, count(*) AS common FROM m x JOIN m y USING (shingle, nth) WHERE x.node < y.node GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN t x ON x.node = a JOIN t y ON y.node = b WHERE 5 * common >= 4 * (x.total + y.total - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT node, node AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT doc_id, min(doc_id) OVER g AS class_id, count(*) OVER g AS class_size, doc_id = min(doc_id) OVER g AS kept
        FROM d JOIN n USING (text) JOIN c USING (node) WINDOW g AS (PARTITION BY root)""",
    "op9_secret_scan": _SECRETS_SQL,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

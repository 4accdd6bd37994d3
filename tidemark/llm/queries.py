"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import table
from tidemark.llm.fingerprints import compare_documents
from tidemark.llm.html_text import extract_pages
from tidemark.llm.language_id import judge_language
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.topk_search import top_k
from tidemark.llm.toxicity import judge_toxicity
from tidemark.llm.url_filter import judge_urls, rules_frame

#: Fixed values of op3: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_file(name: str) -> bytes:
    """The content of a public tokenizer's file; read on the driver, since executors may not have it."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules_frame(spark, URL_RULES)).drop("url")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("remaining")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_language(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_topk_search": op2_topk_search,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_html_text": op8_html_text,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op2_topk_search": r"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
    """,
    "op4_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, encode(coalesce(text, '')) AS t FROM documents),
        w AS (SELECT r, doc_id, unnest(range(greatest(length(h) // 2 - 49, 0))) AS i,
            unnest(list_transform(range(greatest(length(h) // 2 - 49, 0)), lambda i: md5(t[i + 1 : i + 50]))) AS g FROM d),
        m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
        hit AS (SELECT r, i FROM w JOIN m USING (g) WHERE least < coalesce(doc_id, 9223372036854775806)),
        step AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
        run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM step),
        span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY r, k),
        gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM span
            UNION ALL SELECT r, max(b), NULL FROM span GROUP BY r UNION ALL SELECT r, 0, NULL FROM d WHERE r NOT IN (SELECT r FROM span)),
        kept AS (SELECT gap.r, string_agg(substr(h, 2 * gap.a + 1, 2 * (coalesce(gap.b, length(h) // 2) - gap.a)), '' ORDER BY gap.a) AS h FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r),
        total AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY r)
        SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
        FROM d LEFT JOIN total ON total.r = d.r LEFT JOIN kept ON kept.r = d.r
    """,
    "op3_url_filter": r"""
        WITH rules(host, path, verdict) AS (VALUES
            ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        urls AS (SELECT page_id, row_number() OVER () AS n,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path FROM pages),
        fits AS (SELECT u.n, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS place
            FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM urls u LEFT JOIN fits f ON f.n = u.n AND f.place = 1
    """,
}

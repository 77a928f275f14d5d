"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.byte_bpe import encode_decode
from codeloom.llm.common import fresh_path
from codeloom.llm.decontaminate import contamination
from codeloom.llm.embedding_dedup import near_vectors
from codeloom.llm.fill_in_middle import fill_in_middle, restored
from codeloom.llm.filter_audit import audit
from codeloom.llm.language_id import identify
from codeloom.llm.minhash_dedup import near_duplicates
from codeloom.llm.packing import pack
from codeloom.llm.suffix_dedup import PASSAGE_WORDS, remove_repeats
from codeloom.llm.token_counts import count_tokens
from codeloom.llm.token_files import read_token_files, write_token_files
from codeloom.llm.url_filter import Rule, filter_urls
from codeloom.llm.warc import read_archives, write_archives

URL_RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path)
    return rows.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, outputs=("n_tokens", "ids_crc32"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_ids=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_warc": op2_warc,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_url_filter": op6_url_filter,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_token_files": op8_token_files,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_filter_audit": op13_filter_audit,
    }


_HOST = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', {})"

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN m.original <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.original <> d.page_id THEN m.original END AS refers_to
        FROM d LEFT JOIN m ON d.payload_bytes >= 1000 AND d.payload_digest = m.payload_digest
    """,
    "op6_url_filter": f"""
        WITH u AS (SELECT page_id, translate({_HOST.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          {_HOST.format(2)} AS path FROM pages),
        r(host_rule, path_rule, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        f AS (SELECT u.page_id, u.host, u.path, r.host_rule || r.path_rule AS rule, r.verdict,
                     row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host_rule || r.path_rule) DESC NULLS LAST) AS k
              FROM u LEFT JOIN r ON (u.host = r.host_rule OR ends_with(u.host, '.' || r.host_rule)) AND starts_with(u.path, r.path_rule))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
        x AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT) AS k FROM d),
        y AS (SELECT doc_id, t, u, n, least(k[1] % (n + 1), k[2] % (n + 1))::BIGINT AS a, greatest(k[1] % (n + 1), k[2] % (n + 1))::BIGINT AS b,
                     CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
        z AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM y)
        SELECT doc_id, n::BIGINT AS n, form, if(form = 'plain', NULL, length(p)) AS prefix_chars, if(form = 'plain', NULL, length(m)) AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM z
    """,
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
        d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     [(len(words) < 100)::INT, (100 * len(list_distinct(words)) < 80 * len(words))::INT,
                      (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT,
                      regexp_matches(text, '[#$%&*|]')::INT, (coalesce(doc_id > low, false))::INT] AS f
              FROM w LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
        b AS (SELECT range AS i FROM range(1, 6)),
        o AS (SELECT [b1.i, b2.i, b3.i, b4.i, b5.i] AS o FROM b b1, b b2, b b3, b b4, b b5 WHERE len(list_distinct([b1.i, b2.i, b3.i, b4.i, b5.i])) = 5),
        e AS (SELECT part, o, i AS step, n, good, toxic, f[o[i]] = 1 AS hit,
                     list_sum(list_transform(o[1:i - 1], lambda x: f[x])) AS gone, list_sum(f) AS fails FROM g, o, b),
        r AS (SELECT part, o, step, sum(n) FILTER (coalesce(gone, 0) = 0 AND NOT hit) AS kept, sum(n) FILTER (coalesce(gone, 0) = 0 AND hit) AS removed,
                     sum(n) FILTER (gone > 0 AND hit) AS redundant, sum(n) FILTER (hit AND fails = 1) AS unique_fails,
                     sum(n) FILTER (coalesce(gone, 0) = 0 AND hit AND good) AS good_lost, sum(n) FILTER (coalesce(gone, 0) = 0 AND hit AND toxic) AS toxic_lost
              FROM e GROUP BY ALL)
        SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step,
               coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, o[step]), 0)::BIGINT AS shapley
        FROM r
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

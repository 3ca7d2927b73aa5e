"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm.clusters import cluster
from gridwright.llm.exact_dedup import exact_dedup
from gridwright.llm.host_rules import MAX_REPEAT_PERCENT, MIN_WORDS, host_quality
from gridwright.llm.language import learn_and_identify
from gridwright.llm.minhash import near_duplicates
from gridwright.llm.packing import pack_documents
from gridwright.llm.pieces import encode_decode
from gridwright.llm.quality import quality
from gridwright.llm.records import token_records
from gridwright.llm.substring_dedup import substring_dedup
from gridwright.llm.token_counts import edited_counts
from gridwright.llm.topk import top_k
from gridwright.llm.whitening import whiten
from gridwright.session import table


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in ``TOKENIZER_DIR`` if that is set, else where the package of public
    tokenizers keeps it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir), words=4, percent=80)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(_docs(spark, sf_dir)).drop("host", "host_rate")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir), window=20)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(_docs(spark, sf_dir))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_docs(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), count=40, rounds=5, scale=256, seed=2)


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
_ASSIGNED = """a{k} AS MATERIALIZED (SELECT vec_id, e, struct_extract(min({{'d': q + cq - 2 * CAST(list_dot_product(e, c) AS BIGINT), 'k': k}}), 'k') AS k, struct_extract(min({{'d': q + cq - 2 * CAST(list_dot_product(e, c) AS BIGINT), 'k': k}}), 'd') AS d
          FROM v, (SELECT k, c, CAST(list_dot_product(c, c) AS BIGINT) AS cq FROM c{k}) GROUP BY vec_id, e)"""
_MOVED = """u{k} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS j FROM a{k}) GROUP BY k, j),
        m{k} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS c FROM u{k} GROUP BY k),
        c{next} AS MATERIALIZED (SELECT k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (k))"""

SQL = {
    "op12_top_k": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS e FROM embeddings WHERE {_SOUND}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op13_clusters": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, e, CAST(list_dot_product(e, e) AS BIGINT) AS q FROM (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = 64 AND {_SOUND})),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT sha256('2:' || vec_id) AS h, e AS c FROM v ORDER BY h LIMIT 40)),
        {", ".join(_ASSIGNED.format(k=k) + ", " + _MOVED.format(k=k, next=k + 1) for k in range(5))},
        {_ASSIGNED.format(k=5)},
        i AS (SELECT k, CAST(sum(d) AS BIGINT) AS ci FROM a5 GROUP BY k),
        n AS (SELECT k, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS h FROM c5)
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, ci AS cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a5) AS inertia, h AS centroid_sha256 FROM a5 JOIN i USING (k) JOIN n USING (k)""",
    "op9_exact": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op2_host_rules": f"""
        WITH w AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
                  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 7]) AS n FROM p),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 8) AS r(k) WHERE n > 1 GROUP BY doc_id),
        base AS (
          SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
                 CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
        h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS x
              FROM f WHERE source IS NOT NULL GROUP BY source),
        t1 AS (SELECT least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS m, sum(x * x / n) / sum(n) AS q, count(*) / sum(n) AS k FROM h),
        t2 AS (SELECT m, greatest(q - m * m - k * m * (1 - m), m * (1 - m) / 1e6) AS v FROM t1),
        t3 AS (SELECT m, least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) AS s FROM t2),
        bad AS (SELECT source, (x + m * s) / (n + s) > 0.5 AS rejected FROM h, t3)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(rejected, false) AS kept
        FROM f LEFT JOIN bad USING (source)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_host_rules, op3_token_counts, op4_token_records, op5_substring, op6_language, op7_pieces, op8_packing, op9_exact, op10_quality, op11_whitening, op12_top_k, op13_clusters)
}

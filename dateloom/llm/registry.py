"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dateloom.llm.decontamination import contamination_report
from dateloom.llm.exact_dedup import exact_duplicates
from dateloom.llm.language_id import identify
from dateloom.llm.licenses import oracle as licence_oracle
from dateloom.llm.licenses import scan_licences
from dateloom.llm.packing import pack
from dateloom.llm.pii import pseudonymize, session_key
from dateloom.llm.sharding import assign_shards
from dateloom.llm.simhash import near_duplicates
from dateloom.llm.suffix_tree import score_documents
from dateloom.llm.token_files import token_ids

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_decontamination,
        op3_suffix_tree,
        op4_simhash,
        op5_exact_dedup,
        op6_pii_surrogates,
        op7_language_id,
        op8_rendezvous_sharding,
        op9_license_scan,
        op10_length_buckets,
    )
}

ORACLES: dict[str, str] = {
    "op10_length_buckets": r"""
        WITH RECURSIVE lengths AS (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents
        ), binned AS (
            SELECT *, (ceil(n_tokens / width) * width)::BIGINT AS bin
            FROM (SELECT *, 8 * 2 ** greatest(0, ceil(log2(n_tokens / 32768))) AS width FROM lengths)
        ), counted AS (
            SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS j, sum(c) OVER (ORDER BY bin)::BIGINT AS total
            FROM (SELECT bin, count(*) AS c FROM binned GROUP BY bin)
        ), best(k, j, cost, edges) AS (
            SELECT 0, j, bin * total, [bin] FROM counted
            UNION ALL
            SELECT any_value(k) + 1, c.j, min(b.cost + c.bin * (c.total - p.total)),
                   list_append(arg_min(b.edges, (b.cost + c.bin * (c.total - p.total))::HUGEINT * 1048576 + b.j), any_value(c.bin))
            FROM best b JOIN counted p ON p.j = b.j JOIN counted c ON c.j > b.j
            WHERE k < 11 GROUP BY c.j
        ), chosen AS (
            SELECT edges FROM best WHERE j = (SELECT max(j) FROM counted) ORDER BY k DESC LIMIT 1
        ), bucketed AS (
            SELECT doc_id, n_tokens, len(list_filter(edges[1:len(edges) - 1], lambda e: e < n_tokens))::INTEGER AS bucket, edges
            FROM lengths, chosen
        ), placed AS (
            SELECT *, edges[bucket + 1] AS bucket_len, greatest(1, 65536 // edges[bucket + 1]) AS held,
                   row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR), doc_id, n_tokens) - 1 AS slot
            FROM bucketed
        )
        SELECT doc_id, n_tokens, bucket, bucket_len, slot // held AS batch, slot % held AS place, bucket_len - n_tokens AS padding FROM placed
    """,
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (
            SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size,
               doc_id = keep_id AND row_number() OVER (PARTITION BY doc_id, n.norm) = 1 AS kept,
               sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm
    """,
    "op8_rendezvous_sharding": """
        WITH shards AS (SELECT unnest(range(9)) AS i),
        scores AS (
            SELECT doc_id, i,
                   1.0 / -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
            FROM documents, shards
        ),
        chosen AS (
            SELECT doc_id, arg_max(i, score) FILTER (WHERE i < 8) AS shard, arg_max(i, score) AS grown_shard
            FROM scores GROUP BY doc_id
        ),
        crc_bytes AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
                       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS step
        ),
        crc AS (
            SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
                       list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
                       lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
            FROM documents, crc_bytes
        )
        SELECT d.doc_id, coalesce(strlen(text), 0) + 1 AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS slot,
               grown_shard::INTEGER AS grown_shard
        FROM documents d JOIN chosen USING (doc_id) JOIN crc USING (doc_id)
    """,
    "op9_license_scan": licence_oracle(),
    "op2_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
        ), grams AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ), found AS (
            SELECT doc_id, item_id, i, g.n FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram
        ), hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}

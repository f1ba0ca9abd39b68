"""The registered queries ``opN_<name>`` over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    extract,
    language,
    maxent,
    minhash,
    periods,
    quality,
    suffix_dedup,
    urls,
    vector_codes,
    warc,
)
from trialspark.llm.common import crc_mod, limit_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query.
RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract.extract("html").alias("text"))
    return pages.select("*", F.length("text").cast("long").alias("n_chars"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.training_fold(F.col("doc_id")))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), quality.score("text", model).alias("score"))
    return scored.select("*", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    limit_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", path, public_tokenizers.PATTERN).alias("done"))
    return docs.select(
        "doc_id",
        (F.octet_length("done.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2("done.decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    scored = maxent.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.Model(language.sample(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), language.predict("text", model, spark).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def planted_period(words: list[str], doc_id: int | None) -> list[str]:
    """The query's words: of one document in ten, the tail repeats with a period set by its id (none if null)."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)
    best = periods.steepest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        periods.digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": op1_extract,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_minhash": op8_minhash,
    "op9_maxent": op9_maxent,
    "op10_language": op10_language,
    "op11_warc": op11_warc,
    "op12_vector_codes": op12_vector_codes,
    "op13_periods": op13_periods,
}



def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of nearest entry and floored mean, written out one after the other."""
    nearest = """
        near{r} AS MATERIALIZED (
            SELECT rid, p, any_value(part) AS part, min(struct_pack(d := d, e := e)) AS best
            FROM (SELECT t.rid, t.p, t.part, b.e,
                         list_sum(list_transform(range(1, len(t.part) + 1), lambda i: (t.part[i] - b.entry[i]) * (t.part[i] - b.entry[i])))::BIGINT AS d
                  FROM parts t JOIN book{r} b USING (p))
            GROUP BY rid, p)"""
    moved = """
        book{s} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry
            FROM book{r} b LEFT JOIN (
                SELECT p, e, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS entry
                FROM (SELECT p, best.e AS e, i, sum(part[i]) AS total, count(*) AS n
                      FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS i)
                      GROUP BY p, best.e, i)
                GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    chain = []
    for r in range(rounds):
        chain += [nearest.format(r=r), moved.format(r=r, s=r + 1)]
    chain.append(nearest.format(r=rounds))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid,
                   list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS cells
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT rid, p, cells[p * (len(cells) // {parts}) + 1 : (p + 1) * (len(cells) // {parts})] AS part
            FROM kept, (SELECT unnest(range({parts})) AS p)),
        book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, part AS entry FROM parts WHERE rid <= {entries}),
        {",".join(chain)},
        coded AS (
            SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
            FROM near{rounds} GROUP BY rid)
        SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM kept k JOIN coded c USING (rid)
    """


ORACLE: dict[str, str] = {
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages)
        SELECT page_id, strlen(payload) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
               nullif(min(page_id) OVER same, page_id) AS refers_to
        FROM p WINDOW same AS (PARTITION BY payload)
    """,
    "op12_vector_codes": vector_codes_sql(),
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept,
               sha256(content) AS text_sha256
        FROM d
        WINDOW g AS (PARTITION BY content ORDER BY size DESC, doc_id)
    """,
    "op8_minhash": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: w[i:i + 2])) AS s
            FROM words WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN sets USING (doc_id) GROUP BY doc_id),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
            JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, m.n, n.n
            HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
    """,
}

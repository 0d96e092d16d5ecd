"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import bpe, chat, decontaminate, line_dedup, near_dedup, quality, repeats, resample, search, token_counts, token_files, toxicity, warc
from tidewrack.llm.common import read_table
from tidewrack.session import prepare

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and Arrow batches that hold some megabytes of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepare(spark)


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = lambda spark, folder: fn(ready(spark), folder)
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict]:
    """Queries and SQL of the operators and of the pipeline, which belongs to this package."""
    import corpus_pipeline

    queries = dict(_QUERIES) | {"pipeline": corpus_pipeline.run}
    return queries, dict(_SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    blocks, freq = token_files.write_token_files(read_table(spark, folder, "documents"))
    return token_files.read_token_files(blocks, freq)


@query("op7_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, folder, "documents"), similarity=85)


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, folder, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.assess(read_table(spark, folder, "documents"))
    return rows.select("doc_id", *quality.BASE, "base_failed", "kept", F.round("distance2", 3).alias("distance2"))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, read_table(spark, folder, "labels")))


@query("op4_warc", """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN n > 1 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n > 1 AND page_id <> first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write_warc(read_table(spark, folder, "pages"))
    return warc.read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


#: A conversation whose texts hold the template's own marks, an escape before them.
MARKS_WITHIN = "\\### Assistant: </turn> ok"


@query("op3_chat_format", """
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
    ), g AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (lower(role) = 'assistant'), '') AS loss,
            sum(CASE WHEN contains(text, '\\') OR contains(text, '###') OR contains(text, '</turn>')
                     THEN length(text) + length(regexp_replace(text, '[^\\\\#/]', '', 'g')) ELSE length(text) END + length(role) + 14) AS formatted_chars
        FROM t GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS_WITHIN).alias("text"))
    formatted = chat.format_conversations(rows.unionByName(extra))
    back = chat.read_back(formatted).select(F.col("conv_id").alias("_conv"), "turns", "loss_text")
    both = formatted.select("conv_id", "n_turns", F.char_length("formatted").cast("long").alias("formatted_chars")).join(back, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return both.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


#: Words of a text column as the ranked search and the resampling take them.
WORDS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word"


#: CRC-32 of a word's bytes: the table of its polynomial, then one step a byte.
CRC_TABLE = """
    step0 AS (SELECT range AS i, range::BIGINT AS c FROM range(256)),
    """ + ",\n    ".join(f"step{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM step{k})" for k in range(8)) + """,
    crc_table AS (SELECT list(c ORDER BY i) AS entries FROM step8)
"""


@query("op12_resample", f"""
    WITH {CRC_TABLE},
    w AS (
        SELECT 'd' AS side, doc_id AS id, {WORDS} FROM documents
        UNION ALL
        SELECT 't', item_id, {WORDS} FROM benchmark
    ),
    c AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
    v AS (
        SELECT word, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
            lambda crc, b: xor(crc >> 8, entries[xor(crc & 255, b) + 1])))) % 10000 AS bucket
        FROM (SELECT DISTINCT word FROM c), crc_table
    ),
    b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM c JOIN v USING (word) GROUP BY bucket),
    a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM b),
    g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM b, a),
    m AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN v USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
    d AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
        FROM documents LEFT JOIN m ON doc_id = id
    ),
    r AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM d)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * able) // 100 THEN place END AS "rank" FROM r
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op11_ranked_search", f"""
    WITH w AS (SELECT doc_id, count(*) AS tf, word FROM (SELECT doc_id, {WORDS} FROM documents) GROUP BY doc_id, word),
    d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM w GROUP BY doc_id),
    t AS (SELECT count(*) AS all_n, sum(n)::BIGINT AS all_l FROM d),
    q AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, {WORDS} FROM benchmark)),
    f AS (SELECT word, floor(1000 * ln((2 * any_value(all_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM w, t GROUP BY word),
    s AS (
        SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_n) // all_l))))::BIGINT AS score
        FROM q JOIN f USING (word) JOIN w USING (word) JOIN d USING (doc_id), t GROUP BY item_id, doc_id
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "rank" FROM s WHERE score > 0)
    SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 10
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    index = search.build_index(read_table(spark, folder, "documents"))
    return search.search(index, read_table(spark, folder, "benchmark"))


@query("op13_repeats")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats.remove_repeats(read_table(spark, folder, "documents"), length=400)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

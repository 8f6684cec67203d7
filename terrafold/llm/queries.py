"""The queries of the subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_classes

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar_classes(docs, width=3, similarity=90).withColumnRenamed("id", "doc_id")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digests, format_chats

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_digests(format_chats(turns))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours(vectors, vectors.where("id % 100 = 0")).withColumnRenamed("id", "vec_id")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", "n_found", F.round("score", 4).alias("score"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import media_features, store_media

    seen = media_features(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    payload = F.col("thumbnail")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d:%d:%s", "width", "height", "frames", "thumbnail_hash").alias("feature"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch date and no list is given, so both derive from the table: a page is
    fetched on day page_id % 366 of 2024; hosts and host/segment keys whose MD5 falls in some
    classes are listed, delisted and listed again on days that it gives."""
    from .url_lists import SEGMENT, host_of, screen

    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    host, segment = host_of(F.col("url")), F.regexp_extract("url", SEGMENT, 1)
    keys = pages.select(F.lit("hosts").alias("list"), host.alias("key")).union(pages.select(F.lit("paths"), F.concat_ws("/", host, segment))).where("key <> ''").distinct()
    keys = keys.withColumn("x", F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("bigint")).where("x % 3 = 0")
    days = F.array(*[F.struct(((F.col("x") % 300) + k).cast("int").alias("day"), F.lit(k != 40).alias("listed")) for k in (0, 40, 90)])
    entries = keys.select("list", "key", F.inline(days)).select("list", "key", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("dated"), "listed")
    return screen(captures, entries).select("page_id", "n_active", "lists", F.date_format("since", "yyyy-MM-dd").alias("since"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, sanitise

    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_chat": op1_chat,
    "op2_ann": op2_ann,
    "op3_lm": op3_lm,
    "op4_media": op4_media,
    "op5_bpe": op5_bpe,
    "op7_mixing": op7_mixing,
    "op8_url_lists": op8_url_lists,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op6_jaccard_join": op6_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op1_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'),
    '[INST]', '\sINST]'), '[/INST]', '\s/INST]'), '[ROLE]', '\sROLE]'), '[/ROLE]', '\s/ROLE]') AS e
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op3_lm": r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
), pairs AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM words),
c1 AS (SELECT w, count(*) AS n FROM words GROUP BY w),
c2 AS (SELECT u, w, count(*) AS n FROM pairs WHERE u IS NOT NULL GROUP BY u, w HAVING count(*) >= 2),
scored AS (
  SELECT p.doc_id, p.u IS NULL OR c2.n IS NOT NULL AS found,
    CASE WHEN c2.n IS NOT NULL THEN ln(c2.n / a.n) ELSE ln(b.n / (SELECT count(*) FROM words)) + CASE WHEN p.u IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM pairs p JOIN c1 b ON b.w = p.w LEFT JOIN c1 a ON a.w = p.u LEFT JOIN c2 ON c2.u = p.u AND c2.w = p.w
)
SELECT d.doc_id, count(s.s) AS n_tokens, count(*) FILTER (WHERE found) AS n_found, round(coalesce(sum(s.s), 0), 4) AS score
FROM documents d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inters AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inters JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
""",
    "op8_url_lists": r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS seg
  FROM pages
), listed AS (
  SELECT DISTINCT 'hosts' AS list, host AS key FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'paths', host || '/' || seg FROM p
), x AS (SELECT *, ('0x' || substr(md5(key), 1, 7))::BIGINT AS x FROM listed),
entries AS (
  SELECT list, key, DATE '2024-01-01' + (x % 300 + k)::INTEGER AS dated, k <> 40 AS listed FROM x, (VALUES (0), (40), (90)) t(k) WHERE x % 3 = 0
), valid AS (
  SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS until FROM entries) WHERE listed
), keys AS (
  SELECT page_id, fetched, array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, 1 + greatest(1, len(string_split(host, '.')) - 1))) AS i FROM p WHERE host <> '')
  UNION SELECT page_id, fetched, host || '/' || seg FROM p WHERE host <> '' AND seg <> ''
), met AS (
  SELECT k.page_id, v.* FROM keys k JOIN valid v ON v.key = k.key AND k.fetched >= v.dated AND (v.until IS NULL OR k.fetched < v.until)
)
SELECT p.page_id, count(m.key) AS n_active, coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, strftime(max(m.dated), '%Y-%m-%d') AS since
FROM p LEFT JOIN met m USING (page_id) GROUP BY p.page_id
""",
}

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import archives, chat, conversation_repair, exact_dedup, hard_negatives, html_extract, language, mixing, near_dedup, packing, secret_scan, token_counts, vectors
from tideway.storage import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("findings", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    base = F.sha2(secret_scan.span_text(of(*secret_scan.BASE_KINDS)), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, secret_scan.span_text(F.col("findings")).alias("spans"), *counts[3:])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], kinds)
    turns = turns.unionByName(probe).select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    return chat.read_back(chat.format_turns(turns))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    messages = archives.page_messages(_table(spark, sf_dir, "pages"))
    archives.write_arc(messages, arcs)
    archives.convert_archives(spark, arcs, warcs)
    return archives.page_records(spark, warcs)


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, lost)``: conversations with faults by a checksum of conversation and turn; nulls are one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    changed = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    named = F.when(fault == 4, "user").otherwise(role).alias("role")
    return turns.select("conv_id", "turn", named, changed.alias("text"), (fault == 0).alias("lost"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, turns = conversation_repair.repair_conversations(damaged(_table(spark, sf_dir, "conversations")), "lost")
    digests = conversation_repair.digests(turns).withColumnRenamed("conv_id", "c")
    joined = found.join(digests, found["conv_id"].eqNullSafe(digests["c"]), "left").drop("c")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_secret_scan, op2_simhash, op3_packing, op4_language, op5_chat, op6_html, op7_exact_dedup, op8_mixing, op9_neighbours,
        op10_token_counts, op11_hard_negatives, op12_warc, op13_conversation_repair, pipeline,
    )
    return {f.__name__: f for f in named}


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    length(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) AS text_chars,
    length(replace(role, '\', '\\')) AS role_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + role_chars + length('<|turn|><|text|><|end|>') + 1
    + CASE WHEN role = 'assistant' THEN length('<|loss|><|/loss|>') ELSE 0 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP7_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), texts AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM rows JOIN texts USING (norm)
"""

OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS r
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source
), shares AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM shares
), targets AS (
  SELECT source, source_size, least(most, coalesce(weight * (
    SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), most)) AS target FROM levels
), queued AS (
  SELECT d.doc_id, d.source, d.size, d.r, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r, d.doc_id) AS queued
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT *, (queued + (epoch - 1) * source_size)::DOUBLE / target AS finish
  FROM queued CROSS JOIN (SELECT unnest([1, 2, 3]) AS epoch) WHERE target > 0
), merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, r, doc_id) AS running FROM items
), last AS (
  SELECT source, max(struct_pack(epoch := epoch, r := r, doc_id := doc_id)) AS last FROM merged
  WHERE running <= (SELECT sum(size) FROM docs) GROUP BY source
)
SELECT q.doc_id, q.size, q.source_size, q.target AS target,
  (q.size * coalesce(l.last.epoch - 1 + CASE WHEN (q.r, q.doc_id) <= (l.last.r, l.last.doc_id) THEN 1 ELSE 0 END, 0))::BIGINT AS taken
FROM queued q LEFT JOIN last l ON q.source IS NOT DISTINCT FROM l.source
"""

OP11_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), components AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM whole
), met AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
  FROM components a JOIN components c ON a.place = c.place AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP12_SQL = r"""
WITH records AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS turn,
    first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first
  FROM records
)
SELECT page_id, url, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN first END AS refers_to, true AS intact
FROM ranked
"""

OP13_SQL = r"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
  FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault FROM spaced
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(2) copies(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), ordered AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, E' \t\n\x0b\x0c\r') AS trimmed, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM ordered
), steps(last, inserted, prior, price) AS (
  VALUES ('', '', '', 0), ('s', '', 's', 0), ('u', '', 'u', 0), ('a', '', 'a', 0), ('', 'I', 'u', 2), ('s', 'I', 'u', 2), ('u', 'I', 'a', 2), ('a', 'I', 'u', 2), ('s', 'II', 'a', 4)
), prefixes AS (
  SELECT conv_id, 0::BIGINT AS rn, '' AS last, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT conv_id, rn, last, min(struct_pack(cost := cost, audit := audit)).cost, min(struct_pack(cost := cost, audit := audit)).audit,
    arg_min(said, struct_pack(cost := cost, audit := audit))
  FROM (
    SELECT p.conv_id, f.rn, CASE e WHEN 'D' THEN s.prior WHEN 'K' THEN f.initial WHEN 'R' THEN CASE s.prior WHEN 'u' THEN 'a' ELSE 'u' END END AS last,
      p.cost + s.price + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      p.audit || s.inserted || e AS audit,
      p.said || CASE WHEN s.inserted = '' THEN [] WHEN s.inserted = 'II' THEN ['user:', 'assistant:'] WHEN s.prior = 'u' THEN ['user:'] ELSE ['assistant:'] END
        || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE s.prior WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text] END AS said
    FROM prefixes p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.rn = p.rn + 1 JOIN steps s ON s.last = p.last, (VALUES ('D'), ('K'), ('R')) edits(e)
    WHERE e = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR f.initial = CASE s.prior WHEN 'u' THEN 'a' ELSE 'u' END OR (s.prior = '' AND f.initial = 's')))
  ) GROUP BY conv_id, rn, last
), ended AS (
  SELECT p.conv_id, min(struct_pack(cost := p.cost + s.price, audit := p.audit || s.inserted)) AS best,
    arg_min(p.said || CASE WHEN s.inserted = '' THEN [] WHEN s.inserted = 'II' THEN ['user:', 'assistant:'] ELSE ['assistant:'] END,
      struct_pack(cost := p.cost + s.price, audit := p.audit || s.inserted)) AS said
  FROM prefixes p JOIN (SELECT conv_id, max(rn) AS n FROM faulty GROUP BY conv_id) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.rn = f.n
    JOIN steps s ON s.last = p.last WHERE s.prior IN ('', 'a') GROUP BY p.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_conversation_repair": OP13_SQL}

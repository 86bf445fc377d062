"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, hard_negatives, html_text, mixing, near_dup, paragraph_sketch, pieces, pii, quality, sharding, token_files
from tidemark.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", found["digest"].alias("text_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_digests(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


#: The conversation that the query adds: both turns hold control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    formatted = chat.windows(rows.unionByName(planted)).withColumn("formatted_chars", F.length("formatted").cast("long"))
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = chat.read_back(formatted, "formatted_chars").select(
        "conv_id", "window", "formatted_chars", F.size("turns").alias("n"), F.array_join(turn, "").alias("said"), F.array_join("targets", "").alias("learnt")
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"),
    )
    said, learnt = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learnt"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.pages_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.chained(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.scaled(F.col("embedding")).alias("embedding"))
    return hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_exact_dedup, op3_mixing, op4_token_files, op5_pii, op6_sentencepiece, op7_minhash_near_dedup, op8_sharding, op9_chat_formatting,
        op10_html_extraction, op11_fingerprints, op12_hard_negatives,
    )}


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY r),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines FROM lines GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
                 + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 20 * n_symbols > word_chars THEN 4 ELSE 0 END
                 + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
                 + CASE WHEN 2 * n_upper > n_letters THEN 16 ELSE 0 END
                 + CASE WHEN word_chars > 12 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM f
"""

OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
q AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
v AS (SELECT level AS lv FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL OR ratio < lv THEN cap ELSE lv * w END AS target FROM l LEFT JOIN v ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""


OP8_SQL = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                  ('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT doc_id, bytes, depth, h >> (60 - depth) AS prefix, sum(bytes) OVER (PARTITION BY depth, h >> (60 - depth))::BIGINT AS total
      FROM d, range(0, 25) AS t(depth)),
m AS (SELECT doc_id, min(depth) AS depth FROM l WHERE total <= 8388608 GROUP BY doc_id)
SELECT doc_id, bytes, right(lpad(bin(prefix), 64, '0'), depth::INT) AS shard, depth::INT AS depth, total AS shard_bytes, false AS oversize
FROM l JOIN m USING (doc_id, depth)
"""


#: The template's escapes as SQL, and the windows' arithmetic on prefix sums.
_ESCAPED = "replace(x, '␛', '␛0')"
for _i, _c in enumerate(chat.CONTROL, 1):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '␛{_i}')"
OP9_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat.TURN_TOKENS} AS tokens,
             length({_ESCAPED.replace("x, '␛'", "role, '␛'", 1)}) + length({_ESCAPED.replace("x, '␛'", "text, '␛'", 1)}) + {len("<||>") + 1 + len(chat.END)} AS chars,
             row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, first_value(role) OVER w = 'system' AS led0,
             sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto0,
             first_value(tokens) OVER w AS first_tokens, first_value(chars) OVER w AS first_chars
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (SELECT *, led0 AND n > 1 AS led, upto0 - CASE WHEN led0 AND n > 1 THEN first_tokens ELSE 0 END AS upto, upto - tokens AS start,
             greatest({chat.BUDGET - chat.HISTORY} - CASE WHEN led0 AND n > 1 THEN first_tokens ELSE 0 END, {chat.HISTORY}) AS room, start // room AS cell FROM t),
v AS (SELECT *, max(i) OVER c AS last_i, count(*) OVER c AS k, max(upto) OVER c - min(start) OVER c AS total FROM u WHERE NOT (led AND i = 1) WINDOW c AS (PARTITION BY conv_id, cell)),
s AS (SELECT conv_id, cell, k > 1 AND total > room AND i = last_i AS alone, min(i) AS i, min(start) AS start, sum(chars) + any_value(CASE WHEN led THEN first_chars ELSE 0 END) AS chars FROM v GROUP BY ALL),
o AS (SELECT s.conv_id, s.i, sum(v.chars) AS chars FROM s JOIN v ON v.conv_id IS NOT DISTINCT FROM s.conv_id AND v.i < s.i AND s.start - v.start <= {chat.HISTORY} GROUP BY ALL),
f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM s UNION ALL SELECT conv_id, chars FROM o) GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt FROM r GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, f.chars::BIGINT AS formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, k ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WHERE k <= 5)
SELECT * FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": OP12_SQL, "op1_quality_rules": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op8_sharding": OP8_SQL, "op9_chat_formatting": OP9_SQL}

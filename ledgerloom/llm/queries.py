"""The training-data operators on the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import arc_convert, chat_tokens, compression_bands, edit_contamination, ftrl_quality, kneser_ney, mixing, multi_index_negatives, simhash_ring, spelling_variants, super_kmers, token_files, trigram_secrets
from ledgerloom.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_compression_bands")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return compression_bands.quality_figures(table(spark, folder, "documents"))


@query("op2_edit_contamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return edit_contamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_simhash_ring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_ring.classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_ftrl_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return ftrl_quality.predict_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM m
"""


@query("op5_arc_convert", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return arc_convert.archive_pages(table(spark, folder, "pages"))


@query("op6_kneser_ney")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.predict_languages(table(spark, folder, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS fill FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT source, source_size,
         least(coalesce(w * (SELECT max(level) FROM l WHERE level <= fill), 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM l),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS until FROM g),
b AS (
  SELECT t.*, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 1) ELSE 0 END AS base FROM t)
SELECT d.doc_id, d.size, b.source_size::BIGINT AS source_size, b.target,
       (d.size * (b.base + (r.until - r.words + r.words / 2.0::DOUBLE <= b.target - b.base * b.source_size
                            AND r.until - r.words < b.target - b.base * b.source_size)::INT))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write_tokens(table(spark, folder, "documents"), vocabulary()).documents()


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (h) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(w) AS e, generate_subscripts(w, 1) AS p FROM d),
r AS (SELECT doc_id, string_agg(e, ' ' ORDER BY p) AS kept FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op9_super_kmers", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return super_kmers.remove_repeats(table(spark, folder, "documents"))


def _secret_sql() -> str:
    """Spans in SQL: between the matches of a pattern lie the pieces of a split by it."""
    parts = []
    for place, rule in enumerate(trigram_secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, m, g, sum(length(p) + coalesce(length(q), 0)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS s FROM (
      SELECT doc_id, m, g, p, i, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g,
               unnest(string_split_regex(t, '{pattern}')) AS p, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i
        FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE m IS NOT NULL AND length(g) >= {rule.least}""")
    base = [rule.kind for rule in trigram_secrets.RULES if rule.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in base)
    named = ", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in base)
    spell = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT doc_id, {counts}, {spell} FILTER (place < {len(base)}) AS base, {spell} AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (doc_id)
"""


@query("op10_trigram_secrets", _secret_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return trigram_secrets.secrets(table(spark, folder, "documents"))


def _escaped_sql(column: str) -> str:
    """Control strings of ``column`` with one more backslash after their first character."""
    for first in ("#", "<"):
        rest = "|".join(re.escape(c[1:]).replace("\\ ", " ").replace("\\#", "#") for c in chat_tokens.CONTROLS if c[0] == first)
        column = f"regexp_replace({column}, '{first}(\\\\*)({rest})', '{first}\\\\\\1\\2', 'g')"
    return column


#: The conversation that holds control strings.
PROBE = r"\### Assistant: </turn> ok"
OP11_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
f AS (
  SELECT *, length({_escaped_sql("text")}) + length({_escaped_sql("role")}) AS shown FROM c),
h AS (SELECT unnest({list(chat_tokens.HEADERS)}) AS role, unnest({[len(x) for x in chat_tokens.HEADERS.values()]}) AS head)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + CASE WHEN head IS NULL THEN {len(chat_tokens.OTHER + chat_tokens.NAME_END) + 1} ELSE head + 1 - length(role) END
           + {len(chat_tokens.END) + 2})::BIGINT AS formatted_chars
FROM f LEFT JOIN h USING (role) GROUP BY conv_id
"""


@query("op11_chat_tokens", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    found = chat_tokens.format_chats(rows.unionByName(probe), chat_tokens.Chat(vocabulary())).conversations()
    return found.drop("n_tokens")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10
"""


@query("op12_multi_index_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index_negatives.hard_negatives(rows.withColumn("label", moved))


OP13_SQL = """
WITH RECURSIVE t AS (  -- the table of CRC-32
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
           lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h
  FROM b, t),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.d = b.word),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM e GROUP BY word),
m AS (SELECT word, n_near, top, min(near) AS best FROM f JOIN e USING (word) WHERE near_n = top GROUP BY ALL),
g AS (
  SELECT word, CASE WHEN top >= 10 * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM w LEFT JOIN m USING (word)),
u AS (SELECT word, word AS root FROM g UNION ALL SELECT u.word, g.form FROM u JOIN g ON g.word = u.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, u.root, g.n, g.n_near, g.form_n FROM g JOIN u USING (word) JOIN g AS l ON l.word = u.root WHERE l.form IS NULL
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, folder, "documents"), spelling_variants.Spelling(damage=31))

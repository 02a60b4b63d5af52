"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chain_of_turns, format_conversations, parse_turns, unescape
from .common import table
from .html import extract_main_text
from .jaccard import jaccard_components
from .lines import dedup_lines
from .mixing import mix
from .neighbours import nearest
from .packing import pack_documents
from .quality import judge
from .suffixes import drop_repeats
from .units import drop_repeated_units


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), derive={"ids_crc32": F.crc32("tokens")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, i AS pos, l[i] AS line,
         trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS l,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
hot AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM lines GROUP BY rid, doc_id
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out_col="text")
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1),
covered AS (
  SELECT rid, count(DISTINCT i + d) AS n
  FROM (SELECT rid, i FROM grams SEMI JOIN twice USING (rid, g)), (VALUES (0), (1), (2)) t(d)
  GROUP BY rid),
dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
fit AS (SELECT least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS m, var_pop(f / n) AS v, avg(1 / n) AS inv FROM hosts),
prior AS (
  SELECT m, CASE WHEN v - m * (1 - m) * inv > 0
                 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1), 1e6) ELSE 1e6 END AS s FROM fit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (f + m * s) / (n + s) <= 0.5 AS kept
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source, prior
"""


def op6_mixing_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]), F.lit(0).cast("long"))
    count = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")
    return done.select("doc_id", chars.alias("removed_chars"), count.alias("n_removed"), "n_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Lines as tokens (a word with the white space around it); sentences are numbered by the words
#: that end them, passages by the sentences of six words or more before them.
OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, i, l[i] AS line, len(l) AS n_lines,
         regexp_extract_all(l[i], '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tokens
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
tokens AS (
  SELECT doc_id, i, j, tokens[j] AS token,
         trim(translate(tokens[j], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word
  FROM (SELECT doc_id, i, tokens, unnest(range(1, len(tokens) + 1)) AS j FROM lines)),
sentences AS (
  SELECT *, coalesce(sum((right(word, 1) IN ('.', '!', '?'))::INT)
                     OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM tokens),
long AS (
  SELECT doc_id, i, s, (count(*) >= 6)::INT AS is_long FROM sentences GROUP BY ALL),
placed AS (
  SELECT doc_id, i, s, least(coalesce(sum(is_long) OVER (PARTITION BY doc_id, i ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
                             greatest(sum(is_long) OVER (PARTITION BY doc_id, i) - 1, 0)) AS p FROM long),
parts AS (
  SELECT doc_id, i, p, string_agg(word, ' ' ORDER BY j) AS key, string_agg(token, '' ORDER BY j) AS raw, count(*) OVER (PARTITION BY doc_id, i) AS n
  FROM sentences JOIN placed USING (doc_id, i, s) GROUP BY doc_id, i, p),
units AS (
  SELECT doc_id, i, -1 AS p, string_agg(key, ' ' ORDER BY p) AS key FROM parts GROUP BY doc_id, i
  UNION ALL SELECT doc_id, i, p, key FROM parts WHERE n > 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i, p) > 1 AS again FROM units),
verdicts AS (
  SELECT doc_id, i, bool_or(again AND p < 0) OR (count(*) > 1 AND bool_and(again) FILTER (p >= 0)) AS whole FROM ranked GROUP BY doc_id, i),
kept_parts AS (
  SELECT doc_id, i, count(*) FILTER (again) AS n_gone, coalesce(sum(length(raw)) FILTER (again), 0) AS chars,
         coalesce(string_agg(raw, '' ORDER BY p) FILTER (NOT again), '') AS kept
  FROM parts JOIN ranked USING (doc_id, i, p) GROUP BY doc_id, i),
done AS (
  SELECT doc_id, lines.i, coalesce(whole, false) AS whole, n_lines, line,
         CASE WHEN whole THEN 1 ELSE coalesce(n_gone, 0) END AS n_gone,
         CASE WHEN whole THEN length(line) ELSE coalesce(chars, 0) END AS chars,
         CASE WHEN n_gone > 0 THEN kept ELSE line END AS kept
  FROM lines LEFT JOIN verdicts USING (doc_id, i) LEFT JOIN kept_parts USING (doc_id, i))
SELECT doc_id, sum(chars)::BIGINT AS removed_chars, sum(n_gone)::BIGINT AS n_removed, any_value(n_lines) AS n_lines,
       sha256(coalesce(string_agg(kept, chr(10) ORDER BY i) FILTER (NOT whole), '')) AS kept_sha256
FROM done GROUP BY doc_id
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    made = format_conversations(chain_of_turns(rows))

    def read_back(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select("conv", "formatted", "loss_spans").mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || role || '>' || chr(10) || text || chr(10) || '</turn>' || chr(10))
           + len(regexp_extract_all(text, '</?turn')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN list_aggregate(w, 'string_agg', ' ')
                               ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY reach.doc_id
"""


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    n_removed = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]), F.lit(0).cast("long"))
    n_spans = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.when(F.col("removed").isNull(), 0).otherwise(n_spans).alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {
    "op2_approximate_nearest_neighbours": op2_approximate_nearest_neighbours,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing_target_weights": op6_mixing_target_weights,
    "op8_chat_formatting": op8_chat_formatting,
    "op1_best_fit_packing": op1_best_fit_packing,
}
QUERIES["op9_suffix_array_dedup"] = op9_suffix_array_dedup
QUERIES["op10_ngram_jaccard_join"] = op10_ngram_jaccard_join

QUERIES["op7_substring_dedup"] = op7_substring_dedup
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL}

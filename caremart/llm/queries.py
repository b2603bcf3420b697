"""The registered queries of this package, with SQL twins where SQL can express them.

Every query reads its whole table and returns the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm import (ann, conversation_repair, decontaminate, hard_negatives, html_extract, jaccard_join, line_dedup,
                          mixing, quality_mil, sharding, token_counts, token_orc, toxicity)
from caremart.llm.common import only, scratch, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a vocabulary file of the installed public tokenizers; never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_orc.digest(spark, path)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "flat-tokens")
    manifest = token_counts.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_counts.token_counts(manifest, path).select("doc_id", "n_tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.fit_open(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc.doc_id", toxicity.held_out("doc.doc_id").alias("held_out"), "score", "predicted", "evidence")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    found = line_dedup.remove(docs, line_dedup.boilerplate(docs), ["doc_id"])
    return found.select("doc.doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                        F.md5("text").alias("text_md5"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(only(table(spark, sf_dir, "documents"), "doc_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(only(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    found = mixing.ranked(mixing.mix(docs, ["doc_id"]))
    first = {"first_position": F.get("positions", F.lit(0)), "last_position": F.try_element_at("positions", F.lit(-1)),
             "first_rank": F.get("ranks", F.lit(0))}
    return found.select("doc.doc_id", "size", "source_size", "target", "taken", *[c.alias(n) for n, c in first.items()])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(only(table(spark, sf_dir, "documents"), "doc_id", "text"),
                               table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    found = quality_mil.score(docs, model, ["doc_id"])
    return found.select("doc.doc_id", toxicity.held_out("doc.doc_id").alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = f"""
WITH lines AS (
  SELECT row_id, doc_id, source, UNNEST(ls) AS line, UNNEST(range(1, len(ls) + 1)) AS pos
  FROM (SELECT row_number() OVER () AS row_id, doc_id, source, text,
               CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls
        FROM documents)),
wide AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY trim(line, ' ')
  HAVING COUNT(DISTINCT COALESCE('0' || source, '1')) >= {line_dedup.SITES}),
kept AS (
  SELECT row_id, COUNT(*) AS n_lines, COUNT(w.line) AS n_removed,
         COALESCE(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE w.line IS NULL), '') AS text
  FROM lines l LEFT JOIN wide w ON trim(l.line, ' ') = w.line GROUP BY row_id)
SELECT d.doc_id, COALESCE(k.n_lines, 0) AS n_lines, COALESCE(k.n_removed, 0) AS n_removed,
       length(COALESCE(k.text, '')) AS n_chars, md5(COALESCE(k.text, '')) AS text_md5
FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) d LEFT JOIN kept k USING (row_id)
"""

_SLOTS = sharding.table_size(sharding.SHARDS)


def _md5_number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


# The table is filled turn by turn: the shard whose turn it is takes the first free slot of its order.
OP7_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, format('shard-{{:03d}}', i) AS shard FROM range({sharding.SHARDS}) t(i)),
prefs AS (
  SELECT list({_md5_number("'offset|' || shard")} % {_SLOTS} ORDER BY i) AS o,
         list({_md5_number("'skip|' || shard")} % ({_SLOTS} - 1) + 1 ORDER BY i) AS k FROM shards),
fill(turn, slots, owner, tried) AS (
  SELECT 0, []::BIGINT[], [-1 FOR x IN range({_SLOTS})], [0 FOR x IN range({sharding.SHARDS})]
  UNION ALL
  SELECT turn + 1, slots,
         list_concat(list_concat(owner[:s], [turn % {sharding.SHARDS}]), owner[s + 2:]),
         list_concat(list_concat(tried[:turn % {sharding.SHARDS}], [j + 1]), tried[turn % {sharding.SHARDS} + 2:])
  FROM (SELECT *, (o[turn % {sharding.SHARDS} + 1] + j * k[turn % {sharding.SHARDS} + 1]) % {_SLOTS} AS s
        FROM (SELECT fill.*, o, k, list_filter(range(tried[turn % {sharding.SHARDS} + 1], {_SLOTS}), lambda x:
                owner[(o[turn % {sharding.SHARDS} + 1] + x * k[turn % {sharding.SHARDS} + 1]) % {_SLOTS} + 1] = -1)[1] AS j
              FROM fill, prefs WHERE turn < {_SLOTS}))),
placed AS (SELECT UNNEST(range({_SLOTS})) AS slot, UNNEST(owner) AS i FROM fill WHERE turn = {_SLOTS})
SELECT d.doc_id, s.shard
FROM documents d
JOIN placed p ON {_md5_number("COALESCE(CAST(d.doc_id AS VARCHAR), '')")} % {_SLOTS} = p.slot
JOIN shards s ON s.i = p.i
"""

_MIXED = """
words AS (
  SELECT *, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS number FROM words GROUP BY source),
weighed AS (SELECT *, (number - 1) % 3 + 1 AS weight FROM sources),
levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER f, 0))
            / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER f, 0))::DOUBLE AS level
  FROM weighed WINDOW f AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, (source_size / weight, number)) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
  SELECT source, source_size, number, LEAST((3 * source_size)::DOUBLE, final.level * weight) AS target
  FROM levels, final),
ordered AS (
  SELECT w.*, t.source_size, t.target, t.number,
         COALESCE(SUM(size) OVER (PARTITION BY w.source ORDER BY md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))), doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM words w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE
         GREATEST(0, LEAST(3, floor((target - (before + size / 2)) / source_size) + 1)) END::BIGINT AS copies FROM ordered)
"""

# A source's weight runs from f to l over training; a copy's time inverts the integral of that schedule.
OP9_SQL = f"""
WITH {_MIXED},
passes AS (
  SELECT doc_id, size, source, pass, ([1.0, 2.0, 0.5]::DOUBLE[])[(number - 1) % 3 + 1] AS f, ([1.0, 0.5, 2.0]::DOUBLE[])[(number - 1) % 3 + 1] AS l,
         CASE WHEN target = 0 THEN NULL ELSE LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, (before + size / 2 + pass * source_size) / target)) END AS share
  FROM (SELECT *, UNNEST(range(copies)) AS pass FROM mixed)),
timed AS (
  SELECT *, COALESCE(LEAST(1.0::DOUBLE, CASE WHEN f = l THEN share ELSE (sqrt(f * f + 2 * (l - f) * (share * (f + l) / 2)) - f) / (l - f) END), 0.0) AS position
  FROM passes),
ranks AS (
  SELECT *, row_number() OVER (ORDER BY position, {_md5_number("COALESCE(CAST(doc_id AS VARCHAR), '')")}, doc_id, pass) - 1 AS rank FROM timed),
first AS (
  SELECT doc_id, MIN(position) AS first_position, MAX(position) AS last_position, MIN(rank) AS first_rank FROM ranks GROUP BY doc_id)
SELECT m.doc_id, m.size, m.source_size, m.target, m.copies * m.size AS taken, first_position, last_position, first_rank
FROM mixed m LEFT JOIN first USING (doc_id)
"""

_WORD_PATTERN = "[0-9a-zA-Z\\x{80}-\\x{10FFFF}]+"

OP10_SQL = f"""
WITH bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_PATTERN}') AS ws
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, LEAST(13, len(ws)) AS k, array_to_string(ws[i:i + LEAST(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, UNNEST(range(1, len(ws) - LEAST(13, len(ws)) + 2)) AS i FROM bench WHERE len(ws) > 0)),
docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_PATTERN}'), []) AS ws
  FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT row_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT row_id, ws, k, UNNEST(range(1, len(ws) - k + 2)) AS i FROM docs, sizes WHERE len(ws) >= k)),
hits AS (SELECT p.row_id, p.i, p.k, x.item FROM places p JOIN windows x ON p.w = x.w AND p.k = x.k),
covered AS (
  SELECT row_id, COUNT(DISTINCT pos) AS n_hit
  FROM (SELECT DISTINCT row_id, UNNEST(range(i, i + k)) AS pos FROM hits) GROUP BY row_id),
items AS (
  SELECT row_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names
  FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id)
SELECT d.doc_id, len(d.ws) AS n_words, COALESCE(c.n_hit, 0) AS n_hit, COALESCE(t.n_items, 0) AS n_items,
       sha256(COALESCE(t.names, '')) AS items_sha256,
       COALESCE(c.n_hit, 0) > 0 AND 20 * COALESCE(c.n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN covered c USING (row_id) LEFT JOIN items t USING (row_id)
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# crc32 is not a function of DuckDB: a table of the 256 remainders, then byte by byte.
_CRC32 = """
crc_steps(n, i, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL
  SELECT n, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE i = 8)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text; ``crc_table`` must be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),"
            f" lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295)")


# The states are what the repaired turns end with: nothing, a lone s, u, or a (after a u).
OP13_SQL = f"""
WITH RECURSIVE {_CRC32},
plain AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT plain.*, {_crc32("key")} % 20 AS kind FROM plain, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         UNNEST(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, bare = '' AS is_blank,
         bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_duplicate,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
         max(i) OVER (PARTITION BY conv_id) AS n FROM numbered),
faults AS (
  SELECT *, is_blank OR is_duplicate AS gone, NOT is_blank AND NOT is_duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS cut
  FROM judged),
inserts(st, word, st2) AS (
  VALUES ('', '', ''), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('', 'I', 'u'), ('s', 'I', 'u'), ('u', 'I', 'a'),
         ('a', 'I', 'u'), ('', 'II', 'a'), ('s', 'II', 'a')),
steps(st, letter, wanted, st2) AS (
  VALUES ('', 'D', NULL, ''), ('s', 'D', NULL, 's'), ('u', 'D', NULL, 'u'), ('a', 'D', NULL, 'a'), ('', 'K', 's', 's'),
         ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'),
         ('', 'R', NULL, 'u'), ('s', 'R', NULL, 'u'), ('a', 'R', NULL, 'u'), ('u', 'R', NULL, 'a')),
moves AS (
  SELECT i.st, i.word || s.letter AS word, s.letter, s.wanted, s.st2,
         5 * length(i.word) + CASE s.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost
  FROM inserts i JOIN steps s ON i.st2 = s.st),
scripts(conv_id, i, st, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', 0, '' FROM faults
  UNION ALL
  (SELECT conv_id, i, st, (best).c, (best).a FROM (
    SELECT f.conv_id, f.i, m.st2 AS st,
           min({{'c': p.cost + m.cost + CASE WHEN f.cut AND m.letter <> 'D' THEN 5 ELSE 0 END, 'a': p.audit || m.word}}) AS best
    FROM scripts p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    JOIN moves m ON m.st = p.st AND (m.letter = 'D' OR NOT f.gone) AND (m.wanted IS NULL OR m.wanted = f.initial)
    GROUP BY f.conv_id, f.i, m.st2))),
ended AS (
  SELECT s.conv_id, min({{'c': s.cost + 5 * length(i.word), 'a': s.audit || i.word}}) AS best
  FROM scripts s JOIN (SELECT conv_id, max(i) AS n FROM faults GROUP BY conv_id) z
    ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i
  JOIN inserts i ON i.st = s.st AND i.st2 IN ('', 'a') GROUP BY s.conv_id),
audits AS (SELECT conv_id, (best).c AS cost, (best).a AS audit, len(replace((best).a, 'D', '')) AS size FROM ended),
edits AS (
  SELECT conv_id, size, p, substr(audit, p, 1) AS edit, p - len(replace(substr(audit, 1, p), 'I', '')) AS inserted,
         len(replace(substr(audit, 1, p - 1), 'D', '')) AS before
  FROM (SELECT *, UNNEST(range(1, len(audit) + 1)) AS p FROM audits)),
repaired AS (
  SELECT e.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN f.role WHEN (before - size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS text
  FROM edits e LEFT JOIN faults f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = p - inserted
  WHERE edit <> 'D' GROUP BY e.conv_id),
counted AS (
  SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, count_if(is_blank) AS blank,
         count_if(is_duplicate) AS duplicate, count_if(cut) AS truncated,
         count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, COALESCE(c.gaps, 0)::BIGINT AS gaps, COALESCE(c.blank, 0)::BIGINT AS blank,
       COALESCE(c.duplicate, 0)::BIGINT AS duplicate, COALESCE(c.truncated, 0)::BIGINT AS truncated,
       COALESCE(c.illegal, 0)::BIGINT AS illegal, COALESCE(a.cost, 0)::BIGINT AS cost, COALESCE(a.audit, '') AS audit,
       sha256(COALESCE(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.v AS anchor, a.label AS own, r.id, r.label, r.v, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND len(a.v) = len(r.v) AND (a.id, a.label, a.v) <> (r.id, r.label, r.v)),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, own, anchor ORDER BY score DESC, id, v) AS nth
  FROM scored WHERE label = own),
found AS (
  SELECT p.anchor_id, p.own, p.anchor, p.nth, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.own, p.anchor, p.nth ORDER BY s.score DESC, s.id, s.label, s.v)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.anchor = p.anchor
    AND s.label <> p.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_nearest": op2_nearest,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_main_text": op5_main_text,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    # op2's doubles are summed in another order by SQL; tests hold it against brute force
    return {"op6_line_dedup": OP6_SQL, "op7_sharding": OP7_SQL, "op9_mixing": OP9_SQL, "op10_decontamination": OP10_SQL,
            "op12_hard_negatives": OP12_SQL, "op13_conversation_repair": OP13_SQL}

"""One registered query per operator, over whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    chat_format,
    exact_dedup,
    html_extract,
    language_id,
    mixing,
    packing,
    phrases,
    quality_model,
    quality_rules,
    runs,
    secret_scan,
    simhash,
    token_files,
)
from ledgerline.llm.common import held_out, new_path, table, written

# Fixed values of the queries: the tokenizer, and the ids that end a document.
TOKENIZER = "word_bpe_49k.json"
FILE_END_ID = 1
PACK_END_ID = 2
# what separates words
SPACES = r"[\x20\x09-\x0D]+"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), FILE_END_ID, word_level=True)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return quality_model.score(rows, model, carry=("doc_id", "held_out"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return language_id.identify(rows, model, carry=("doc_id", "held_out"))


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), PACK_END_ID, word_level=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = written(secret_scan.candidates(docs), "secret-findings")
    return secret_scan.scan(secret_scan.label_by_rule(found), docs=docs)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), carry=("doc_id",))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, which where crc32 of the id's decimal digits is a multiple of 10
    repeats a part of its words up to the end (a null id's text stays as it is)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    chosen = chosen.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.expr("cast(g % nullif(n, 0) as int)"))
    chosen = chosen.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("transform(sequence(a, n - 1), i -> w[a + (i - a) % p])")
    changed = F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.withColumn("best", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        (-F.col("best.less")).alias("length"),
        "best.period",
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = written(chat_format.format_chat(rows.unionByName(added)), "chat")
    turns = F.transform(chat_format.parse_turns("formatted"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = out.withColumns({"turns": turns, "loss": F.array_join(chat_format.loss_texts("formatted", "loss_spans"), "")})
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_exact_dedup,
        op3_quality_classifier,
        op4_html_extract,
        op5_source_mix,
        op6_simhash_near_dedup,
        op7_language_id,
        op8_sequence_packing,
        op9_secret_scan,
        op10_quality_rules,
        op11_phrase_mining,
        op12_periodic_runs,
        op13_chat_format,
        pipeline,
    )
}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""

# targets by trying every number of capped sources; thresholds by sorting and running sums
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS total,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 2 * total / w, source NULLS LAST) AS k FROM s
), tries AS (
  SELECT x.k, 3 * (SELECT sum(total) FROM r) - 2 * coalesce((SELECT sum(2 * total) FROM r y WHERE y.k < x.k), 0) AS num,
         2 * (SELECT sum(w) FROM r y WHERE y.k >= x.k) AS den, x.w, x.total
  FROM r x
), level AS (
  SELECT k, num, den FROM tries WHERE num * w <= 2 * total * den ORDER BY k LIMIT 1
), t AS (
  SELECT r.source, r.total AS source_size,
         CASE WHEN level.k IS NULL OR r.k < level.k THEN (2 * r.total)::DOUBLE
              ELSE (level.num * r.w)::DOUBLE / level.den END AS target
  FROM r LEFT JOIN level ON true
), b AS (
  SELECT d.doc_id, d.size, d.h, t.*, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base,
         target - (CASE WHEN target >= source_size THEN 1 ELSE 0 END) * source_size AS r0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), l AS (
  SELECT *, size * 50 > source_size AS large,
         r0 * sum(CASE WHEN size * 50 > source_size THEN size ELSE 0 END) OVER (PARTITION BY source) / nullif(source_size, 0) AS share
  FROM b
), b0 AS (
  SELECT *, coalesce(large AND sum(CASE WHEN large THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h)
         - sum(CASE WHEN large THEN size ELSE 0 END) OVER (PARTITION BY source, h) / 2.0 <= share, false) AS t0
  FROM l
), c1 AS (
  SELECT *, r0 - sum(CASE WHEN t0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS r1 FROM b0
), b1 AS (
  SELECT *, NOT t0 AND size > 0 AND size <= r1 AND sum(CASE WHEN NOT t0 AND size > 0 AND size <= r1 THEN size ELSE 0 END)
         OVER (PARTITION BY source ORDER BY h) <= r1 AS t1 FROM c1
), c2 AS (
  SELECT *, t0 OR t1 AS t01, r1 - sum(CASE WHEN t1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS r2 FROM b1
), b2 AS (
  SELECT *, NOT t01 AND size > 0 AND size <= r2 AND sum(CASE WHEN NOT t01 AND size > 0 AND size <= r2 THEN size ELSE 0 END)
         OVER (PARTITION BY source ORDER BY h) <= r2 AS t2 FROM c2
), c3 AS (
  SELECT *, t01 OR t2 AS t012, r2 - sum(CASE WHEN t2 THEN size ELSE 0 END) OVER (PARTITION BY source) AS r3 FROM b2
), b3 AS (
  SELECT *, NOT t012 AND size > 0 AND size <= r3 AND sum(CASE WHEN NOT t012 AND size > 0 AND size <= r3 THEN size ELSE 0 END)
         OVER (PARTITION BY source ORDER BY h) <= r3 AS t3 FROM c3
)
SELECT doc_id, size, source_size, target, size * (base + CASE WHEN t012 OR t3 THEN 1 ELSE 0 END) AS taken FROM b3
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(text, '!')) AS n_exclaims,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 4 * n_exclaims > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM v
"""

# scores by trying every cut; phrases inside longer ones by comparing at each offset
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), g AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS ws
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS MATERIALIZED (
  SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT * FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.k, c.ws, c.f, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, j)
  JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, j + 1, c.k)
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.ws
  FROM (SELECT lang, f, part, list_slice(ws, i, i + part - 1) AS ws
        FROM (SELECT *, unnest(range(1, k - part + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS part FROM c))) s
  JOIN c ON c.lang = s.lang AND c.ws = s.ws
  WHERE 100 * s.f >= 80 * c.f
)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, f DESC, array_to_string(low.ws, ' ')) AS rank,
       array_to_string(low.ws, ' ') AS phrase, f AS a, l, r, n, score::BIGINT AS score
FROM low JOIN n USING (lang) LEFT JOIN inside ON inside.lang = low.lang AND inside.ws = low.ws
WHERE inside.ws IS NULL
QUALIFY row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, f DESC, array_to_string(low.ws, ' ')) <= 2000
"""

# marks: <s> role [INST] text for a block's first turn, [/INST] text for the others, </s> after the last
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w <> role, true) AS first
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(regexp_replace(text, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS text_chars,
         length(regexp_replace(role, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS role_chars
  FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN first THEN 3 + role_chars + 6 + 4 ELSE 7 END)::BIGINT AS formatted_chars,
       count(*) FILTER (first) AS n_blocks
FROM e GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op5_source_mix": OP5_SQL, "op10_quality_rules": OP10_SQL, "op11_phrase_mining": OP11_SQL, "op13_chat_format": OP13_SQL}

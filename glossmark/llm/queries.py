"""Queries of this folder's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmark.llm import garbled, leakage, lookalike, quality, tokenise, topn
from glossmark.session import spread
from glossmark.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.best_entries(table(spark, folder, "nbest"))


def _clean(spark: SparkSession, folder: str) -> list[tuple[DataFrame, str]]:
    return [(table(spark, folder, "hypotheses"), "hyp"), (table(spark, folder, "refs"), "ref")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_tokens(spark, folder).select("entry_id").distinct()


def p1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled token of every entry, with its original and where that comes from."""
    return garbled.garbled_entries(table(spark, folder, "nbest"), _clean(spark, folder), "entry_id", "hyp")


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.restored(table(spark, folder, "nbest"), _clean(spark, folder), "entry_id", "hyp")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_looking(table(spark, folder, "nbest"), table(spark, folder, "refs"))


def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every hypothesis in canonical form."""
    nbest = spread(table(spark, folder, "nbest").select("entry_id", "hyp"))
    return nbest.select("entry_id", lookalike.canonical_text("hyp").alias("hyp"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenise.encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_figures(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of every document that no model is needed for."""
    return quality.plain_figures(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(p8_stats(spark, folder)).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_tokens": p1_tokens,
    "p1_restored": p1_restored,
    "p3_found": p3_found,
    "p3_entries": p3_entries,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p8_plain": p8_plain,
}

_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CJK = r"[\x{3041}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}\x{20000}-\x{2ffff}]"
_UNREAD = (
    r"</?[a-z]{1,6}/?>|<\|[\p{L}\p{N}_]{1,40}\|>|\[(?:UNK|CLS|SEP|PAD|MASK)\]"
    r"|[\x00-\x08\x0e-\x1f\x7f-\x84\x{86}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
)
_SYMBOL = rf"""[^\p{{L}}\p{{N}}{_BLANK}.,!?''"’“”„«»‘—–\-…。、，！？：；:;()（）「」]"""
_EDGE = quality._EDGE.replace("'", "''")

SQL = {
    "p5_found": """
WITH s AS (
  SELECT 'total' AS criterion, sent_id, entry_id, orig_rank, total::DOUBLE AS score FROM nbest
  UNION ALL SELECT 'bleu', sent_id, entry_id, orig_rank, metric_scores[1] FROM nbest
  UNION ALL SELECT 'meteor', sent_id, entry_id, orig_rank, metric_scores[2] FROM nbest
  UNION ALL SELECT 'ter', sent_id, entry_id, orig_rank, -metric_scores[3] FROM nbest),
r AS (SELECT *, row_number() OVER (PARTITION BY criterion, sent_id ORDER BY score DESC, orig_rank NULLS LAST, entry_id NULLS LAST) AS k
  FROM s WHERE sent_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
SELECT criterion, sent_id::BIGINT AS sent_id, entry_id FROM r WHERE k <= 5""",
    "p8_plain": rf"""
WITH every AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
split AS (SELECT row_no, unnest(string_split_regex(text, '[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM every),
written AS (SELECT row_no, row_number() OVER () AS line_no, length(regexp_replace(line, '[{_BLANK}]+', '', 'g')) AS chars, regexp_replace(line, '{_UNREAD}', '', 'g') AS line
  FROM split WHERE regexp_matches(line, '[^{_BLANK}]')),
lines AS (SELECT row_no, line_no, chars, line, regexp_extract_all(line, '{_CJK}') AS cjk FROM
  (SELECT * REPLACE (CASE WHEN regexp_matches(line, '[^{_BLANK}]') THEN line ELSE '-' END AS line) FROM written)),
worded AS (SELECT *, 2 * len(cjk) > len(regexp_extract_all(line, '\p{{L}}')) AS dense,
  list_filter(list_transform(string_split_regex(line, '[{_BLANK}]+'), lambda w: trim(w, '{_EDGE}')), lambda w: w <> '') AS words FROM lines),
looked AS (SELECT line_no, unnest(CASE WHEN dense THEN list_concat(cjk, list_transform(range(1, len(cjk)), lambda i: cjk[i] || cjk[i + 1]))
  ELSE list_transform(words, lambda w: CASE WHEN w[-1] = 'Σ' THEN regexp_replace(lower(w), '(\p{{L}})σ$', '\1ς') ELSE lower(w) END) END) AS word FROM worded),
known AS (SELECT lang, lower(word) AS word FROM (SELECT DISTINCT coalesce(lang, '') AS lang, word FROM common_words WHERE word IS NOT NULL)),
hits AS (SELECT line_no, max(n) AS n FROM (SELECT line_no, lang, count(*) AS n FROM looked JOIN known USING (word) GROUP BY ALL) GROUP BY line_no),
figures AS (SELECT row_no, chars, len(CASE WHEN dense THEN cjk ELSE words END) AS words, len(array_to_string(CASE WHEN dense THEN cjk ELSE words END, '')) AS word_chars,
  len(regexp_extract_all(line, '{_SYMBOL}')) AS symbols, coalesce(hits.n, 0) AS common, regexp_matches(line, '[.!?…。！？]["''’”»)\]」*_ \t\r]*$')::INT AS ended
  FROM worded LEFT JOIN hits USING (line_no)),
sums AS (SELECT row_no, count(*) AS lines, sum(chars) AS chars, sum(words) AS words, sum(word_chars) AS word_chars, sum(symbols) AS symbols, sum(common) AS common,
  sum(ended) AS ended FROM figures GROUP BY row_no)
SELECT doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(lines, 0)::BIGINT AS lines, word_chars::DOUBLE / nullif(words, 0) AS mean_word_length,
  symbols::DOUBLE / nullif(chars, 0) AS symbol_ratio, ended::DOUBLE / lines AS ended_lines, common::DOUBLE / nullif(words, 0) AS common_words
FROM every LEFT JOIN sums USING (row_no)""",
}

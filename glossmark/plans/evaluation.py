"""Queries of translation evaluation over the tables hypotheses, refs and nbest, with their SQL.

Scores are rounded to six decimals on both sides, as engines differ in the last digits of exp and ln.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark import experiment
from glossmark.functions import text as tx
from glossmark.operators import analysis, badrows, corpus, evaluate, nbest, report, resample, wide
from glossmark.operators.metrics import load
from glossmark.operators.metrics.meteor import Meteor
from glossmark.operators.metrics.ter import Ter
from glossmark.session import hold
from glossmark.sources.tables import table
from glossmark.sources.text import nbest_fields

REPLICAS = 10  # of the hashed forms, which SQL repeats: only to compare them, too few for figures
DRAWS = 10_000  # of the sampled forms
BL = "bleu length"


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "hypotheses"), table(spark, folder, "refs")


def _stats(spark: SparkSession, folder: str, metrics: str = BL, keep_text: bool = False) -> DataFrame:
    return evaluate.suff_stats(*_tables(spark, folder), metrics, keep_text)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _by_run(spark: SparkSession, folder: str, metrics: str = BL) -> DataFrame:
    return evaluate.scores_by_run(_stats(spark, folder, metrics), load(metrics))


def normalize_ws(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.outputs(table(spark, folder, "hypotheses"))


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = corpus.outputs(table(spark, folder, "hypotheses"))
    return out.select("sys_id", "opt_id", "sent_id", F.size(tx.tokenize(F.col("hyp"))).cast("bigint").alias("tokens"))


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = corpus.outputs(table(spark, folder, "hypotheses")).withColumn("t", tx.tokenize(F.col("hyp")))
    orders = F.array(*[F.struct(F.lit(n).alias("n"), tx.ngrams(F.col("t"), n).alias("g")) for n in range(1, 5)])
    each = out.select("sys_id", "opt_id", F.inline(orders)).select("sys_id", "opt_id", "n", F.explode("g").alias("g"))
    counted = each.groupBy("sys_id", "opt_id", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("sys_id", "opt_id", "n").agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("c").alias("grams"))


def ref_clip_counts(spark: SparkSession, folder: str) -> DataFrame:
    one = corpus.latest(table(spark, folder, "refs"), ["sent_id", "ref_id"], "ref").where("ref IS NOT NULL")
    t = one.withColumn("t", tx.tokenize(tx.normalize_ws(F.col("ref"))))
    orders = F.array(*[F.struct(F.lit(n).alias("n"), tx.ngrams(F.col("t"), n).alias("g")) for n in range(1, 5)])
    each = t.select("sent_id", "ref_id", F.inline(orders)).select("sent_id", "ref_id", "n", F.explode("g").alias("g"))
    clip = each.groupBy("sent_id", "ref_id", "n", "g").count().groupBy("sent_id", "n", "g").agg(F.max("count").alias("c"))
    return clip.groupBy("sent_id", "n").agg(F.sum("c").alias("clipped"))


def closest_ref_len(spark: SparkSession, folder: str) -> DataFrame:
    s = corpus.sentences(*_tables(spark, folder))
    size = F.size("hyp_tokens")
    return s.select("sys_id", "opt_id", "sent_id", tx.closest_length(size, F.transform("ref_tokens", F.size)).cast("bigint").alias("ref_len"))


def bleu_suff_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder, "bleu")


def clipped_matches(spark: SparkSession, folder: str) -> DataFrame:
    sums = _stats(spark, folder, "bleu").groupBy("sys_id", "opt_id").agg(*load("bleu")[0].sums())
    return sums.select("sys_id", "opt_id", *[f"bleu_match{n}" for n in range(1, 5)])


def bleu_corpus_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.scores_by(_stats(spark, folder, "bleu"), ["sys_id", "opt_id"], load("bleu"), subscores=True))


def length_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.scores_by(_stats(spark, folder, "length"), ["sys_id", "opt_id"], load("length")))


def bleu_multi_ref(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU of each run against each reference number alone, and against all (-1)."""
    h, r = _tables(spark, folder)
    out, metrics = None, load("bleu")
    numbers = r.where("ref_id IS NOT NULL").select("ref_id").distinct().collect()  # one per reference file
    for ref_id in (-1, *sorted(n[0] for n in numbers)):
        own = r if ref_id < 0 else r.where(F.col("ref_id") == ref_id)
        part = evaluate.scores_by(evaluate.suff_stats(h, own, metrics), ["sys_id", "opt_id"], metrics).withColumn("ref_id", F.lit(ref_id))
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


def sentence_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.sentence_scores(_stats(spark, folder), load(BL)))


def bleu_submetrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.sentence_scores(_stats(spark, folder, "bleu"), load("bleu"), subscores=True).drop("bleu"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.run_summary(_by_run(spark, folder)))


def median_run(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.median_runs(_by_run(spark, folder)))


def pooled_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.pooled_scores(_stats(spark, folder), load(BL)))


def results_long(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.results(_by_run(spark, folder)))


def diff_rank(spark: SparkSession, folder: str) -> DataFrame:
    stats, metrics = hold(_stats(spark, folder)), load(BL)
    ranked = evaluate.diff_rank(stats, metrics, evaluate.scores_by_run(stats, metrics))
    return _rounded(ranked.select("metric", "sys_id", "sent_id", "place", "base", "score", "diff"))


def sentence_lines(spark: SparkSession, folder: str) -> DataFrame:
    scored = evaluate.sentence_scores(_stats(spark, folder, keep_text=True), load(BL), subscores=True)
    return analysis.sentence_lines(scored, load(BL))


def diff_blocks(spark: SparkSession, folder: str) -> DataFrame:
    stats, metrics = hold(_stats(spark, folder, keep_text=True)), load(BL)
    return analysis.diff_blocks(evaluate.diff_rank(stats, metrics, evaluate.scores_by_run(stats, metrics)), metrics)


def unmatched_words(spark: SparkSession, folder: str) -> DataFrame:
    """Top words by multiset difference, of each run."""
    return analysis.surface_unmatched(corpus.sentences(*_tables(spark, folder)))


def meteor_unmatched_top(spark: SparkSession, folder: str) -> DataFrame:
    h, r = _tables(spark, folder)
    meteor = Meteor()
    by_run = hold(evaluate.scores_by_run(evaluate.suff_stats(h, r, [meteor]), [meteor]))
    return analysis.unmatched_words(h, r, meteor, by_run)


def bootstrap_replicas(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(BL)
    return _rounded(resample.replica_scores(resample.hashed_bootstrap_sums(hold(_stats(spark, folder)), metrics, REPLICAS), metrics))


def bootstrap_summary(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(BL)
    sums = resample.hashed_bootstrap_sums(hold(_stats(spark, folder)), metrics, REPLICAS)
    return _rounded(resample.bootstrap_summary(resample.replica_scores(sums, metrics)))


def bootstrap_sampled(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(BL)
    sums = resample.bootstrap_sums(hold(_stats(spark, folder)), metrics, DRAWS)
    return _rounded(resample.bootstrap_summary(resample.replica_scores(sums, metrics)))


def ar_shuffle_rows(spark: SparkSession, folder: str) -> DataFrame:
    return resample.hashed_shuffle_rows(_stats(spark, folder, "length"), REPLICAS)


def ar_pvalue(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(BL)
    return _rounded(resample.p_values(resample.hashed_shuffle_sums(hold(_stats(spark, folder)), metrics, REPLICAS), metrics))


def ar_sampled(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(BL)
    return _rounded(resample.p_values(resample.shuffle_sums(hold(_stats(spark, folder)), metrics, DRAWS), metrics))


def ter_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return _by_run(spark, folder, "ter")


def meteor_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return _by_run(spark, folder, "meteor")


def full_results(spark: SparkSession, folder: str) -> DataFrame:
    """All four metrics: summary of runs, bootstrap and randomization, in long form."""
    return experiment.evaluate(*_tables(spark, folder), boot_samples=DRAWS, ar_shuffles=DRAWS)


def ascii_table(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "hypotheses").agg(F.count_distinct("opt_id")).first()[0]
    return report.ascii_table(full_results(spark, folder), load("bleu meteor ter length"), runs)


def edit_distance_noshift(spark: SparkSession, folder: str) -> DataFrame:
    """Word edits of every sentence without shifts, which those with shifts never exceed."""
    return evaluate.suff_stats(*_tables(spark, folder), [Ter(shifts=False)])


def _ranked(spark: SparkSession, folder: str, metrics: str = BL) -> DataFrame:
    own = load(metrics)
    stats = nbest.entry_stats(table(spark, folder, "nbest"), table(spark, folder, "refs"), own)
    return nbest.ranked_entries(hold(nbest.scored_entries(stats, own)), own)


def nbest_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_ranked(spark, folder).select("sent_id", "orig_rank", "bleu", "length", "bleu_rank", "length_rank"))


def nbest_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(nbest.corpus_scores(_ranked(spark, folder), load(BL)))


def nbest_topbest_compat(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(nbest.corpus_scores(_ranked(spark, folder), load(BL), compat=True).where("kind = 'topbest'"))


def nbest_lines(spark: SparkSession, folder: str) -> DataFrame:
    return nbest.entry_lines(_ranked(spark, folder), load(BL), digits=4)


def nbest_all_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with its scores and ranks by BLEU, METEOR and TER."""
    names = ("bleu", "meteor", "ter")
    return _rounded(_ranked(spark, folder, " ".join(names)).select("sent_id", "orig_rank", *names, *[f"{n}_rank" for n in names]))


def nbest_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of those decoder lines that the plain n-best reader takes: it knows no quotes, and raises at the others."""
    parts = F.split("line", r" \|\|\| ", -1)
    number = F.get(parts, 3).rlike(wide.NUMBER) & (F.abs(F.get(parts, 3).try_cast("double")) < badrows.FLOAT_LIMIT)
    taken = (F.size(parts) >= 4) & F.get(parts, 0).rlike("^[0-9]{1,9}$") & number
    return table(spark, folder, "nbest_raw").where(taken).select("line_id", *nbest_fields(F.col("line")))


def corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.counts(*_tables(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_ws, tokenize_counts, ngram_counts, ref_clip_counts, closest_ref_len, bleu_suff_stats, clipped_matches, bleu_corpus_by_run,
        length_corpus, bleu_multi_ref, sentence_scores, bleu_submetrics, run_summary, median_run, pooled_scores, results_long, diff_rank,
        sentence_lines, diff_blocks, unmatched_words, meteor_unmatched_top, bootstrap_replicas, bootstrap_summary, bootstrap_sampled,
        ar_shuffle_rows, ar_pvalue, ar_sampled, ter_by_run, meteor_by_run, full_results, ascii_table, nbest_rank, nbest_corpus,
        nbest_topbest_compat, nbest_lines, nbest_all_metrics, nbest_parse, corpus_counts, edit_distance_noshift,
    )
}

_NORM = r"regexp_replace(regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g')"
_BREAKS = r"[\t\n\x0B\f\r \x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


def _latest(source: str, keys: str, value: str) -> str:
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""(SELECT {keys}, {value} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY loaded_at DESC NULLS LAST, {value} DESC NULLS LAST) AS k
  FROM {source} WHERE {known}) WHERE k = 1)"""


_H = f"h AS (SELECT sys_id, opt_id, sent_id, {_NORM.format("coalesce(hyp, '')")} AS hyp FROM {_latest('hypotheses', 'sys_id, opt_id, sent_id', 'hyp')})"
_N = f"""h AS (SELECT sent_id::BIGINT AS sent_id, orig_rank, {_NORM.format("coalesce(hyp, '')")} AS hyp FROM (SELECT *, row_number() OVER
  (PARTITION BY sent_id, orig_rank ORDER BY entry_id DESC NULLS LAST) AS k FROM nbest WHERE sent_id IS NOT NULL AND orig_rank IS NOT NULL) WHERE k = 1)"""
_R = f"""r AS (SELECT sent_id, ref_id, string_split_regex({_NORM.format('ref')}, '{_BREAKS}') AS t
  FROM {_latest('refs', 'sent_id, ref_id', 'ref')} WHERE ref IS NOT NULL)"""
_ORDERS = "(VALUES (1), (2), (3), (4)) AS v(n)"
_GRAMS = "unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], chr(1)))) AS g"


def _stat_sql(texts: str, keys: str, refs: str = _R) -> str:
    """CTEs up to ``stat``: statistics of BLEU and length for each row of h."""
    atts = ", ".join(f"greatest(len(t) - {n - 1}, 0)::BIGINT AS bleu_att{n}" for n in range(1, 5))
    matches = ", ".join(f"coalesce(max(m) FILTER (WHERE n = {n}), 0)::BIGINT AS bleu_match{n}" for n in range(1, 5))
    return f"""{texts}, {refs},
ht AS (SELECT {keys}, string_split_regex(hyp, '{_BREAKS}') AS t FROM h WHERE sent_id IN (SELECT sent_id FROM r)),
hg AS (SELECT {keys}, n, g, count(*) AS c FROM (SELECT {keys}, n, {_GRAMS} FROM ht, {_ORDERS}) GROUP BY ALL),
clip AS (SELECT sent_id, n, g, max(c) AS c FROM (SELECT sent_id, ref_id, n, g, count(*) AS c
  FROM (SELECT sent_id, ref_id, n, {_GRAMS} FROM r, {_ORDERS}) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT {keys}, n, sum(least(hg.c, coalesce(clip.c, 0))) AS m FROM hg LEFT JOIN clip USING (sent_id, n, g) GROUP BY {keys}, n),
mm AS (SELECT {keys}, {matches} FROM m GROUP BY {keys}),
near AS (SELECT {', '.join('ht.' + k.strip() for k in keys.split(','))}, arg_min(len(r.t), (abs(len(ht.t) - len(r.t)), len(r.t)))::BIGINT AS ref_len
  FROM ht JOIN r USING (sent_id) GROUP BY ALL),
stat AS (SELECT {keys}, {atts}, bleu_match1, bleu_match2, bleu_match3, bleu_match4, ref_len AS bleu_ref_len, len(t)::BIGINT AS length_hyp, ref_len AS length_ref
  FROM ht JOIN mm USING ({keys}) JOIN near USING ({keys}))"""


STATS = [*(f"bleu_att{n}" for n in range(1, 5)), *(f"bleu_match{n}" for n in range(1, 5)), "bleu_ref_len", "length_hyp", "length_ref"]
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in STATS)
_BP = "CASE WHEN bleu_att1 >= bleu_ref_len THEN 1.0::DOUBLE WHEN bleu_att1 = 0 THEN 0.0 ELSE exp(1.0 - bleu_ref_len::DOUBLE / bleu_att1) END"


def _log(n: int) -> str:
    empty = " + ".join(f"CASE WHEN bleu_att{k} > 0 AND bleu_match{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
    return f"CASE WHEN bleu_att{n} = 0 THEN 0.0 WHEN bleu_match{n} = 0 THEN ln(1.0 / (pow(2.0, {empty}) * bleu_att{n})) ELSE ln(bleu_match{n}::DOUBLE / bleu_att{n}) END"


def _partial(n: int) -> str:
    return f"{_BP} * exp({' + '.join(f'0.25 * {_log(k)}' for k in range(1, n + 1))})"


_BLEU = f"100.0 * least(greatest({_partial(4)}, 0.0), 1.0)"
_LENGTH = "CASE WHEN length_ref <> 0 THEN 100.0::DOUBLE * (length_hyp::DOUBLE / length_ref) END"
_SUBS = ", ".join([*(f"round({_partial(n)}, 6) AS bleu{n}p" for n in range(1, 5)), f"round({_BP}, 6) AS brevity"])
_STAT = _stat_sql(_H, "sys_id, opt_id, sent_id")
_LONG = "(SELECT {k}, 'bleu' AS metric, {b} AS score FROM {t} UNION ALL SELECT {k}, 'length', {l} FROM {t})"


def _long(t: str, k: str) -> str:
    return _LONG.format(t=t, k=k, b=_BLEU, l=_LENGTH)


_BY_RUN = f"""{_STAT},
runs AS (SELECT sys_id, opt_id, {_SUMS} FROM stat GROUP BY ALL),
by_run AS {_long('runs', 'sys_id, opt_id')}"""
_MEDIAN = f"""{_BY_RUN},
ordered AS (SELECT *, row_number() OVER (PARTITION BY metric, sys_id ORDER BY score, opt_id) AS k, count(*) OVER (PARTITION BY metric, sys_id) AS n FROM by_run),
med AS (SELECT metric, sys_id, max(score) FILTER (WHERE k = floor(n / 2) + 1) AS score FROM ordered GROUP BY ALL),
median AS (SELECT metric, sys_id, min(b.opt_id) AS opt_id, score FROM by_run b JOIN med USING (metric, sys_id, score) GROUP BY ALL)"""
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_BOOT = f"""{_STAT},
num AS (SELECT *, row_number() OVER (PARTITION BY sys_id, opt_id ORDER BY sent_id) - 1 AS row_no, count(*) OVER (PARTITION BY sys_id, opt_id) AS n FROM stat),
slots AS (SELECT sys_id, opt_id, row_no AS slot, n, unnest(range({REPLICAS}))::INT AS replica FROM num),
drawn AS (SELECT sys_id, opt_id, replica, {_HASH.format("concat_ws(':', 0, replica, sys_id, opt_id, slot)")} % n AS row_no FROM slots),
sums AS (SELECT sys_id, opt_id, replica, {_SUMS} FROM drawn JOIN num USING (sys_id, opt_id, row_no) GROUP BY ALL),
reps AS {_long('sums', 'sys_id, opt_id, replica')}"""
_SHUFFLE = f"""rows AS (SELECT sys_id, opt_id, sent_id, unnest(range({REPLICAS}))::INT AS shuffle FROM stat WHERE sys_id <> 0),
drawn AS (SELECT *, ({_HASH.format("concat_ws(':', 's', 0, shuffle, sys_id, sent_id, opt_id)")} % 2)::INT AS swap,
  {_HASH.format("concat_ws(':', 'p', 0, shuffle, sys_id, sent_id, opt_id)")} AS hash FROM rows),
perm AS (SELECT *, row_number() OVER (PARTITION BY shuffle, sys_id, sent_id ORDER BY opt_id) AS i,
  row_number() OVER (PARTITION BY shuffle, sys_id, sent_id ORDER BY hash, opt_id) AS p FROM drawn),
shuf AS (SELECT a.sys_id, a.shuffle, a.sent_id, a.opt_id, a.swap, x.opt_id AS from_x, y.opt_id AS from_y FROM perm a
  JOIN perm x ON x.shuffle = a.shuffle AND x.sys_id = a.sys_id AND x.sent_id = a.sent_id AND x.i = a.p
  JOIN perm y ON y.shuffle = a.shuffle AND y.sys_id = a.sys_id AND y.sent_id = a.sent_id AND y.p = a.i)"""


def _side(side: str, yes: str, no: str) -> str:
    sums = ", ".join(f"sum(CASE WHEN swap = 1 THEN {yes}.{c} ELSE {no}.{c} END)::BIGINT AS {c}" for c in STATS)
    return f"""SELECT s.sys_id, shuffle, '{side}' AS side, {sums} FROM shuf s
  JOIN stat a ON a.sys_id = 0 AND a.opt_id = s.from_{side} AND a.sent_id = s.sent_id
  JOIN stat b ON b.sys_id = s.sys_id AND b.opt_id = s.from_{side} AND b.sent_id = s.sent_id GROUP BY ALL"""


def _real(side: str, of: str) -> str:
    sums = ", ".join(f"sum({of}.{c})::BIGINT AS {c}" for c in STATS)
    return f"SELECT b.sys_id, -1 AS shuffle, '{side}' AS side, {sums} FROM stat b JOIN stat a ON a.sys_id = 0 AND a.opt_id = b.opt_id AND a.sent_id = b.sent_id WHERE b.sys_id <> 0 GROUP BY ALL"


_RANKED = f"""{_stat_sql(_N, "sent_id, orig_rank")},
scored AS (SELECT *, {_BLEU} AS bleu, {_LENGTH} AS length FROM stat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY round(bleu, 9) DESC, orig_rank) - 1 AS bleu_rank,
  row_number() OVER (PARTITION BY sent_id ORDER BY round(length, 9) DESC, round(bleu, 9) DESC, orig_rank) - 1 AS length_rank,
  count(*) OVER (PARTITION BY sent_id) AS entries FROM scored)"""


def _chosen(metric: str, kind: str, where: str) -> str:
    score = _BLEU if metric == "bleu" else _LENGTH
    return f"SELECT '{metric}' AS metric, '{kind}' AS kind, round({score}, 6) AS score FROM (SELECT {_SUMS} FROM ranked WHERE {where})"


def _decimals(x: str, digits: int) -> str:
    """As text, halves away from zero."""
    return f"""(CASE WHEN {x} < 0 THEN '-' ELSE '' END || printf('%.{digits}f', round(abs({x}), {digits})))"""


def _gain(metric: str) -> str:
    own, base = f"o.{metric}", f"b.{metric}"
    return f"'{metric}: ' || {_decimals(base, 1)} || ' -> ' || {_decimals(own, 1)} || ' = ' || {_decimals(f'({own} - {base})', 1)}"


_SUB_NAMES = ("bleu1p", "bleu2p", "bleu3p", "bleu4p", "brevity")
_SUB_VALUES = ", ".join([*(f"{_partial(n)} AS bleu{n}p" for n in range(1, 5)), f"{_BP} AS brevity"])
_TEXT_REFS = _R.replace("SELECT sent_id, ref_id, string_split", f"SELECT sent_id, ref_id, {_NORM.format('ref')} AS text, string_split")


def _block(metric: str, other: str) -> str:
    return f"""SELECT '{metric}' AS metric, o.sys_id, o.sent_id, row_number() OVER (PARTITION BY o.sys_id ORDER BY round(o.{metric} - b.{metric}, 9) DESC, o.sent_id) AS place,
  'sys' || (o.sys_id + 1) || '.sortedby.{metric}' AS file,
  'SENT ' || o.sent_id || chr(9) || {_gain(metric)} || chr(9) || {_gain(other)} || chr(10) || '{metric}-median-baseline: ' || hb.hyp || chr(10)
    || '{metric}-median-variant: ' || ho.hyp || chr(10) || texts || chr(10) AS block
FROM scored o JOIN median m ON m.metric = '{metric}' AND m.sys_id = o.sys_id AND m.opt_id = o.opt_id
JOIN median n ON n.metric = '{metric}' AND n.sys_id = 0 JOIN scored b ON b.sys_id = 0 AND b.opt_id = n.opt_id AND b.sent_id = o.sent_id
JOIN h ho ON ho.sys_id = o.sys_id AND ho.opt_id = o.opt_id AND ho.sent_id = o.sent_id JOIN h hb ON hb.sys_id = 0 AND hb.opt_id = n.opt_id AND hb.sent_id = o.sent_id
JOIN told ON told.sent_id = o.sent_id WHERE o.sys_id <> 0"""


_KINDS = (("oracle", "{}_rank = 0"), ("worst", "{}_rank = entries - 1"), ("topbest", "orig_rank = 0"))
_KEYS = "sys_id, opt_id, sent_id"

SQL = {
    "normalize_ws": f"WITH {_H} SELECT * FROM h",
    "tokenize_counts": f"WITH {_H} SELECT {_KEYS}, len(string_split_regex(hyp, '{_BREAKS}'))::BIGINT AS tokens FROM h",
    "ngram_counts": f"""WITH {_H}, t AS (SELECT *, string_split_regex(hyp, '{_BREAKS}') AS t FROM h),
g AS (SELECT sys_id, opt_id, n, g, count(*) AS c FROM (SELECT sys_id, opt_id, n, {_GRAMS} FROM t, {_ORDERS}) GROUP BY ALL)
SELECT sys_id, opt_id, n, count(*) AS distinct_grams, sum(c)::BIGINT AS grams FROM g GROUP BY ALL""",
    "ref_clip_counts": f"""WITH {_R}, c AS (SELECT sent_id, ref_id, n, g, count(*) AS c FROM (SELECT sent_id, ref_id, n, {_GRAMS} FROM r, {_ORDERS}) GROUP BY ALL),
m AS (SELECT sent_id, n, g, max(c) AS c FROM c GROUP BY ALL) SELECT sent_id, n, sum(c)::BIGINT AS clipped FROM m GROUP BY ALL""",
    "closest_ref_len": f"WITH {_STAT} SELECT {_KEYS}, length_ref AS ref_len FROM stat",
    "bleu_suff_stats": f"WITH {_STAT} SELECT * EXCLUDE (length_hyp, length_ref) FROM stat",
    "clipped_matches": f"WITH {_BY_RUN} SELECT sys_id, opt_id, bleu_match1, bleu_match2, bleu_match3, bleu_match4 FROM runs",
    "bleu_corpus_by_run": f"WITH {_BY_RUN} SELECT sys_id, opt_id, round({_BLEU}, 6) AS bleu, {_SUBS} FROM runs",
    "length_corpus": f"WITH {_BY_RUN} SELECT sys_id, opt_id, round({_LENGTH}, 6) AS length FROM runs",
    "sentence_scores": f"WITH {_STAT} SELECT {_KEYS}, round({_BLEU}, 6) AS bleu, round({_LENGTH}, 6) AS length FROM stat",
    "bleu_submetrics": f"WITH {_STAT} SELECT {_KEYS}, {_SUBS} FROM stat",
    "run_summary": f"""WITH {_BY_RUN} SELECT metric, sys_id, round(avg(score), 6) AS avg, round(stddev_samp(score), 6) AS stddev,
  round(min(score), 6) AS min, round(max(score), 6) AS max FROM by_run GROUP BY ALL""",
    "median_run": f"WITH {_MEDIAN} SELECT metric, sys_id, opt_id, round(score, 6) AS score FROM median",
    "pooled_scores": f"""WITH {_STAT}, pooled AS (SELECT sys_id, {_SUMS} FROM stat GROUP BY ALL)
SELECT sys_id, metric, round(score, 6) AS score FROM {_long('pooled', 'sys_id')}""",
    "results_long": f"""WITH {_MEDIAN}, s AS (SELECT metric, sys_id, avg(score) AS avg, stddev_samp(score) AS stddev, min(score) AS min, max(score) AS max FROM by_run GROUP BY ALL)
SELECT metric, sys_id, 'avg' AS type, round(avg, 6) AS value FROM s UNION ALL SELECT metric, sys_id, 'stddev', round(stddev, 6) FROM s
UNION ALL SELECT metric, sys_id, 'min', round(min, 6) FROM s UNION ALL SELECT metric, sys_id, 'max', round(max, 6) FROM s
UNION ALL SELECT metric, sys_id, 'median', round(score, 6) FROM median UNION ALL SELECT metric, sys_id, 'median_idx', opt_id::DOUBLE FROM median""",
    "diff_rank": f"""WITH {_MEDIAN}, long AS {_long('stat', _KEYS)},
own AS (SELECT l.* FROM long l JOIN median m USING (metric, sys_id, opt_id)),
d AS (SELECT o.metric, o.sys_id, o.sent_id, b.score AS base, o.score, o.score - b.score AS diff FROM own o
  JOIN own b ON b.sys_id = 0 AND b.metric = o.metric AND b.sent_id = o.sent_id WHERE o.sys_id <> 0)
SELECT metric, sys_id, sent_id, row_number() OVER (PARTITION BY metric, sys_id ORDER BY round(diff, 9) DESC, sent_id) AS place,
  round(base, 6) AS base, round(score, 6) AS score, round(diff, 6) AS diff FROM d""",
    "unmatched_words": f"""WITH {_STAT}, one AS (SELECT sent_id, g, c FROM clip WHERE n = 1)
SELECT sys_id, opt_id, g AS word, sum(hg.c - coalesce(one.c, 0))::BIGINT AS n FROM hg LEFT JOIN one USING (sent_id, g)
WHERE hg.n = 1 AND hg.c > coalesce(one.c, 0) GROUP BY ALL""",
    "bootstrap_replicas": f"WITH {_BOOT} SELECT sys_id, opt_id, replica, metric, round(score, 6) AS score FROM reps",
    "bootstrap_summary": f"""WITH {_BOOT}, one AS (SELECT metric, sys_id, opt_id, avg(score) AS m, stddev_samp(score) AS s, min(score) AS lo, max(score) AS hi FROM reps GROUP BY ALL)
SELECT metric, sys_id, round(avg(m), 6) AS resampled_mean_avg, round(avg(s), 6) AS resampled_stddev_avg, round(min(lo), 6) AS resampled_min, round(max(hi), 6) AS resampled_max
FROM one GROUP BY ALL""",
    "ar_shuffle_rows": f"WITH {_STAT}, {_SHUFFLE} SELECT * FROM shuf",
    "ar_pvalue": f"""WITH {_STAT}, {_SHUFFLE},
sums AS ({_side('x', 'b', 'a')} UNION ALL {_side('y', 'a', 'b')} UNION ALL {_real('x', 'a')} UNION ALL {_real('y', 'b')}),
long AS {_long('sums', 'sys_id, shuffle, side')},
d AS (SELECT metric, sys_id, shuffle, abs(max(score) FILTER (WHERE side = 'x') - max(score) FILTER (WHERE side = 'y')) AS d FROM long GROUP BY ALL)
SELECT a.metric, a.sys_id, round(any_value(r.d), 6) AS diff, round((count(*) FILTER (WHERE a.d > r.d) + 1) / (count(*) + 1), 6) AS p
FROM d a JOIN d r ON r.metric = a.metric AND r.sys_id = a.sys_id AND r.shuffle = -1 WHERE a.shuffle >= 0 GROUP BY a.metric, a.sys_id""",
    "nbest_rank": f"WITH {_RANKED} SELECT sent_id, orig_rank, round(bleu, 6) AS bleu, round(length, 6) AS length, bleu_rank, length_rank FROM ranked",
    "sentence_lines": f"""WITH {_STAT}, scored AS (SELECT {_KEYS}, {_BLEU} AS bleu, {_LENGTH} AS length, {_SUB_VALUES} FROM stat)
SELECT {_KEYS}, 'sys' || (sys_id + 1) || '.opt' || (opt_id + 1) AS file, sent_id || ' ||| ' || hyp || ' ||| bleu=' || {_decimals('bleu', 2)} || ' length=' || {_decimals('length', 2)}
  || ' ||| ' || {" || ' ' || ".join(f"'{s}=' || {_decimals(s, 2)}" for s in _SUB_NAMES)} AS line FROM scored JOIN h USING ({_KEYS})""",
    "diff_blocks": f"""WITH {_MEDIAN.replace(_R, _TEXT_REFS)}, scored AS (SELECT {_KEYS}, {_BLEU} AS bleu, {_LENGTH} AS length FROM stat),
nth AS (SELECT sent_id, text, row_number() OVER (PARTITION BY sent_id ORDER BY ref_id) AS k FROM r),
told AS (SELECT sent_id, string_agg('ref' || k || ': ' || text, chr(10) ORDER BY k) AS texts FROM nth GROUP BY sent_id)
{_block('bleu', 'length')} UNION ALL {_block('length', 'bleu')}""",
    "nbest_lines": f"""WITH {_RANKED}, subs AS (SELECT *, {_SUB_VALUES} FROM ranked),
texts AS (SELECT sent_id::BIGINT AS sent_id, orig_rank, coalesce(feats, '') AS feats, total FROM (SELECT *, row_number() OVER
  (PARTITION BY sent_id, orig_rank ORDER BY entry_id DESC NULLS LAST) AS k FROM nbest WHERE sent_id IS NOT NULL AND orig_rank IS NOT NULL) WHERE k = 1)
SELECT sent_id, orig_rank, sent_id || ' ||| ' || hyp || ' ||| ' || feats || ' ||| ' || CASE WHEN total IS NULL OR isnan(total) THEN 'NaN' ELSE printf('%.6f', total::DOUBLE) END
  || ' ||| origRank=' || orig_rank || ' bleuRank=' || bleu_rank || ' lengthRank=' || length_rank || ' ||| bleu=' || {_decimals('bleu', 4)} || ' length=' || {_decimals('length', 4)}
  || ' ' || {" || ' ' || ".join(f"'{s}=' || {_decimals(s, 4)}" for s in _SUB_NAMES)} AS line FROM subs JOIN texts USING (sent_id, orig_rank) JOIN h USING (sent_id, orig_rank)""",
    "nbest_parse": r"""WITH p AS (SELECT line_id, string_split(line, ' ||| ') AS p FROM nbest_raw)
SELECT line_id, p[1]::INT AS sent_id, p[2] AS hyp, p[3] AS feats, p[4]::FLOAT AS total FROM p WHERE len(p) >= 4 AND regexp_full_match(p[1], '[0-9]{1,9}')
  AND regexp_full_match(p[4], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND abs(TRY_CAST(p[4] AS DOUBLE)) < 3.4028235677973366e38""",
    # Words common to both texts become characters of their own, all others one character for each side; then letters are compared.
    "edit_distance_noshift": f"""WITH {_H}, {_R},
ht AS (SELECT {_KEYS}, list_filter(list_transform(string_split_regex(hyp, '{_BREAKS}'), lambda x: lower(x)), lambda x: x <> '') AS a FROM h),
rt AS (SELECT sent_id, list_filter(list_transform(t, lambda x: lower(x)), lambda x: x <> '') AS b FROM r),
pairs AS (SELECT *, list_distinct(list_filter(a, lambda x: list_contains(b, x))) AS shared FROM ht JOIN rt USING (sent_id)),
coded AS (SELECT {_KEYS}, len(b) AS n, array_to_string(list_transform(a, lambda x: chr((coalesce(list_position(shared, x), 0) + 2)::INT)), '') AS x,
  array_to_string(list_transform(b, lambda y: chr(coalesce(list_position(shared, y) + 2, 1)::INT)), '') AS y FROM pairs)
SELECT {_KEYS}, min(levenshtein(x, y))::BIGINT AS ter_edits, floor(avg(n))::BIGINT AS ter_words FROM coded GROUP BY ALL""",
    "nbest_corpus": f"WITH {_RANKED} " + " UNION ALL ".join(_chosen(m, k, w.format(m)) for m in ("bleu", "length") for k, w in _KINDS),
    "nbest_topbest_compat": f"WITH {_RANKED} {_chosen('bleu', 'topbest', 'orig_rank = 0')} UNION ALL {_chosen('length', 'topbest', 'bleu_rank = 0')}",
    "corpus_counts": f"""WITH {_H} SELECT (SELECT count(DISTINCT sent_id) FROM h) AS sentences, (SELECT count(DISTINCT sys_id) FROM h) AS systems,
  (SELECT count(DISTINCT opt_id) FROM h) AS runs, (SELECT count(DISTINCT ref_id) FROM refs WHERE sent_id IS NOT NULL) AS "references\"""",
}


def _one_ref(ref_id: int) -> str:
    refs = _R if ref_id < 0 else _R[:-1] + f" AND ref_id = {ref_id})"
    inner = _stat_sql(_H, _KEYS, refs)
    return f"SELECT * FROM (WITH {inner}, runs AS (SELECT sys_id, opt_id, {_SUMS} FROM stat GROUP BY ALL) SELECT sys_id, opt_id, round({_BLEU}, 6) AS bleu, {ref_id} AS ref_id FROM runs)"


SQL["bleu_multi_ref"] = " UNION ALL ".join(map(_one_ref, (-1, 0, 1, 2, 3)))

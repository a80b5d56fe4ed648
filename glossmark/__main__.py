"""Command line: ``python -m glossmark eval ...`` and ``python -m glossmark nbest ...``.

Long option names follow the usual ones: --hyps-baseline, --hyps-sys1, --hyps-sys2 and so on each take a file per run.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossmark import experiment
from glossmark.operators import analysis, corpus, evaluate, nbest, report
from glossmark.operators.metrics import load
from glossmark.operators.metrics.ter import Costs
from glossmark.session import clean
from glossmark.sources import text as source
from glossmark.sources.tables import word_table


#: Options of the usual tool for what Spark does by itself, or for distances that are exact here.
WITHOUT_MEANING = ("--threads", "--debug", "--bleu.verbosity", "--ter.beamWidth")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossmark")
    subs = top.add_subparsers(dest="module", required=True)
    ev, nb = subs.add_parser("eval"), subs.add_parser("nbest")
    ev.add_argument("--hyps-baseline", nargs="+", required=True)
    ev.add_argument("--boot-samples", type=int, default=10_000)
    ev.add_argument("--ar-shuffles", type=int, default=10_000)
    ev.add_argument("--seed", type=int, default=0)
    ev.add_argument("--latex")
    ev.add_argument("--fullLatexDoc", action="store_true")
    ev.add_argument("--sentLevelDir")
    nb.add_argument("--nbest", required=True)
    nb.add_argument("--out", help="folder of the scored entries in their original order")
    for p, default in ((ev, "bleu meteor ter length"), (nb, "bleu meteor ter")):
        p.add_argument("--metrics", nargs="+", default=default.split())
        p.add_argument("--refs", nargs="+", required=True)
        p.add_argument("--rankDir")
        p.add_argument("--verbosity", type=int, default=0)
        p.add_argument("--ter.punctuation", dest="ter_punctuation", choices=("true", "false"), default="true")
        p.add_argument("--ter.maxShiftDistance", dest="ter_far", type=int, default=50)
        p.add_argument("--ter.maxBlock", dest="ter_block", type=int, default=10, help="words of the longest block that is shifted; 0 for any")
        p.add_argument("--meteor.language", dest="meteor_language", default="en")
        p.add_argument("--meteor.task", dest="meteor_task", default="rank")
        p.add_argument("--meteor.beamSize", dest="meteor_beam", type=int, default=40)
        p.add_argument("--meteor.synonymDirectory", dest="meteor_synonyms", help="folder of lines word<TAB>synonym")
        p.add_argument("--meteor.paraphraseFile", dest="meteor_paraphrases", help="lines phrase<TAB>paraphrase")
        p.add_argument("--meteor.functionWords", dest="meteor_function", help="a word a line")
        for name in WITHOUT_MEANING:
            p.add_argument(name, nargs="?", help="accepted and not used: Spark does this work, or there is nothing to do")
        for cost, value in (("match", 0.0), ("delete", 1.0), ("substitute", 1.0), ("insert", 1.0), ("shift", 1.0)):
            p.add_argument(f"--ter.{cost}Cost", dest=f"ter_{cost}", type=float, default=value)
        p.add_argument("--meteor.modules", dest="meteor_modules", nargs="+")
        p.add_argument("--meteor.weights", dest="meteor_weights", nargs="+", type=float)
        p.add_argument("--meteor.params", dest="meteor_params", nargs="+", type=float)
        p.add_argument("--meteor.keepPunctuation", dest="meteor_punctuation", choices=("true", "false"), default="true")
    return top


def _metrics(spark: SparkSession, args: argparse.Namespace) -> list:
    pairs = lambda path: word_table(spark, path) if path else None
    function_words = [r[0] for r in spark.read.text(args.meteor_function).collect()] if args.meteor_function else ()  # a list for people
    costs = Costs(args.ter_match, args.ter_delete, args.ter_substitute, args.ter_insert, args.ter_shift)
    return load(
        args.metrics,
        ter={"punctuation": args.ter_punctuation == "true", "max_shift_distance": args.ter_far, "costs": costs, "max_block": args.ter_block or None},
        meteor={
            "modules": tuple(args.meteor_modules) if args.meteor_modules else None, "weights": tuple(args.meteor_weights) if args.meteor_weights else None,
            "params": tuple(args.meteor_params) if args.meteor_params else None, "keep_punctuation": args.meteor_punctuation == "true",
            "language": args.meteor_language, "task": args.meteor_task, "beam": args.meteor_beam, "synonyms": pairs(args.meteor_synonyms),
            "paraphrases": pairs(args.meteor_paraphrases), "function_words": function_words,
        },
    )


def run_eval(spark: SparkSession, args: argparse.Namespace, systems: list[list[str]]) -> list[str]:
    metrics = _metrics(spark, args)
    hyps, refs = source.read_hypotheses(spark, systems), source.read_refs(spark, args.refs)
    corpus.check_complete(hyps, refs)
    stats = evaluate.suff_stats(hyps, refs, metrics, keep_text=True).persist()
    long = experiment.results(stats, metrics, args.boot_samples, args.ar_shuffles, args.seed).persist()
    runs = len(systems[0])
    out = [r["line"] for r in report.ascii_table(long, metrics, runs).orderBy("line_no").collect()]  # a line per system
    by_run = evaluate.scores_by_run(stats, metrics)
    if args.verbosity:
        out += [r["line"] for r in report.run_lines(by_run).orderBy("metric", "sys_id", "opt_id").collect()]  # a line per run
        out += [r["line"] for r in report.result_lines(long).orderBy("metric", "sys_id", "type").collect()]
    if args.latex:
        with open(args.latex, "w", encoding="utf-8") as f:
            f.write(report.latex_table(long, metrics, runs, full_document=args.fullLatexDoc))
    if args.sentLevelDir:
        scored = evaluate.sentence_scores(stats, metrics, subscores=True)
        report.write_lines(analysis.sentence_lines(scored, metrics), args.sentLevelDir)
    if args.rankDir:
        ranked = evaluate.diff_rank(stats, metrics, by_run)
        report.write_lines(analysis.diff_blocks(ranked, metrics), args.rankDir, order=("place",), text="block")
    for frame in (long, stats):
        frame.unpersist()
    return out


def run_nbest(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    metrics = _metrics(spark, args)
    entries = source.read_nbest(spark, args.nbest).withColumn("entry_id", F.lit(None).cast("bigint")).persist()
    refs = source.read_refs(spark, args.refs)
    corpus.check_lists(entries, refs)
    ranked, scores = experiment.nbest(entries, refs, metrics)
    if args.out or args.rankDir:
        ranks = [f"{m.name}_rank" for m in metrics]
        lines = nbest.entry_lines(ranked, metrics).join(ranked.select("sent_id", "orig_rank", *ranks), ["sent_id", "orig_rank"])
        if args.out:
            report.write_lines(lines.withColumn("file", F.lit("nbest")), args.out, order=("sent_id", "orig_rank"))
        for m in metrics if args.rankDir else ():
            report.write_lines(lines.withColumn("file", F.lit(f"{m.name}.sorted")), f"{args.rankDir}/{m.name}", order=("sent_id", f"{m.name}_rank"))
    labels = {m.name: m.label for m in metrics}
    kinds = {"topbest": "topbest", "oracle": "oracle", "worst": "worst-oracle"}
    text = F.format_string("%.2f (%s)", "score", "submetrics")
    rows = {(r["metric"], r["kind"]): r["text"] for r in scores.select("metric", "kind", text.alias("text")).collect()}  # three rows per metric
    for frame in (ranked, entries):
        frame.unpersist()
    return [f"{label} {shown} score: {rows[name, kind]}" for name, label in labels.items() for kind, shown in kinds.items()]


def main(argv: list[str] | None = None) -> list[str]:
    args, rest = _parser().parse_known_args(argv)
    spark = SparkSession.builder.appName("glossmark").getOrCreate()
    if args.module == "nbest":
        if rest:
            raise SystemExit(f"unknown options: {rest}")
        lines = run_nbest(spark, args)
    else:
        systems: dict[int, list[str]] = {0: args.hyps_baseline}
        current: list[str] | None = None
        for word in rest:
            if m := re.fullmatch(r"--hyps-sys(\d+)", word):
                current = systems.setdefault(int(m[1]), [])
            elif current is None or word.startswith("--"):
                raise SystemExit(f"unknown option: {word}")
            else:
                current.append(word)
        lines = run_eval(spark, args, [systems[k] for k in sorted(systems)])
    clean(spark)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main(sys.argv[1:])

"""Tables of results for people, and files.

The renderers take long results (metric, sys_id, type, value), a handful of rows per system and metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.operators.metrics.base import Metric

TYPES = ("avg", "resampled_stddev_avg", "stddev", "p")


def _wide(results: DataFrame) -> DataFrame:
    return results.groupBy("sys_id", "metric").pivot("type", list(TYPES)).agg(F.first("value"))


def cells(results: DataFrame, runs: int, baseline: int = 0) -> DataFrame:
    """(sys_id, metric, cell): ``avg (s_sel/s_opt/p)`` as text; of one run s_opt is * and p is **."""
    num = lambda c: F.format_string("%.1f", F.col(c))
    s_opt = F.lit("*") if runs < 2 else F.coalesce(num("stddev"), F.lit("-"))
    p = F.when(F.col("sys_id") == baseline, "-").otherwise(F.lit("**") if runs < 2 else F.coalesce(F.format_string("%.2f", F.col("p")), F.lit("-")))
    text = F.format_string("%s (%s/%s/%s)", num("avg"), F.coalesce(num("resampled_stddev_avg"), F.lit("-")), s_opt, p)
    return _wide(results).select("sys_id", "metric", text.alias("cell"))


def _padded(text: Column, width: int) -> Column:
    """Padded with blanks, never cut."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))))


def ascii_table(results: DataFrame, metrics: list[Metric], runs: int, names: dict[int, str] | None = None) -> DataFrame:
    """(line_no, line): a header, then a line per system."""
    wide = cells(results, runs).groupBy("sys_id").pivot("metric", [m.name for m in metrics]).agg(F.first("cell"))
    title = F.when(F.col("sys_id") == 0, F.lit("baseline")).otherwise(F.concat(F.lit("system "), F.col("sys_id").cast("string")))
    for k, v in (names or {}).items():
        title = F.when(F.col("sys_id") == k, F.lit(v)).otherwise(title)
    row = F.concat(_padded(title, 15), *[_padded(F.coalesce(F.col(m.name), F.lit("-")), 23) for m in metrics])
    head = f"n={runs}".ljust(15) + "".join(f"{m.label} (s_sel/s_opt/p)".ljust(23) for m in metrics)
    top = results.sparkSession.createDataFrame([(0, head)], "line_no int, line string")
    out = top.unionByName(wide.select((F.col("sys_id") + 1).alias("line_no"), row.alias("line")))
    if runs >= 2:
        return out
    notes = [(1_000_000, "  *  no estimate of optimizer instability: a single optimizer run"), (1_000_001, "  ** no p-value: a single optimizer run")]
    footer = results.sparkSession.createDataFrame(notes, "line_no int, line string")
    several = F.broadcast(results.agg((F.count_distinct("sys_id") > 1).alias("several")))  # one row
    return out.unionByName(footer.join(several, (F.col("line_no") == 1_000_000) | F.col("several")).drop("several"))


def latex_table(results: DataFrame, metrics: list[Metric], runs: int, names: dict[int, str] | None = None, full_document: bool = False) -> str:
    """A LaTeX table, by metric and then system. Reads a few rows per system and metric."""
    texts = [F.when(F.isnan(t) | F.col(t).isNull(), F.lit("-")).otherwise(F.format_string("%.2f" if t == "p" else "%.1f", t)).alias(t) for t in TYPES]
    rows = {(r["metric"], r["sys_id"]): r for r in _wide(results).select("metric", "sys_id", *texts).collect()}
    systems = sorted({s for _, s in rows})

    lines = [r"\begin{table}[htb]", r"\begin{center}", r"\begin{tabular}{|l|l|c|c|c|c|}", r"\hline"]
    lines.append(r"\textbf{Metric} & \textbf{System} & \textbf{Avg} & $\overline{s}_{\text{sel}}$ & $s_{\text{Test}}$ & $p$-value \\ \hline")
    for m in metrics:
        arrow = "" if m.name == "length" else r" $\uparrow$" if m.bigger_better else r" $\downarrow$"
        for i, s in enumerate(systems):
            r = rows.get((m.name, s))
            first = rf"\multirow{{{len(systems)}}}{{*}}{{{m.label}{arrow}}}" if i == 0 else ""
            name = (names or {}).get(s, "baseline" if s == 0 else f"system {s}")
            values = ["-" if r is None or (t == "p" and s == 0) else r[t] for t in TYPES]
            lines.append(f"{first} & {name} & " + " & ".join(values) + r" \\")
        lines.append(r"\hline")
    about = "; ".join(f"{m.label}: {m.description}" for m in metrics)
    lines += [r"\end{tabular}", r"\end{center}", rf"\caption{{Scores over {runs} optimizer runs. {about}.}}", r"\end{table}"]
    if full_document:
        lines = [r"\documentclass{article}", r"\usepackage{multirow,amsmath}", r"\begin{document}", *lines, r"\end{document}"]
    return "\n".join(lines) + "\n"


def result_lines(results: DataFrame) -> DataFrame:
    """Every statistic as ``RESULT: sys: METRIC: TYPE: value``."""
    text = F.format_string("RESULT: %d: %s: %s: %.6f", "sys_id", F.upper("metric"), F.upper("type"), "value")
    return results.select("metric", "sys_id", "type", text.alias("line"))


def run_lines(by_run: DataFrame) -> DataFrame:
    """The score of every run as ``RESULT: sys: METRIC: OptRun run: score``."""
    text = F.format_string("RESULT: %d: %s: OptRun %d: %.6f", "sys_id", F.upper("metric"), "opt_id", "score")
    return by_run.select("metric", "sys_id", "opt_id", text.alias("line"))


def write_lines(lines: DataFrame, folder: str, file: str = "file", order: tuple[str, ...] = ("sent_id",), text: str = "line") -> None:
    """One folder of text per value of ``file``, each in order: ranges of the order become part files."""
    (
        lines.repartitionByRange(F.col(file), *[F.col(c) for c in order])
        .sortWithinPartitions(file, *order)
        .select(file, text)
        .write.partitionBy(file)
        .mode("overwrite")
        .text(folder)
    )

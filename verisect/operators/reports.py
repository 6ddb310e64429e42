"""Run reports: metrics per run, paired deltas, comparisons, formats and tables."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.operators import metrics as M
from verisect.operators.joins import small


def percent(x: Column) -> Column:
    """12.3%, or n/a for null."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%.1f%%", x * 100))


def points(a: Column, b: Column) -> Column:
    """The difference b - a in percentage points, or n/a."""
    return F.when(a.isNull() | b.isNull(), "n/a").otherwise(F.format_string("%+.1f pp", (b - a) * 100))


def cost(given: Column, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """The provider's cost, else tokens times price for a million."""
    return F.coalesce(given, (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1e6))


def tint(x: Column, good: tuple[float, str], fair: tuple[float, str], poor: str) -> Column:
    return F.when(x < good[0], good[1]).when(x < fair[0], fair[1]).otherwise(poor)


def latest_gold(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of question files; of a question in several, the earliest file's row."""
    from verisect.operators.joins import union_first_wins

    return union_first_wins(parts, "qid")


def visible_runs(runs: DataFrame, include_mock: bool = False) -> DataFrame:
    """Runs with `model_key` and `tag`; mock and dry runs only on demand."""
    config = F.from_json(F.coalesce("config_json", F.lit("{}")), "model_key string, dry_run boolean")
    named = runs.withColumn("_c", config).withColumns({"model_key": F.coalesce("_c.model_key", "model"), "tag": F.element_at(F.split("run_id", ":"), -1)})
    mock = (F.col("model_key") == "mock") | F.coalesce("_c.dry_run", F.lit(False))
    return (named if include_mock else named.where(~mock)).drop("_c")


def graded_metrics(grades: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """The metrics of graded answers by `keys`: pooled rates, means over answers, and those over questions whose case is bad law."""
    rows = grades.join(gold.select("qid", "gold_flag"), "qid", "left")
    bad = F.coalesce(F.col("gold_flag").isin("yellow", "red"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        total("n_cites").alias("cites"),
        M.micro_rate("n_fabricated", "n_cites").alias("fabricated_rate"),
        M.micro_rate(F.coalesce("n_fabricated", F.lit(0)) + F.coalesce("n_unindexed", F.lit(0)), "n_cites").alias("fabricated_strict_rate"),
        M.micro_rate(F.coalesce("n_name_mismatch", F.lit(0)) + F.coalesce("n_quote_absent", F.lit(0)), "n_cites").alias("misgrounded_rate"),
        M.micro_rate("n_red", "n_verified").alias("red_rate"),
        M.flag_mean("gold_hit").alias("gold_recall"),
        M.guarded_mean("gold_equivalent").alias("gold_equiv"),
        M.flag_mean("abstained").alias("abstain_rate"),
        M.filtered_mean("warned_treatment", bad).alias("warned_rate"),
        F.count_if(bad).alias("n_bad"),
    )


RATES = ("fabricated_rate", "misgrounded_rate", "red_rate", "gold_recall", "abstain_rate", "warned_rate")


def run_report(runs: DataFrame, answers: DataFrame, grades: DataFrame, gold: DataFrame, last_qid: str | None = None) -> DataFrame:
    """One row per run: its facts and metrics. last_qid cuts by the id as a text."""
    if last_qid is not None:
        answers, grades = answers.where(F.col("qid") <= last_qid), grades.where(F.col("qid") <= last_qid)
    facts = M.run_facts(answers, "run_id", error=F.col("error").isNotNull(), cost=F.col("cost_usd"), latency=F.col("latency_s"), calls=F.json_array_length("tool_calls_json"))
    versions = grades.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("grader_version", F.lit("unstamped")))), ",").alias("grader_versions"))
    shown = visible_runs(runs).select("run_id", "model_key", "arm", "tag")
    return shown.join(facts, "run_id", "left").join(graded_metrics(grades, gold, "run_id"), "run_id", "left").join(versions, "run_id", "left")


def paired_deltas(runs: DataFrame, grades: DataFrame, gold: DataFrame, left: str = "bare", right: str = "mcp") -> DataFrame:
    """Per model and tag, on the questions that both arms have graded: their number and each rate's difference."""
    # Runs are few, and each has very many grades: joined by a shuffle, a run's grades would meet in one task.
    named = grades.join(small(visible_runs(runs).select("run_id", "model_key", "tag", "arm")), "run_id")
    both = named.groupBy("model_key", "tag", "qid").agg(F.min("arm").alias("_first"), F.max("arm").alias("_last")).where("_first < _last").drop("_first", "_last")
    common = named.where(F.col("arm").isin(left, right)).join(both, ["model_key", "tag", "qid"], "left_semi")
    by_arm = graded_metrics(common, gold, "model_key", "tag", "arm")
    of = lambda arm: [F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{arm}") for c in ("n", *RATES)]
    met = by_arm.groupBy("model_key", "tag").agg(*of(left), *of(right)).where(F.col(f"n_{left}").isNotNull() & F.col(f"n_{right}").isNotNull())
    return met.select("model_key", "tag", F.col(f"n_{left}").alias("common"), *((F.col(f"{r}_{right}") - F.col(f"{r}_{left}")).alias(f"d_{r}") for r in RATES))


def markdown_table(df: DataFrame, columns: Sequence[str]) -> str:
    """A small report as a markdown table; reads its rows to the driver, a row a run."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in columns)).collect()
    lines = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *(f"| {' | '.join(r[c].replace('|', '/') for c in columns)} |" for r in rows)]) + "\n"


def html_table(df: DataFrame, columns: Sequence[str]) -> str:
    """The same as an HTML table, with everything escaped."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in columns)).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', (r[c] for c in columns))}</tr>" for r in rows)
    return f"<table><thead><tr>{cells('th', columns)}</tr></thead><tbody>{body}</tbody></table>"


def bar_chart(df: DataFrame, label: str, values: Sequence[str], width: int = 480, bar: int = 16) -> str:
    """A small report as horizontal bars in SVG: a group of bars a row, one for each value column, to the scale of the largest.

    Nulls are written as n/a and have no bar; negative values run to the left of the zero line.
    """
    rows = df.select(F.col(label).cast("string").alias(label), *(F.col(v).cast("double").alias(v) for v in values)).collect()
    numbers = [r[v] for r in rows for v in values if r[v] is not None and r[v] == r[v]]
    low, high = min([0.0, *numbers]), max([0.0, *numbers])
    scale = width / ((high - low) or 1.0)
    left, step, out = 160, bar * len(values) + 10, []
    zero = left - low * scale
    for k, r in enumerate(rows):
        top = k * step
        out.append(f'<text x="{left - 8}" y="{top + step / 2:.1f}" text-anchor="end">{html.escape(r[label] or "")}</text>')
        for j, v in enumerate(values):
            x, known = r[v], r[v] is not None and r[v] == r[v]
            at = zero + min(0.0, x) * scale if known else zero
            size = abs(x) * scale if known else 0.0
            out.append(f'<rect class="s{j}" x="{at:.1f}" y="{top + j * bar}" width="{size:.1f}" height="{bar - 2}"><title>{html.escape(v)}</title></rect>')
            out.append(f'<text x="{at + size + 4:.1f}" y="{top + j * bar + bar - 5}">{f"{x:.3g}" if known else "n/a"}</text>')
    head = f'<svg xmlns="http://www.w3.org/2000/svg" font-size="11" width="{left + width + 60}" height="{max(1, len(rows)) * step}">'
    style = "<style>.s0{fill:#2a78d6}.s1{fill:#eb6834}.s2{fill:#1baf7a}.s3{fill:#4a3aa7}</style>"
    return "".join([head, style, *out, f'<line x1="{zero:.1f}" x2="{zero:.1f}" y1="0" y2="{len(rows) * step}" stroke="#898781"/>', "</svg>"])

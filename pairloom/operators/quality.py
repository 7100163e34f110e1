"""Declared data-quality rules, evaluated as Spark aggregates into one report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.checks import require

REPORT = "dataset string, rule string, column string, severity string, checked bigint, failed bigint, rate double, passed boolean"


@dataclass
class TableRules:
    """Rules of one table. Severity is ``error`` unless a rule says otherwise.

    ``allowed`` and ``text_length`` map a column to ``(rule value, severity)``;
    ``list_size`` maps a column to ``(delimiter, least, warn_above)``.
    """

    required: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    non_null: list[str] = field(default_factory=list)
    allowed: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    text_length: dict[str, tuple[int, str]] = field(default_factory=dict)
    list_size: dict[str, tuple[str, int, int]] = field(default_factory=dict)


def _row_rules(rules: TableRules):
    """(rule, column, severity, failure predicate) of every row-level rule."""
    for name in rules.non_null:
        yield "non_null", name, "error", F.col(name).isNull()
    for name, (values, severity) in rules.allowed.items():
        yield "allowed_values", name, severity, ~F.col(name).isin(values)
    for name, (least, severity) in rules.text_length.items():
        yield "text_length", name, severity, F.length(name) < least
    for name, (delimiter, least, warn_above) in rules.list_size.items():
        pieces = F.split(F.col(name), "\\Q" + delimiter + "\\E")
        size = F.size(F.filter(pieces, lambda piece: F.trim(piece) != ""))
        yield "list_size_min", name, "warning", size < least
        yield "list_size_max", name, "warning", size > warn_above


def _unpivot(counts: DataFrame, dataset: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Wide one-row counts to one report row per rule."""
    entries = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column"),
            F.lit(severity).alias("severity"),
            F.col("checked").alias("checked"),
            F.coalesce(F.col(f"f{at}"), F.lit(0)).alias("failed"),
        )
        for at, (rule, column, severity) in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("r")).select(
        F.lit(dataset).alias("dataset"), "r.*"
    )


def check_table(df: DataFrame, dataset: str, rules: TableRules) -> DataFrame:
    """Required columns, then all row rules in one pass and the key rule in one grouping.

    NULL values only fail ``non_null``; the other rules judge values that exist.
    """
    absent = [name for name in rules.required if name not in df.columns]
    header = df.sparkSession.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.lit("required_columns").alias("rule"),
        F.lit(", ".join(absent)).alias("column"),
        F.lit("error").alias("severity"),
        F.lit(len(rules.required)).cast("bigint").alias("checked"),
        F.lit(len(absent)).cast("bigint").alias("failed"),
    )
    report = header if rules.required else header.limit(0)
    row_rules = list(_row_rules(rules))
    usable = [r for r in row_rules if r[1] in df.columns]
    # A rule on a column that is not there is broken for every row, and for the table itself.
    key = ", ".join(rules.primary_key)
    broken = [r[:3] for r in row_rules if r[1] not in df.columns]
    broken += [("unique_key", key, "error")] if set(rules.primary_key) - set(df.columns) else []
    if broken:
        counts = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("checked"))
        failing = counts.withColumns({f"f{at}": F.col("checked") for at in range(len(broken))})
        report = report.unionByName(_unpivot(failing, dataset, broken))
    if usable:
        counts = df.agg(
            F.count(F.lit(1)).alias("checked"),
            *[F.count_if(fails).alias(f"f{at}") for at, (_, _, _, fails) in enumerate(usable)],
        )
        report = report.unionByName(_unpivot(counts, dataset, [r[:3] for r in usable]))
    if rules.primary_key and not set(rules.primary_key) - set(df.columns):
        # Long keys travel as digests, which are equal exactly when the keys are.
        kinds = dict(df.dtypes)
        keys = [F.sha2(name, 256).alias(name) if kinds[name] == "string" else F.col(name) for name in rules.primary_key]
        per_key = df.select(*keys).groupBy(*rules.primary_key).agg(F.count(F.lit(1)).alias("n"))
        counts = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("f0"),
        )
        report = report.unionByName(_unpivot(counts, dataset, [("unique_key", key, "error")]))
    return _judge(report, least_rate=None)


def _judge(report: DataFrame, least_rate: float | None) -> DataFrame:
    """Add the pass rate and verdict; without a least rate, no failure is allowed."""
    rate = F.when(F.col("checked") == 0, 1.0).otherwise(
        1.0 - F.try_divide(F.col("failed"), F.col("checked"))
    )
    passed = F.col("failed") == 0 if least_rate is None else F.col("rate") >= least_rate
    return report.withColumn("rate", rate).withColumn("passed", passed)


def check_parent_match(
    child: DataFrame,
    parent: DataFrame,
    child_key: str,
    parent_key: str,
    dataset: str,
    least_rate: float = 1.0,
    severity: str = "error",
) -> DataFrame:
    """Share of child rows whose key exists in the parent.

    Child rows are counted per key before the join, so a key that holds a third of
    the child is a single row by then.
    """
    per_key = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("key")).distinct().withColumn("known", F.lit(1))
    counts = per_key.join(known, "key", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("f0"),
    )
    return _judge(_unpivot(counts, dataset, [("parent_match", child_key, severity)]), least_rate)


def check_coverage(
    df: DataFrame, has: Column, dataset: str, name: str, least_rate: float, severity: str = "warning"
) -> DataFrame:
    """Share of rows for which ``has`` is true."""
    counts = df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~has | has.isNull()).alias("f0"))
    return _judge(_unpivot(counts, dataset, [("coverage", name, severity)]), least_rate)


def check_row_count(source: DataFrame, result: DataFrame, dataset: str) -> DataFrame:
    """A transform must neither add nor lose rows."""
    before = source.agg(F.count(F.lit(1)).alias("checked"))
    after = result.agg(F.count(F.lit(1))).scalar()
    counts = before.withColumn("f0", F.abs(after - F.col("checked")))
    return _judge(_unpivot(counts, dataset, [("row_count", "*", "error")]), None)


def check_disjoint_groups(df: DataFrame, group: str, split: str, dataset: str) -> DataFrame:
    """Every group must lie in one split only."""
    per_group = df.groupBy(group).agg(
        F.min(split).alias("low"), F.max(split).alias("high")
    )
    counts = per_group.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("low") != F.col("high")).alias("f0"),
    )
    return _judge(_unpivot(counts, dataset, [("disjoint_groups", group, "error")]), None)


def check_split_shares(
    df: DataFrame, split: str, shares: dict[str, float], dataset: str, margin: float = 0.05, severity: str = "warning"
) -> DataFrame:
    """Each split's share of the rows must lie within ``margin`` of the planned one.

    One row per planned split: ``failed`` is the number of rows by which it misses the
    nearer end of its range.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col(split) == name).alias(f"n{at}") for at, name in enumerate(shares)],
    )
    total = F.col("checked")
    missed = {}
    for at, share in enumerate(shares.values()):
        over = F.col(f"n{at}") - F.floor(total * min(1.0, share + margin))
        under = F.ceil(total * max(0.0, share - margin)) - F.col(f"n{at}")
        missed[f"f{at}"] = F.greatest(over, under, F.lit(0)).cast("bigint")
    rules = [("split_share", f"{split}={name}", severity) for name in shares]
    return _judge(_unpivot(counts.withColumns(missed), dataset, rules), None)


def quality_report(*parts: DataFrame) -> DataFrame:
    """All findings as one table."""
    require(len(parts) > 0, "a report needs at least one part")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def enforce(report: DataFrame) -> DataFrame:
    """Raise when an ``error`` rule failed; warnings are reported and remove nothing."""
    # One row per declared rule, so the report is as long as its rules.
    broken = (
        report.filter((F.col("severity") == "error") & ~F.col("passed"))
        .orderBy("dataset", "rule", "column")
        .collect()
    )
    if broken:
        named = "; ".join(f"{r.dataset}.{r.rule}({r.column}): {r.failed} failed" for r in broken)
        raise ValueError(f"{len(broken)} data quality errors: {named}")
    return report

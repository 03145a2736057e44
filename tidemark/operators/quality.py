"""Data quality: one rule form, compiled to aggregates, serves checks, contracts and scores.

A rule is a dict with ``check`` (completeness, uniqueness, range, pattern, accepted_values),
``column`` and its parameters. All row-wise rules of a table are one aggregate. Uniqueness needs a
shuffle by the column, so each such rule is its own distinct count; putting several distinct counts
in one aggregate would multiply every input row instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import matches

Rule = Mapping[str, object]
#: Columns of a check's result; rules may carry a ``label`` to show instead of the check, and a ``severity``.
RESULT = ("check", "column_name", "passed", "total_rows", "failing_rows", "failure_pct")


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, NaN or empty text."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def breaks(rule: Rule, full_match: bool = False, numbers_only: bool = False) -> Column:
    """True where a non-null value breaks a range, pattern or accepted-values rule.

    A value that is no number passes a range rule, unless ``numbers_only``.
    """
    c = F.col(rule["column"])
    if rule["check"] == "range":
        number = c.try_cast("double")
        low, high = rule.get("min"), rule.get("max")
        bad = F.lit(numbers_only) & c.isNotNull() & number.isNull()
        bad = bad | (number < low) if low is not None else bad
        bad = bad | (number > high) if high is not None else bad
    elif rule["check"] == "pattern":
        bad = ~matches(c, rule["pattern"], full_match)
    else:
        bad = ~c.isin(*rule["values"])
    return F.coalesce(bad, F.lit(False))


def _failing(df: DataFrame, rule: Rule, full_match: bool) -> Column:
    if rule["check"] == "completeness":
        return F.count_if(is_missing(df, rule["column"]))
    return F.count_if(breaks(rule, full_match))


def _rows(frame: DataFrame, items: Sequence[tuple[Rule, Column, Column]]) -> DataFrame:
    """One result row per ``(rule, failing, total)`` of a one-row aggregate."""
    def line(rule: Rule, bad: Column, total: Column) -> Column:
        pct = F.when(total > 0, bad / total * 100).otherwise(0.0)
        allowed = float(rule.get("max_null_pct", 0.0)) if rule["check"] == "completeness" else 0.0
        return F.struct(
            F.lit(rule.get("label", rule["check"])).alias("check"),
            F.lit(rule["column"]).alias("column_name"),
            F.lit(rule.get("severity", "error")).alias("severity"),
            (pct <= allowed).alias("passed"),
            total.alias("total_rows"),
            bad.alias("failing_rows"),
            pct.alias("failure_pct"),
        )

    return frame.select(F.inline(F.array(*[line(*i) for i in items])))


def run_checks(df: DataFrame, rules: Sequence[Rule], full_match: bool = False) -> DataFrame:
    """One row per rule: check, column, passed, rows, failing rows, failing percent."""
    return _checked(df, rules, full_match).select(*RESULT)


def _checked(df: DataFrame, rules: Sequence[Rule], full_match: bool) -> DataFrame:
    """Results with each rule's own severity."""
    plain = [r for r in rules if r["check"] != "uniqueness"]
    parts = []
    if plain:
        aggs = [_failing(df, r, full_match).alias(f"_{i}") for i, r in enumerate(plain)]
        row = df.agg(F.count(F.lit(1)).alias("_total"), *aggs)
        parts.append(_rows(row, [(r, F.col(f"_{i}"), F.col("_total")) for i, r in enumerate(plain)]))
    for rule in (r for r in rules if r["check"] == "uniqueness"):
        c = F.col(rule["column"])
        row = df.agg(
            F.count(F.lit(1)).alias("_total"), (F.count(c) - F.count_distinct(c)).alias("_0")
        )
        parts.append(_rows(row, [(rule, F.col("_0"), F.col("_total"))]))
    return reduce(DataFrame.unionAll, parts)


def referential(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str, samples: int = 10) -> DataFrame:
    """Distinct child keys, how many lack a parent, and the smallest few of those."""
    keys = child.select(F.col(child_key).alias("k")).filter("k is not null").distinct()
    known = parent.select(F.col(parent_key).alias("k")).filter("k is not null").distinct()
    tested = keys.join(known.withColumn("_hit", F.lit(True)), "k", "left")
    lost = F.col("_hit").isNull()
    counts = tested.agg(
        F.count(F.lit(1)).alias("child_keys"), F.count_if(lost).alias("orphan_keys")
    )
    few = tested.filter(lost).select("k").orderBy("k").limit(samples)
    listed = few.agg(F.array_join(F.sort_array(F.collect_list(F.col("k"))), ",").alias("samples"))
    return counts.crossJoin(F.broadcast(listed)).select(
        F.lit(name).alias("relationship"),
        "child_keys",
        "orphan_keys",
        F.when(F.col("child_keys") > 0, F.col("orphan_keys") / F.col("child_keys") * 100)
        .otherwise(0.0).alias("orphan_pct"),
        (F.col("orphan_keys") == 0).alias("passed"),
        "samples",
    )


def schema_tests(df: DataFrame, tests: Mapping[str, Sequence[object]], parents: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Column tests by name: 'unique', 'not_null', ('accepted_values', [...]), 'relationships'."""
    rules, links = [], []
    for column, wanted in tests.items():
        for test in wanted:
            kind, arg = test if isinstance(test, tuple) else (test, None)
            if kind == "relationships":
                links.append(column)
            elif kind == "accepted_values":
                rules.append({"check": kind, "column": column, "values": arg})
            else:
                rules.append({"check": {"unique": "uniqueness", "not_null": "completeness"}[kind], "column": column})
    shown = F.create_map(*[F.lit(x) for x in ("uniqueness", "unique", "completeness", "not_null", "accepted_values", "accepted_values")])
    parts = [
        run_checks(df, rules).select(
            F.element_at(shown, F.col("check")).alias("test"), "column_name", "failing_rows", "passed"
        )
    ]
    for column in links:
        parent, key = parents[column]
        found = referential(df, column, parent, key, column)
        parts.append(
            found.select(
                F.lit("relationships").alias("test"), F.lit(column).alias("column_name"),
                F.col("orphan_keys").alias("failing_rows"), "passed",
            )
        )
    return reduce(DataFrame.unionAll, parts)


def assert_empty(df: DataFrame, name: str) -> DataFrame:
    """A test that passes when ``df`` has no rows."""
    return df.agg(F.count(F.lit(1)).alias("failing_rows")).select(
        F.lit(name).alias("test"), "failing_rows", (F.col("failing_rows") == 0).alias("passed")
    )


def freshness(df: DataFrame, ts: str, slo_days: float, as_of: str, name: str) -> DataFrame:
    """Latest row, its age in days at ``as_of`` and whether that is within the objective."""
    latest = df.agg(F.max(ts).alias("latest"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp("latest")) / 86400
    status = F.when(F.col("latest").isNull(), "UNKNOWN").when(age <= slo_days, "PASS").otherwise("STALE")
    return latest.select(F.lit(name).alias("dataset"), "latest", age.alias("age_days"), status.alias("status"))


def volume_check(df: DataFrame, low: int, high: int, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("dataset"), "rows", F.col("rows").between(low, high).alias("passed")
    )


def volume_ratio(a: DataFrame, b: DataFrame, period: str) -> DataFrame:
    """Rows of two sources per period, for periods both have, and their ratio."""
    left = a.groupBy(period).agg(F.count(F.lit(1)).alias("rows_a"))
    right = b.groupBy(period).agg(F.count(F.lit(1)).alias("rows_b"))
    return left.join(right, period).withColumn("ratio", F.col("rows_a") / F.col("rows_b"))


# Spark types a contract type stands for.
CONTRACT_TYPES = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "string": (T.StringType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def validate_contract(df: DataFrame, contract: Mapping[str, object], as_of: str) -> DataFrame:
    """One row per promise: kind, column, severity, failing rows, passed.

    Existence and type come from the schema; the rest is :func:`run_checks` plus one aggregate.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    rules: list[dict] = []
    static: list[Column] = []

    def fixed(check: str, column: str, severity: str, ok: bool) -> None:
        static.append(
            F.struct(
                F.lit(check).alias("check"), F.lit(column).alias("column_name"),
                F.lit(severity).alias("severity"), F.lit(0 if ok else 1).cast("bigint").alias("failing_rows"),
                F.lit(ok).alias("passed"),
            )
        )

    for field in contract.get("schema", ()):
        name = field["name"]
        fixed("column_exists", name, "error", name in fields)
        if name not in fields:
            continue
        if "type" in field:
            fixed("type_matches", name, "error", isinstance(fields[name], CONTRACT_TYPES[field["type"]]))
        if not field.get("nullable", True):
            rules.append({"check": "completeness", "column": name, "severity": "error", "label": "not_nullable"})
        if field.get("unique", False):
            rules.append({"check": "uniqueness", "column": name, "severity": "error", "label": "unique"})
    for rule in contract.get("quality_rules", ()):
        if rule["column"] not in fields:
            fixed(rule["rule"], rule["column"], rule.get("severity", "warning"), False)
        else:
            rules.append({**rule, "check": rule["rule"], "severity": rule.get("severity", "warning"), "label": rule["rule"]})

    parts = []
    if rules:
        checked = _checked(df, rules, full_match=True)
        parts.append(checked.select("check", "column_name", "severity", "failing_rows", "passed"))
    fresh, volume = contract.get("freshness"), contract.get("volume")
    measured = list(static)
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz"))
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *([F.max(fresh["timestamp_column"]).alias("_latest")] if fresh else []),
    )

    def tested(check: str, column: str, ok: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(column).alias("column_name"), F.lit("error").alias("severity"),
            F.when(ok, 0).otherwise(1).cast("bigint").alias("failing_rows"), ok.alias("passed"),
        )

    if fresh:
        hours = (now - F.unix_timestamp("_latest")) / 3600
        ok = F.coalesce(hours <= fresh["max_delay_hours"], F.lit(False))
        measured.append(tested("freshness", fresh["timestamp_column"], ok))
    if volume:
        low, high = volume.get("min_rows", 0), volume.get("max_rows")
        ok = F.col("_rows") >= low if high is None else F.col("_rows").between(low, high)
        measured.append(tested("volume", "*", ok))
    if measured:
        parts.append(row.select(F.inline(F.array(*measured))))
    return reduce(DataFrame.unionAll, parts)


def compliance(results: DataFrame) -> DataFrame:
    """Checks passed, failed and the passing percent; freshness and volume are reported apart."""
    counted = results.filter(~F.col("check").isin("freshness", "volume"))
    return counted.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        (F.count_if("passed") / F.count(F.lit(1)) * 100).alias("compliance_pct"),
    )


# Weight of each dimension, and the lowest score of each grade.
WEIGHTS = {"completeness": 0.30, "uniqueness": 0.20, "validity": 0.25, "consistency": 0.15, "timeliness": 0.10}
GRADES = ((95, "EXCELLENT"), (85, "GOOD"), (70, "FAIR"), (50, "POOR"))


def score(df: DataFrame, spec: Mapping[str, object], as_of: str, name: str) -> DataFrame:
    """Five dimensions from 0 to 100, their weighted mean and a grade; one row.

    ``spec``: required (columns), keys (columns), validity (rules), formats (pattern rules),
    timestamp, max_age_days.
    """
    required, keys = list(spec.get("required", ())), list(spec.get("keys", ()))
    valid, formats = list(spec.get("validity", ())), list(spec.get("formats", ()))
    one = F.lit(0).cast("bigint")

    def total(cols: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, cols, one)

    def passing(rules: Sequence[Rule]) -> tuple[Column, Column]:
        seen = total([F.count(F.col(r["column"])) for r in rules])
        return seen, seen - total([F.count_if(breaks(r, numbers_only=True)) for r in rules])

    seen_v, pass_v = passing(valid)
    seen_f, pass_f = passing(formats)
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        total([F.count_if(is_missing(df, c)) for c in required]).alias("_missing"),
        seen_v.alias("_seen_v"), pass_v.alias("_pass_v"),
        seen_f.alias("_seen_f"), pass_f.alias("_pass_f"),
        F.max(spec["timestamp"]).alias("_latest"),
    )
    for i, key in enumerate(keys):
        part = df.agg((F.count_distinct(key)).alias(f"_d{i}"), F.count(key).alias(f"_n{i}"))
        row = row.crossJoin(F.broadcast(part))

    def pct(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den * 100).otherwise(100.0)

    cells = F.col("_rows") * len(required)
    each = [pct(F.col(f"_d{i}"), F.col(f"_n{i}")) for i in range(len(keys))]
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp("_latest")) / 86400
    lateness = age / spec["max_age_days"]
    row = row.select(
        F.lit(name).alias("dataset"),
        pct(cells - F.col("_missing"), cells).alias("completeness"),
        (reduce(lambda a, b: a + b, each) / len(each) if each else F.lit(100.0)).alias("uniqueness"),
        pct(F.col("_pass_v"), F.col("_seen_v")).alias("validity"),
        pct(F.col("_pass_f"), F.col("_seen_f")).alias("consistency"),
        F.when(F.col("_latest").isNull(), 0.0)
        .when(lateness <= 1, 100.0)
        .otherwise(F.greatest(F.lit(0.0), (1 - (lateness - 1) / 2) * 100)).alias("timeliness"),
    )
    overall = reduce(lambda a, b: a + b, [F.col(d) * w for d, w in WEIGHTS.items()])
    graded = row.withColumn("overall", overall)
    grade = F.lit("CRITICAL")
    for floor, label in reversed(GRADES):
        grade = F.when(F.col("overall") >= floor, label).otherwise(grade)
    return graded.withColumn("grade", grade)


# The limits of the gate.
def circuit(scores: DataFrame, passing: float = 90, warning: float = 80, critical: float = 50) -> DataFrame:
    """Turn a score into a gate: CLOSED proceeds, HALF-OPEN warns, OPEN halts."""
    s = F.col("overall")
    return scores.select(
        "dataset",
        "overall",
        F.when(s < warning, "OPEN").when(s < passing, "HALF-OPEN").otherwise("CLOSED").alias("state"),
        F.when(s < critical, "CRITICAL").when(s < warning, "ERROR").when(s < passing, "WARNING")
        .otherwise("INFO").alias("severity"),
    )


class GateOpen(RuntimeError):
    """A dataset scored too low for the run to go on."""


def enforce_gate(decisions: DataFrame) -> None:
    """Raise when any dataset's gate is OPEN (one row per dataset comes to the driver)."""
    halted = [r["dataset"] for r in decisions.filter("state = 'OPEN'").select("dataset").collect()]
    if halted:
        raise GateOpen(f"quality gate open for {', '.join(halted)}")


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule a row fails (an unknown outcome fails); NULL if it passes all."""
    out = F
    for name, ok in rules:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return out.otherwise(F.lit(None))


def split(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the rest with the reason. Together they are the input."""
    marked = df.withColumn("reason", first_failure(rules))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def clean(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows dropped per rule in cascade order, counted in one pass."""
    valid, _ = split(df, rules)
    order = F.create_map(*[x for i, (n, _) in enumerate(rules) for x in (F.lit(n), F.lit(i + 1))])
    dropped = (
        df.groupBy(first_failure(rules).alias("rule")).agg(F.count(F.lit(1)).alias("dropped"))
        .filter("rule is not null")
        .select(F.element_at(order, F.col("rule")).alias("step"), "rule", "dropped")
    )
    return valid, dropped


def issue_counts(df: DataFrame, issues: Mapping[str, Column]) -> DataFrame:
    """Rows showing each issue; all counted in one pass."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in issues.items()])
    lines = [F.struct(F.lit(n).alias("issue"), F.col(n).alias("issue_count")) for n in issues]
    return row.select(F.inline(F.array(*lines)))


# Percent above which an issue is HIGH and MEDIUM.
SEVERITY = {"completeness": (5.0, 1.0), "uniqueness": (1.0, 0.0), "orphans": (5.0, 0.0), "range": (5.0, 1.0)}


def issue_report(results: Mapping[str, DataFrame]) -> DataFrame:
    """Failed checks of several datasets, most severe and most frequent first.

    The window is over check results: as many rows as rules, whatever the data size.
    """
    frames = [r.withColumn("dataset", F.lit(n)) for n, r in results.items()]
    found = reduce(DataFrame.unionByName, frames).filter("failing_rows > 0")
    level = F.lit("LOW")
    for check, (high, medium) in SEVERITY.items():
        here = F.when(F.col("failure_pct") > high, "HIGH").when(F.col("failure_pct") > medium, "MEDIUM").otherwise("LOW")
        level = F.when(F.col("check") == check, here).otherwise(level)
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    order = Window.partitionBy().orderBy(rank, F.col("failing_rows").desc(), "dataset", "check", "column_name")
    return found.withColumn("severity", level).select(
        F.row_number().over(order).alias("place"), "dataset", "check", "column_name", "severity", "failing_rows", "failure_pct"
    )


def drift(df: DataFrame, period: Column, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of each column per period, and the shift of the mean in earlier deviations.

    One aggregate over the facts; the window runs over periods.
    """
    lines = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]
    long = df.select(period.alias("period"), F.explode(F.array(*lines)).alias("_x")).select("period", "_x.*")
    stats = long.groupBy("period", "column_name").agg(
        F.count("v").alias("rows"), F.avg("v").alias("mean_value"), F.stddev_samp("v").alias("std_value")
    )
    w = Window.partitionBy("column_name").orderBy("period")
    shift = F.try_divide(F.col("mean_value") - F.lag("mean_value").over(w), F.lag("std_value").over(w))
    return stats.withColumn("z_shift", shift)


def stability_index(df: DataFrame, is_base: Column, column: str, width: float) -> DataFrame:
    """Population stability index of a column between base rows and the others, over fixed bins."""
    low = (F.floor(F.col(column) / width) * width).cast("double")
    bins = df.filter(F.col(column).isNotNull()).groupBy(low.alias("bin")).agg(
        F.count_if(is_base).alias("base_rows"), F.count_if(~is_base).alias("other_rows")
    )
    all_rows = bins.agg(F.sum("base_rows").alias("_base"), F.sum("other_rows").alias("_other"))
    p = F.greatest(F.col("base_rows"), F.lit(1)) / F.col("_base")
    q = F.greatest(F.col("other_rows"), F.lit(1)) / F.col("_other")
    return bins.crossJoin(F.broadcast(all_rows)).withColumn("contribution", (q - p) * F.log(q / p)).drop("_base", "_other")


def drift_quantiles(df: DataFrame, period: Column, column: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column per period, and their change against the period before in percent."""
    from tidemark.operators.aggregates import quantiles

    values = quantiles(df.select(period.alias("period"), F.col(column).alias("_v")), ["period"], "_v", qs)
    prev = F.lag("value").over(Window.partitionBy("q").orderBy("period"))
    change = F.when(prev != 0, (F.col("value") - prev) / prev * 100)
    return values.withColumns({"prev_value": prev, "change_pct": change})

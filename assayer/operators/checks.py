"""Check types: which aggregates they need and how a verdict follows from them.

A check type is described by three Column-level steps, so that many checks can share
one scan: ``aggregates`` (what to compute over the rows), ``report`` (typed columns
derived from those aggregates) and ``judge`` (status). Nothing here runs a job except
the one-row compile test of a regular expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import (
    all_of,
    column_type,
    count_rows,
    hours_between,
    number_literal,
    pct,
    text_list,
    typed_literal,
    utc_instant,
    utc_now,
    zero_if_null,
)
from assayer.functions.formats import VALUE_FORMATS, matches_format
from assayer.operators.volume import GRAINS, by_bucket
from assayer.specs import CheckSpec, SpecError, THRESHOLD_OPERATORS


@dataclass
class Verdict:
    """Columns of a result. ``fails``/``warns``/``error`` are combined into the status."""

    actual: Column
    fails: Column
    expected: Column | None = None
    percentage: Column | None = None
    warns: Column | None = None
    error: Column | None = None
    message: Column | None = None
    actual_text: Column | None = None
    expected_text: Column | None = None


@dataclass
class Context:
    """What a check may look up besides its own target."""

    spark: SparkSession
    resolve: Callable[[str], DataFrame]
    sql: Callable[..., DataFrame]


class CheckType:
    """Base of all check types."""

    name = ""
    # True when the metrics are plain aggregates over the target, so checks can share a scan.
    fused = True
    # True when only the schema is read.
    schema_only = False

    def shares_scan(self, spec: CheckSpec) -> bool:
        return self.fused

    def validate(self, spec: CheckSpec, target: DataFrame) -> None:
        """Raise SpecError when the spec cannot run on the target."""

    def aggregates(self, spec: CheckSpec, target: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def frame(self, spec: CheckSpec, target: DataFrame, ctx: Context | None) -> DataFrame:
        """One row holding the metrics."""
        return target.agg(*[c.alias(n) for n, c in self.aggregates(spec, target).items()])

    def report(self, spec: CheckSpec, m: dict[str, Column]) -> dict[str, Column]:
        return dict(m)

    def judge(self, spec: CheckSpec, r: dict[str, Column]) -> Verdict:
        raise NotImplementedError


_REGISTRY: dict[str, CheckType] = {}


def register_check(check_type: CheckType) -> CheckType:
    """Add or replace a check type."""
    _REGISTRY[check_type.name] = check_type
    return check_type


def check_type(name: str) -> CheckType:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise SpecError(f"no check type is named {name!r}") from None


def check_types() -> list[str]:
    return sorted(_REGISTRY)


# --------------------------------------------------------------------------- status


def threshold_test(spec: CheckSpec, actual: Column, percentage: Column | None) -> Column | None:
    """The pass condition a threshold operator states, or None when no operator is set."""
    th = spec.threshold
    operator = th.operator
    if not operator:
        if th.type == "range" and th.min_value is not None and th.max_value is not None:
            operator = "between"
        else:
            return None
    if operator not in THRESHOLD_OPERATORS:
        raise SpecError(f"unknown threshold operator: {operator}")
    subject = actual
    if th.type == "percentage":
        if percentage is None:
            raise SpecError(f"{spec.type} has no percentage to compare")
        subject = percentage
    value = F.lit(float(th.value))
    if operator == "eq":
        return subject == value
    if operator == "ne":
        return subject != value
    if operator == "lt":
        return subject < value
    if operator == "lte":
        return subject <= value
    if operator == "gt":
        return subject > value
    if operator == "gte":
        return subject >= value
    low = th.min_value if th.min_value is not None else 0.0
    high = th.max_value if th.max_value is not None else 0.0
    return subject.between(F.lit(float(low)), F.lit(float(high)))


def status_of(spec: CheckSpec, v: Verdict) -> tuple[Column, Column]:
    """(status, error) for a verdict."""
    fails, error = v.fails, v.error
    test = threshold_test(spec, v.actual, v.percentage)
    if test is not None:
        fails = ~test
        missing = F.when(v.actual.isNull(), F.lit("no data to compare"))
        error = missing if error is None else F.coalesce(error, missing)
    error = F.lit(None).cast("string") if error is None else error.cast("string")
    status = F.when(error.isNotNull(), F.lit("error")).when(fails, F.lit("failed"))
    if v.warns is not None:
        status = status.when(v.warns, F.lit("warning"))
    return status.otherwise(F.lit("passed")), error


def _required_column(spec: CheckSpec, target: DataFrame) -> str:
    if not spec.column:
        raise SpecError(f"{spec.type} needs a column")
    _known(target, spec.column)
    return spec.column


def _known(target: DataFrame, name: str) -> T.DataType:
    try:
        return column_type(target, name)
    except PySparkException as exc:
        raise SpecError(f"column {name!r} cannot be resolved: {exc.getCondition()}") from exc


def _share_verdict(spec: CheckSpec, share: Column, label: str) -> Verdict:
    """Fail when a percentage is below the expected one (100 unless the threshold says less)."""
    expected = spec.threshold.value if spec.threshold.value > 0 else 100.0
    return Verdict(
        actual=share,
        percentage=share,
        expected=F.lit(float(expected)),
        fails=share < F.lit(float(expected)),
        warns=None if spec.warn_threshold is None else share < F.lit(float(spec.warn_threshold)),
        message=F.format_string(f"{label} %.2f%%, expected at least %.2f%%", share, F.lit(float(expected))),
    )


# --------------------------------------------------------------------------- scan checks


class RowCount(CheckType):
    name = "row_count"

    def aggregates(self, spec, target):
        return {"row_count": count_rows()}

    def judge(self, spec, r):
        p, n = spec.parameters, r["row_count"]
        low, high = p.limit("min_rows"), p.limit("max_rows")
        below = F.lit(False) if low is None else n < low
        above = F.lit(False) if high is None else n > high
        expected = F.lit(None).cast("double")
        if high is not None:
            expected = F.when(above, F.lit(float(high))).otherwise(expected)
        if low is not None:
            expected = F.when(below, F.lit(float(low))).otherwise(expected)
        return Verdict(
            actual=n.cast("double"),
            expected=expected,
            fails=below | above,
            warns=None if spec.warn_threshold is None else n < F.lit(spec.warn_threshold),
            message=F.format_string("row count %d", n),
        )


class NullCheck(CheckType):
    name = "null_check"

    def validate(self, spec, target):
        _required_column(spec, target)

    def aggregates(self, spec, target):
        return {"total_count": count_rows(), "null_count": F.count_if(F.col(spec.column).isNull())}

    def report(self, spec, m):
        return {**m, "null_percentage": pct(m["null_count"], m["total_count"])}

    def judge(self, spec, r):
        p = spec.parameters
        max_pct, max_count = p.limit("max_null_percentage"), p.limit("max_null_count")
        over_pct = F.lit(False) if max_pct is None else r["null_percentage"] > F.lit(float(max_pct))
        over_count = F.lit(False) if max_count is None else r["null_count"] > max_count
        expected = F.lit(None).cast("double")
        if max_count is not None:
            expected = F.when(over_count, F.lit(float(max_count))).otherwise(expected)
        if max_pct is not None:
            expected = F.when(over_pct, F.lit(float(max_pct))).otherwise(expected)
        return Verdict(
            actual=r["null_percentage"],
            percentage=r["null_percentage"],
            expected=expected,
            fails=over_pct | over_count,
            warns=None if spec.warn_threshold is None else r["null_percentage"] > F.lit(float(spec.warn_threshold)),
            message=F.format_string("null percentage %.2f%%", r["null_percentage"]),
        )


class Freshness(CheckType):
    name = "freshness"

    def validate(self, spec, target):
        column = spec.parameters.timestamp_column
        if not column:
            raise SpecError("freshness needs parameters.timestamp_column")
        data_type = _known(target, column)
        if not isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise SpecError(f"column {column!r} is not a timestamp")

    def aggregates(self, spec, target):
        column = spec.parameters.timestamp_column
        return {"latest_timestamp": utc_instant(F.max(F.col(column)), _known(target, column))}

    def report(self, spec, m):
        return {**m, "age_hours": hours_between(m["latest_timestamp"], utc_now(spec.parameters.as_of))}

    def judge(self, spec, r):
        limit, age = spec.parameters.limit("max_age_hours"), r["age_hours"]
        return Verdict(
            actual=age,
            expected=None if limit is None else F.when(age > limit, F.lit(float(limit))),
            fails=F.lit(False) if limit is None else age > F.lit(float(limit)),
            warns=None if spec.warn_threshold is None else age > F.lit(float(spec.warn_threshold)),
            error=F.when(age.isNull(), F.lit("no latest timestamp")),
            message=F.format_string("data age %.2f hours", age),
        )


class ValueCheck(CheckType):
    """An aggregate of one column, compared for equality within a tolerance."""

    def __init__(self, name, function, expected):
        self.name, self.function, self.expected = name, function, expected

    def validate(self, spec, target):
        column = _required_column(spec, target)
        if not isinstance(_known(target, column), (T.NumericType, T.StringType, T.BooleanType)):
            raise SpecError(f"column {column!r} is not numeric")

    def aggregates(self, spec, target):
        col = F.col(spec.column)
        if not isinstance(_known(target, spec.column), T.NumericType):
            col = col.cast("double") if isinstance(_known(target, spec.column), T.BooleanType) else col.try_cast("double")
        elif self.function is F.sum and isinstance(_known(target, spec.column), T.IntegralType):
            col = col.cast("decimal(38,0)")  # a sum of longs can be larger than a long
        return {"actual_value": self.function(col).cast("double")}

    def judge(self, spec, r):
        p, actual = spec.parameters, r["actual_value"]
        expected = p.limit(self.expected) if self.expected else None
        if expected is None:
            return Verdict(actual=actual, fails=F.lit(False), message=F.format_string("value is %s", actual.cast("string")))
        tolerance = float(p.tolerance or (0.0 if spec.threshold.operator else spec.threshold.value))
        off = F.abs(actual - F.lit(float(expected)))
        return Verdict(
            actual=actual,
            expected=F.lit(float(expected)),
            fails=off > F.lit(tolerance),
            warns=None if spec.warn_threshold is None else off > F.lit(float(spec.warn_threshold)),
            error=F.when(actual.isNull(), F.lit("no data to compare")),
            message=F.format_string("value is %s, expected %s", actual.cast("string"), F.lit(str(expected))),
        )


@lru_cache(maxsize=1024)
def _compile_error(pattern: str) -> str | None:
    """Why a pattern does not compile, or None. Decided by the engine that will run it."""
    spark = SparkSession.active()
    try:
        spark.sql("SELECT rlike('', :p) AS ok", args={"p": pattern}).collect()
    except PySparkException as exc:
        return exc.getCondition() or "invalid"
    return None


class _MatchShare(CheckType):
    """Share of rows that satisfy a condition; a NULL never does."""

    hit, miss, share, label = "", "", "", ""

    def condition(self, spec: CheckSpec, target: DataFrame) -> Column:
        raise NotImplementedError

    def aggregates(self, spec, target):
        return {"total_count": count_rows(), self.hit: F.count_if(self.condition(spec, target))}

    def report(self, spec, m):
        return {
            **m,
            self.miss: m["total_count"] - m[self.hit],
            self.share: pct(m[self.hit], m["total_count"]),
        }

    def judge(self, spec, r):
        return _share_verdict(spec, r[self.share], self.label)


class Regex(_MatchShare):
    name = "regex"
    hit, miss, share, label = "match_count", "non_match_count", "match_percentage", "pattern match"

    def validate(self, spec, target):
        _required_column(spec, target)
        if not spec.parameters.pattern:
            raise SpecError("regex needs parameters.pattern")
        problem = _compile_error(spec.parameters.pattern)
        if problem:
            raise SpecError(f"the pattern does not compile: {problem}")

    def condition(self, spec, target):
        return F.col(spec.column).cast("string").rlike(spec.parameters.pattern)


class Format(_MatchShare):
    name = "format"
    hit, miss, share, label = "match_count", "non_match_count", "match_percentage", "format match"

    def validate(self, spec, target):
        _required_column(spec, target)
        if spec.parameters.format not in VALUE_FORMATS:
            raise SpecError(f"unknown format {spec.parameters.format!r}")

    def condition(self, spec, target):
        return matches_format(F.col(spec.column), spec.parameters.format)


class Range(_MatchShare):
    name = "range"
    hit, miss, share, label = "in_range_count", "out_of_range_count", "in_range_percentage", "in range"

    def validate(self, spec, target):
        _required_column(spec, target)

    def condition(self, spec, target):
        p = spec.parameters
        col, data_type = F.col(spec.column), _known(target, spec.column)
        if isinstance(data_type, T.StringType):
            col = col.try_cast("double")
        return col.between(number_literal(p.expected_min or 0, data_type), number_literal(p.expected_max or 0, data_type))


class SetMembership(_MatchShare):
    name = "set_membership"
    hit, miss, share, label = "valid_count", "invalid_count", "valid_percentage", "valid values"

    def validate(self, spec, target):
        column = _required_column(spec, target)
        if not spec.parameters.allowed_values:
            raise SpecError("set_membership needs parameters.allowed_values")
        data_type = _known(target, column)
        for value in spec.parameters.allowed_values:
            typed_literal(value, data_type)

    def condition(self, spec, target):
        data_type = _known(target, spec.column)
        return F.col(spec.column).isin(*[typed_literal(v, data_type) for v in spec.parameters.allowed_values])


class Volume(CheckType):
    """Rows against an expected number, of the whole table or, with a grain, of every time bucket."""

    name = "volume"

    def shares_scan(self, spec):
        return not spec.parameters.grain

    def validate(self, spec, target):
        p = spec.parameters
        if not p.grain:
            return
        if p.grain not in GRAINS:
            raise SpecError(f"unknown grain {p.grain!r}")
        if not p.timestamp_column or not p.expected_volume:
            raise SpecError("volume by grain needs parameters.timestamp_column and expected_volume")
        if not isinstance(_known(target, p.timestamp_column), (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise SpecError(f"column {p.timestamp_column!r} is not a timestamp")

    def aggregates(self, spec, target):
        return {"row_count": count_rows()}

    def frame(self, spec, target, ctx):
        p = spec.parameters
        if not p.grain:
            return super().frame(spec, target, ctx)
        buckets = by_bucket(target, p.timestamp_column, p.grain, p.expected_volume, p.volume_tolerance)
        return buckets.agg(
            zero_if_null(F.sum("row_count")).alias("row_count"),
            count_rows().alias("bucket_count"),
            F.count_if(F.col("status") == "failed").alias("failed_buckets"),
            F.count_if(F.col("row_count") == 0).alias("empty_buckets"),
            F.max("deviation_percentage").alias("deviation_percentage"),
        )

    def report(self, spec, m):
        if "bucket_count" in m:
            return dict(m)
        expected = spec.parameters.expected_volume
        if not expected:
            return {**m, "deviation_percentage": F.lit(0.0)}
        off = F.abs(m["row_count"].cast("double") - F.lit(float(expected)))
        return {**m, "deviation_percentage": off / F.lit(float(expected)) * 100.0}

    def judge(self, spec, r):
        p = spec.parameters
        n = r["row_count"].cast("double")
        if "bucket_count" in r:
            worst = r["deviation_percentage"]
            return Verdict(
                actual=r["failed_buckets"].cast("double"),
                percentage=worst,
                expected=F.lit(0.0),
                fails=(r["failed_buckets"] > 0) | (r["bucket_count"] == 0),
                warns=None if spec.warn_threshold is None else worst > F.lit(float(spec.warn_threshold)),
                message=F.format_string("%d of %d buckets off", r["failed_buckets"], r["bucket_count"]),
            )
        if not p.expected_volume:
            return Verdict(actual=n, fails=F.lit(False), message=F.format_string("volume %d", r["row_count"]))
        expected = float(p.expected_volume)
        off = F.abs(n - F.lit(expected))
        return Verdict(
            actual=n,
            percentage=r["deviation_percentage"],
            expected=F.lit(expected),
            fails=off > F.lit(expected * p.volume_tolerance / 100.0),
            warns=None if spec.warn_threshold is None else r["deviation_percentage"] > F.lit(float(spec.warn_threshold)),
            message=F.format_string("volume %d, expected %d", r["row_count"], F.lit(int(expected))),
        )


# --------------------------------------------------------------------------- keyed checks


def _compact_key(col: Column, data_type: T.DataType) -> Column:
    """Grouping column for a key. Texts of any length travel as 256-bit digests."""
    return F.unhex(F.sha2(col, 256)) if isinstance(data_type, T.StringType) else col


class Uniqueness(CheckType):
    """Distinct keys against rows. Keys are grouped once; rows are counted from the groups."""

    name = "uniqueness"
    fused = False

    @staticmethod
    def keys(spec: CheckSpec) -> list[str]:
        return list(spec.parameters.unique_columns) or ([spec.column] if spec.column else [])

    def validate(self, spec, target):
        if not self.keys(spec):
            raise SpecError("uniqueness needs a column or parameters.unique_columns")
        for name in self.keys(spec):
            _known(target, name)

    def frame(self, spec, target, ctx, by=()):
        names = self.keys(spec)
        parts = [_compact_key(F.col(name), _known(target, name)).alias(f"k{i}") for i, name in enumerate(names)]
        groups = target.groupBy(*by, *parts).agg(count_rows().alias("n"))
        complete = all_of([F.col(f"k{i}").isNotNull() for i in range(len(names))])
        return groups.groupBy(*by).agg(
            zero_if_null(F.sum("n")).alias("total_count"),
            F.count_if(complete).alias("unique_count"),
            zero_if_null(F.sum(F.when(~complete, F.col("n")))).alias("null_key_count"),
        )

    def report(self, spec, m):
        return {
            "total_count": m["total_count"],
            "unique_count": m["unique_count"],
            "null_key_count": m["null_key_count"],
            "duplicate_count": m["total_count"] - m["unique_count"],
            "uniqueness_percentage": pct(m["unique_count"], m["total_count"]),
        }

    def judge(self, spec, r):
        verdict = _share_verdict(spec, r["uniqueness_percentage"], "uniqueness")
        if not spec.parameters.allow_nulls:
            verdict.fails = verdict.fails | (r["null_key_count"] > 0)
        return verdict


class ReferentialIntegrity(CheckType):
    """Child keys that occur in a reference column.

    Both sides meet in one aggregation over their union: no join, so duplicate reference keys
    never fan out, a hot key collapses before the shuffle, and neither side has to fit in
    memory, whatever their sizes. ``joined`` counts what a left join would return; ``child``
    counts every child row once. Products are decimals, so that hot keys cannot overflow; a
    count above what a long can hold is NULL, its percentage is still right.
    """

    name = "referential_integrity"
    fused = False

    def validate(self, spec, target):
        p = spec.parameters
        _required_column(spec, target)
        if not p.reference_table or not p.reference_column:
            raise SpecError("referential_integrity needs parameters.reference_table and reference_column")
        if p.count_mode not in ("joined", "child"):
            raise SpecError(f"unknown count_mode {p.count_mode!r}")

    def frame(self, spec, target, ctx, by=()):
        p = spec.parameters
        reference = ctx.resolve(p.reference_table)
        child_type, ref_type = _known(target, spec.column), _known(reference, p.reference_column)
        if isinstance(child_type, T.StringType) != isinstance(ref_type, T.StringType):
            raise SpecError(f"cannot compare {child_type.simpleString()} with {ref_type.simpleString()}")
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        children = target.select(*by, F.col(spec.column).alias("key"))
        has_group = all(c in reference.columns for c in by)
        keys = reference.select(*(by if has_group else ()), F.col(p.reference_column).alias("key")).where(F.col("key").isNotNull())
        if has_group:
            both = children.select(*by, "key", one.alias("c"), none.alias("r")).union(keys.select(*by, "key", none.alias("c"), one.alias("r")))
            pairs = both.groupBy(*by, "key").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
        else:  # the reference holds for every group: counted keys of both sides meet once per group
            counted = children.groupBy(*by, "key").agg(count_rows().alias("c"))
            known = keys.groupBy("key").agg(count_rows().alias("r"))
            pairs = counted.join(known, "key", "left").withColumn("r", F.coalesce("r", none))
        wide = lambda name: F.col(name).cast("decimal(19,0)")
        if p.count_mode == "joined":
            total = F.sum(wide("c") * F.greatest(wide("r"), F.lit(1).cast("decimal(19,0)")))
            matched = F.sum(wide("c") * wide("r"))
        else:
            total = F.sum(wide("c"))
            matched = F.sum(F.when(F.col("r") > 0, wide("c")).otherwise(none))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
        return pairs.groupBy(*by).agg(zero(total).alias("total_count"), zero(matched).alias("matched_count"))

    def report(self, spec, m):
        total, matched = m["total_count"], m["matched_count"]
        return {
            "total_count": total.try_cast("bigint"),
            "matched_count": matched.try_cast("bigint"),
            "orphan_count": (total - matched).try_cast("bigint"),
            "integrity_percentage": pct(matched, total),
        }

    def judge(self, spec, r):
        return _share_verdict(spec, r["integrity_percentage"], "referential integrity")


class Distribution(CheckType):
    """Largest gap between the actual and the expected share of any value."""

    name = "distribution"
    fused = False

    def validate(self, spec, target):
        data_type = _known(target, _required_column(spec, target))
        for value in spec.parameters.expected_distribution or {}:
            typed_literal(value, data_type)

    def frame(self, spec, target, ctx, by=()):
        expected = spec.parameters.expected_distribution or {}
        data_type = _known(target, spec.column)
        groups = target.groupBy(*by, F.col(spec.column).alias("value")).agg(count_rows().alias("n"))
        value, n = F.col("value"), F.col("n")
        metrics = [zero_if_null(F.sum("n")).alias("total_count"), count_rows().alias("value_count")]
        if not expected:
            return groups.groupBy(*by).agg(*metrics, F.lit(0.0).alias("max_deviation"))
        literals = [typed_literal(v, data_type) for v in expected]
        other = ~F.coalesce(value.isin(*literals), F.lit(False))
        metrics.append(zero_if_null(F.max(F.when(other, n))).alias("other_max"))
        metrics += [zero_if_null(F.sum(F.when(value == lit, n))).alias(f"e{i}") for i, lit in enumerate(literals)]
        total = F.col("total_count").cast("double")
        share = lambda name: F.when(total > 0, F.col(name).cast("double") / total).otherwise(F.lit(0.0))
        gaps = [F.abs(share(f"e{i}") - F.lit(float(s))) for i, s in enumerate(expected.values())]
        return groups.groupBy(*by).agg(*metrics).select(
            *by, "total_count", "value_count", F.greatest(share("other_max"), *gaps).alias("max_deviation")
        )

    def judge(self, spec, r):
        p = spec.parameters
        tolerance = float(p.tolerance or (0.0 if spec.threshold.operator else spec.threshold.value))
        informational = not p.expected_distribution
        return Verdict(
            actual=r["max_deviation"],
            percentage=r["max_deviation"] * 100.0,
            expected=None if informational else F.lit(tolerance),
            fails=F.lit(False) if informational else r["max_deviation"] > F.lit(tolerance),
            warns=None if spec.warn_threshold is None else r["max_deviation"] > F.lit(float(spec.warn_threshold)),
            message=F.format_string("largest deviation %.4f", r["max_deviation"]),
        )


# --------------------------------------------------------------------------- schema checks

# Common database names of Spark types.
TYPE_ALIASES = {
    "bool": "boolean",
    "int1": "tinyint",
    "byte": "tinyint",
    "int2": "smallint",
    "short": "smallint",
    "int4": "int",
    "integer": "int",
    "int8": "bigint",
    "long": "bigint",
    "real": "float",
    "float4": "float",
    "float8": "double",
    "double precision": "double",
    "numeric": "decimal",
    "varchar": "string",
    "char": "string",
    "character varying": "string",
    "text": "string",
    "bytea": "binary",
    "blob": "binary",
    "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp",
    "timestamp without time zone": "timestamp_ntz",
}


def canonical_type(name: str) -> str:
    base = " ".join(name.strip().lower().split())
    head, _, rest = base.partition("(")
    head = TYPE_ALIASES.get(head.strip(), head.strip())
    return head if not rest or head == "string" else f"{head}({rest}"


def _one_row(target: DataFrame, **columns: Column) -> DataFrame:
    return target.sparkSession.range(1).select(*[c.alias(n) for n, c in columns.items()])


class SchemaMatch(CheckType):
    """Missing columns and differing types fail; extra columns do not unless asked."""

    name = "schema_match"
    fused = False
    schema_only = True

    def frame(self, spec, target, ctx):
        expected = {c.name: c.data_type for c in spec.parameters.expected_schema}
        actual = {f.name: f.dataType.simpleString() for f in target.schema}
        missing = sorted(set(expected) - set(actual)) if expected else []
        extra = sorted(set(actual) - set(expected)) if expected else []
        differing = [
            f"{n}: expected {t}, got {actual[n]}"
            for n, t in sorted(expected.items())
            if n in actual and t and t != actual[n]
        ]
        return _one_row(
            target,
            column_count=F.lit(len(target.schema)).cast("bigint"),
            missing_columns=F.lit(text_list(missing)),
            extra_columns=F.lit(text_list(extra)),
            type_mismatches=F.lit("; ".join(differing)),
        )

    def judge(self, spec, r):
        fails = (r["missing_columns"] != "") | (r["type_mismatches"] != "")
        if spec.parameters.fail_on_extra:
            fails = fails | (r["extra_columns"] != "")
        return Verdict(
            actual=r["column_count"].cast("double"),
            fails=fails,
            message=F.format_string("schema has %d columns", r["column_count"]),
        )


class ColumnCount(CheckType):
    name = "column_count"
    fused = False
    schema_only = True

    def frame(self, spec, target, ctx):
        return _one_row(target, column_count=F.lit(len(target.schema)).cast("bigint"))

    def judge(self, spec, r):
        expected = spec.parameters.limit("expected_columns")
        return Verdict(
            actual=r["column_count"].cast("double"),
            expected=None if expected is None else F.lit(float(expected)),
            fails=F.lit(False) if expected is None else r["column_count"] != expected,
            message=F.format_string("table has %d columns", r["column_count"]),
        )


class ColumnType(CheckType):
    name = "column_type"
    fused = False
    schema_only = True

    def validate(self, spec, target):
        _required_column(spec, target)
        if not spec.parameters.expected_schema or not spec.parameters.expected_schema[0].data_type:
            raise SpecError("column_type needs a type in parameters.expected_schema")

    def frame(self, spec, target, ctx):
        return _one_row(
            target,
            actual_type=F.lit(_known(target, spec.column).simpleString()),
            expected_type=F.lit(canonical_type(spec.parameters.expected_schema[0].data_type)),
        )

    def judge(self, spec, r):
        return Verdict(
            actual=F.lit(None).cast("double"),
            fails=r["actual_type"] != r["expected_type"],
            actual_text=r["actual_type"],
            expected_text=r["expected_type"],
            message=F.format_string("type %s, expected %s", r["actual_type"], r["expected_type"]),
        )


# --------------------------------------------------------------------------- custom SQL


class CustomSQL(CheckType):
    """First value of a query against an expected text, or mere existence of rows."""

    name = "custom_sql"
    fused = False

    def validate(self, spec, target):
        if not spec.parameters.custom_sql:
            raise SpecError("custom_sql needs parameters.custom_sql")

    def frame(self, spec, target, ctx):
        own = {"_view": target} if spec.view_id and target is not None else {}
        try:
            rows = ctx.sql(spec.parameters.custom_sql, own)
        except PySparkException as exc:
            raise SpecError(f"the query cannot be analysed: {exc.getCondition()}") from exc
        # Renamed by position, so repeated or odd column names do no harm.
        first = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        value = F.col("c0").cast("string")
        # Row ids ascend with the partitions, so the smallest is the first row of a sorted query.
        numbered = first.select(value.alias("value"), F.monotonically_increasing_id().alias("id"))
        return numbered.agg(F.min_by("value", "id").alias("actual_text"), count_rows().alias("row_count"))

    def report(self, spec, m):
        return {"actual_text": m["actual_text"], "row_found": m["row_count"] > 0, "row_count": m["row_count"]}

    def judge(self, spec, r):
        expected = spec.parameters.expected_value
        number = r["actual_text"].try_cast("double")
        if not expected:
            return Verdict(
                actual=number,
                fails=~r["row_found"],
                actual_text=r["actual_text"],
                message=F.when(r["row_found"], "the query found rows").otherwise("the query found nothing"),
            )
        wanted = F.lit(expected).try_cast("double")
        same = F.coalesce(r["actual_text"] == F.lit(expected), F.lit(False))
        return Verdict(
            actual=number,
            expected=wanted,
            fails=~same,
            actual_text=r["actual_text"],
            expected_text=F.lit(expected),
            message=F.concat(F.lit(f"expected '{expected}', got '"), F.coalesce(r["actual_text"], F.lit("")), F.lit("'")),
        )


for _type in (
    RowCount(),
    NullCheck(),
    Freshness(),
    ValueCheck("min_value", F.min, "expected_min"),
    ValueCheck("max_value", F.max, "expected_max"),
    ValueCheck("mean_value", F.avg, "expected_mean"),
    ValueCheck("sum_value", F.sum, None),
    ValueCheck("std_dev", F.stddev_samp, None),
    Regex(),
    Format(),
    Range(),
    SetMembership(),
    Volume(),
    Uniqueness(),
    ReferentialIntegrity(),
    Distribution(),
    SchemaMatch(),
    ColumnCount(),
    ColumnType(),
    CustomSQL(),
):
    register_check(_type)


# --------------------------------------------------------------------------- single check


def measure(spec: CheckSpec, target: DataFrame | None, ctx: Context) -> DataFrame:
    """One check as one flat, typed row: its metrics and its status."""
    kind = check_type(spec.type)
    kind.validate(spec, target)
    metrics = kind.frame(spec, target, ctx)
    report = kind.report(spec, {n: F.col(n) for n in metrics.columns})
    flat = metrics.select(*[c.alias(n) for n, c in report.items()])
    status, _ = status_of(spec, kind.judge(spec, {n: F.col(n) for n in flat.columns}))
    return flat.withColumn("status", status)

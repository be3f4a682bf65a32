"""Audits as declared constraints: each states what must hold of named tables, and all run as one report.

The tests of a table's rows are one aggregate over one scan. A key, a reference or a list of ids is a join of
values that were counted before they move, so a value that many rows hold is one row of it. The report has a row
for each constraint: what it checked, how much failed, the smallest failing id, and a status. A constraint whose table or
manifest isn't there is BLOCKED, which is not a pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

PASS, FAIL, BLOCKED = "PASS", "FAIL", "BLOCKED"


@dataclass(frozen=True)
class Holds:
    """A test of each row; null fails. `among` says which rows it is about (null: not)."""

    name: str
    table: str
    test: Column = field(compare=False)
    among: Column | None = field(default=None, compare=False)
    hard: bool = True
    kind = "holds"


@dataclass(frozen=True)
class Unique:
    """No two rows have one key. Rows with a null in it have none; of those that share one, all fail."""

    name: str
    table: str
    key: tuple[str, ...]
    hard: bool = True
    kind = "unique"


@dataclass(frozen=True)
class Refers:
    """A row's columns are those of some row of the target; rows with a null in them refer to nothing and aren't checked.

    `among` and `target_among` choose rows of either side. A row that something must point to (an orphan test) is a
    reference from it to where it must be named.
    """

    name: str
    table: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    among: Column | None = field(default=None, compare=False)
    target_among: Column | None = field(default=None, compare=False)
    hard: bool = True
    kind = "refers"


@dataclass(frozen=True)
class Parity:
    """A table's ids are those of a manifest that was made independently of it, neither more nor fewer; nulls don't count."""

    name: str
    table: str
    column: str
    manifest: str
    manifest_column: str
    hard: bool = True
    kind = "parity"


Constraint = Holds | Unique | Refers | Parity

_REPORT = "constraint string, table_name string, kind string, hard boolean, checked long, failed long, sample string, status string"


def needs(c: Constraint) -> list[str]:
    """The tables that a constraint reads."""
    other = {"refers": "target", "parity": "manifest"}.get(c.kind)
    return [c.table, getattr(c, other)] if other else [c.table]


def _whole(columns: Iterable[str]) -> Column:
    return reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns])


def _entry(c: Constraint, checked: Column, failed: Column, sample: Column) -> Column:
    failed = F.coalesce(failed, F.lit(0)).cast("long")
    return F.struct(
        F.lit(c.name).alias("constraint"), F.lit(c.table).alias("table_name"), F.lit(c.kind).alias("kind"), F.lit(c.hard).alias("hard"),
        F.coalesce(checked, F.lit(0)).cast("long").alias("checked"), failed.alias("failed"), sample.cast("string").alias("sample"), F.when(failed > 0, FAIL).otherwise(PASS).alias("status"),
    )


def _tests(rows: DataFrame, tests: list[Holds], own: str) -> DataFrame:
    """One scan for all tests of a table."""
    parts, entries = [], []
    for i, c in enumerate(tests):
        among = F.coalesce(c.among, F.lit(False)) if c.among is not None else F.lit(True)
        bad = among & ~F.coalesce(c.test, F.lit(False))
        parts += [F.count_if(among).alias(f"n{i}"), F.count_if(bad).alias(f"f{i}"), F.min(F.when(bad, F.col(f"`{own}`"))).alias(f"s{i}")]
        entries.append(_entry(c, F.col(f"n{i}"), F.col(f"f{i}"), F.col(f"s{i}")))
    return rows.agg(*parts).select(F.inline(F.array(*entries)))


def _unique(rows: DataFrame, c: Unique, own: str) -> DataFrame:
    keys = rows.where(_whole(c.key)).groupBy(*[F.col(f"`{k}`") for k in c.key]).agg(F.count("*").alias("n"), F.min(F.col(f"`{own}`")).alias("m"))
    twice = F.col("n") > 1
    return _one(c, keys.agg(F.sum("n").alias("n"), F.sum(F.when(twice, F.col("n"))).alias("f"), F.min(F.when(twice, F.col("m"))).alias("s")))


def _one(c: Constraint, sums: DataFrame) -> DataFrame:
    return sums.select(F.inline(F.array(_entry(c, F.col("n"), F.col("f"), F.col("s")))))


def _refers(rows: DataFrame, target: DataFrame, c: Refers, own: str) -> DataFrame:
    if len(c.columns) != len(c.target_columns):
        raise ValueError(f"{c.name}: as many columns as in its target")
    names = [f"k{i}" for i in range(len(c.columns))]
    rows = rows.where(c.among) if c.among is not None else rows
    target = target.where(c.target_among) if c.target_among is not None else target
    values = rows.where(_whole(c.columns)).groupBy(*[F.col(f"`{x}`").alias(k) for x, k in zip(c.columns, names, strict=True)]).agg(F.count("*").alias("n"), F.min(F.col(f"`{own}`")).alias("m"))
    known = target.where(_whole(c.target_columns)).select(*[F.col(f"`{x}`").alias(k) for x, k in zip(c.target_columns, names, strict=True)]).distinct().withColumn("here", F.lit(1))
    lost = F.col("here").isNull()
    joined = values.join(known, names, "left")
    return _one(c, joined.agg(F.sum("n").alias("n"), F.sum(F.when(lost, F.col("n"))).alias("f"), F.min(F.when(lost, F.col("m"))).alias("s")))


def _parity(rows: DataFrame, manifest: DataFrame, c: Parity) -> DataFrame:
    side = lambda df, column, name: df.where(_whole([column])).select(F.col(f"`{column}`").alias("k")).distinct().withColumn(name, F.lit(1))
    both = side(rows, c.column, "a").join(side(manifest, c.manifest_column, "b"), "k", "full_outer")
    apart = F.col("a").isNull() | F.col("b").isNull()
    return _one(c, both.agg(F.count("*").alias("n"), F.count_if(apart).alias("f"), F.min(F.when(apart, F.col("k"))).alias("s")))


def audit(tables: Mapping[str, DataFrame | None], constraints: list[Constraint], ids: Mapping[str, str]) -> DataFrame:
    """constraint, table_name, kind, hard, checked, failed, sample, status: a row for each constraint.

    ids names the column of each table by which a failing row is told: the smallest one is the sample. A table that is missing
    or None blocks what needs it. An empty table passes with nothing checked: state a Parity if that is a fault.
    Names of constraints must differ.
    """
    names = [c.name for c in constraints]
    if len(set(names)) < len(names):
        raise ValueError("names of constraints must differ")
    here = {k: v for k, v in tables.items() if v is not None}
    blocked = [c for c in constraints if any(t not in here for t in needs(c))]
    able = [c for c in constraints if c not in blocked]
    parts = []
    for t in dict.fromkeys(c.table for c in able):
        own = [c for c in able if c.table == t]
        if tests := [c for c in own if isinstance(c, Holds)]:
            parts.append(_tests(here[t], tests, ids[t]))
        for c in own:
            if isinstance(c, Unique):
                parts.append(_unique(here[t], c, ids[t]))
            elif isinstance(c, Refers):
                parts.append(_refers(here[t], here[c.target], c, ids[t]))
            elif isinstance(c, Parity):
                parts.append(_parity(here[t], here[c.manifest], c))
    if blocked:
        spark = next(iter(here.values())).sparkSession if here else None
        if spark is None:
            raise ValueError("no table is there")
        parts.append(spark.createDataFrame([(c.name, c.table, c.kind, c.hard, 0, 0, None, BLOCKED) for c in blocked], _REPORT))
    return reduce(DataFrame.unionByName, parts)


def gate(report: DataFrame) -> DataFrame:
    """One row: constraints, passed, failed, blocked, verdict.

    Hard constraints decide: any of them blocked makes BLOCKED, else any failed FAILED, else PASSED. A report without rows is BLOCKED.
    """
    of = lambda s: F.count_if(F.col("status") == s)
    hard = lambda s: F.count_if(F.col("hard") & (F.col("status") == s)) > 0
    verdict = F.when(hard(BLOCKED) | (F.count("*") == 0), BLOCKED).when(hard(FAIL), "FAILED").otherwise("PASSED")
    return report.agg(F.count("*").alias("constraints"), of(PASS).alias("passed"), of(FAIL).alias("failed"), of(BLOCKED).alias("blocked"), verdict.alias("verdict"))

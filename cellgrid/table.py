"""Cell tables: a DataFrame, its panel of channels, and selectors of columns."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

Selector = str | Iterable[str] | Callable[[T.StructField], bool] | None


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def starts_with(*prefixes: str) -> Callable[[T.StructField], bool]:
    return lambda f: f.name.lower().startswith(tuple(p.lower() for p in prefixes))


def ends_with(*suffixes: str) -> Callable[[T.StructField], bool]:
    return lambda f: f.name.lower().endswith(tuple(s.lower() for s in suffixes))


def contains(*parts: str) -> Callable[[T.StructField], bool]:
    return lambda f: any(p.lower() in f.name.lower() for p in parts)


def matches(pattern: str) -> Callable[[T.StructField], bool]:
    return lambda f: re.search(pattern, f.name, re.I) is not None


def num_range(prefix: str, numbers: Iterable[int]) -> Callable[[T.StructField], bool]:
    names = {f"{prefix}{n}" for n in numbers}
    return lambda f: f.name in names


def everything() -> Callable[[T.StructField], bool]:
    return lambda f: True


def where(test: Callable[[T.StructField], bool]) -> Callable[[T.StructField], bool]:
    return test


class any_of(list):
    """Names of which those that exist are meant."""


class all_of(list):
    """Names that must all exist."""


def last_col(df: DataFrame) -> str:
    return df.columns[-1]


def columns(df: DataFrame, spec: Selector, default: Selector = None) -> list[str]:
    """Names that a selector means, in the table's order for predicates and as given for names."""
    spec = default if spec is None else spec
    if spec is None:
        return []
    if callable(spec):
        return [f.name for f in df.schema if spec(f)]
    names = [spec] if isinstance(spec, str) else list(spec)
    if isinstance(spec, any_of):
        return [n for n in names if n in df.columns]
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {absent}")
    return names


def q(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def deframe(df: DataFrame, name: str, value: str, most: int = 1_000_000) -> dict[Any, Any]:
    """Two columns of a small table as a dict; of equal names the last in the order of values counts."""
    got = df.select(q(name).alias("n"), q(value).alias("v")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return {r.n: r.v for r in sorted(got, key=lambda r: (r.v is not None, str(r.v)))}


def pull_unless_null(df: DataFrame, name: str | None) -> DataFrame | None:
    """The one column, or None where no name is given."""
    return None if name is None else df.select(q(name))


def with_cell_id(df: DataFrame, keys: list[str], name: str = "cell_id") -> DataFrame:
    """df with consecutive numbers from 1 in the order of keys.

    Rows are dealt by ranges of the keys and numbered in each range, so no task sees all rows; only the
    number of rows of each range meets in one place. Ties in all keys are broken arbitrarily but once.
    """
    ordered = df.repartitionByRange(*[q(k) for k in keys]).sortWithinPartitions(*[q(k) for k in keys])
    dealt = materialize(ordered.withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*[q(k) for k in keys]))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + rank).cast("long")).drop("__part", "__before")


@dataclass(frozen=True)
class CellTable:
    """A table of cells with its panel (metals and antigens of the channels), which every verb keeps."""

    df: DataFrame
    panel: DataFrame | None = None
    #: Columns that verbs group by where none are given.
    groups: tuple[str, ...] = ()

    def with_panel(self, panel: DataFrame | None) -> CellTable:
        if panel is not None and set(panel.columns) != {"metals", "antigens"}:
            raise ValueError("a panel has the columns metals and antigens")
        return replace(self, panel=panel)

    def group_by(self, *names: str, add: bool = False) -> CellTable:
        """The same rows with groups, which verbs that take groups (`by`) then work in; add: to those there are."""
        kept = self.groups if add else ()
        return replace(self, groups=tuple(dict.fromkeys([*kept, *columns(self.df, list(names))])))

    def ungroup(self) -> CellTable:
        return replace(self, groups=())

    def pipe(self, verb: Callable[..., DataFrame], *args: Any, **options: Any) -> CellTable:
        """The verb's result, with this table's panel; a verb that takes `by` gets the groups unless others are given."""
        if self.groups and "by" not in options:
            places = list(inspect.signature(verb).parameters)
            if "by" in places and places.index("by") > len(args):
                options["by"] = list(self.groups)
        return replace(self, df=verb(self.df, *args, **options))

    def mutate(self, **new: Column) -> CellTable:
        return replace(self, df=self.df.withColumns(new))

    def filter(self, condition: Column | str) -> CellTable:
        return replace(self, df=self.df.filter(condition))

    def select(self, *names: str | Column) -> CellTable:
        return replace(self, df=self.df.select(*names))

    def nest(self, by: list[str] | None = None, name: str = "data") -> CellTable:
        by = list(self.groups) if by is None else by
        rest = [q(c) for c in self.df.columns if c not in by]
        return replace(self, df=self.df.groupBy(*[q(c) for c in by]).agg(F.collect_list(F.struct(*rest)).alias(name)))

    def unnest(self, name: str = "data") -> CellTable:
        rest = [q(c) for c in self.df.columns if c != name]
        return replace(self, df=self.df.select(*rest, F.explode(q(name)).alias("__x")).select(*rest, "__x.*"))

    def pivot_longer(self, cols: Selector, names_to: str = "name", values_to: str = "value") -> CellTable:
        cols = columns(self.df, cols)
        ids = [q(c) for c in self.df.columns if c not in cols]
        return replace(self, df=self.df.unpivot(ids, [q(c) for c in cols], names_to, values_to))

    def pivot_wider(self, names_from: str, values_from: str, values: list[str]) -> CellTable:
        """values: the new columns, named beforehand, so that no pass is needed to find them."""
        ids = [q(c) for c in self.df.columns if c not in (names_from, values_from)]
        return replace(self, df=self.df.groupBy(*ids).pivot(names_from, values).agg(F.first(q(values_from))))

    def sample(self, n: int | None = None, prop: float | None = None, by: list[str] | None = None, weight_by: str | None = None, replace: bool = False, seed: int = 0) -> CellTable:
        from .operators.sample import slice_sample

        return self.pipe(slice_sample, n, prop, list(self.groups) if by is None else by, weight_by, replace, seed)

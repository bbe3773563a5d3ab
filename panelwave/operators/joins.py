"""Joins of the panel build and membership filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F



def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing at run time if a key occurs twice.

    The check groups on the join keys, so its exchange also serves the join.
    """
    others = [c for c in df.columns if c not in set(keys)]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in others]
    )
    message = F.lit(f"duplicate key on ({', '.join(keys)})")
    unique = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.filter(unique).select(*df.columns)


@dataclass(frozen=True)
class JoinSpec:
    """A table to attach.  ``on`` is a list of shared names or a left-to-right mapping."""

    df: DataFrame
    on: Sequence[str] | Mapping[str, str]
    how: str = "left"
    check_unique: bool = True
    pairs: tuple[tuple[str, str], ...] = field(init=False)

    def __post_init__(self) -> None:
        on = self.on.items() if isinstance(self.on, Mapping) else [(k, k) for k in self.on]
        object.__setattr__(self, "pairs", tuple(on))


def attach(left: DataFrame, spec: JoinSpec) -> DataFrame:
    """Join one table on its keys; the right keys do not appear in the result."""
    right_keys = [r for _, r in spec.pairs]
    right = unique_by(spec.df, right_keys) if spec.check_unique else spec.df
    hidden = {r: f"__r{i}" for i, r in enumerate(right_keys)}
    right = right.withColumnsRenamed(hidden)
    on = [F.col(l) == F.col(hidden[r]) for l, r in spec.pairs]
    return left.join(right, on, spec.how).drop(*hidden.values())


def build_panel(spine: DataFrame, specs: Sequence[JoinSpec]) -> DataFrame:
    """Left-join all tables to the spine.

    Tables on the same left keys are joined one after the other, so the spine is
    shuffled once per key set and not once per table.  Columns keep the order of
    ``specs``.
    """
    order = {keys: i for i, keys in enumerate(dict.fromkeys(tuple(l for l, _ in s.pairs) for s in specs))}
    panel = spine
    for spec in sorted(specs, key=lambda s: order[tuple(l for l, _ in s.pairs)]):
        panel = attach(panel, spec)
    added = [c for s in specs for c in s.df.columns if c not in {r for _, r in s.pairs}]
    return panel.select(*spine.columns, *added)


def match_by_name(df: DataFrame, ref: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach the reference codes by (normalised) name; rows without a match go."""
    return attach(df, JoinSpec(ref, on, "inner"))


def drop_incomplete(df: DataFrame, unit: str, n: int) -> DataFrame:
    """Leave out units with fewer than ``n`` rows."""
    short = df.groupBy(unit).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < n)
    return df.join(short.select(unit), unit, "left_anti")


def drop_always_treated(
    df: DataFrame, adoption: DataFrame, first: int, unit: str = "unit_id", start: str = "start_year"
) -> DataFrame:
    """Leave out units treated before the first period."""
    early = adoption.filter(F.col(start) < first).select(unit).distinct()
    return df.join(early, unit, "left_anti")


def treated_regions(df: DataFrame, region: str, treated: str = "treated") -> DataFrame:
    """Regions with at least one treated unit-year."""
    return df.filter(F.col(treated) == 1).select(region).distinct()


def keep_treated_regions(
    df: DataFrame, region: str, treated: str = "treated", source: DataFrame | None = None
) -> DataFrame:
    """Keep regions with a treated unit-year in ``source`` (default: the table itself).

    The region list is far smaller than the panel, so adaptive execution normally
    broadcasts it, and a region that holds much of the panel causes no skew.
    """
    regions = treated_regions(source if source is not None else df, region, treated)
    return df.join(regions, region, "left_semi")


def audit_excluded(
    df: DataFrame, excluded: DataFrame, unit: str = "unit_id", treated: str = "treated"
) -> DataFrame:
    """The treated units among those that a rule excludes."""
    ever = df.filter(F.col(treated) == 1).select(unit).distinct()
    return ever.join(excluded.select(unit).distinct(), unit, "left_semi")


def drop_flagged(df: DataFrame, flags: DataFrame, unit: str = "unit_id", flag: str = "outlier") -> DataFrame:
    """Remove a unit altogether when any of its rows is flagged."""
    bad = flags.filter(F.col(flag) == 1).select(unit).distinct()
    return df.join(bad, unit, "left_anti")

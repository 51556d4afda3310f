"""Recoding up hierarchies until every group has at least k rows.

An export without ids still names people by combinations of ordinary columns:
a birth year, a gender and a date may fit one person alone. Each such column
gets a hierarchy of coarser values (a year, five years, ten, ..., nothing).
``find_recoding`` looks for the lowest common levels at which no more than a
given share of the rows lies in groups smaller than k; ``recode`` rewrites the
columns and leaves out the rows of the groups that are still too small.

The rows are counted once, by their finest combination. All levels are judged
on these counts, one job per height of the lattice, so the work after the
first pass grows with the combinations and not with the rows. The driver sees
one row per combination of levels.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, salted_join

ANY = "'*'"


@dataclass(frozen=True)
class Hierarchy:
    """A column and its levels, as SQL texts in which ``{c}`` is the column;
    level 0 is the finest. NULL is a value of its own below the top."""

    column: str
    levels: tuple[str, ...]

    def at(self, level: int, column: str | None = None) -> Column:
        return F.expr(self.levels[level].format(c=f"`{column or self.column}`")).cast("string")


def keep_or_hide(column: str) -> Hierarchy:
    return Hierarchy(column, ("CAST({c} AS VARCHAR(200))", ANY))


def year_bands(column: str, widths: Sequence[int] = (5, 10, 20)) -> Hierarchy:
    """A year, then bands of ``widths`` years."""
    bands = tuple(f"CAST({{c}} - {{c}} % {w} AS VARCHAR(11)) || '-' || CAST({{c}} - {{c}} % {w} + {w - 1} AS VARCHAR(11))"
                  for w in widths)
    return Hierarchy(column, ("CAST({c} AS VARCHAR(11))", *bands, ANY))


def calendar(column: str) -> Hierarchy:
    """A date, then its month, quarter and year."""
    return Hierarchy(column, (
        "CAST({c} AS VARCHAR(10))", "substring(CAST({c} AS VARCHAR(10)), 1, 7)",
        "CAST(year({c}) AS VARCHAR(5)) || '-Q' || CAST(quarter({c}) AS VARCHAR(1))",
        "CAST(year({c}) AS VARCHAR(5))", ANY))


@dataclass(frozen=True)
class Recoding:
    """The chosen levels and what they leave."""

    hierarchies: tuple[Hierarchy, ...]
    levels: tuple[int, ...]
    k: int
    rows: int
    suppressed: int
    smallest: int | None                # rows of the smallest group that stays

    @property
    def share(self) -> float:
        return self.suppressed / self.rows if self.rows else 0.0


def _nodes(hierarchies: Sequence[Hierarchy]) -> dict[int, list[tuple[int, ...]]]:
    """Combinations of levels by their height (the sum of the levels)."""
    found: dict[int, list[tuple[int, ...]]] = {}
    for node in itertools.product(*(range(len(h.levels)) for h in hierarchies)):
        found.setdefault(sum(node), []).append(node)
    return dict(sorted(found.items()))


def finest_counts(df: DataFrame, hierarchies: Sequence[Hierarchy]) -> DataFrame:
    """Rows per combination of the original values, stored once."""
    columns = [F.col(f"`{h.column}`").alias(f"q{i}") for i, h in enumerate(hierarchies)]
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def _judged(counts: DataFrame, hierarchies: Sequence[Hierarchy], nodes: list[tuple[int, ...]], k: int) -> list:
    """(node, rows, suppressed, smallest) per combination of levels."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("node"), *(
        h.at(level, f"q{j}").alias(f"v{j}") for j, (h, level) in enumerate(zip(hierarchies, node))))
        for i, node in enumerate(nodes))))
    values = [f"v{j}" for j in range(len(hierarchies))]
    groups = (counts.select(each.alias("x"), "n").select("x.*", "n")
              .groupBy("node", *values).agg(F.sum("n").alias("n")))
    small = F.col("n") < k
    found = groups.groupBy("node").agg(
        F.sum("n").alias("rows"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("suppressed"),
        F.min(F.when(~small, F.col("n"))).alias("smallest")).collect()
    return [(nodes[r.node], r.rows, r.suppressed, r.smallest) for r in found]


def find_recoding(df: DataFrame, hierarchies: Sequence[Hierarchy], k: int,
                  max_share: float = 0.05, counts: DataFrame | None = None) -> Recoding:
    """The lowest levels (least height, then fewest rows left out, then in
    order) with at most ``max_share`` of the rows in groups smaller than k.
    If even the top has fewer than k rows, all rows are left out there."""
    if k < 1 or not 0 <= max_share < 1:
        raise ValueError("k must be positive and max_share at least 0 and below 1")
    missing = [h.column for h in hierarchies if h.column not in df.columns]
    if missing or not hierarchies:
        raise ValueError(f"columns not in the data: {missing}" if missing else "no hierarchy is given")
    hierarchies = tuple(hierarchies)
    counts = finest_counts(df, hierarchies) if counts is None else counts
    best = (tuple(len(h.levels) - 1 for h in hierarchies), 0, 0, None)
    for nodes in _nodes(hierarchies).values():
        found = _judged(counts, hierarchies, nodes, k)
        if not found:
            break                                        # no rows
        best = min(found, key=lambda x: (x[2], x[0]))
        if best[2] <= max_share * best[1]:
            break
    levels, rows, suppressed, smallest = best
    return Recoding(hierarchies, levels, k, rows, suppressed, smallest)


def _group(recoding: Recoding, names: Sequence[str]) -> Column:
    """One text per group; values are framed, NULL is apart from any text."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                      for v in (h.at(level, c) for h, level, c in zip(recoding.hierarchies, recoding.levels, names))))


def recode(df: DataFrame, recoding: Recoding, counts: DataFrame | None = None,
           skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """``df`` with the columns at the chosen levels (as texts), without the
    rows of groups smaller than k. The rows meet the list of groups that stay;
    a group with a large share of the rows is spread over salts."""
    own = "__group"
    while own in df.columns:
        own += "_"
    rows = df
    if recoding.suppressed:
        counts = finest_counts(df, recoding.hierarchies) if counts is None else counts
        inner = [f"q{i}" for i in range(len(recoding.hierarchies))]
        stay = (counts.groupBy(_group(recoding, inner).alias(own)).agg(F.sum("n").alias("n"))
                .where(F.col("n") >= recoding.k).select(own))
        tagged = df.withColumn(own, _group(recoding, [h.column for h in recoding.hierarchies]))
        rows = salted_join(tagged, stay, own, "left_semi", skew)
    chosen = {h.column: h.at(level).alias(h.column) for h, level in zip(recoding.hierarchies, recoding.levels)}
    return rows.select(*(chosen.get(c, F.col(f"`{c}`")) for c in df.columns))


def anonymous(df: DataFrame, hierarchies: Sequence[Hierarchy], k: int, max_share: float = 0.05,
              skew: SkewPolicy | None = DEFAULT_SKEW) -> tuple[DataFrame, Recoding]:
    """The recoded rows and the report of the recoding; counts serve both."""
    counts = finest_counts(df, tuple(hierarchies))
    recoding = find_recoding(df, hierarchies, k, max_share, counts)
    return recode(df, recoding, counts, skew), recoding

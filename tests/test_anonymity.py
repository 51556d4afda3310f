"""Recoding against a plain search over all levels."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from custodia.operators import SkewPolicy
from custodia.operators.anonymity import anonymous, calendar, find_recoding, keep_or_hide, recode, year_bands

QUASI = (keep_or_hide("gender"), year_bands("birthDate", (5, 10)), calendar("date"))


def plain_levels(row):
    g, y, d = row
    band = lambda w: None if y is None else f"{y - y % w}-{y - y % w + w - 1}"
    return ((g, "*"), (None if y is None else str(y), band(5), band(10), "*"),
            (None, None, None, None, "*") if d is None else
            (d.isoformat(), d.isoformat()[:7], f"{d.year}-Q{(d.month + 2) // 3}", str(d.year), "*"))


def plain(rows, k, share):
    """(levels, rows that stay with their place, suppressed)."""
    tables = [plain_levels(r) for r in rows]
    best = None
    for node in itertools.product(range(2), range(4), range(5)):
        groups = collections.Counter(tuple(t[j][n] for j, n in enumerate(node)) for t in tables)
        lost = sum(n for n in groups.values() if n < k)
        if lost <= share * len(rows) and (best is None or (sum(node), lost, node) < best[0]):
            stay = [(i, *g) for i, t in enumerate(tables) for g in [tuple(t[j][n] for j, n in enumerate(node))]
                    if groups[g] >= k]
            best = ((sum(node), lost, node), stay)
    return best


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(500)) for _ in range(40)]
    return [(rng.choice(["female", "male", None, "male", "-"]), rng.choice([None, *range(1950, 1990)]), rng.choice([None, *days]))
            for _ in range(600)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "i long, gender string, birthDate int, date date").withColumn("n", F.lit("clash"))


@pytest.mark.parametrize("k, share", [(1, 0.0), (3, 0.05), (5, 0.3), (20, 0.0), (200, 0.1)])
def test_recoding_equals_the_plain_search(spark, rows, k, share):
    df = frame(spark, rows)
    got, made = anonymous(df, QUASI, k, share, skew=SkewPolicy(rows_per_task=60))
    (height, lost, node), stay = plain(rows, k, share)
    assert (made.levels, made.suppressed, made.rows) == (node, lost, len(rows)) and sum(made.levels) == height
    assert got.columns == df.columns
    assert sorted(map(repr, ((r.i, r.gender, r.birthDate, r.date) for r in got.collect()))) == sorted(map(repr, stay))
    groups = collections.Counter(s[1:] for s in stay)
    assert min(groups.values()) == made.smallest >= k and made.share <= share


def test_edges(spark, rows):
    df = frame(spark, rows)
    few, made = anonymous(df.where("i < 3"), QUASI, 5, 0.5)
    assert few.isEmpty() and (made.rows, made.suppressed, made.smallest) == (3, 3, None)
    none, made = anonymous(df.where("i < 0"), QUASI, 5)
    assert none.isEmpty() and made.rows == 0 and made.share == 0
    repeated, made = anonymous(df.where("i = 1").unionByName(df.where("i = 1")), QUASI, 2, 0.0)
    assert repeated.count() == 2 and made.levels == (0, 0, 0)
    made = find_recoding(df, QUASI, 4)
    assert recode(df, made).count() == made.rows - made.suppressed
    for bad in ({"k": 0}, {"k": 2, "max_share": 1.0}):
        with pytest.raises(ValueError):
            find_recoding(df, QUASI, **bad)
    for hierarchies in ((), (keep_or_hide("nothing"),)):
        with pytest.raises(ValueError):
            find_recoding(df, hierarchies, 2)

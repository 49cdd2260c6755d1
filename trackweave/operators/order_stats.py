"""Exact quantiles without holding a column's values in one task.

``percentile`` and ``median`` keep every distinct value of a group in one hash map. That is fine for a
small column and fatal for a global statistic over a huge one. Here a bounded sketch brackets each
wanted rank, one counting scan says what lies below the bracket, and only values strictly inside it
are looked at again. A hot value ends the search at once, because it fills a bracket edge.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns with at most this many values go to the built-in exact percentile in one task. Its hash map
# of values is slower than narrowing well before it becomes too large.
SMALL_COLUMN = 100_000
# Sketch size. All partial sketches merge in one task, so they stay small; another pass costs less.
ACCURACY = 1000


@dataclass(frozen=True)
class ColumnSummary:
    """One scan's worth of facts about a numeric column."""

    rows: int
    filled: int
    mean: float | None
    deviation: float | None  # sum of squared deviations from the mean
    low: float | None
    high: float | None
    median: float | None = None

    @property
    def missing(self) -> int:
        return self.rows - self.filled


def summarize(df: DataFrame, columns: Mapping[str, Column], known_rows: int | None = None) -> dict[str, ColumnSummary]:
    """Counts, mean, squared deviation and range of all columns in a single scan.

    With an upper bound of the row count that is small enough, the exact median comes along.
    """
    with_median = known_rows is not None and known_rows <= SMALL_COLUMN
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for name, column in columns.items():
        aggregates += [
            F.count(column).alias(f"{name}|filled"),
            F.avg(column).alias(f"{name}|mean"),
            F.var_pop(column).alias(f"{name}|var"),
            F.min(column).alias(f"{name}|low"),
            F.max(column).alias(f"{name}|high"),
        ]
        if with_median:
            aggregates.append(F.median(column).alias(f"{name}|median"))
    row = df.agg(*aggregates).first().asDict()
    summaries = {}
    for name in columns:
        filled, spread = row[f"{name}|filled"], row[f"{name}|var"]
        summaries[name] = ColumnSummary(
            rows=row["rows"],
            filled=filled,
            mean=row[f"{name}|mean"],
            deviation=None if spread is None else spread * filled,
            low=row[f"{name}|low"],
            high=row[f"{name}|high"],
            median=row.get(f"{name}|median"),
        )
    return summaries


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    small: int = SMALL_COLUMN,
    accuracy: int = ACCURACY,
) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation; None for a column without values.

    ``counts`` (non-null values per column) saves a scan when the caller already knows them. The
    columns must be doubles without NaN.
    """
    if counts is None:
        row = df.agg(*[F.count(column).alias(name) for name, column in columns.items()]).first()
        counts = row.asDict()
    result: dict[str, list[float] | None] = {name: None for name in columns}
    easy = [name for name in columns if 0 < counts[name] <= small]
    if easy:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(columns[name], wanted).alias(name) for name in easy]).first()
        result.update({name: list(row[name]) for name in easy})

    targets: dict[str, set[int]] = {}
    for name in columns:
        if counts[name] > small:
            positions = [p * (counts[name] - 1) for p in probabilities]
            targets[name] = {math.floor(x) for x in positions} | {math.ceil(x) for x in positions}
    if targets:
        found = _select_ranks(df, columns, targets, dict(counts), small, accuracy)
        for name in targets:
            values = []
            for p in probabilities:
                place = p * (counts[name] - 1)
                lower, upper = found[name, math.floor(place)], found[name, math.ceil(place)]
                values.append(lower + (upper - lower) * (place - math.floor(place)))
            result[name] = values
    return result


def medians(df: DataFrame, columns: Mapping[str, Column], counts: Mapping[str, int] | None = None) -> dict[str, float | None]:
    found = quantiles(df, columns, [0.5], counts)
    return {name: None if values is None else values[0] for name, values in found.items()}


def value_at_rank(df: DataFrame, column: str, rank: int, small: int = SMALL_COLUMN, accuracy: int = ACCURACY):
    """Value at a zero-based rank of an ascending column, None past its end."""
    number = F.col(column).cast("double")
    rows = df.agg(F.count(number)).first()[0]
    if not 0 <= rank < rows:
        return None
    return _select_ranks(df, {column: number}, {column: {rank}}, {column: rows}, small, accuracy)[column, rank]


@dataclass
class _Search:
    """Values strictly between ``low`` and ``high`` (None: unbounded); ``below`` lie at or under low."""

    name: str
    rank: int
    low: float | None
    high: float | None
    below: int
    inside: int


def _select_ranks(df, columns, targets, counts, small, accuracy) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    open_searches = [
        _Search(name, rank, None, None, 0, counts[name]) for name, ranks in targets.items() for rank in ranks
    ]
    while open_searches:
        finishing = [s for s in open_searches if s.inside <= small]
        narrowing = [s for s in open_searches if s.inside > small]
        if finishing:
            # At most ``small`` values per interval are sorted in one place.
            lists = {(s.name, s.low, s.high): F.sort_array(F.collect_list(_inside(columns[s.name], s))) for s in finishing}
            place = {interval: str(i) for i, interval in enumerate(lists)}
            sorted_once = df.agg(*[values.alias(place[interval]) for interval, values in lists.items()])
            row = sorted_once.select(
                *[
                    F.get(F.col(place[s.name, s.low, s.high]), F.lit(s.rank - s.below)).alias(f"r{i}")
                    for i, s in enumerate(finishing)
                ]
            ).first()
            found.update({(s.name, s.rank): row[i] for i, s in enumerate(finishing)})
        open_searches = _narrow(df, columns, narrowing, found, accuracy) if narrowing else []
    return found


def _inside(column: Column, search: _Search) -> Column:
    condition = column.isNotNull()
    if search.low is not None:
        condition = condition & (column > search.low)
    if search.high is not None:
        condition = condition & (column < search.high)
    return F.when(condition, column)


def _narrow(df, columns, searches, found, accuracy) -> list[_Search]:
    edges = _edges(df, columns, searches, accuracy)
    tallies = {}
    for s, (low, high) in zip(searches, edges):
        column = _inside(columns[s.name], s)
        tallies[s.name, s.low, s.high, low, high] = F.struct(
            F.count_if(column < low), F.count_if(column == low), F.count_if((column > low) & (column < high)), F.count_if(column == high)
        )
    counted = dict(zip(tallies, df.agg(*[t.alias(str(i)) for i, t in enumerate(tallies.values())]).first()))
    still_open = []
    for s, (low, high) in zip(searches, edges):
        n_under, n_low, n_between, n_high = counted[s.name, s.low, s.high, low, high]
        under = s.below + n_under
        upto_low = under + n_low
        upto_between = upto_low + n_between
        upto_high = upto_between + (n_high if high > low else 0)
        if s.rank < under:
            still_open.append(_Search(s.name, s.rank, s.low, low, s.below, n_under))
        elif s.rank < upto_low:
            found[s.name, s.rank] = low
        elif s.rank < upto_between:
            still_open.append(_Search(s.name, s.rank, low, high, upto_low, n_between))
        elif s.rank < upto_high:
            found[s.name, s.rank] = high
        else:
            rest = s.inside - (upto_high - s.below)
            still_open.append(_Search(s.name, s.rank, high, s.high, upto_high, rest))
    return still_open


def _edges(df, columns, searches, accuracy) -> list[tuple[float, float]]:
    """Bracket around every wanted rank; searches in the same interval share one sketch.

    The sketch's rank error is at most 1/accuracy of what it has seen; two such steps to either side
    of the wanted rank always enclose it.
    """
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(searches):
        shared.setdefault((s.name, s.low, s.high), []).append(i)
    sketches = []
    for members in shared.values():
        ends, step = [], 2.0 / accuracy
        for s in (searches[i] for i in members):
            place = (s.rank - s.below) / s.inside
            ends += [F.lit(max(0.0, place - step)), F.lit(min(1.0, place + step))]
        first = searches[members[0]]
        sketches.append(F.percentile_approx(_inside(columns[first.name], first), F.array(*ends), accuracy))
    row = df.agg(*[sketch.alias(str(n)) for n, sketch in enumerate(sketches)]).first()
    edges: list = [None] * len(searches)
    for values, members in zip(row, shared.values()):
        for n, i in enumerate(members):
            edges[i] = (values[2 * n], values[2 * n + 1])
    return edges

"""Next-fit bins over a sequence that no task sees whole.

A bin takes rows in order until the next one would exceed the budget. What a stretch of rows
does depends on one number, the cost held by the open bin where it begins, and as a function
of it has few pieces: the stretch's first break moves back row by row as more is held, and
behind the break all goes its own way. Stretches tell their function, functions are composed
FAN at a time up a tree, what is held is handed down again, and stretches are then numbered
side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32
#: Upper bound of the last piece.
TOP = (1 << 63) - 1
MAPS = "pieces array<array<long>>, zero array<long>"


def next_fit(costs: Iterable, budget: int, held: int = 0, number: int = 0) -> Iterator[int]:
    """Bins of a sequence of costs: a new one where a non-empty bin would exceed budget."""
    for cost in costs:
        if held and held + cost > budget:
            number, held = number + 1, 0
        held += cost
        yield number


class Fold:
    """What a stretch does to the cost held where it begins: (bins begun, cost held at its end).

    pieces: (upto, bins, value, grows), by upto; for a held cost of at most upto the end holds
    value, and the held cost as well where it grows. zero: (bins, value) where nothing is held.
    """

    def __init__(self, pieces: list[tuple[int, int, int, int]], zero: tuple[int, int]):
        self.pieces, self.zero = pieces, zero
        self.bounds = [p[0] for p in pieces]

    def at(self, held: int) -> tuple[int, int]:
        if held == 0:
            return self.zero
        _, bins, value, grows = self.pieces[bisect_left(self.bounds, held)]
        return bins, value + held * grows

    @staticmethod
    def of(costs: np.ndarray, budget: int) -> Fold:
        sums = np.append(0, np.cumsum(costs))
        n = len(costs)
        filled = np.append(np.flatnonzero(costs > 0), n)
        ends: dict[int, tuple[int, int]] = {n: (0, 0)}

        def onward(first: int) -> tuple[int, int]:
            """(breaks behind it, cost held at the end) of a bin that row `first` begins."""
            path = []
            while first not in ends:
                path.append(first)
                some = int(filled[np.searchsorted(filled, first)])
                stop = int(np.searchsorted(sums, sums[first] + budget, "right")) - 1
                stop = min(n, max(stop, some + 1))
                if stop >= n:
                    ends[first] = (0, int(sums[n] - sums[first]))
                    break
                first = stop
            for row, then in zip(reversed(path), reversed([*path[1:], first])):
                if row not in ends:
                    ends[row] = (ends[then][0] + 1, ends[then][1])
            return ends[path[0] if path else first]

        pieces = [(int(budget - sums[n]), 0, int(sums[n]), 1)] if sums[n] < budget else []
        upto = pieces[-1][0] if pieces else 0
        for row in range(n - 1, -1, -1):  # more held: an earlier first break
            bound = TOP if row == 0 else int(budget - sums[row])
            if bound <= upto:
                continue
            breaks, held = onward(row)
            if pieces and pieces[-1][1:] == (breaks + 1, held, 0):
                pieces[-1] = (bound, *pieces[-1][1:])
            else:
                pieces.append((bound, breaks + 1, held, 0))
            upto = bound
        if not n:
            pieces = [(TOP, 0, 0, 1)]
        return Fold(pieces or [(TOP, 0, 0, 1)], onward(0) if n else (0, 0))

    def then(self, other: Fold) -> Fold:
        """This stretch, and the other behind it."""
        pieces, low = [], 0

        def add(upto: int, bins: int, value: int, grows: int) -> None:
            if pieces and pieces[-1][1:] == (bins, value, grows):
                pieces[-1] = (upto, bins, value, grows)
            else:
                pieces.append((upto, bins, value, grows))

        for upto, bins, value, grows in self.pieces:
            if not grows:
                more, held = other.at(value)
                add(upto, bins + more, held, 0)
            else:
                for bound, more, held, on in other.pieces:
                    top = min(upto, bound - value) if bound < TOP else upto
                    if top > low:
                        add(top, bins + more, held + value * on, on)
                        low = top
                    if top == upto:
                        break
            low = upto
        more, held = other.at(self.zero[1])
        return Fold(pieces, (self.zero[0] + more, held))

    def row(self) -> dict:
        return {"pieces": [list(p) for p in self.pieces], "zero": list(self.zero)}

    @staticmethod
    def read(pieces, zero) -> Fold:
        return Fold([tuple(int(x) for x in p) for p in pieces], (int(zero[0]), int(zero[1])))


def _carried(folds: DataFrame, width: int, lane_kind: str) -> DataFrame:
    """(lane, part, held, bin): what each part's open bin holds where it begins, and its number."""
    up = F.floor(F.col("part") / FAN).cast("long")
    given = f"lane {lane_kind}, part long, held long, bin long"

    def handed(own: pd.DataFrame, held: int, number: int) -> pd.DataFrame:
        out = []
        for row in own.sort_values("part").itertuples():
            out.append((row.lane, row.part, held, number))
            bins, held = Fold.read(row.pieces, row.zero).at(held)
            number += bins
        return pd.DataFrame(out, columns=["lane", "part", "held", "bin"])

    if width <= FAN:
        return folds.groupBy("lane").applyInPandas(lambda own: handed(own, 0, 0), given)

    def composed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        whole = None
        for row in own.itertuples():
            fold = Fold.read(row.pieces, row.zero)
            whole = fold if whole is None else whole.then(fold)
        return pd.DataFrame([{"lane": own["lane"].iloc[0], "part": int(own["part"].iloc[0]) // FAN, **whole.row()}])

    grouped = folds.groupBy("lane", up.alias("up"))
    above = _carried(grouped.applyInPandas(composed, f"lane {lane_kind}, part long, {MAPS}"), -(-width // FAN), lane_kind)
    taken = above.select("lane", F.col("part").alias("up"), "held", "bin").groupBy("lane", "up")
    return grouped.cogroup(taken).applyInPandas(lambda own, given: handed(own, int(given["held"].iloc[0]), int(given["bin"].iloc[0])), given)


def bins_of_ranges(rows: DataFrame, order: str, budget: int, width: int) -> DataFrame:
    """(lane, part, order, cost, bin) of (lane, part, order, cost): parts are ranges of the order, numbered below width.

    A task holds the rows of one part, or the functions of FAN parts. A missing or negative
    cost counts 0, and a row above the budget has a bin of its own. Lanes are sequences of
    their own; a null lane is one.
    """
    clean = rows.select("lane", F.col("part").cast("long").alias("part"), order, F.greatest(F.lit(0), F.coalesce(F.col("cost"), F.lit(0))).cast("long").alias("cost"))
    kinds = {f.name: f.dataType.simpleString() for f in clean.schema}

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable")
        return pd.DataFrame([{"lane": own["lane"].iloc[0], "part": int(own["part"].iloc[0]), **Fold.of(own["cost"].to_numpy(), budget).row()}])

    def number(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable")
        return own.assign(bin=list(next_fit(own["cost"].tolist(), budget, int(given["held"].iloc[0]), int(given["bin"].iloc[0]))))

    parts = clean.groupBy("lane", "part")
    folds = parts.applyInPandas(fold, f"lane {kinds['lane']}, part long, {MAPS}")
    carried = _carried(folds, width, kinds["lane"])
    return parts.cogroup(carried.groupBy("lane", "part")).applyInPandas(number, f"lane {kinds['lane']}, part long, `{order}` {kinds[order]}, cost long, bin long")

"""Items of varying length into containers of one capacity."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_rank
from vitalake.session import cut

CAPACITY = 2048
TIERS = (2048, 1024, 512, 256)
#: Containers of one step group.
STEP = 16
#: Items of one size are ranked in blocks of about so many.
BLOCK_ITEMS = 50_000


class _Stock:
    """What is left of each size, and the next rank of it."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)

    def largest(self, most: int, used: dict[int, int]) -> int:
        """The largest size of at most ``most`` of which any is left beside ``used``; 0 if there is none."""
        at = bisect_right(self.sizes, most) - 1
        while at >= 0 and used.get(self.sizes[at], 0) >= self.left[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def _has(self, size: int, used: dict[int, int], n: int = 1) -> bool:
        return self.left.get(size, 0) - used.get(size, 0) >= n

    def fill(self, gap: int, most: int, used: dict[int, int]) -> int:
        """Put sizes of at most ``most`` into ``gap``, exactly by one or two where that can be, else the largest; what remains."""
        while gap:
            if gap <= most and self._has(gap, used):
                used[gap] = used.get(gap, 0) + 1
                return 0
            first = self.largest(min(gap, most), used)
            if not first:
                return gap
            for i in range(bisect_right(self.sizes, min(gap, most)) - 1, -1, -1):
                a, b = self.sizes[i], gap - self.sizes[i]
                if 2 * a < gap:
                    break
                if b <= most and self._has(a, used, 1 + (a == b)) and self._has(b, used):
                    used[a] = used.get(a, 0) + 1
                    used[b] = used.get(b, 0) + 1
                    return 0
            used[first] = used.get(first, 0) + 1
            gap -= first
        return 0

    def take(self, used: dict[int, int]) -> tuple[int, list[tuple[int, int, int]]]:
        """How often the pattern ``used`` can be repeated, and (size, first rank, number each time); it is taken so often."""
        times = min(self.left[s] // n for s, n in used.items())
        rows = [(s, self.rank[s], n) for s, n in used.items()]
        for s, n in used.items():
            self.rank[s] += n * times
            self.left[s] -= n * times
            if not self.left[s]:
                self.sizes.remove(s)
        return times, rows


@dataclass
class Plan:
    """Places by rank. ``items``: (size, first rank, number a window, fill of the window, first window of that fill, window's
    tier); ``windows``: (fill, first window of that fill, number a container, first container); ``fills``:
    (fill of the container, first container, number of them), fullest first."""

    items: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    windows: list[tuple[int, int, int, int]] = field(default_factory=list)
    fills: list[tuple[int, int, int]] = field(default_factory=list)
    containers: int = 0

    def per_tier(self) -> dict[int, tuple[int, int]]:
        """Windows and units of each tier."""
        out: dict[int, tuple[int, int]] = {}
        for fill, tier, times in self.made:
            n, units = out.get(tier, (0, 0))
            out[tier] = (n + times, units + fill * times)
        return out

    made: list[tuple[int, int, int]] = field(default_factory=list)


def _tiers(capacity: int, tiers: tuple[int, ...]) -> list[int]:
    return sorted({min(t, capacity) for t in tiers if t > 0} | {capacity}, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> Plan:
    """Windows and containers for ``counts`` items of each size.

    An item is routed to the shortest tier that holds it, and each tier, from the longest on, is packed into
    windows of its own length: a window begins with the largest item of the tier left and takes further
    ones of the tier while they fit; its gap is filled from the shorter tiers. A window is closed
    at its fill; windows are then nested into containers of ``capacity`` in the same way. A
    pattern found is repeated while the sizes last, so the work depends on the number of sizes, not of items.
    """
    stock = _Stock({s: n for s, n in counts.items() if s <= capacity})
    out = Plan()
    steps = _tiers(capacity, tiers)
    by_fill: dict[int, int] = {}
    for length, floor in zip(steps, [*steps[1:], 0], strict=True):
        while stock.sizes and stock.sizes[-1] > floor:
            used: dict[int, int] = {}
            gap = length
            while (own := stock.largest(gap, used)) > floor:
                used[own] = used.get(own, 0) + 1
                gap -= own
            gap = stock.fill(gap, floor, used)
            times, rows = stock.take(used)
            fill = length - gap
            out.items += [(s, r, n, fill, by_fill.get(fill, 0), length) for s, r, n in rows]
            out.made.append((fill, length, times))
            by_fill[fill] = by_fill.get(fill, 0) + times
    nest = _Stock(by_fill)
    found = []
    while nest.sizes:
        used = {nest.sizes[-1]: 1}
        gap = nest.fill(capacity - nest.sizes[-1], capacity, used)
        times, rows = nest.take(used)
        found.append((capacity - gap, times, rows))
    for fill, times, rows in sorted(found, key=lambda x: -x[0]):
        out.windows += [(f, r, n, out.containers) for f, r, n in rows]
        out.fills.append((fill, out.containers, times))
        out.containers += times
    return out


class _Places:
    """The plan as arrays, for look-ups by size and rank."""

    def __init__(self, made: Plan) -> None:
        items = np.array(sorted(made.items), np.int64).reshape(-1, 6)
        windows = np.array(sorted(made.windows), np.int64).reshape(-1, 4)
        self.items, self.windows = items, windows
        self.item_at = (items[:, 0] << 44) + items[:, 1]
        self.window_at = (windows[:, 0] << 44) + windows[:, 1]
        fills = np.unique(windows[:, 0])
        counts = {int(f): 0 for f in fills}
        for f, _, t in made.made:
            counts[f] += t
        self.offset = np.zeros(CAPACITY + 1 if not len(fills) else int(fills[-1]) + 1, np.int64)
        self.offset[fills] = np.cumsum([0, *(counts[int(f)] for f in fills)])[:-1]

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, its tier and container of the items with these sizes and ranks (from 0)."""
        row = self.items[np.searchsorted(self.item_at, (size << 44) + rank, side="right") - 1]
        window = row[:, 4] + (rank - row[:, 1]) // row[:, 2]
        into = self.windows[np.searchsorted(self.window_at, (row[:, 3] << 44) + window, side="right") - 1]
        return self.offset[row[:, 3]] + window, row[:, 5], into[:, 3] + (window - into[:, 1]) // into[:, 2]


def step_groups(container: np.ndarray, groups: int) -> np.ndarray:
    """The step group of each container: dealt to and fro, as containers are numbered from the fullest on, so that groups weigh alike."""
    turn, at = container // groups, container % groups
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def pack(
    sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY,
    tiers: tuple[int, ...] = TIERS, step: int = STEP,
) -> DataFrame:
    """The container of each item: ``key``, ``part``, ``size``, ``tier``, ``window``, ``window_size``, ``container``, ``step_group``.

    An item above ``capacity`` is split into full parts and a rest (``part`` from 0), no other
    is. ``tier`` is the shortest of ``tiers`` that holds the part, ``window_size`` the tier of the window it lies in, which
    is longer where the part fills a gap, and ``window`` the number of that window. A container
    holds whole windows, ``capacity`` units at most, and is numbered from the fullest on. Step groups have about ``step``
    containers each and weigh alike.

    Only the number of parts of each size, at most ``capacity`` numbers, goes to the
    driver, which plans with them; ranks within a size pick the place in the plan. Items of
    size 0 or null take no room and get window and container 0; repeated rows are items of their
    own, a null key is kept; an empty table gives an empty one; further columns aren't
    looked at.
    """
    kind = sizes.schema[key].dataType.simpleString()
    n = F.coalesce(F.col("n"), F.lit(0))
    parts = (
        sizes.select(sizes[key].alias("k"), sizes[size].cast("bigint").alias("n"))
        .select(
            "k",
            F.greatest(n, F.lit(0)).alias("n"),
            F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int"))).alias("part"),
        )
        .select("k", "part", F.least(F.col("n") - F.col("part") * F.lit(capacity), F.lit(capacity)).cast("int").alias("s"))
    )
    parts = cut(parts)
    counts = {r["s"]: r["n"] for r in parts.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``capacity`` rows at most
    made = plan(counts, capacity, tiers)
    places = _Places(made)
    groups = max(1, -(-made.containers // step))
    tier_of = np.array(sorted(_tiers(capacity, tiers)), np.int64)
    blocks = max(1, -(-max(counts.values(), default=0) // BLOCK_ITEMS))
    ranked = blocked_rank(parts, ["s"], [F.col("k"), F.col("part")], F.pmod(F.xxhash64("k", "part"), F.lit(blocks)), "r").select(
        "k", "part", "s", "r"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b["s"].to_numpy(zero_copy_only=False).astype(np.int64)
            r = b["r"].to_numpy(zero_copy_only=False).astype(np.int64) - 1
            window, length, at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            tier = tier_of[np.searchsorted(tier_of, s)]
            some = s > 0  # the rest takes no room
            length[~some] = tier[~some]
            if some.any():
                window[some], length[some], at[some] = places.of(s[some], r[some])
            yield pa.RecordBatch.from_arrays(
                [
                    b["k"],
                    b["part"],
                    b["s"],
                    pa.array(tier.astype(np.int32)),
                    pa.array(window),
                    pa.array(length.astype(np.int32)),
                    pa.array(at),
                    pa.array(step_groups(at, groups)),
                ],
                names=[key, "part", size, "tier", "window", "window_size", "container", "step_group"],
            )

    return ranked.mapInArrow(
        place,
        f"`{key}` {kind}, part int, `{size}` int, tier int, window bigint, window_size int, container bigint, step_group bigint",
    )

"""Bin completion for bin packing on counts of lengths.

All pieces of one length are alike, so a packing is a list of fillings, each
with how often it is used, and the work depends on the number of distinct
lengths, never on the number of pieces.

Best fit decreasing gives the first incumbent. Branch and bound then takes the
largest length left, enumerates every undominated filling around it, by least
waste first, each with every number of bins that may use it, most first, and
leaves a branch once its waste exceeds what a packing with fewer bins than the
incumbent can have. Sums that the lengths left can reach, as bits of one number
for each length, keep the enumeration free of dead ends. The search is whole
unless ``work`` runs out, and ``Packing.proven`` says which.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Lengths with how often each stands in a bin, and the number of such bins.
Filling = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound from lengths that share no bin."""
    number = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in counts.items():
        number[k] = n
    pieces = np.r_[0, np.cumsum(number)]  # below a length
    volume = np.r_[0, np.cumsum(number * np.arange(capacity + 1))]
    half = capacity // 2
    small = np.arange(half + 1)
    big = pieces[-1] - pieces[capacity - small + 1]
    middle = pieces[capacity - small + 1] - pieces[half + 1]
    room = middle * capacity - (volume[capacity - small + 1] - volume[half + 1])
    rest = volume[half + 1] - volume[small]
    return int(max(-(-volume[-1] // capacity), (big + middle + np.maximum(0, -(-(rest - room) // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit decreasing; equal bins are handled together."""
    free: dict[int, list[list]] = {}
    order: list[int] = []

    def put(room: int, items: tuple, bins: int) -> None:
        if room not in free:
            free[room] = []
            insort(order, room)
        free[room].append([items, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                whole, left = divmod(left, per)
                if whole:
                    put(capacity - per * length, ((length, per),), whole)
                if left:
                    put(capacity - left * length, ((length, left),), 1)
                    left = 0
                continue
            room = order[at]
            items, bins = free[room].pop()
            if not free[room]:
                del free[room], order[at]
            per = room // length
            used = min(bins, left // per)
            if not used:
                per, used = left, 1
            put(room - per * length, (*items, (length, per)), used)
            if bins > used:
                put(room, items, bins - used)
            left -= per * used
    return [(items, bins) for batches in free.values() for items, bins in batches]


@dataclass(frozen=True)
class Packing:
    """Fillings; the bound from below; whether fewer bins are known to be impossible."""

    fillings: list[Filling]
    lower_bound: int
    proven: bool

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.fillings)


def _reach(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """For each place the sums, as bits, of what is left from there on."""
    mask = (1 << (capacity + 1)) - 1
    out = [1] * (len(sizes) + 1)
    bits = 1
    for i in range(len(sizes) - 1, -1, -1):
        k, n = sizes[i], min(left[i], capacity // sizes[i])
        step = 1
        while n > 0:
            take = min(step, n)
            bits |= bits << (take * k) & mask
            n -= take
            step *= 2
        out[i] = bits
    return out


def _sums(sizes: list[int], left: list[int], reach: list[int], i: int, room: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Every choice of (place, less the number) from place ``i`` on whose sizes add up to ``room``, in order."""
    if not room:
        yield ()
        return
    while i < len(sizes) and reach[i] >> room & 1:
        if sizes[i] <= room:
            for q in range(min(left[i], room // sizes[i]), 0, -1):
                rest = room - q * sizes[i]
                if reach[i + 1] >> rest & 1:
                    for more in _sums(sizes, left, reach, i + 1, rest):
                        yield ((i, -q), *more)
        i += 1


def completions(sizes: list[int], left: list[int], capacity: int, top: int, most: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...], bool]]:
    """Waste and choice of every maximal filling around a piece of ``sizes[top]`` that wastes ``most`` at most, least waste first, and whether it is undominated; ``sizes`` falls.

    A filling is dominated if a piece that is left would fit beside it, or in
    place of a smaller one of its own.
    """
    left = list(left)
    left[top] -= 1
    reach = _reach(sizes[top:], left[top:], capacity)
    reach = [0] * top + reach
    room = capacity - sizes[top]
    smallest = next((sizes[i] for i in range(len(sizes) - 1, top - 1, -1) if left[i]), capacity + 1)
    for waste in range(0, min(most, room, smallest - 1) + 1):
        if reach[top] >> (room - waste) & 1:
            for choice in _sums(sizes, left, reach, top, room - waste):
                used = {i: -q for i, q in choice}
                yield waste, choice, not waste or not any(left[j] > used.get(j, 0) for i in used for j in _larger(sizes, i, top, waste))


def _larger(sizes: list[int], i: int, top: int, waste: int) -> Iterator[int]:
    """Places of sizes above that of place ``i`` by ``waste`` at most."""
    j = i - 1
    while j >= top and sizes[j] <= sizes[i] + waste:
        yield j
        j -= 1


#: Frames that hold an open enumeration, and numbers in remembered states: what bounds the search's memory.
OPEN, REMEMBERED = 32, 4_000_000


def pack(counts: dict[int, int], capacity: int, work: int = 3_000_000) -> Packing:
    """Fillings that hold ``counts[k]`` pieces of each length ``k`` from 1 to ``capacity`` in few bins, never more than best fit decreasing.

    ``work`` bounds the search, in steps of about a microsecond to ten. A search
    that ends before is whole, and what it returns has the fewest bins there are.
    Beyond ``OPEN`` frames an enumeration is closed, and begun again after the
    choice taken when the search comes back to it.
    """
    counts = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a length is outside 1 to the capacity")
    incumbent = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in incumbent), lower_bound(counts, capacity) if counts else 0
    if fewest <= least:
        return Packing(incumbent, least, True)

    sizes = sorted(counts, reverse=True)
    left = [counts[k] for k in sizes]
    volume = sum(k * n for k, n in counts.items())
    seen: dict[tuple, int] = {}  # states and the fewest bins that led to them
    trail: list[tuple[int, tuple[tuple[int, int], ...], int]] = []

    def choices(top: int, waste: int, after: tuple | None, taken: tuple | None = None) -> Iterator[tuple[int, tuple[tuple[int, int], ...], int]]:
        """Fillings of the pieces of one size in order, so that no set of bins comes twice."""
        nonlocal work
        work -= len(sizes) - top
        for w, choice, undominated in completions(sizes, left, capacity, top, (fewest - 1) * capacity - volume - waste):
            work -= 5 * (1 + len(choice))
            if work <= 0:
                return
            if not undominated or (after is not None and (w, choice) <= after):
                continue
            if taken is not None and (w, choice) < taken[:2]:
                continue
            used = dict(choice)
            used[top] = used.get(top, 0) - 1
            times_most = min(left[i] // -q for i, q in used.items())
            if taken is not None and (w, choice) == taken[:2]:
                times_most = taken[2] - 1
            for times in range(times_most, 0, -1):
                if waste + times * w <= (fewest - 1) * capacity - volume:
                    yield w, choice, times
                if work <= 0:
                    return

    def change(top: int, choice: tuple[tuple[int, int], ...], times: int) -> None:
        left[top] -= times
        for i, q in choice:
            left[i] += q * times

    # Frames: the size in turn, bins and waste so far, choices, the choice that is taken, and the one that all follow.
    stack = [[0, 0, 0, choices(0, 0, None), None, None]]
    while stack and work > 0 and fewest > least:
        frame = stack[-1]
        top, bins, waste, of, taken, follows = frame
        if taken is not None:
            change(top, taken[1], -taken[2])
            trail.pop()
        if of is None:
            frame[3] = of = choices(top, waste, follows, taken)
        frame[4] = taken = next(of, None)
        if taken is None:
            stack.pop()
            continue
        w, choice, times = taken
        change(top, choice, times)
        trail.append((top, choice, times))
        bins, waste = bins + times, waste + times * w
        down = next((i for i in range(top, len(sizes)) if left[i]), None)
        if down is None:
            if bins < fewest:
                fewest, incumbent = bins, []
                for t, taken_choice, n in trail:
                    items = {sizes[i]: -q for i, q in taken_choice}
                    items[sizes[t]] = items.get(sizes[t], 0) + 1
                    incumbent.append((tuple(sorted(items.items(), reverse=True)), n))
            continue
        if waste > (fewest - 1) * capacity - volume:
            continue
        after = (w, choice) if down == top else None
        if len(sizes) <= 256:
            state = (after, *left)
            if seen.get(state, bins + 1) <= bins:
                continue
            if len(seen) * len(sizes) < REMEMBERED:
                seen[state] = bins
        stack.append([down, bins, waste, choices(down, waste, after), None, after])
        if len(stack) > OPEN:
            stack[-OPEN - 1][3] = None
    return Packing(incumbent, least, fewest <= least or (work > 0 and not stack))

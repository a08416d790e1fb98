"""Filling fixed-capacity containers: a configuration linear program over the length histogram.

Lengths -> a histogram of at most `capacity` rows -> the driver solves the configuration LP (one variable per way to fill
a container) by multiplicative weights: a length that is covered already loses weight, and a knapsack dynamic program
finds the fullest container under the weights; the solution is rounded down and the rest is filled by the same knapsack
over what is left, at last by best fit -> every text finds its container from its place among the texts of its length.
What the driver holds depends on the capacity, never on the number of texts.

Defined results: a null or empty text has no tokens and lies in container 0; a text above the capacity is cut into pieces
of exactly the capacity and a last shorter one; rows that come again are packed again; null ids are packed as they are.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import token_count
from marlstone.operators.numbering import numbered
from marlstone.session import cut

CAPACITY = 1024
ROUNDS = 400
SHARE = 0.1
LEARN = 1.0

Pattern = tuple[tuple[int, int], ...]  # (length, how many), descending


def _best_fill(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[Pattern, float]:
    """Unbounded knapsack: the multiset of lengths with sum <= capacity and the greatest worth."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], take[c] = best[c - 1], -1
        if e := ends[c]:
            sums = best[c - lengths[:e]] + worth[:e]
            k = int(sums.argmax())
            if sums[k] > best[c]:
                best[c], take[c] = sums[k], k
    c, found = capacity, Counter()
    while c > 0:
        if (k := take[c]) < 0:
            c -= 1
        else:
            found[int(lengths[k])] += 1
            c -= int(lengths[k])
    return tuple(sorted(found.items(), reverse=True)), float(best[capacity])


def _fullest(left: dict[int, int], capacity: int) -> Pattern:
    """Bounded subset sum over what is left: start from the longest item, then reach the greatest sum with bit sets."""
    first = max(left)
    room, reach, steps = capacity - first, 1, []
    for length in sorted(left, reverse=True):
        n = min(left[length] - (length == first), room // length)
        size = 1
        while n > 0:
            size = min(size, n)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & ((1 << (room + 1)) - 1)
            n, size = n - size, size * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, Counter({first: 1})
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            found[length] += size
            at -= length * size
    return tuple(sorted(found.items(), reverse=True))


def _filled(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Containers for all of `counts`: the fullest one at a time, as often as it can be repeated, at last by best fit."""
    used: Counter[Pattern] = Counter()
    left = {k: v for k, v in counts.items() if v}
    while sum(left.values()) > 2 * capacity:
        pattern = _fullest(left, capacity)
        n = min(left[k] // a for k, a in pattern)
        used[pattern] += n
        for k, a in pattern:
            left[k] -= n * a
            if not left[k]:
                del left[k]
    rooms: list[tuple[int, int]] = []  # (room, which), sorted
    boxes: list[list[int]] = []
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            at = bisect.bisect_left(rooms, (k, -1))
            if at == len(rooms):
                boxes.append([k])
                bisect.insort(rooms, (capacity - k, len(boxes) - 1))
            else:
                room, which = rooms.pop(at)
                boxes[which].append(k)
                bisect.insort(rooms, (room - k, which))
    for box in boxes:
        used[tuple(sorted(Counter(box).items(), reverse=True))] += 1
    return used


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, share: float = SHARE) -> tuple[list[tuple[Pattern, int]], float]:
    """Patterns with how often each is used, covering exactly `counts`; and a lower bound on the number of containers.

    A round adds the pattern of greatest worth as often as brings its scarcest length a `share` further. The bound is the
    best feasible dual seen: worths divided by the worth of the best pattern. The rounded solution is kept unless filling
    alone, without it, needs fewer containers; both cost what the histogram costs.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0 and k > 0}
    used: Counter[Pattern] = Counter()
    full = counts.pop(capacity, 0)
    left, bound = dict(counts), 0.0
    if counts:
        lengths = np.array(sorted(counts))
        have = np.array([counts[x] for x in lengths], float)
        where = {int(x): i for i, x in enumerate(lengths)}
        covered, weights, part = np.zeros(len(lengths)), lengths / capacity, Counter()
        for _ in range(rounds):
            pattern, worth = _best_fill(lengths, weights, capacity)
            bound = max(bound, float((have * weights).sum() / worth))
            ix, a = np.array([where[x] for x, _ in pattern]), np.array([n for _, n in pattern], float)
            step = share * float((have[ix] / a).min())
            part[pattern] += step
            covered[ix] += step * a / have[ix]
            weights[ix] *= np.exp(-LEARN * step * a / have[ix])
            if covered.min() >= 1:
                break
        over = max(1.0, float((covered * have * lengths).sum() / (have * lengths).sum()))
        for pattern, x in part.most_common():
            n = min(int(x / over), *(left.get(k, 0) // a for k, a in pattern))
            if n > 0:
                used[pattern] += n
                for k, a in pattern:
                    left[k] -= n * a
    best = min((used + _filled(left, capacity), _filled(counts, capacity)), key=lambda u: sum(u.values()))
    best[((capacity, 1),)] += full
    total = sum(k * v for k, v in counts.items())
    return list((+best).items()), full + max(bound, total / capacity)


def _slots(used: list[tuple[Pattern, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each length, runs of places: (key = length and first place, first container, texts of that length a container)."""
    taken: Counter[int] = Counter()
    rows, base = [], 0
    for pattern, n in used:
        for length, a in pattern:
            rows.append(((length << 40) | taken[length], base, a, taken[length]))
            taken[length] += n * a
        base += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, pieces, tokens, container): the container of each text, or of each piece of a longer one, from piece 0."""
    sizes = cut(df.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("n")))
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("long")
    items = sizes.select("id", "n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    items = items.select("id", "piece", "pieces", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("tokens"))
    placed = numbered(items, "tokens", "id", "piece")
    counts = {r["tokens"]: r["c"] for r in placed.groupBy("tokens").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    used, _ = solve(counts, capacity)
    keys, bases, per, firsts = _slots(used)
    lengths = np.array(sorted(counts) or [0], np.int64)
    before = np.concatenate([[0], np.cumsum([counts[x] for x in sorted(counts)])[:-1]]).astype(np.int64) if counts else np.zeros(1, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, num = b.column(3).to_numpy(), b.column(4).to_numpy()
            rank = num - before[np.searchsorted(lengths, tokens)]
            if len(keys):
                at = np.maximum(np.searchsorted(keys, (tokens << 40) | rank, "right") - 1, 0)
                box = np.where(tokens > 0, bases[at] + (rank - firsts[at]) // per[at], 0)
            else:
                box = np.zeros(len(tokens), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(box, pa.int64())], ["id", "piece", "pieces", "tokens", "container"])

    kind = items.schema["id"].dataType.simpleString()
    return placed.select("id", "piece", "pieces", "tokens", "num").mapInArrow(assign, f"id {kind}, piece long, pieces long, tokens long, container long")

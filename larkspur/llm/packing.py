"""Best-fit packing: a configuration linear program over the length histogram, planned on the driver.

Workers tokenise and cut; only the histogram (at most `capacity` bins) reaches the driver. There multiplicative
weights price the lengths, which also bounds every packing from below; a knapsack dynamic program at those prices
gives the configurations, whose fractional numbers cover the histogram and are rounded; best fit, still on counts,
packs what rounding leaves. The plan, a few entries for each length, goes back to the workers, which place piece
number r of a length by interval lookup. If plain best fit needs fewer sequences, its plan is taken.

Defined cases: null and empty texts are the single closing token; a text is cut only if it is longer than a sequence;
repeated rows are each placed; null ids are placed too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import shards, stored, text_buffers, tuned
from .tokenise import WORD_BPE, piece_encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0

Pattern = tuple[tuple[int, int], ...]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    tuned(docs.sparkSession)
    path = vocabulary_path(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, keep="pieces"):
            encoder = piece_encoder(path)
            ids, bounds = encoder.encode(*text_buffers(shard.column("text")))
            row, piece, start, length, crc = [], [], [], [], []
            end = np.array([END_ID], "<u4")
            for i in range(len(bounds) - 1):
                own = np.concatenate((ids[bounds[i] : bounds[i + 1]].astype("<u4"), end))
                for k, a in enumerate(range(0, len(own), capacity)):
                    part = own[a : a + capacity]
                    row.append(i), piece.append(k), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            names = shard.column("doc_id").combine_chunks().take(pa.array(row, pa.int64()))
            yield from pa.table(
                {"doc_id": names, "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            ).to_batches()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value for each room, and the length taken last for it (-1: as for a room less by one)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        value = best[room - lengths[:n]] + prices[:n]
        k = value.argmax()
        if value[k] > best[room - 1] + 1e-12:
            best[room], took[room] = value[k], k
        else:
            best[room] = best[room - 1]
    return best, took


def completed(lengths: np.ndarray, took: np.ndarray, capacity: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length of `own` the best configuration that holds it: parallel arrays of configuration, length, count."""
    last = np.maximum.accumulate(np.where(took >= 0, np.arange(len(took)), 0))
    parts, rooms, live = [np.stack((np.arange(len(own)), own))], last[capacity - lengths[own]], np.arange(len(own))
    while len(live):
        live = live[took[rooms[live]] >= 0]
        k = took[rooms[live]]
        parts.append(np.stack((live, k)))
        rooms[live] = last[rooms[live] - lengths[k]]
    code, count = np.unique(np.concatenate(parts, axis=1).T @ np.array([len(lengths), 1]), return_counts=True)
    return code // len(lengths), code % len(lengths), count


def weighted_prices(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 24, eps: float = 0.3, near: float = 0.02) -> tuple[np.ndarray, float]:
    """Prices of the lengths and the number of sequences that no packing can be under, by multiplicative weights.

    A round takes, for each length, the best configuration that holds it, if that is within `near` of the best of all;
    lengths that those cover more than others get cheaper. Prices over the best configuration's value are a feasible
    dual, so each round gives a bound; the round of the highest bound decides.
    """
    price = lengths / capacity
    kept, bound = price, 0.0
    for _ in range(rounds):
        best, took = knapsack(lengths, price, capacity)
        top = best[capacity]
        if (price @ demand) / top > bound:
            kept, bound = price / top, float(price @ demand / top)
        own = np.flatnonzero(price + best[capacity - lengths] >= (1 - near) * top)
        which, k, count = completed(lengths, took, capacity, own)
        step = np.full(len(own), np.inf)
        np.minimum.at(step, which, demand[k] / count)
        gain = np.bincount(k, count * step[which], len(lengths)) / demand
        price = price * (1 - eps) ** (gain / gain.max())
    return kept, bound


def linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None, near: float = 0.01, weights: bool = True) -> list[tuple[Counter, float]]:
    """Fractional numbers of configurations that cover the demand exactly.

    Configurations come from the knapsack program over what is not covered yet, at the prices of multiplicative
    weights (without `weights` at those of the lengths alone): one for each length, longest first, each filled with the
    longest of the lengths that lose next to nothing. How far the sum is from weighted_prices' bound is the gap.
    """
    price = lengths / capacity
    if weights:
        price, _ = weighted_prices(lengths, demand, capacity, **({} if rounds is None else {"rounds": rounds}))
    price = price * (lengths / capacity) ** 0.03  # of two full configurations the one of longer pieces wins
    rest = demand.astype(float)
    out: list[tuple[Counter, float]] = []
    while (live := np.flatnonzero(rest > 1e-9)).size:
        size, value = lengths[live], price[live]
        best, _ = knapsack(size, value, capacity)
        least = (1 - near) * best[capacity]
        whole = value + best[capacity - size] >= least
        before = len(out)
        for full in (True, False):  # where no full configuration is left, the lengths that are left stand as they can
            for i in np.flatnonzero(whole | (not full))[::-1].tolist():
                if rest[live[i]] <= 1e-9:
                    continue
                held = _filled(i, size, value, best, rest[live], demand[live], capacity, near * best[capacity] / 4)
                if full and sum(value[k] * n for k, n in held.items()) < least:
                    continue
                step = min(rest[live[k]] / n for k, n in held.items())
                for k, n in held.items():
                    rest[live[k]] -= step * n
                out.append((Counter({int(live[k]): n for k, n in held.items()}), step))
            if len(out) > before:
                break
    return out


def _filled(first: int, size: np.ndarray, value: np.ndarray, best: np.ndarray, rest: np.ndarray, demand: np.ndarray, capacity: int, slack: float) -> Counter:
    """A configuration that holds one piece of length number `first`; no length more often than there are pieces."""
    held, room = Counter([first]), capacity - int(size[first])
    while room >= size[0]:
        n = int(np.searchsorted(size, room, "right"))
        free = rest[:n] > 1e-9
        for k, c in held.items():
            if k < n and c >= demand[k]:
                free[k] = False
        good = np.flatnonzero((best[room - size[:n]] + value[:n] >= best[room] - slack) & free)
        if not len(good):
            break
        held[int(good[-1])] += 1
        room -= int(size[good[-1]])
    return held


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[Pattern, int]]:
    """Configurations ((length, count), ...), longest first, and how many sequences use each; they hold every piece once.

    The rounded program with best fit of what it leaves, or plain best fit where that needs fewer sequences.
    """
    whole = {k: v for k, v in histogram.items() if v > 0}
    rest = dict(whole)
    out: list[tuple[Pattern, int]] = []
    if capacity in rest:
        out.append((((capacity, 1),), rest.pop(capacity)))
    if rest:
        lengths = np.array(sorted(rest))
        demand = np.array([rest[int(x)] for x in lengths])
        for pattern, times in sorted(linear_program(lengths, demand, capacity, rounds), key=lambda x: -x[1]):
            n = min([math.ceil(times - 1e-9), *(rest[int(lengths[k])] // c for k, c in pattern.items())])
            if n > 0:
                for k, c in pattern.items():
                    rest[int(lengths[k])] -= n * c
                out.append((tuple((int(lengths[k]), c) for k, c in sorted(pattern.items(), reverse=True)), n))
    mixed, plain = best_fit(rest, capacity, out), best_fit(whole, capacity)
    return mixed if sum(n for _, n in mixed) <= sum(n for _, n in plain) else plain


def best_fit(rest: dict[int, int], capacity: int, begun: list[tuple[Pattern, int]] | tuple = ()) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on counts, into the bins begun and new ones: equal bins are one entry."""
    bins: dict[int, dict[Pattern, int]] = {}
    rooms = np.zeros(capacity + 1, np.int64)

    def put(pattern: Pattern, room: int, n: int) -> None:
        own = bins.setdefault(room, {})
        own[pattern] = own.get(pattern, 0) + n
        rooms[room] += n

    for pattern, n in begun:
        put(pattern, capacity - sum(length * each for length, each in pattern), n)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left > 0:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                pattern, n = next(iter(bins[room].items()))
                each = room // length
                n = min(n, max(1, left // each))
                each = min(each, left)
                bins[room][pattern] -= n
                rooms[room] -= n
                if not bins[room][pattern]:
                    del bins[room][pattern]
            else:
                pattern, room, each = (), capacity, min(capacity // length, left)
                n = max(1, left // each)
            left -= n * each
            put((*pattern, (length, each)), room - each * length, n)
    return [(pattern, n) for own in bins.values() for pattern, n in own.items()]


class Slots:
    """Where piece number r of a length goes: intervals of r for each length."""

    def __init__(self, plans: list[tuple[Pattern, int]]):
        own: dict[int, list[tuple[int, int, int, int]]] = {}
        given: Counter = Counter()
        base = 0
        for pattern, n in plans:
            offset = 0
            for length, each in pattern:
                own.setdefault(length, []).append((given[length], each, base, offset))
                given[length] += n * each
                offset += length * each
            base += n
        self.sequences = base
        self.by_length = {k: np.array(v, np.int64).T for k, v in own.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            size = int(length[part[0]])
            first, each, base, begin = self.by_length[size]
            k = np.searchsorted(first, rank[part], "right") - 1
            q = rank[part] - first[k]
            sequence[part] = base[k] + q // each[k]
            offset[part] = begin[k] + (q % each[k]) * size
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = tuned(docs.sparkSession)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = stored(cut_pieces(docs, capacity, vocabulary).withColumn("salt", salt))
    counts = pieces.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(Slots(plan(histogram, capacity)))
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

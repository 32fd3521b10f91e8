"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

1. Within each text, every window of `length` bytes elects the first smallest hash among its 64-byte grams;
   neighbouring windows that elect one place form a record. Equal windows elect equal hashes at equal places, so they
   meet under one key and at one distance from it, with about one record for 69 bytes instead of one row a byte.
2. Keys that occur once go. A record whose whole content occurs again is repeated throughout; contents are told apart
   by a cryptographic digest of 128 bits and their length. Only one of each content is looked at further, so groups of
   copies never pile up.
3. Where one key has several contents, the suffixes that begin at the same distance from it are sorted: a mergesort
   compares two by prefix polynomial hashes and a binary search for their common extension, and in that order
   neighbours whose common extension reaches `length` are repeated, once their bytes agree too. Hashes only order; a
   collision is seen by the bytes and settled by them. The windows of a key of more than `GROUP` contents are not
   gathered in one task: those whose hash occurs once go, and the others are grouped by their very bytes.
4. Spans go back to their documents; only texts that may have some are shuffled.

Defined cases: null counts as empty; texts shorter than `length` lose nothing; repeated rows (equal id and text) are
separate occurrences and so lose whatever is long enough; null ids are kept apart from others; other columns are
ignored; an empty table gives no rows; a text of any length is worked on whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import KeyBitmap, ddl, discard, shards, stored, text_buffers, text_key, tuned

LENGTH = 200
GRAM = 64
#: Window starts in one record at most.
RECORD = 256
#: Contents of one key that a single task sorts.
GROUP = 20_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def records(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elected hash, row, first window start (in data) and number of windows of each record."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none
    prefix = B.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = B.mix(B.span_hash(prefix, at, at + gram))
    least = sliding_min(grams, length - gram + 1)
    room = np.diff(offs) - length + 1
    rows = np.flatnonzero(room > 0)
    fresh = np.zeros(len(least) + 1, bool)
    fresh[1:-1] = least[1:] != least[:-1]
    # where the elected gram drops out a new record begins even if an equal gram follows: windows of one record share
    # the elected place, so no two of them can be equal, and a window that occurs twice has its hash in two records
    fresh[1:] |= grams[: len(least)] == least
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, offs[rows], 1)
    np.add.at(valid, offs[rows] + room[rows], -1)
    valid = np.cumsum(valid)[:-1] > 0
    fresh[offs[rows]] = True
    start = np.flatnonzero(fresh[:-1] & valid)
    row = np.searchsorted(offs, start, "right") - 1
    last = offs[row] + room[row]
    stop = np.minimum(np.append(start[1:], len(least)), last)
    count = stop - start
    if len(count) and count.max() > RECORD:  # periodic text: one elect for very many windows
        parts = -(-count // RECORD)
        k, which = B.expand(np.zeros(len(count), np.int64), parts)
        start, stop, row = start[which] + k * RECORD, stop[which], row[which]
        count = np.minimum(stop - start, RECORD)
    return least[start], row, start, count


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a cryptographic digest of each data[start:end]."""
    raw = data.tobytes()
    both = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    halves = np.frombuffer(both, np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


class SuffixOrder:
    """Suffixes of one buffer compared through prefix hashes: a common extension costs a binary search."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = np.concatenate((data, np.zeros(1, np.uint8))), limit
        self.prefix = B.prefix_hash(data)
        self.power = B.powers(B.BASE, len(data) + 1)
        padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
        self.head = np.zeros(len(data) + 1, np.uint64)
        for i in range(8):
            self.head = (self.head << np.uint64(8)) | padded[i : i + len(data) + 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, up to limit (both lie inside the buffer that far)."""
        out = np.full(len(a), self.limit)
        part = np.flatnonzero(~self._alike(a, b, np.int64(self.limit)))
        a, b = a[part], b[part]
        low, step = np.zeros(len(part), np.int64), 1 << (self.limit.bit_length() - 1)
        while step and len(part):
            reach = np.minimum(low + step, self.limit)
            low = np.where(self._alike(a, b, reach), reach, low)
            step >>= 1
        out[part] = low
        return out

    def _alike(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the next n bytes have one hash; both sides are brought to one power instead of dividing by it."""
        x, y = self.prefix[a + n] - self.prefix[a], self.prefix[b + n] - self.prefix[b]
        return x * self.power[b] == y * self.power[a]

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a sorts before, with or after b."""
        x, y = self.head[a], self.head[b]
        sign = (x > y).astype(np.int16) - (x < y)
        tied = np.flatnonzero(sign == 0)  # equal in their first eight bytes
        if len(tied):
            a, b = a[tied], b[tied]
            n = self.common(a, b)
            over = n >= self.limit
            x, y = self.data[np.where(over, 0, a + n)].astype(np.int16), self.data[np.where(over, 0, b + n)].astype(np.int16)
            sign[tied] = np.where(over, 0, np.sign(x - y))
        return sign

    def sort(self, suffixes: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """Bottom-up mergesort inside each part (numbers that never fall); a pass ranks each suffix in its sibling run."""
        out, n, width = suffixes.copy(), len(suffixes), 1
        if not n:
            return out
        first = np.zeros(1, np.int64) if part is None else np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(first, n))
        base, stop = np.repeat(first, size), np.repeat(first + size, size)
        while width < size.max():
            spot = np.flatnonzero(stop - base > width)
            low_end, high_end = base[spot], stop[spot]
            run = (spot - low_end) // width
            left = run % 2 == 0
            begin = np.minimum(low_end + np.where(left, run + 1, run - 1) * width, high_end)
            low, high = begin.copy(), np.minimum(begin + width, high_end)
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) >> 1
                sign = self.before(out[middle], out[spot[live]])
                less = np.where(left[live], sign < 0, sign <= 0)  # ties keep the left run first
                low[live] = np.where(less, middle + 1, low[live])
                high[live] = np.where(less, high[live], middle)
                live = live[low[live] < high[live]]
            place = np.where(left, spot + low - begin, spot - width + low - begin)
            merged = out.copy()
            merged[place] = out[spot]
            out, width = merged, width * 2
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte-by-byte verification that suffixes a and b agree for limit bytes."""
        out = np.ones(len(a), bool)
        span = np.arange(self.limit)
        for i in range(0, len(a), 4096):
            out[i : i + 4096] = (self.data[a[i : i + 4096, None] + span] == self.data[b[i : i + 4096, None] + span]).all(1)
        return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at `starts` equal another one of the same part: by the common extensions of neighbours in
    the suffix order, verified byte by byte."""
    order = SuffixOrder(data, length)
    by_part = np.argsort(part, kind="stable")
    part, begin = part[by_part], starts[by_part]
    several = np.flatnonzero(np.concatenate(([False], part[1:] == part[:-1])) | np.concatenate((part[1:] == part[:-1], [False])) if len(part) else np.zeros(0, bool))
    part, begin, by_part = part[several], begin[several], by_part[several]
    line = order.sort(begin, part)
    again = np.zeros(len(line), bool)
    near = np.flatnonzero(part[1:] == part[:-1])
    near = near[order.common(line[near], line[near + 1]) >= length]
    same = order.equal(line[near], line[near + 1])
    again[near[same]] = again[near[same] + 1] = True
    if not same.all():  # unequal strings of one hash have confused the order there: settle those parts by their bytes
        raw = order.data.tobytes()
        for p in np.unique(part[near[~same]]).tolist():
            at = np.flatnonzero(part == p)
            count = Counter(raw[s : s + length] for s in line[at].tolist())
            again[at] = [count[raw[s : s + length]] > 1 for s in line[at].tolist()]
    # a start is in one part only, so it is found again by its place in the buffer
    out = np.zeros(len(starts), bool)
    out[np.isin(starts, line[again])] = True
    return out


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (what is left, as bytes) of every row."""
    tuned(docs.sparkSession)
    id_ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    keyed = docs.select("doc_id", text_key(), "text")

    def elects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            m, *_ = records(*text_buffers(shard.column("text")), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], ["m"])

    several = stored(keyed.select("text").mapInArrow(elects, "m bigint").groupBy("m").count().where("count > 1").select("m"))
    seen = KeyBitmap(several, "m", 27)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            data, offs = text_buffers(shard.column("text"))
            m, row, start, count = records(data, offs, length, gram)
            k = np.flatnonzero(seen.has(m.view(np.int64)))
            one, two = digests(data, start[k], start[k] + count[k] - 1 + length)
            pick = pa.array(row[k])
            yield from pa.table(
                {"m": m.view(np.int64)[k], "one": one, "two": two, "doc_id": shard.column("doc_id").combine_chunks().take(pick), "tk": shard.column("tk").combine_chunks().take(pick), "a": (start[k] - offs[row[k]]).astype(np.int32), "n": count[k].astype(np.int32)}
            ).to_batches()

    found = stored(keyed.mapInArrow(candidates, f"m bigint, one bigint, two bigint, {id_ddl}, tk bigint, a int, n int").join(several, "m"))
    content = ["m", "one", "two", "n"]
    contents = stored(found.groupBy(*content).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tk", "a")).alias("at")))
    whole = found.join(contents.where("times > 1").select(*content), content).select("doc_id", "tk", F.col("a").alias("s"), (F.col("a") + F.col("n") + (length - 1)).alias("e"))
    mixed = contents.groupBy("m").agg(F.count("*").alias("k")).where("k > 1")
    wanted = contents.join(mixed, "m").select("at.doc_id", "at.tk", F.struct("m", "at.a", "n", "times", "k").alias("r")).groupBy("doc_id", "tk").agg(F.collect_list("r").alias("rs"))
    wanted = stored(wanted)
    some = KeyBitmap(wanted, "tk", 26).maybe(keyed, "tk")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("m", "k", "times", "a", "content")}
            row = []
            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("rs").to_pylist(), strict=True)):
                raw = (text or "").encode()
                for r in own:
                    row.append(i)
                    for c in ("m", "k", "times", "a"):
                        out[c].append(r[c])
                    out["content"].append(raw[r["a"] : r["a"] + r["n"] - 1 + length])
            pick = pa.array(row, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("tk").take(pick), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", "tk", *out]
            )

    right = wanted.select(F.col("doc_id").alias("w"), F.col("tk").alias("wk"), "rs")
    joined = some.join(right.hint("shuffle_hash"), some["doc_id"].eqNullSafe(F.col("w")) & (F.col("tk") == F.col("wk"))).select("doc_id", "tk", "text", "rs")
    pieces = stored(joined.mapInArrow(fetch, f"{id_ddl}, tk bigint, m bigint, k bigint, times bigint, a int, content binary"))

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            m = batch.column("m").to_numpy()
            if not len(m):
                continue
            edge = int(np.flatnonzero(m != m[-1])[-1]) + 1 if m[0] != m[-1] else 0
            new_key = bool(held) and held[-1].column("m")[-1].as_py() != m[0]
            if new_key and sum(b.num_rows for b in held) >= 2000:
                yield _sorted_spans(pa.Table.from_batches(held), length, gram)
                held = []
            if edge:
                held.append(batch.slice(0, edge))
                if sum(b.num_rows for b in held) >= 2000:
                    yield _sorted_spans(pa.Table.from_batches(held), length, gram)
                    held = []
            held.append(batch.slice(edge))
        if held:
            yield _sorted_spans(pa.Table.from_batches(held), length, gram)

    span_ddl = f"{id_ddl}, tk bigint, s int, e int"
    parts = pieces.where(F.col("k") <= group).select("doc_id", "tk", "m", "times", "a", "content").repartition("m").sortWithinPartitions("m").mapInArrow(sort_groups, span_ddl)

    def hashed(batches: Iterator[pa.RecordBatch], once_more: KeyBitmap | None) -> Iterator[pa.RecordBatch]:
        """A row of each window of the contents: key and hash; if once_more may hold that also where it is, and its bytes."""
        for batch in batches:
            for i, raw in enumerate(batch.column("content").to_pylist()):
                prefix = B.prefix_hash(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - length + 1)
                code = B.mix(B.span_hash(prefix, at, at + length)).view(np.int64)
                if once_more is not None:
                    at = at[once_more.has(code)]
                    code = code[at]
                own = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in ("doc_id", "tk", "m", "times")]
                if once_more is None:
                    yield pa.RecordBatch.from_arrays([own[2], pa.array(code)], ["m", "code"])
                else:
                    bytes_of = pa.array([raw[s : s + length] for s in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32) + batch.column("a")[i].as_py(), pa.int32()), bytes_of], ["doc_id", "tk", "m", "times", "s", "bytes"])

    large = pieces.where(F.col("k") > group)
    twice = stored(large.mapInArrow(lambda batches: hashed(batches, None), "m bigint, code bigint").groupBy("m", "code").count().where("count > 1").select("code"))
    known = KeyBitmap(twice, "code", 26)
    windows = large.mapInArrow(lambda batches: hashed(batches, known), f"{id_ddl}, tk bigint, m bigint, times bigint, s int, bytes binary")
    repeated = windows.groupBy("m", "bytes").count().where("count > 1").select("m", "bytes")
    hot = windows.where("times = 1").join(repeated, ["m", "bytes"]).select("doc_id", "tk", "s", (F.col("s") + length).alias("e"))

    spans = stored(whole.unionByName(parts).unionByName(hot).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("s", "e")).alias("found")))
    discard(several, found, contents, wanted, pieces, twice)
    hit = KeyBitmap(spans, "tk", 26)
    maybe = hit.maybe(keyed, "tk")
    right = spans.select(F.col("doc_id").alias("w"), F.col("tk").alias("wk"), "found")
    dirty = maybe.join(right.hint("shuffle_hash"), maybe["doc_id"].eqNullSafe(F.col("w")) & (F.col("tk") == F.col("wk")), "left").select("doc_id", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, own in zip(batch.column("text").to_pylist(), _column(batch, "found"), strict=True):
                raw = (text or "").encode()
                spans, kept = [], raw
                if own:
                    s, e = _merge(np.array([x["s"] for x in own]), np.array([x["e"] for x in own]))
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                for v, x in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                    v.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    result = f"{id_ddl}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"
    clean = keyed.mapInArrow(lambda batches: cut(hit.pick(batches, "tk", False)), result)
    return clean.unionByName(dirty.mapInArrow(cut, result))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist() if name in batch.schema.names else [None] * batch.num_rows


def _sorted_spans(table: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """Spans of the windows that a group's contents share, for contents that occur once."""
    table = table.combine_chunks()
    raws = table.column("content").to_pylist()
    data = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(x) for x in raws], np.int64)
    begin = np.cumsum(size) - size
    starts, which = B.expand(begin, size - length + 1)
    m = table.column("m").to_numpy()
    group = np.cumsum(np.concatenate(([0], m[1:] != m[:-1])))
    # equal windows elect equal places, so only those at one distance from it can be equal
    at = np.arange(len(data) - gram + 1)
    elected = np.flatnonzero(B.mix(B.span_hash(B.prefix_hash(data), at, at + gram)).view(np.int64) == np.repeat(m, size)[: len(at)])
    place = elected[np.searchsorted(elected, begin)]
    again = repeated_windows(data, starts, group[which] * np.int64(length) + place[which] - starts, length)
    again &= (table.column("times").to_numpy() == 1)[which]
    first, last = B.runs(again)
    inner = np.flatnonzero(again[1:] & again[:-1] & (which[1:] != which[:-1])) + 1
    first, last = np.sort(np.concatenate((first, inner))), np.sort(np.concatenate((last, inner)))
    own = which[first] if len(first) else first
    base = table.column("a").to_numpy()[own] - begin[own]
    pick = pa.array(own)
    return pa.RecordBatch.from_arrays(
        [table.column("doc_id").combine_chunks().take(pick), table.column("tk").combine_chunks().take(pick), pa.array((starts[first] + base).astype(np.int32)), pa.array((starts[last - 1] + length + base if len(last) else first).astype(np.int32))],
        ["doc_id", "tk", "s", "e"],
    )

"""Benchmark decontamination: an FM-index per training shard, searched with every benchmark window.

A shard is some megabytes of whole documents inside one task. Its words that no benchmark item uses can be in no
match, so they become breaks; what lies between breaks and is long enough is indexed, and every window of the
benchmark runs through the index by backward search. Nothing is shuffled. The benchmark is handed to the workers in
compressed blocks of at most `block_bytes` of text, which a worker opens one after the other for each shard.

Defined cases: null or word-free texts have no words and no hits; an item without words matches nothing, one with a
null id has nothing to be listed by and is left out; repeated rows are each reported; equal items are all reported; null
document ids pass through; an empty benchmark flags nothing; an empty table gives no rows; a text of any length is
searched whole; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .fmindex import FMIndex
from .runtime import shards, text_buffers, tuned

WINDOW = 8
MIN_ITEMS = 2
BLOCK_BYTES = 4 << 20

FOUND = "array<struct<start:int,end:int>>"


class Windows:
    """The distinct windows of some benchmark items over a vocabulary of their own words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data = [t.encode() for _, t in items]
        buf = np.frombuffer(b"".join(data), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
        low, start, end, row = B.words(buf, offs)
        hashes = B.word_hashes(low, start, end)
        self.hashes, first = np.unique(hashes, return_index=True)
        self.letters = low
        self.spans = np.stack((start[first], end[first])) if len(first) else np.zeros((2, 0), np.int64)
        self.filter = np.zeros(1 << 18, bool)
        self.filter[self.hashes >> np.uint64(46)] = True
        code = (np.searchsorted(self.hashes, hashes) + 1).astype(np.int32)
        per_item = np.bincount(row, minlength=len(items))
        begin = np.cumsum(per_item) - per_item
        at, owner = B.expand(begin, np.where(per_item >= window, per_item - window + 1, (per_item > 0).astype(np.int64)))
        size = np.minimum(per_item, window)[owner]
        every = np.zeros((len(at), window), np.int32)
        for k in range(window):
            inside = size > k
            every[inside, k] = code[at[inside] + k]
        self.patterns, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, at)
        self.length = (self.patterns > 0).sum(1)
        # which items have a window: of window w those from first_item[w] on
        pairs = np.unique(which.ravel() * np.int64(max(len(items), 1)) + owner)
        self.item_of = pairs % max(len(items), 1)
        self.first_item = np.searchsorted(pairs // max(len(items), 1), np.arange(len(self.patterns) + 1))
        self.names = [x for x, _ in items]
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def spelled(self, number: int) -> bytes:
        a, b = self.spans[:, number]
        return self.letters[a:b].tobytes()

    def codes(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each word its number in the vocabulary from 1, or 0."""
        hashes = B.word_hashes(low, start, end)
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), max(len(self.hashes) - 1, 0))
        ok = self.hashes[at] == hashes[maybe]
        out[maybe[ok]] = at[ok] + 1
        return out

    def occurrences(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number and window number of each occurrence."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.length) or not len(start):
            return none
        code = self.codes(low, start, end)
        raw = low.tobytes()
        while True:
            first, last = B.runs(code > 0)
            if len(first):  # a run is cut where a document ends
                inner = np.flatnonzero((np.diff(row) != 0) & (code[1:] > 0) & (code[:-1] > 0)) + 1
                first, last = np.sort(np.concatenate((first, inner))), np.sort(np.concatenate((last, inner)))
            keep = last - first >= self.shortest
            first, last = first[keep], last[keep]
            if not len(first):
                return none
            source, which = B.expand(first, last - first)
            place = np.arange(len(source)) + which  # one break between runs
            text = np.ones(int(place[-1]) + 1, np.int64)
            text[place] = code[source] + 1
            back = np.full(len(text), -1, np.int64)
            back[place] = source
            index = FMIndex(text, len(self.hashes) + 2)
            lo, hi = index.search(np.where(self.patterns > 0, self.patterns + 1, 0), self.length)
            rows, window = B.expand(lo, hi - lo)
            at = back[index.locate(rows)] if len(rows) else none[0]
            hit, _ = B.expand(at, self.length[window])
            wrong = [i for i in np.unique(hit).tolist() if raw[start[i] : end[i]] != self.spelled(int(code[i]) - 1)]
            if not wrong:
                return at, window
            code[wrong] = 0  # another word of the same hash


def _found(windows: Windows, words: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of a shard a block of windows hits; row and item number of each item found, once each."""
    row = words[3]
    at, window = windows.occurrences(*words)
    mark = np.zeros(len(row) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + windows.length[window] if len(at) else at, -1)
    pairs = np.unique(row[at] * np.int64(max(len(windows.length), 1)) + window)
    r, w = pairs // max(len(windows.length), 1), pairs % max(len(windows.length), 1)
    spot, which = B.expand(windows.first_item[w], windows.first_item[w + 1] - windows.first_item[w])
    m = max(len(windows.names), 1)
    both = np.unique(r[which] * np.int64(m) + windows.item_of[spot])
    return np.cumsum(mark[:-1]) > 0, both // m, both % m


def _scan(blocks: list[Broadcast], min_items: int, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _opened(blocks[0]) if len(blocks) == 1 else None
        for shard in shards(batches, size=1 << 20):
            data, offs = text_buffers(shard.column("text"))
            words = B.words(data, offs)
            _, start, end, row = words
            n = len(offs) - 1
            per_row = np.bincount(row, minlength=n)
            hit = np.zeros(len(start), bool)
            names: list[list[str]] = [[] for _ in range(n)]
            for block in blocks:
                windows = only or _opened(block)
                own, rows, items = _found(windows, words, n)
                hit |= own
                for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                    names[r].append(windows.names[i])
            names = [sorted(set(x)) for x in names]  # items of one id may be in several blocks
            a, b = B.runs(hit)
            if len(a):
                inner = np.flatnonzero((np.diff(row) != 0) & hit[1:] & hit[:-1]) + 1
                a, b = np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))
            owner = row[a] if len(a) else a
            spans: list[list[dict]] = [[] for _ in range(n)]
            for r, s, e in zip(owner.tolist(), (start[a] - offs[owner]).tolist(), (end[b - 1] - offs[owner]).tolist(), strict=True):
                spans[r].append({"start": s, "end": e})
            counts = [len(x) for x in names]
            out = {
                "n_words": pa.array(per_row, pa.int64()), "n_hit": pa.array(np.bincount(row, weights=hit, minlength=n).astype(np.int64)), "n_items": pa.array(counts, pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), "contaminated": pa.array([c >= min_items for c in counts], pa.bool_()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(names, pa.list_(pa.string())),
            }
            yield from pa.table({c: shard.column(c).combine_chunks() for c in keep} | out).to_batches()

    return work


def _opened(block: Broadcast) -> Windows:
    return pickle.loads(zlib.decompress(block.value))


def _packed(items: DataFrame, window: int, block_bytes: int) -> Iterator[bytes]:
    """Blocks of windows of whole items, in the order in which the items arrive; the driver holds one at a time."""
    held: list[tuple[str, str]] = []
    size = 0
    for r in items.toLocalIterator():
        held.append((r["item"], r["text"]))
        size += len(r["text"].encode()) + 64
        if size >= block_bytes:
            yield zlib.compress(pickle.dumps(Windows(held, window)), 1)
            held, size = [], 0
    if held:
        yield zlib.compress(pickle.dumps(Windows(held, window)), 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Per document row: the columns `keep` (text among them), n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    spans: the maximal runs of hit words, as byte offsets into the UTF-8 text.
    """
    spark = tuned(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item is not null")
    blocks = [spark.sparkContext.broadcast(b) for b in _packed(items, window, block_bytes)] or [spark.sparkContext.broadcast(zlib.compress(pickle.dumps(Windows([], window))))]
    carried = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{carried}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans {FOUND}, items array<string>"
    return docs.select(*keep).mapInArrow(_scan(blocks, min_items, keep), schema)


def cut_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found's texts without their spans, under the columns of `docs` that found carries."""
    schema = found.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
                if own:
                    raw, at, kept = text.encode(), 0, []
                    for s in own:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return found.mapInArrow(work, schema)

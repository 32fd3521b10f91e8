"""LM scoring: a log-frequency Bloom filter of quantised bigram counts in hash-partitioned blocks, probed level by level.

Counts cover every training token, and every bigram that occurs in training text is in the filter, at any corpus size.
A count is quantised on a scale that is exact up to ten and then grows by a tenth a step; a bigram enters the filter
once for each level up to its own, and probing levels until the first miss gives the count back.

The filter grows with the corpus, so it has no bound under which it could be broadcast. It is cut by bigram hash into
blocks of BLOCK_BYTES of text each, and probes travel to the blocks instead: documents are gathered into packs, a pack
asks each block once for the distinct bigrams that fall there (sorted, differences only, compressed), and the answers,
one byte a bigram, return to the pack. The exact counts of words are asked for in the same way. A hot word or bigram is
one entry of each pack. In the limit of very many packs and blocks a request is one bigram, never less.

The model is a bigram model with Dirichlet smoothing over unigrams that are smoothed by one:
p1(w) = (c(w) + 1) / (N + V + 1), p(w | h) = (c(hw) + MU * p1(w)) / (c(h) + MU), which adds up to one over all words
and one unseen word but for quantisation and the filter's false positives. The end of a text is a token, and the
history of its first word.

Words are told apart by 128 bits. Defined cases: null counts as empty (one end token); without training rows every
token has probability one; repeated rows each train and each get a result; null ids count as the empty text in the
fold rule; other columns are ignored; a text of any length is one row of one pack.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import discard, shards, stored, text_buffers, tuned

#: Bytes of text in a pack; its distinct words and bigrams are asked for together.
PACK_BYTES = 6 << 20
#: Bytes of text for each block of the filter: some 2 million bigrams, a filter of 3 to 5 MB.
BLOCK_BYTES = 16 << 20
LEVEL_BASE = 1.1
BITS_PER_ENTRY = 16
PROBES = 4
#: Weight of the unigram part, in tokens.
MU = 4.0
#: Stands for the end of a text among word hashes.
END = (np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5))


def level_bounds(most: int = 1 << 62) -> np.ndarray:
    """Least count of each level."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * LEVEL_BASE))))
    return np.array(out, np.int64)


BOUNDS = level_bounds()


def quantise(counts: np.ndarray) -> np.ndarray:
    """Level of each count, from 1; 0 for nought."""
    return np.searchsorted(BOUNDS, counts, "right")


def expected(levels: np.ndarray) -> np.ndarray:
    """The mean of a level's counts; 0 for level 0."""
    ends = np.append(BOUNDS[1:], BOUNDS[-1] + 1)
    return np.concatenate(([0.0], (BOUNDS + (ends - 1)) / 2))[levels]


class LogFrequencyFilter:
    def __init__(self, entries: int):
        self.table = np.zeros(-(-max(entries * BITS_PER_ENTRY, 1024) // 8), np.uint8)

    @classmethod
    def of(cls, table: bytes) -> LogFrequencyFilter:
        out = cls(1)
        out.table = np.frombuffer(table, np.uint8)
        return out

    def _spots(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        bits = np.uint64(len(self.table) * 8)
        one = B.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        two = B.mix(one) | np.uint64(1)
        for _ in range(PROBES):
            yield one % bits
            one = one + two

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        flat = np.unpackbits(self.table, bitorder="little")
        for level in range(1, int(levels.max(initial=0)) + 1):
            for spot in self._spots(keys[levels >= level], level):
                flat[spot] = 1
        self.table = np.packbits(flat, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live, level = np.arange(len(keys)), 1
        while len(live):
            hit = np.ones(len(live), bool)
            for spot in self._spots(keys[live], level):
                hit &= (self.table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = level
            level += 1
        return out


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of one width, byte by byte of each, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def unplaned(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).reshape(-1).view(kind)


def rising(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences."""
    return planes(np.diff(numbers, prepend=numbers.dtype.type(0)))


def risen(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.cumsum(unplaned(raw, kind, n), dtype=kind)


def narrowest(numbers: np.ndarray) -> np.ndarray:
    """Counts in one, four or eight bytes each."""
    most = int(numbers.max(initial=0))
    return numbers.astype(np.uint8 if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8")


KINDS = {1: "u1", 4: "<u4", 8: "<u8"}


class Tokens:
    """The tokens of some texts: their distinct words and bigrams, and which of them each token is.

    Words are sorted by their hash halves, bigrams by block and fingerprint; both orders depend on the texts only.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, blocks: int):
        low, start, end, row = B.words(data, offs, B.SOLID)
        n = len(offs) - 1
        self.row = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
        one, two = (np.full(len(start) + n, e) for e in END)
        at = np.arange(len(start)) + row
        one[at], two[at] = B.word_codes(low, start, end)
        self.one, first, self.word = np.unique(one, return_index=True, return_inverse=True)
        self.two = two[first]
        if (self.two[self.word] != two).any():  # words that share a half: sort by both
            order = np.lexsort((two, one))
            fresh = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
            self.word = np.empty(len(one), np.int64)
            self.word[order] = np.cumsum(fresh) - 1
            self.one, self.two = one[order][fresh], two[order][fresh]
        ends = np.flatnonzero((self.one == END[0]) & (self.two == END[1]))
        self.before = np.concatenate((ends[:1], self.word[:-1]))  # the token before a text's first word is an end
        both = B.mix(self.one * np.uint64(0xD1342543DE82EF95) ^ self.two)
        key = B.mix(both[self.before] * np.uint64(0x9E3779B97F4A7C15) + both[self.word])
        # the block, then 32 bits that name the bigram inside it: a clash there is a false positive of the filter
        code = (key >> np.uint64(32)) * np.uint64(blocks) & np.uint64(0xFFFFFFFF00000000) | key & np.uint64(0xFFFFFFFF)
        self.code, self.pair = np.unique(code, return_inverse=True)
        self.blocks = blocks

    def requests(self, counts: bool) -> Iterator[dict]:
        """One for each block that any word or bigram falls in; word blocks are numbered after those of bigrams."""
        block = (self.code >> np.uint64(32)).astype(np.int64)
        times = np.bincount(self.pair, minlength=len(self.code))
        for a, b in _stretches(block):
            yield {"block": int(block[a]), "n": b - a, "keys": rising(self.code[a:b].astype(np.uint32)), "other": b"", "counts": planes(times[a:b].astype("<u4")) if counts else b""}
        block = word_block(self.one, self.blocks)
        times = np.bincount(self.word, minlength=len(self.one))
        for a, b in _stretches(block):
            yield {"block": self.blocks + int(block[a]), "n": b - a, "keys": rising(self.one[a:b]), "other": planes(self.two[a:b]), "counts": planes(times[a:b].astype("<u4")) if counts else b""}


def word_block(one: np.ndarray, blocks: int) -> np.ndarray:
    return ((one >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _stretches(block: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


REQUEST = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("other", pa.binary()), ("counts", pa.binary())])
REQUEST_DDL = "block bigint, n bigint, keys binary, other binary, counts binary"


def held_out(column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 7."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks dealt out in turn: as many to each partition, give or take one."""
    n = max(1, min(2 * blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartitionById(n, F.pmod("block", F.lit(n)).cast("int"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def _summed(rows: list[dict], bigrams: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys (and other halves) of a block's requests and the sums of their counts."""
    one = np.concatenate([risen(r["keys"], "<u4" if bigrams else "<u8", r["n"]) for r in rows])
    count = np.concatenate([unplaned(r["counts"], "<u4", r["n"]) for r in rows]).astype(np.int64)
    two = None if bigrams else np.concatenate([unplaned(r["other"], "<u8", r["n"]) for r in rows])
    order = np.argsort(one, kind="stable") if bigrams else np.lexsort((two, one))
    one, count = one[order], count[order]
    fresh = np.ones(len(one), bool)
    fresh[1:] = one[1:] != one[:-1]
    if two is not None:
        two = two[order]
        fresh[1:] |= two[1:] != two[:-1]
        two = two[fresh]
    return one[fresh], two, np.add.reduceat(count, np.flatnonzero(fresh))


@dataclass
class Model:
    """parts: the filter (keys) of each block of bigrams; sorted halves and counts of the words of each word block."""

    blocks: int
    total: int
    distinct: int
    parts: DataFrame


def train(docs: DataFrame) -> Model:
    """Counts of all words and bigrams of the rows that are not held out."""
    tuned(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size=PACK_BYTES):
            own = Tokens(*text_buffers(shard.column("text")), blocks)
            yield pa.RecordBatch.from_pylist(list(own.requests(True)), REQUEST)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_rows(batches), lambda r: r["block"]):
            one, two, count = _summed(list(rows), block < blocks)
            if two is None:
                level = quantise(count)
                made = LogFrequencyFilter(int(level.sum()))
                made.add(one, level)
                out = {"keys": made.table.tobytes(), "other": b"", "counts": b""}
            else:
                out = {"keys": rising(one), "other": planes(two), "counts": planes(count.astype("<u8"))}
            yield pa.RecordBatch.from_pylist([{"block": block, "n": len(one), "total": 0 if two is None else int(count.sum())} | out], REQUEST.append(pa.field("total", pa.int64())))

    counted = docs.where(~held_out()).select("text").mapInArrow(count, REQUEST_DDL)
    parts = stored(_by_block(counted, blocks).sortWithinPartitions("block").mapInArrow(build, REQUEST_DDL + ", total bigint"))
    zero = F.lit(0).cast("bigint")
    distinct, total = parts.where(F.col("block") >= blocks).agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("total"), zero)).first()
    return Model(blocks, total, distinct, parts)


def _packs(docs: DataFrame) -> DataFrame:
    """pack, and of all its rows ids, sizes of texts (bytes) and body (the texts, compressed)."""
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, shard in enumerate(shards(batches, size=PACK_BYTES)):
            data, offs = text_buffers(shard.column("text"))
            body = pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b""
            ids = pa.ListArray.from_arrays(pa.array([0, shard.num_rows], pa.int32()), shard.column("doc_id").combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), ids, pa.array([np.diff(offs).astype("<i8").tobytes()]), pa.array([body])], ["pack", "ids", "sizes", "body"])

    return stored(docs.select("doc_id", "text").mapInArrow(work, f"pack bigint, ids array<{kind.simpleString()}>, sizes binary, body binary"))


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    offs = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))))
    raw = pa.decompress(row["body"], decompressed_size=int(offs[-1]), codec="zstd", asbytes=True) if offs[-1] else b""
    return np.frombuffer(raw, np.uint8), offs


def score_texts(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    tuned(docs.sparkSession)
    model = model or train(docs)
    blocks, mass, total = model.blocks, float(model.total + model.distinct + 1), int(model.total)
    packs = _packs(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            asked = [r | {"pack": row["pack"]} for r in Tokens(*_texts(row), blocks).requests(False)]
            yield pa.RecordBatch.from_pylist(asked, REQUEST.append(pa.field("pack", pa.int64())))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block: what the model has of it comes first, then each pack's request."""
        held: tuple = (None,)
        for r in _rows(batches):
            block, n = r["block"], r["n"]
            if r["pack"] is None:
                if block < blocks:
                    held = (block, LogFrequencyFilter.of(r["keys"]))
                else:
                    held = (block, risen(r["keys"], "<u8", n), unplaned(r["other"], "<u8", n), unplaned(r["counts"], "<u8", n).astype(np.int64))
                continue
            if held[0] != block:
                found = np.zeros(n, np.int64)
            elif block < blocks:
                found = held[1].levels(risen(r["keys"], "<u4", n))
            else:
                found = _looked_up(risen(r["keys"], "<u8", n), unplaned(r["other"], "<u8", n), *held[1:])
            small = narrowest(found)
            yield pa.RecordBatch.from_arrays([pa.array([r["pack"]]), pa.array([block]), pa.array([small.dtype.itemsize]), pa.array([n]), pa.array([planes(small)])], ["pack", "block", "width", "n", "found"])

    asked = packs.select("pack", "sizes", "body").mapInArrow(ask, REQUEST_DDL + ", pack bigint")
    met = model.parts.drop("total").unionByName(asked, allowMissingColumns=True)
    met = _by_block(met, blocks).sortWithinPartitions("block", "pack")
    answers = stored(met.mapInArrow(answer, "pack bigint, block bigint, width bigint, n bigint, found binary"))
    discard(model.parts)
    kind = docs.schema["doc_id"].dataType

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one pack: the answers by block, then its texts."""
        found: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for i, r in enumerate(_rows([batch.drop_columns(["ids"])])):
                if r["sizes"] is None:
                    found.append((r["block"], unplaned(r["found"], KINDS[r["width"]], r["n"]).astype(np.int64)))
                    continue
                own = Tokens(*_texts(r), blocks)
                level = np.concatenate([x for b, x in found if b < blocks])
                count = np.concatenate([x for b, x in found if b >= blocks])
                found = []
                if len(level) != len(own.code) or len(count) != len(own.one):
                    raise RuntimeError("the answers to a pack are not those to its texts")
                p1 = (count + 1) / mass
                lone, known = np.log10(p1), count > 0
                seen = expected(level)[own.pair]
                value = np.log10(np.minimum((seen + MU * p1[own.word]) / (count[own.before] + MU), 1.0))
                n = len(r["sizes"]) // 8
                sums = [np.bincount(own.row, x, n) for x in (np.ones(len(own.row)), known[own.word], lone[own.word], value)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x + 0.0) for x in sums[2:])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    # an answer's block is below the place of the pack's own row
    last = packs.withColumn("block", F.lit(2 * blocks).cast("bigint"))
    joined = answers.unionByName(last, allowMissingColumns=True).repartition("pack").sortWithinPartitions("pack", "block")
    scored = joined.mapInArrow(settle, f"doc_id {kind.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def _looked_up(one: np.ndarray, two: np.ndarray, have_one: np.ndarray, have_two: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each asked word among sorted ones, 0 where it is not there."""
    at = np.searchsorted(have_one, one)
    out = np.zeros(len(one), np.int64)
    live = np.arange(len(one))
    while len(live):  # more than one step only where words share a half
        live = live[at[live] < len(have_one)]
        live = live[have_one[at[live]] == one[live]]
        same = have_two[at[live]] == two[live]
        out[live[same]] = counts[at[live[same]]]
        live = live[~same]
        at[live] += 1
    return out

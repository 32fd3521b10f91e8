"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded, then verified.

Each shingle with multiplicity w owns the intervals [0,1), [1,2), [2,4), [4,8) ... below w. An interval carries a
Poisson process of points (time, component) at a rate of its length times the signature's size; points of a half-used
interval also have a position and count only below w. A component keeps its earliest time, so two texts agree in it
with the probability of their weighted Jaccard similarity. Points are drawn in order of time for all shingles at once
and drawing stops at the latest kept time, so a text costs a few points for each component, whatever its length.

Texts of one 128-bit digest are one node from the start. Nodes that share a band (ROWS components) meet in a bucket.
In a bucket, pairs in different components that may be similar enough are thinned to a spanning forest of the likeliest
pairs; only its edges leave the task. They are verified on the whole shingle multisets, components are formed, and
buckets that still hold hopeful, untested pairs across components go round again with more forests, and at last with
all such pairs. What is hopeful is told from a second, longer signature that only nodes in buckets get. A pair is
looked at in the first bucket it shares.

A bucket beyond BLOCK nodes is dealt out in blocks. In the first round a block keeps to itself, which makes most of a
large group of copies one component. After it the largest component of a bucket stays where it is, and only the nodes
of its other components visit all blocks: the rows are the bucket's, and once more for each block those of the nodes
that are not in its largest component.

A class is what verified links connect; its id is its least doc_id. Defined cases: a text of fewer than `shingle`
words has one shingle, all its words; texts without words are linked to no other text, equal ones (a null text is an
empty one) are one class like all equal texts; repeated rows share a class; null ids never name a class (a class of null ids only has a null id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .runtime import KeyBitmap, ddl, discard, shards, stored, text_buffers, tuned

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Nodes of one bucket that a task compares with each other.
BLOCK = 1024
#: Spanning forests in each round; the last round tests every pair that is left, so nothing needs another.
FORESTS = (1, 8, None)
#: Components of the longer signature of nodes that share a bucket, of which one bit each is kept.
LONG = 2048


def hopeful_share(threshold: float) -> float:
    """Least estimate that is tested: four standard deviations below the threshold."""
    same = (1 + threshold) / 2
    return threshold - 8 * (same * (1 - same) / LONG) ** 0.5


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and multiplicity of each distinct k-word shingle of each text."""
    low, start, end, row = B.words(data, offs)
    word = B.word_hashes(low, start, end)
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at, owner = B.expand(first, count)
    size = np.minimum(n, k)[owner]
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        live = size > j
        code[live] = B.mix(code[live] * np.uint64(0xD1342543DE82EF95) + word[at[live] + j])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))) if len(code) else at
    return owner[fresh], code[fresh], np.diff(np.append(fresh, len(code)))


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash of n weighted sets given as elements; infinite where a set is empty."""
    level = np.zeros(len(weight), np.int64)
    level[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)  # the last interval that begins below w
    step, which = B.expand(np.zeros(len(weight), np.int64), level + 1)
    begin = np.where(step == 0, 0, 1 << np.maximum(step - 1, 0))
    length = np.where(step == 0, 1, begin)
    used = np.minimum(weight[which] - begin, length)
    seed = B.mix(code[which] + step.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    owner, time, slow = row[which], np.zeros(len(which)), 1.0 / (size * length)
    kept = np.full(n * size, np.inf)
    latest = np.full(n, np.inf)
    point = 0
    while len(seed):
        point += 1
        draw = B.mix(seed + np.uint64(point * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * slow
        live = time < latest[owner]
        seed, owner, time, slow, used, length, draw = seed[live], owner[live], time[live], slow[live], used[live], length[live], draw[live]
        spot = B.mix(draw + np.uint64(0x8CB92BA72F3D8DD7))
        counts = ((spot >> np.uint64(32)) % length.astype(np.uint64)).astype(np.int64) < used
        at = owner[counts] * size + ((spot[counts] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(kept, at, time[counts])
        if point < 8 or point % 4 == 0:
            touched = np.unique(owner[counts])
            latest[touched] = kept.reshape(n, size)[touched].max(1)
    return kept.reshape(n, size)


def similarity(row_a: tuple, row_b: tuple, n: int) -> np.ndarray:
    """Exact weighted Jaccard of n pairs of multisets, each side as (row, hash, multiplicity)."""
    row = np.concatenate((row_a[0], row_b[0]))
    code = np.concatenate((row_a[1], row_b[1]))
    count = np.concatenate((row_a[2], row_b[2])).astype(float)
    order = np.lexsort((code, row))
    row, code, count = row[order], code[order], count[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] == code[:-1]))
    shared = np.bincount(row[both], np.minimum(count[both], count[both + 1]), n)
    return shared / np.maximum(np.bincount(row, count, n) - shared, 1)


def forest(sketch: np.ndarray, bands: np.ndarray, key: int, component: np.ndarray, guest: np.ndarray, hopeful: float, tested: set[tuple[int, int]], times: int | None) -> list[tuple[int, int]]:
    """Edges of up to `times` disjoint spanning forests over components (of all, if None), likeliest pairs first.

    sketch: packed bits. bands: all band keys; a pair is only looked at in the first bucket that it shares, here the
    one of `key`. guest: nodes of other blocks; pairs of two guests are not looked at.
    """
    n, bits = sketch.shape[0], sketch.shape[1] * 8
    words = sketch.view(np.uint64)
    pairs_i, pairs_j, differ = [], [], []
    most = int((1 - hopeful) / 2 * bits)  # bits of texts that are alike by s agree with probability (1 + s) / 2
    for i in range(n - 1):
        other = np.arange(i + 1, n)
        ok = component[other] != component[i]
        if guest[i]:
            ok &= ~guest[other]
        other = other[ok]
        if len(other):
            apart = np.bitwise_count(words[other] ^ words[i]).sum(1)
            good = apart <= most
            spot = np.flatnonzero(good)
            shared = bands[other[spot]] == bands[i]
            good[spot] = bands[i][shared.argmax(1)] == key
            pairs_i.append(np.full(int(good.sum()), i)), pairs_j.append(other[good]), differ.append(apart[good])
    if not pairs_i:
        return []
    i, j, apart = np.concatenate(pairs_i), np.concatenate(pairs_j), np.concatenate(differ)
    order = np.argsort(apart, kind="stable")
    left = [(a, b) for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True) if (a, b) not in tested]
    if times is None:
        return left
    out: list[tuple[int, int]] = []
    for _ in range(times):
        parent = {c: c for c in component.tolist()}

        def root(c: int, parent: dict[int, int] = parent) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        rest = []
        for a, b in left:
            x, y = root(int(component[a])), root(int(component[b]))
            if x != y:
                parent[x] = y
                out.append((a, b))
            else:
                rest.append((a, b))
        left = rest
        if not left:
            break
    return out


def text_name() -> F.Column:
    """A 128-bit digest of the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("name")


def sketch_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """name (digest of the text), doc_id and bands; null ones without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            n = shard.num_rows
            row, code, weight = shingles(*text_buffers(shard.column("text")), shingle)
            kept = signatures(row, code, weight, n)
            empty = ~np.isfinite(kept[:, 0]) if n else np.zeros(0, bool)
            bits = B.mix(kept.view(np.uint64))
            band = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                band = B.mix(band * np.uint64(0xD1342543DE82EF95) + bits[:, r::ROWS] + np.uint64(r))
            band = B.mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            bands = pa.array([None if e else x for e, x in zip(empty.tolist(), band.tolist(), strict=True)], pa.list_(pa.int64()))
            yield from pa.table({"name": shard.column("name").combine_chunks(), "doc_id": shard.column("doc_id").combine_chunks(), "bands": bands}).to_batches()

    return docs.select(text_name(), "doc_id", "text").mapInArrow(work, f"name binary, {ddl(docs, ['doc_id'])}, bands array<bigint>")


def long_sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """node and sketch (LONG bits) of texts (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size=1 << 18):  # a row's signature takes 16 KB
            kept = signatures(*shingles(*text_buffers(shard.column("text")), shingle), shard.num_rows, LONG)
            sketch = np.packbits((B.mix(kept.view(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1)
            yield from pa.table({"node": shard.column("node").combine_chunks(), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary())}).to_batches()

    # a text costs a signature of LONG components whatever its length, so tasks get equal numbers of them
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // 2000))
    return texts.select("node", "text").repartition(n, "node").mapInArrow(work, "node bigint, sketch binary")


def near_copies(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) of every row."""
    return classes(docs, threshold, shingle, block).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, keep: tuple[str, ...], threshold: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` of one row of each class, that of the least doc_id."""
    tuned(docs.sparkSession)
    told = stored(classes(docs, threshold, shingle))
    best = told.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("s"))
    goes = told.join(best, "c").where(~(F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("name") == F.col("s.name")))).select("doc_id", "name").distinct()
    again = told.groupBy("doc_id", "name").count().where("count > 1").select("doc_id", "name", F.lit(False).alias("goes"))
    marked = stored(again.unionByName(goes.withColumn("goes", F.lit(True))).groupBy("doc_id", "name").agg(F.max("goes").alias("goes")))
    columns = list(dict.fromkeys(("doc_id", "text", *keep)))
    keyed = docs.select(*(F.col(c).alias(f"_{c}") for c in columns), text_name()).withColumn("spot", F.xxhash64("name"))
    hit = KeyBitmap(marked.select(F.xxhash64("name").alias("spot")), "spot", 26)
    right = marked.select(F.col("doc_id").alias("w"), F.col("name").alias("wn"), "goes")
    maybe = hit.maybe(keyed, "spot")
    seen = maybe.join(right.hint("shuffle_hash"), maybe["_doc_id"].eqNullSafe(F.col("w")) & (F.col("name") == F.col("wn")), "left")
    once = seen.where("goes = false").dropDuplicates(["_doc_id", "name"])
    clear = keyed.mapInArrow(lambda batches: hit.pick(batches, "spot", False), ddl(keyed, keyed.columns))
    back = [F.col(f"_{c}").alias(c) for c in keep]
    return clear.select(*back).unionByName(seen.where("goes is null").select(*back)).unionByName(once.select(*back))


def classes(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, name (the text's digest), c (the class's least node), class_id of every row."""
    spark = tuned(docs.sparkSession)
    rows = stored(sketch_texts(docs, shingle))
    # nodes are numbered once and kept, so a number never stands for two texts
    nodes = stored(rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    member = nodes.select("node", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    member = stored(member.join(shared, "key"))
    in_some = stored(nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "name", F.xxhash64("name").alias("spot")))
    keep = KeyBitmap(in_some, "spot", 26)
    texts = keep.maybe(docs.select(text_name(), "text").withColumn("spot", F.xxhash64("name")), "spot").drop("spot").join(in_some.drop("spot"), "name")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")))
    sketches = stored(long_sketches(texts, shingle).join(nodes.select("node", "bands"), "node"))
    empty = "u bigint, v bigint"
    links, tested, label = spark.createDataFrame([], empty), spark.createDataFrame([], empty), None
    hopeful = hopeful_share(threshold)
    for times in FORESTS:
        now = member.withColumn("c", F.col("node")) if label is None else member.join(label, "node", "left").withColumn("c", F.coalesce("c", "node"))
        apart = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
        fresh = stored(_hopeful_pairs(now.join(apart, "key"), sketches, tested, hopeful, block, times, label is None and times == FORESTS[0]))
        found = stored(_verified(fresh, texts, threshold, shingle))
        if found.take(1):
            links = links.unionByName(found)
            label = components(links).select(F.col("u").alias("node"), F.col("v").alias("c"))
        tested = tested.unionByName(fresh)
    discard(member, in_some, texts, sketches)
    if label is None:
        label = spark.createDataFrame([], "node bigint, c bigint")
    named = nodes.select("node", "name", "least").join(label, "node", "left").withColumn("c", F.coalesce("c", "node"))
    named_classes = named.join(named.groupBy("c").agg(F.min("least").alias("class_id")), "c").select("name", "c", "class_id")
    return rows.select("name", "doc_id").join(named_classes, "name").select("doc_id", "name", "c", "class_id")


def _hopeful_pairs(member: DataFrame, sketches: DataFrame, tested: DataFrame, hopeful: float, block: int, times: int | None, first: bool) -> DataFrame:
    """Distinct untested pairs (u > v) of nodes that forests over the buckets pick."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.hash("node"), blocks)
    if first:  # every node is a component yet: blocks keep to themselves
        placed = member.select("key", "node", "c", own.alias("p"), F.lit(False).alias("guest"))
    else:
        large = member.where(F.col("size") > block)
        main = large.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", "count").alias("main"))
        cut = member.join(main, "key", "left").withColumn("own", own)
        visits = F.when(F.col("c") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), blocks - 1))
        placed = cut.withColumn("p", F.explode(visits)).select("key", "node", "c", "p", (F.col("p") != F.col("own")).alias("guest"))
    # what was tested in vain goes along with its first node, so that a forest does not pick it again
    vain = tested.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("vain"))
    full = placed.join(sketches, "node").join(vain, "node", "left")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None

        def done() -> pa.RecordBatch:
            sketch = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint8).reshape(len(held), -1)
            component = np.array([r["c"] for r in held])
            guest = np.array([r["guest"] for r in held])
            at = {r["node"]: i for i, r in enumerate(held)}
            tested_here = {(min(i, at[v]), max(i, at[v])) for i, r in enumerate(held) for v in r["vain"] or () if v in at}
            bands = np.array([r["bands"] for r in held])
            found = [(held[i]["node"], held[j]["node"]) for i, j in forest(sketch, bands, last[0], component, guest, hopeful, tested_here, times)]
            return pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for r in batch.to_pylist():
                name = (r["key"], r["p"])
                if held and name != last:
                    yield done()
                    held = []
                last = name
                held.append(r)
        if held:
            yield done()

    order = ["key", "p"]
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(pick, "u bigint, v bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs whose texts are at least `threshold` alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "a"):
            left, right = (shingles(*text_buffers(shard.column(c)), shingle) for c in ("a", "b"))
            good = pa.array(similarity(left, right, shard.num_rows) >= threshold)
            yield from shard.select(["u", "v"]).filter(good).to_batches()

    first = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    second = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(first, "u").join(second, "v").mapInArrow(work, "u bigint, v bigint")

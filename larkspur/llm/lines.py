"""Line dedup: winnowed line fingerprints, positions joined by them, matches extended both ways, later runs deleted.

The lines of a text are its non-blank lines, stripped of ASCII white space at both ends. Winnowing selects the smallest
line hash of every `window` lines in a row (the leftmost of equal ones), so any `window` lines that occur twice have a
selected position in common; a line of at least `long_words` words is always selected. Only selected positions leave
the task, each with what extends it: the hash of the lines before and after it inside each window that it was selected
for. Positions are joined by fingerprint, those that occur once go, and a match of two positions is extended both ways:
to each window around it that agrees there too. A window (or one long line) that agrees with an earlier one, in order
of doc_id, text hash and line, is repeated and its lines are deleted; repeated windows that follow each other make one
run, since each `window` lines of a longer match have a selected position of their own. What is deleted is judged on
the input.

A line is known by 128 bits and an extension by 64 more. Counting and first positions are pre-aggregated, so a line in
a third of all documents is one row for each task.

Defined cases: null and empty texts have no lines; blank lines are no lines and stay, except inside a deleted run;
rows of equal id and text are one document and get one result each; null ids sort first; an empty table gives no rows;
other columns are ignored; a text of any length is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import KeyBitmap, ddl, discard, shards, stored, text_buffers, text_key, tuned

WINDOW = 2
LONG_WORDS = 50


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Each stripped non-blank line, where it begins and ends, its row."""
    raw = data.tobytes()
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    row = np.searchsorted(offs, start, "right") - 1
    inside = row < len(offs) - 1
    start, row = start[inside], row[inside]
    after = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(raw))[after], offs[row + 1])
    lines, first, last, keep = [], [], [], []
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        line = raw[a:b].rstrip()
        stripped = line.lstrip()
        if stripped:
            lines.append(stripped), first.append(a + len(line) - len(stripped)), last.append(a + len(line)), keep.append(k)
    return lines, np.array(first, np.int64), np.array(last, np.int64), row[np.array(keep, np.int64)]


def winnowed(data: np.ndarray, offs: np.ndarray, window: int, long_words: int) -> dict[str, np.ndarray]:
    """The selected positions: two hash halves of the line, row, line (within the row), whether it is long, and around:
    for each place that it may have in a window (0: it comes first) the hash of the window's other lines, 0 where it
    was not selected for that window."""
    lines, start, end, row = line_spans(data, offs)
    n = len(lines)
    if not n:
        none = np.zeros(0, np.int64)
        return {"one": none, "two": none, "row": none, "line": none, "long": none > 0, "around": np.zeros((0, window), np.int64)}
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), np.uint64).reshape(-1, 2)
    one, two = both[:, 0].copy(), both[:, 1].copy()
    solid = B.SOLID[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[start] = True  # a stripped line begins with the beginning of a word
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(begins, out=total[1:])
    long = total[end] - total[start] >= long_words
    around = np.zeros((n, window), np.uint64)
    first = np.flatnonzero(row[: n - window + 1] == row[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if len(first):
        least = np.stack([one[first + k] for k in range(window)]).argmin(0)
        for place in range(window):
            at = first[least == place]
            code = np.full(len(at), np.uint64(place + 1))
            for k in range(window):
                if k != place:
                    code = B.mix((code ^ one[at + k]) * np.uint64(0x9E3779B97F4A7C15) + two[at + k])
            around[at + place, place] = np.maximum(code, np.uint64(1))
    picked = np.flatnonzero(long | around.any(1))
    number = np.arange(n) - np.searchsorted(row, row)
    return {"one": one[picked], "two": two[picked], "row": row[picked], "line": number[picked], "long": long[picked], "around": around[picked].view(np.int64)}


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` of every row (doc_id and text as they were), n_lines, n_removed, n_runs and kept (the text left)."""
    tuned(docs.sparkSession)
    id_ddl = ddl(docs, ["doc_id"])
    columns = tuple(dict.fromkeys(("doc_id", "text", *keep)))
    keyed = docs.select(*columns, text_key())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = winnowed(*text_buffers(shard.column("text")), window, long_words)
            pick = pa.array(found["row"])
            around = pa.FixedSizeListArray.from_arrays(pa.array(found["around"].ravel()), window).cast(pa.list_(pa.int64()))
            yield from pa.table(
                {"one": found["one"].view(np.int64), "two": found["two"].view(np.int64), "doc_id": shard.column("doc_id").combine_chunks().take(pick), "tk": shard.column("tk").combine_chunks().take(pick), "line": found["line"].astype(np.int32), "long": found["long"], "around": around}
            ).to_batches()

    fingerprint = ["one", "two"]
    rows = stored(keyed.select("doc_id", "tk", "text").mapInArrow(find, f"one bigint, two bigint, {id_ddl}, tk bigint, line int, long boolean, around array<bigint>"))
    again = rows.groupBy(*fingerprint).count().where("count > 1").select(*fingerprint)
    # a match is extended to each window that the position was selected for; a long line stands alone (place -1)
    ways = F.array(*(F.struct(F.lit(k).alias("place"), F.get("around", F.lit(k)).alias("with"), F.lit(window).alias("n")) for k in range(window)), F.struct(F.lit(-1).alias("place"), F.when(F.col("long"), F.lit(1)).otherwise(0).cast("bigint").alias("with"), F.lit(1).alias("n")))
    matched = rows.join(again, fingerprint).select(*fingerprint, "doc_id", "tk", "line", F.explode(ways).alias("way")).where("way.with <> 0")
    line = F.col("line") - F.greatest("way.place", F.lit(0))
    matched = stored(matched.select(*fingerprint, "doc_id", "tk", line.alias("line"), "way.place", "way.with", "way.n"))
    extended = [*fingerprint, "place", "with"]
    first = matched.groupBy(*extended).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tk", "line")).alias("first")).where("times > 1").drop("times")
    later = matched.join(first, extended).where(F.struct("doc_id", "tk", "line") > F.col("first"))
    # one row for every repeated unit; a document's own are gathered, which its length bounds
    spans = stored(later.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("line", "n")).alias("found")))
    discard(rows, matched)
    hit = KeyBitmap(spans, "tk", 26)
    maybe = hit.maybe(keyed, "tk")
    right = spans.select(F.col("doc_id").alias("w"), F.col("tk").alias("wk"), "found")
    dirty = maybe.join(right.hint("shuffle_hash"), maybe["doc_id"].eqNullSafe(F.col("w")) & (F.col("tk") == F.col("wk")), "left").select(*columns, "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            data, offs = text_buffers(shard.column("text"))
            _, start, end, row = line_spans(data, offs)
            n = len(offs) - 1
            n_lines = np.bincount(row, minlength=n)
            first_line = np.cumsum(n_lines) - n_lines
            gone = np.zeros(len(start) + 1, np.int64)
            for i, own in enumerate(shard.column("found").to_pylist() if "found" in shard.column_names else ()):
                for u in own or ():
                    gone[first_line[i] + u["line"]] += 1
                    gone[first_line[i] + u["line"] + u["n"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            a, b = B.runs(gone)
            if len(a):
                inner = np.flatnonzero(gone[1:] & gone[:-1] & (row[1:] != row[:-1])) + 1
                a, b = np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))
            raw = data.tobytes()
            texts: list[str | None] = [x.as_py() for x in shard.column("text").combine_chunks()]
            per = np.searchsorted(row[a] if len(a) else a, np.arange(n + 1))
            for i in np.flatnonzero(np.diff(per)).tolist():
                at, parts = int(offs[i]), []
                for j in range(per[i], per[i + 1]):
                    # a run goes with the line break after it, or at the very end with the one before
                    parts.append(raw[at : start[a[j]]])
                    at = int(end[b[j] - 1])
                    stop = raw.find(b"\n", at, int(offs[i + 1]))
                    at = int(offs[i + 1]) if stop < 0 else stop + 1
                parts.append(raw[at : offs[i + 1]])
                texts[i] = b"".join(parts).decode("utf-8", "replace")
            kept = {c: shard.column(c).combine_chunks() for c in keep}
            removed = np.bincount(row, gone, n).astype(np.int64)
            yield from pa.table(kept | {"n_lines": n_lines.astype(np.int64), "n_removed": removed, "n_runs": np.diff(per).astype(np.int64), "kept": pa.array(texts, pa.string())}).to_batches()

    out = f"{ddl(docs, keep)}, n_lines bigint, n_removed bigint, n_runs bigint, kept string"
    clean = keyed.mapInArrow(lambda batches: cut(hit.pick(batches, "tk", False)), out)
    return clean.unionByName(dirty.mapInArrow(cut, out))

"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled good in the training fold, at most SAMPLE of them, those of smallest hash. The
unlabelled set is every document of that fold, whatever its label: each is counted at the nearest of CELLS cells, whose
centres are the rows of smallest hash, and the means of the cells weighted by their counts stand for it. The class
prior is estimated from positives and unlabelled rows alone (best bin: the threshold of a positive-against-unlabelled
score where the share of unlabelled rows above it, over that of positives, is surely least). A small network over 26
character, word and line statistics is then fitted on the driver; every document is scored.

Defined cases: null or empty text scores as a text of no bytes; labels that disagree about a document count as bad;
null labels and labels of unknown documents are ignored; without any training positive every score is the share of good
labels (0.5 when there are no labels at all); null ids are training-fold, unlabelled rows; repeated rows are each
counted and each scored; an empty table gives no rows; other columns are ignored; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import shards, text_buffers, tuned

#: Most rows of trusted positives that the fit sees.
SAMPLE = 8000
#: Weighted means that stand for all unlabelled rows.
CELLS = 4096
EPOCHS = 400
HIDDEN = 16
#: Weight decay; keeps a fit to a few dozen positives from rejecting what it has not seen.
DECAY = 0.01


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


CLASSES = [_class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(b" "), _class(b"\n"), _class(b"!"), _class(b"#$%&*"), _class(b"|"), _class(b".,;:?"), _class(b"<>{}[]()/\\=_~^@+-\"'`"), _class(range(128, 256)), _class(range(0, 9))]
N_FEATURES = 26


def row_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES doubles for each text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    safe = np.maximum(size, 1)
    out = np.zeros((n, N_FEATURES))

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offs]).astype(float)

    for k, kind in enumerate(CLASSES):
        out[:, k] = per_row(kind[data]) / safe
    k = len(CLASSES)
    out[:, k] = np.log1p(size)
    low, start, end, row = B.words(data, offs, B.SOLID)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    code = B.word_hashes(low, start, end)
    length = (end - start).astype(float)
    out[:, k + 1] = np.bincount(row, length, n) / some
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(row, length * length, n) / some - out[:, k + 1] ** 2, 0))
    out[:, k + 3] = np.log1p(words)
    if len(code):
        same = np.zeros(len(code))
        same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        out[:, k + 4] = np.bincount(row, same, n) / some
        for j, h in ((5, code), (6, B.mix(code * np.uint64(3) + np.roll(code, 1)))):
            order = np.lexsort((h, row))
            fresh = np.ones(len(h))
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            out[:, k + j] = np.bincount(row[order], fresh, n) / some
            if j == 5:  # the share of the commonest word
                begin = np.flatnonzero(fresh)
                count = np.diff(np.append(begin, len(h)))
                most = np.zeros(n)
                np.maximum.at(most, row[order][begin], count)
                out[:, k + 7] = most / some
        last = data[end - 1]
        out[:, k + 8] = np.bincount(row, (last == 33), n) / some
        out[:, k + 9] = np.bincount(row, CLASSES[6][last], n) / some
        out[:, k + 10] = np.bincount(row, CLASSES[0][data[start]] & CLASSES[0][data[end - 1]], n) / some
        out[:, k + 11] = np.bincount(row, length > 25, n) / some
    _, ls, le, lrow = B.words(data, offs, _NOT_NEWLINE)
    lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    out[:, k + 12] = np.log1p(lines)
    if len(ls):
        h = B.word_hashes(low, ls, le)
        order = np.lexsort((h, lrow))
        again = np.zeros(len(h))
        again[1:] = (h[order][1:] == h[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
        out[:, k + 13] = np.bincount(lrow[order], again, n) / lines
    return out


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def featurise(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = row_features(*text_buffers(shard.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * N_FEATURES, pa.int32()), pa.array(found.ravel()))
            yield from pa.table({c: shard.column(c).combine_chunks() for c in keep} | {"features": flat}).to_batches()

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(work, ddl + "features array<double>")


class Model:
    """A network of one hidden layer on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray] | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        a, b, c, d = self.weights
        return 1 / (1 + np.exp(-np.clip(np.tanh(self.ready(x) @ a + b) @ c + d, -30, 30)))


def _descent(model: Model, positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, prior: float | None, epochs: int, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits the network by full gradients. prior None: positives against unlabelled rows, as two classes."""
    xp, xu = model.ready(positive), model.ready(unlabelled)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.3, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    x = np.concatenate((xp, xu))
    is_p = np.arange(len(x)) < len(xp)
    share = np.concatenate((np.full(len(xp), 1 / len(xp)), weight / weight.sum()))
    for t in range(1, epochs + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        s = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))
        slope = s * (1 - s) * share
        if prior is None:
            g = np.where(is_p, -slope, slope)
        elif share[~is_p] @ s[~is_p] - prior * (share[is_p] @ s[is_p]) >= 0:
            g = np.where(is_p, -2 * prior * slope, slope)
        else:  # the estimate of a risk went below nought: step back from it
            g = np.where(is_p, prior * slope, -slope)
        back = np.outer(g, w[2]) * (1 - hidden * hidden)
        grads = [x.T @ back + DECAY * w[0], back.sum(0), hidden.T @ g + DECAY * w[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def _scaled(unlabelled: np.ndarray, weight: np.ndarray, prior: float) -> Model:
    mean = np.average(unlabelled, axis=0, weights=weight)
    return Model(mean, np.sqrt(np.average((unlabelled - mean) ** 2, axis=0, weights=weight)) + 1e-3, None, prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The class prior, from scores: the least share of unlabelled over positive scores above a threshold, where both
    shares are known well enough (an upper confidence bound picks the threshold)."""
    order = np.argsort(unlabelled)
    above_u = 1 - np.concatenate(([0.0], np.cumsum(weight[order]) / weight.sum()))[np.searchsorted(unlabelled[order], positive, "left")]
    above_p = (np.argsort(np.argsort(-positive, kind="stable"), kind="stable") + 1) / len(positive)
    many = weight.sum() ** 2 / (weight**2).sum()
    doubt = np.sqrt(np.log(4 / delta) / 2 / many) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    k = int(((above_u + (1 + gamma) * doubt) / above_p).argmin())
    return float(min(max(above_u[k] / above_p[k], 0.02), 0.98))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> float:
    """Cross-fitted: each half is scored by a network that was fitted to the other."""
    scores_p, scores_u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in (0, 1):
        p, u = np.arange(len(positive)) % 2 == k, np.arange(len(unlabelled)) % 2 == k
        if not (p.any() and (~p).any() and u.any() and (~u).any()):
            return 0.5
        model = _descent(_scaled(unlabelled[u], weight[u], 0.5), positive[p], unlabelled[u], weight[u], None, epochs)
        scores_p[~p], scores_u[~u] = model.score(positive[~p]), model.score(unlabelled[~u])
    return best_bin(scores_p, scores_u, weight)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = EPOCHS, weight: np.ndarray | None = None, constant: float = 0.5) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the sigmoid loss; estimates prior where it is
    None. Without positives or unlabelled rows every score is `constant`."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, constant)
    weight = np.ones(len(unlabelled)) if weight is None else weight
    prior = class_prior(positive, unlabelled, weight, epochs) if prior is None else prior
    return _descent(_scaled(unlabelled, weight, prior), positive, unlabelled, weight, prior, epochs)


def held_out(column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: Features are summed as whole numbers of this part, so that sums do not depend on their order.
_UNIT = 1 << 20


def cells(docs: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and number of the rows nearest to each centre, over all rows of docs; empty cells are left out."""
    centre = centres.mean(0)
    scale = centres.std(0) + 1e-3
    ready = ((centres - centre) / scale).clip(-6, 6)
    shared = docs.sparkSession.sparkContext.broadcast((centre, scale, ready))  # CELLS rows at most
    columns = [f"f{i}" for i in range(N_FEATURES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scale, ready = shared.value
        count, total = np.zeros(len(ready), np.int64), np.zeros((N_FEATURES, len(ready)), np.int64)
        for shard in shards(batches):
            found = row_features(*text_buffers(shard.column("text")))
            own = ((found - centre) / scale).clip(-6, 6)
            square = (ready * ready).sum(1)
            near = np.concatenate([(square - 2 * own[i : i + 512] @ ready.T).argmin(1) for i in range(0, len(own), 512)])
            count += np.bincount(near, minlength=len(ready))
            for i in range(N_FEATURES):
                np.add.at(total[i], near, np.rint(found[:, i] * _UNIT).astype(np.int64))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, count[some], *total[:, some])], ["cell", "n", *columns])

    sums = docs.select("text").mapInArrow(work, "cell bigint, n bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = sums.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).orderBy("cell").collect()  # a row for each centre at most
    count = np.array([r["n"] for r in rows], float)
    return np.array([[r[c] for c in columns] for r in rows], float).reshape(-1, N_FEATURES) / _UNIT / count[:, None], count


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_cells: int = CELLS) -> Model:
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    share = told.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    constant = 0.5 if share is None else min(max(share, 0.02), 0.98)
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = told.where("quality = 1").orderBy(*first).limit(sample).select("doc_id")
    fold = docs.select("doc_id", "text").where(~held_out())
    free = fold.select("doc_id").distinct().orderBy(*first).limit(n_cells)
    picked = good.withColumn("p", F.lit(1)).unionByName(free.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    # repeated rows of an id are one row here; ids of one document each are at most sample + n_cells rows
    own = fold.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("p").alias("p"), F.first("u").alias("u"))
    rows = sorted(featurise(own, ("doc_id", "p", "u")).collect(), key=lambda r: str(r["doc_id"]))
    x = np.array([r["features"] for r in rows], float).reshape(-1, N_FEATURES)
    p, u = np.array([r["p"] for r in rows], int), np.array([r["u"] for r in rows], int)
    if not (p == 1).any() or not (u == 0).any():
        return fit(x[:0], x[:0], constant=constant)
    means, count = cells(fold, np.unique(x[u == 0], axis=0))
    mixed = np.random.default_rng(3).permutation(len(means))  # cells are in order of their centres, halves have to be alike
    return fit(x[p == 1], means[mixed], weight=count[mixed])


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, held_out, score and predicted."""
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    columns = tuple(dict.fromkeys((*keep, "text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            score = shared.value.score(row_features(*text_buffers(shard.column("text"))))
            yield from pa.table({c: shard.column(c).combine_chunks() for c in keep} | {"score": score, "predicted": (score >= 0.5).astype(np.int32)}).to_batches()

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*columns).mapInArrow(work, ddl + "score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    tuned(docs.sparkSession)
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")

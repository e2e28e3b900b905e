"""Document quality from random-indexing word vectors and a small network.

A token is a run of word characters or of other printable characters. Its form (lower-cased) and its
shape (case, digits, marks) each have an index vector: a few signs at places drawn from its hash. A
word's vector is its index vector plus the sum of its neighbours' in the learning sample; vectors live
in ``SLOTS`` hashed slots, so the table has one size whatever the corpus. A document is the mean of its
tokens' vectors, beside the mean of its shapes' and the share of tokens that repeat one of the two before.
A network of two layers, trained with numpy, scores it; one temperature, fitted on rows kept aside,
calibrates the probabilities.

Learning takes a bounded sample: the ``ROWS`` labelled rows of smallest hash, with their whole texts. Texts
stay in Spark's tasks: neighbour sums and document vectors are computed there, and the driver fits the
network on one vector a row. Scoring reads whole texts. Cases: a null text counts as empty and is scored by the network from a
zero vector; labels that are null or belong to no document teach nothing; of several labels for a
document each is a row; with fewer than two classes to learn from every score is the share of ones
(0.5 without any label). A null ``doc_id`` joins no label. Rows with equal ids are rows of their own,
extra columns pass through untouched, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convfeat.llm.common import as_row, map_texts, remainder, row_schema, text_blocks, text_bytes, text_of, written

ROWS = 6000
SLOTS = 1 << 14
WIDTH = 48
SIGNS = 6
HIDDEN = 24
EPOCHS = 150
SEED = 20240501

_KIND = np.zeros(256, np.uint8)  # 0: between tokens, 1: word, 2: other mark
_KIND[0x21:0x7F] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RANDOM = np.random.default_rng(SEED)
_BYTE = _RANDOM.integers(1, 1 << 62, 256, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)


@lru_cache(1)
def _index() -> np.ndarray:
    """The index vector of each slot."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, WIDTH), np.float32)
    places = rng.random((SLOTS, WIDTH)).argsort(1)[:, :SIGNS]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (SLOTS, SIGNS)), 1)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each token's form, its shape (0-31) and how many tokens each text has."""
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & (kind > 0))
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first & (kind > 0), out=counts[1:])
    counts = np.diff(counts[offsets])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], len(data))[np.searchsorted(runs, starts)]
    size = ends - starts
    inside = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    body = data[starts[inside] + at]
    begin = np.cumsum(size) - size
    mixed = np.add.reduceat(_BYTE[_LOWER[body]] * _PLACE[at & 63], begin)
    mixed ^= mixed >> np.uint64(29)
    slots = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
    upper = np.add.reduceat((body >= 65) & (body <= 90), begin, dtype=np.int64)
    digit = np.add.reduceat((body >= 48) & (body <= 57), begin, dtype=np.int64)
    mark = kind[starts] == 2
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 2, 1))
    shapes = np.where(mark, 12 + np.minimum(size, 4), case + 3 * (digit > 0) + 6 * (size > 3))
    return slots, shapes, counts


def _pooled(slots, shapes, counts, vectors: np.ndarray) -> np.ndarray:
    """Document vectors: mean word vector, mean shape, share of repeated tokens, length."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    total = np.zeros((n, WIDTH))
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    if len(full):
        total[full] = np.add.reduceat(vectors[slots], begin, axis=0)
    shape = np.bincount(owner * 32 + shapes, minlength=n * 32).reshape(n, 32)
    again = np.zeros(len(slots), bool)
    for gap in (1, 2):
        again[gap:] |= (slots[gap:] == slots[:-gap]) & (owner[gap:] == owner[:-gap])
    repeats = np.bincount(owner[again], minlength=n)
    size = np.maximum(counts, 1)[:, None]
    return np.hstack([total / size, shape / size, repeats[:, None] / size, np.log1p(counts)[:, None] / 10])


def _add_neighbours(sums: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
    """Adds to each token's slot the index vectors of its neighbours within two tokens of the same text."""
    index, owner = _index(), np.repeat(np.arange(len(counts)), counts)
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        left, right = slots[:-gap][same], slots[gap:][same]
        np.add.at(sums, left, index[right])
        np.add.at(sums, right, index[left])


def _word_vectors(vectors: np.ndarray) -> np.ndarray:
    """Index vectors plus the neighbours' sums of the sample, scaled to length one."""
    index = _index()
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    mixed = index / np.sqrt(SIGNS) + vectors / np.maximum(norm, 1e-6)
    return (mixed / np.maximum(np.linalg.norm(mixed, axis=1, keepdims=True), 1e-6)).astype(np.float32)


@dataclass
class Network:
    """Two layers over scaled document vectors, with a temperature; ``share`` alone if nothing was learned."""

    share: float = 0.5
    vectors: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple | None = None
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.share)
        slots, shapes, counts = tokens(data, offsets)
        return _sigmoid(self.logits(_pooled(slots, shapes, counts, self.vectors)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(features: np.ndarray, labels: np.ndarray, network: Network) -> None:
    """Adam on the log loss of most rows; the temperature on every fifth."""
    aside = np.arange(len(labels)) % 5 == 4
    rng = np.random.default_rng(SEED)
    network.centre, network.scale = features[~aside].mean(0), features[~aside].std(0) + 1e-3
    x, y = (features[~aside] - network.centre) / network.scale, labels[~aside]
    width = x.shape[1]
    params = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // 256)):
            step += 1
            hidden = np.tanh(x[rows] @ params[0] + params[1])
            error = (_sigmoid(hidden @ params[2] + params[3]) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            slopes = [x[rows].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], error.sum()]
            for k, slope in enumerate(slopes):
                first, second = moments[k]
                moments[k] = [0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2]
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[k] = params[k] - rate * moments[k][0] / (np.sqrt(moments[k][1]) + 1e-8)
    network.weights = tuple(params)
    if aside.any():
        logits, y = network.logits(features[aside]), labels[aside]
        losses = {t: -np.log(np.where(y > 0, _sigmoid(logits / t), _sigmoid(-logits / t))).mean() for t in np.geomspace(0.25, 8, 41)}
        network.temperature = float(min(losses, key=losses.get))


def _neighbour_sums(sample: DataFrame) -> np.ndarray:
    """Per slot the sum of its neighbours' index vectors over all whole texts; one partial table a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SLOTS, WIDTH))
        for batch in batches:
            for block in text_blocks(batch):
                slots, _, counts = tokens(*text_bytes(text_of(block)))
                _add_neighbours(sums, slots, counts)
        used = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(used), *[pa.array(sums[used, k]) for k in range(WIDTH)]]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", *(f"v{k}" for k in range(WIDTH))])

    columns = [f"v{k}" for k in range(WIDTH)]
    parts = sample.select("text").mapInArrow(run, "slot long, " + ", ".join(f"{c} double" for c in columns))
    found = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # at most SLOTS rows, whole numbers
    out = np.zeros((SLOTS, WIDTH))
    out[found.column("slot").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    return out


def _pooled_rows(sample: DataFrame, vectors: np.ndarray) -> DataFrame:
    """The key columns of ``sample`` and its document vectors, from whole texts."""
    shared = sample.sparkSession.sparkContext.broadcast(vectors)
    keys = [c for c in sample.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pooled = _pooled(*tokens(*text_bytes(text_of(batch))), shared.value)
        rows = pa.array(list(pooled), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], rows], names=[*keys, "features"])

    schema = T.StructType([*[sample.schema[c] for c in keys], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return map_texts(sample, run, schema)


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Network:
    """A network from the whole texts of a bounded sample of the labelled rows of ``documents``."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    order = ["__hash", "doc_id", "label", "__text_hash"]
    picked = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    picked = picked.withColumn("__hash", F.xxhash64("doc_id")).withColumn("__text_hash", F.xxhash64("text"))
    # rows dealt by a number of their own: equal ids and texts spread too
    sample = written(picked.withColumn("__row", F.monotonically_increasing_id()).repartition("__row"), "quality-sample")
    last = sample.select(*order).orderBy(*order).limit(2 * rows).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last")).first()
    if last["n"] == 2 * rows:  # documents of equal ids beyond the bound
        sample = sample.where(F.struct(*order) <= F.struct(*[F.lit(last["last"][c]).cast(sample.schema[c].dataType) for c in order]))
    classes = sample.agg(F.avg("label").alias("share"), F.count_distinct("label").alias("n")).first()
    if classes["n"] < 2:
        return Network(0.5 if classes["share"] is None else float(classes["share"]))
    vectors = _word_vectors(_neighbour_sums(sample))
    found = _pooled_rows(sample, vectors).orderBy(*order, "__row").limit(2 * rows).select("label", "features").toArrow().combine_chunks()
    y = found.column("label").to_numpy()
    features = found.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    network = Network(float(y.mean()), vectors)
    _fit(features, y, network)
    return network


def scored(documents: DataFrame, network: Network) -> DataFrame:
    """``row`` (all columns) and ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*text_bytes(text_of(batch)))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    rows = as_row(documents)
    return map_texts(rows, run, row_schema(rows, "score double"))


def held_out_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the probability of label 1, learned from labels of rows that are not held out."""
    network = learn(documents, labels.where(remainder("doc_id", 3) != 1))
    out = scored(documents.select("doc_id", "text"), network).select("row.doc_id", "score")
    return out.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Near duplicates: a Jaccard join on word n-grams by MinHash banding.

Words are lower-cased runs between white space, a text's n-grams its runs of five words (all its words
where it has fewer). Texts of the same n-gram set form a class and one row speaks for it. Band and row
counts follow from the similarity and the recall wanted. Rows are shuffled on their band hashes; rows
that share one are tied to the least of their bucket, and the components of these ties are clusters
outside of which no pair shares a band. The texts of a cluster meet once, in pairs of blocks of at most
``BLOCK`` rows, where every pair that shares a band is verified on full n-gram sets. What leaves a block
pair is one count per row and a spanning forest of its links, never the pairs themselves.

Cases: a null, empty or blank text has no n-gram and links to nothing, not even to another one. A null
``doc_id`` comes after any number; a class of nulls only has a null id. Rows with equal ids are rows of
their own. Extra columns pass through ``distinct_rows`` untouched. Empty tables give empty results.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, row_schema, text_bytes, text_of, written
from convfeat.llm.graph import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
HASHES = 128
BLOCK = 512
CLASS = ["set1", "set2", "n_grams"]

_RANDOM = np.random.default_rng(977)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_GRAM = _RANDOM.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence fewest false candidates, that reach the recall within the hashes."""
    for rows in range(hashes, 1, -1):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


BANDS, ROWS = banding()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, and how many each has."""
    rows = len(offsets) - 1
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    counts = np.searchsorted(starts, offsets)
    counts = np.diff(counts)
    inside = np.cumsum(first) - 1
    at = np.arange(len(data)) - starts[np.maximum(inside, 0)]
    values = _BYTE[_LOWER[data]] * _PLACE[at & 63] + (at.astype(np.uint64) >> np.uint64(6))
    words = _mix(np.add.reduceat(np.where(word, values, np.uint64(0)), starts))
    owner = np.repeat(np.arange(rows), counts)
    grams = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        same = owner[k:] == owner[: len(owner) - k]
        grams[: len(words) - k] += np.where(same, words[k:] * _GRAM[k], np.uint64(0))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = (left >= WORDS) | (place == 0)
    grams, owner = _mix(grams[whole]), owner[whole]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=rows)


def _sketch(bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = gram_sets(*text_bytes(text_of(batch)))
        full = np.flatnonzero(counts)
        begin = (np.cumsum(counts) - counts)[full]
        sets = np.zeros((2, batch.num_rows), np.uint64)
        hashed = np.zeros((batch.num_rows, bands), np.uint64)
        if len(full):
            sets[0, full] = np.add.reduceat(grams, begin)
            sets[1, full] = np.add.reduceat(_mix(grams + np.uint64(1)), begin)
            for band in range(bands):
                key = np.full(len(full), band + 1, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    least = np.minimum.reduceat((grams * _MULTIPLY[k] + _ADD[k]) >> np.uint64(24), begin)
                    key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + least)
                hashed[full, band] = key
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()), pa.array(hashed.ravel().view(np.int64))
        )
        arrays = [batch.column("row"), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64))]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(counts.astype(np.int64)), lists], names=["row", "set1", "set2", "n_grams", "bands"]
        )

    return run


def links(sets: list[np.ndarray], bands: np.ndarray, weight: np.ndarray, side: np.ndarray | None, least: float):
    """Pairs of rows that share a band and are similar enough: weights linked to each row, and a spanning forest.

    ``side`` keeps pairs between its two values only, None takes all pairs.
    """
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    count, linked = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    parent, forest = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    marked = np.zeros(len(values), bool)
    for a in range(len(sets) - 1):
        share = (bands[a + 1 :] == bands[a]).any(1)
        if side is not None:
            share &= side[a + 1 :] != side[a]
        others = np.flatnonzero(share) + a + 1
        others = others[np.minimum(sizes[others], sizes[a]) >= least * np.maximum(sizes[others], sizes[a])]
        if not len(others):
            continue
        own = ids[begin[a] : begin[a] + sizes[a]]
        marked[own] = True
        take = np.repeat(begin[others] - (np.cumsum(sizes[others]) - sizes[others]), sizes[others]) + np.arange(sizes[others].sum())
        common = np.add.reduceat(marked[ids[take]], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        marked[own] = False
        near = others[common >= least * (sizes[a] + sizes[others] - common) - 1e-9]
        count[a] += weight[near].sum()
        count[near] += weight[a]
        linked[a] += len(near)
        linked[near] += 1
        for b in near.tolist():
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((a, b))
    return count, linked, forest


def _verify(least: float):
    def run(table: pa.Table) -> pa.Table:
        rids = table.column("rid").to_numpy()
        grams, counts = gram_sets(*text_bytes(table.column("text")))
        ends = np.cumsum(counts)
        sets = np.split(grams, ends[:-1])
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        side = table.column("side").to_numpy() if table.column("mixed")[0].as_py() else None
        count, linked, forest = links(sets, bands, table.column("size").to_numpy(), side, least)
        some = np.flatnonzero(linked)
        pairs = np.array(forest, np.int64).reshape(-1, 2)
        none = np.zeros(len(pairs), np.int64)
        return pa.table(
            {
                "rid": np.concatenate([rids[some], rids[pairs[:, 0]]]),
                "other": pa.array(np.concatenate([rids[some], rids[pairs[:, 1]]]), mask=np.arange(len(some) + len(pairs)) < len(some)),
                "n_links": np.concatenate([count[some], none]),
                "n_class_links": np.concatenate([linked[some], none]),
            }
        )

    return run


def _rows_and_links(documents: DataFrame, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows under a row id; and per row id its class, its component's root and its links."""
    bands, rows = banding(similarity, recall)
    given = as_row(documents)
    fields = "set1 long, set2 long, n_grams long, bands array<long>"
    texts = map_texts(given, _sketch(bands, rows), row_schema(given, fields))
    texts = written(texts.withColumn("rid", F.monotonically_increasing_id()), "sketches")
    marks = texts.select("rid", "row.doc_id", *CLASS)
    classes = written(
        texts.where("n_grams > 0").groupBy(*CLASS).agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = keys.join(shared.drop("n"), "bucket").select(F.col("rep").alias("a"), "b")
    tied = components(ties)
    roots = tied.select(F.col("root").alias("node"), "root").distinct()
    members = tied.unionByName(roots).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    blocks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.join(classes.select("rep", "size", "bands"), "rep").withColumnRenamed("rep", "rid")
    met = texts.select("rid", F.col("row.text").alias("text")).join(placed, "rid")
    # block i meets every block j; both lie under (lower, higher), and a block meets itself once
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    met = met.select("cluster", low.alias("low"), high.alias("high"), "rid", "text", "bands", "size", F.col("own").alias("side"), (F.col("own") != F.col("with")).alias("mixed"))
    found = written(
        met.groupBy("cluster", "low", "high").applyInArrow(_verify(similarity), "rid long, other long, n_links long, n_class_links long"),
        "links",
    )
    counted = found.where("other is null").groupBy(F.col("rid").alias("rep")).agg(F.sum("n_links").alias("n_links"), F.sum("n_class_links").alias("n_class_links"))
    joined = components(found.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    grouped = (
        classes.select(*CLASS, "rep", "size")
        .join(counted, "rep", "left")
        .join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select(
            *CLASS,
            F.coalesce("root", "rep").alias("root"),
            F.col("size").alias("class_size"),
            (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"),
        )
    )
    placed_rows = marks.where("n_grams > 0").join(grouped, CLASS)
    alone = marks.where("n_grams = 0").select(
        *CLASS, "rid", "doc_id", F.col("rid").alias("root"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_class_links"),
    )
    return texts, written(placed_rows.unionByName(alone), "groups")


def _first_row() -> F.Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Every row of ``documents`` (``doc_id``, ``text``) with its group of linked rows and its number of links.

    ``class_id`` is the least ``doc_id`` of all rows that links connect, ``copy_id`` that of the rows with
    the same n-gram set. ``n_links`` counts other rows that are similar enough, ``n_class_links`` other sets.
    """
    _, rows = _rows_and_links(documents.select("doc_id", "text"), similarity, recall, block)
    groups = rows.groupBy("root").agg(_first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
    copies = rows.where("n_grams > 0").groupBy(*CLASS).agg(_first_row().alias("copy"))
    out = rows.join(groups, "root").join(copies, CLASS, "left")
    return out.select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "group_size",
        F.when(F.col("copy").isNull(), F.col("doc_id")).otherwise(F.col("copy.doc_id")).alias("copy_id"), "n_links", "n_class_links",
    )


def distinct_rows(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``documents`` with all columns, of each group of linked rows the one of least ``doc_id``."""
    texts, rows = _rows_and_links(documents, similarity, recall, block)
    groups = rows.groupBy("root").agg(_first_row().alias("first"))
    dropped = written(rows.join(groups, "root").where("rid <> first.rid").select("rid"), "dropped")
    return texts.join(dropped, "rid", "left_anti").select("row.*")

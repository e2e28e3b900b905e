"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where the hash is the least of the ``REACH`` bytes on
either side, so borders depend on nearby bytes only and come back right after an insertion. Chunks are
known by a 128-bit digest. Of equal chunks the earliest stays (smallest ``doc_id``, then the place in the
text); later ones are repeats. Neighbouring repeats form a run, and runs of ``LEAST_RUN`` bytes or more
are removed, so a chance match of one short chunk is not.

Cases: a null or empty text has no chunk. A null ``doc_id`` comes after any number; of rows with equal ids
the one read first counts as smaller. Extra columns pass through ``deduplicated_rows`` untouched. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, row_schema, text_bytes, text_of, written

REACH = 24
LEAST_RUN = 48
_GEAR = np.random.default_rng(2718).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
ROLLED = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash over the last ``ROLLED`` bytes: each byte's number, shifted once for every byte since."""
    out, size = _GEAR[data], 1
    while size < ROLLED:
        older = np.zeros_like(out)
        older[size:] = out[:-size]
        out = out + (older << np.uint32(size))
        size *= 2
    return (out * np.uint32(2654435761)) ^ (out >> np.uint32(15))


def chunk_ends(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Ends of all chunks; every text with bytes ends one. A tie goes to the first of equal hashes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    top = np.uint32(0xFFFFFFFF)
    hashes = np.concatenate([np.full(reach, top), gear(data), np.full(reach, top)])

    def least(values: np.ndarray, span: int) -> np.ndarray:
        size = 1
        while size * 2 <= span:
            values = np.minimum(values[:-size], values[size:])
            size *= 2
        return np.minimum(values[: len(values) - (span - size)], values[span - size :]) if span > size else values

    sides = least(hashes, reach)
    border = (hashes[reach : reach + n] < sides[:n]) & (hashes[reach : reach + n] <= sides[reach + 1 : reach + 1 + n])
    # a border within reach of another text's bytes would depend on that text
    near = np.zeros(n + 1, np.int64)
    for edge, sign in ((offsets[:-1], 1), (np.minimum(offsets[:-1] + reach + ROLLED, offsets[1:]), -1)):
        np.add.at(near, edge, sign)
    for edge, sign in ((np.maximum(offsets[1:] - reach, offsets[:-1]), 1), (offsets[1:], -1)):
        np.add.at(near, edge, sign)
    border &= np.cumsum(near)[:n] == 0
    ends = np.flatnonzero(border) + 1
    return np.unique(np.concatenate([ends, offsets[1:][np.diff(offsets) > 0]]))


def _chunked(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(text_of(batch))
    ends = chunk_ends(data, offsets)
    counts = np.diff(np.searchsorted(ends, offsets, "right"))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    view = memoryview(data)
    digest = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    pair = np.frombuffer(digest, np.int64)
    base = np.repeat(offsets[:-1], counts)
    lists = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    items = pa.StructArray.from_arrays(
        [pa.array(pair[::2]), pa.array(pair[1::2]), pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))],
        names=["d1", "d2", "start", "end"],
    )
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(lists, items)], names=["row", "n_bytes", "chunks"]
    )


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for repeats in batch.column("repeats").to_pylist():
                runs: list[list] = []
                for r in sorted(repeats or [], key=lambda r: r["start"]):
                    if runs and runs[-1][1] == r["start"]:
                        runs[-1][1] = r["end"]
                        runs[-1][2].append(r["first"])
                    else:
                        runs.append([r["start"], r["end"], [r["first"]]])
                runs = [r for r in runs if r[1] - r[0] >= least]
                firsts = sorted({x for r in runs for x in r[2] if x is not None})
                out.append((sum(len(r[2]) for r in runs), sum(r[1] - r[0] for r in runs), [{"start": r[0], "end": r[1]} for r in runs], firsts))
            chunks, size, spans, firsts = zip(*out)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"), batch.column("doc_id"), batch.column("n_bytes"), batch.column("n_chunks"),
                    pa.array(chunks, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "runs", "first_doc_ids"],
            )

    return run


def _repeats(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The rows under a row id; and per row id the runs of repeated chunks."""
    rows = as_row(documents)
    fields = "n_bytes long, chunks array<struct<d1:long,d2:long,start:int,end:int>>"
    texts = written(map_texts(rows, _chunked, row_schema(rows, fields)).withColumn("rid", F.monotonically_increasing_id()), "chunks")
    chunks = texts.select("rid", F.col("row.doc_id").alias("doc_id"), F.explode("chunks").alias("c")).select("rid", "doc_id", "c.*")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start")
    shared = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = chunks.join(shared, ["d1", "d2"]).where("not (rid = first.rid and start = first.start)")
    found = later.groupBy("rid").agg(F.collect_list(F.struct("start", "end", F.col("first.doc_id").alias("first"))).alias("repeats"))
    every = texts.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", F.size("chunks").cast("long").alias("n_chunks"))
    schema = "rid long, doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, "
    schema += "runs array<struct<start:long,end:long>>, first_doc_ids array<long>"
    return texts, every.join(found, "rid", "left").mapInArrow(_runs(least), schema)


def repeated_passages(documents: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """Per row of ``documents`` (``doc_id``, ``text``): chunks, repeated ones, removed bytes and runs, and first holders' ids."""
    _, found = _repeats(documents.select("doc_id", "text"), least)
    return found.drop("rid")


def deduplicated_rows(documents: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """``documents`` with all columns, repeated runs cut out of ``text`` (split characters are dropped)."""
    texts, found = _repeats(documents, least)
    rows = texts.select("rid", "row").join(found.select("rid", "runs"), "rid").select("row", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(text_of(batch).to_pylist(), batch.column("runs").to_pylist()):
                data = (text or "").encode()
                bounds = [0, *(x for r in runs for x in (r["start"], r["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out.append(None if text is None else kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "kept_text"])

    made = rows.mapInArrow(run, row_schema(rows, "kept_text string"))
    return made.select(*[F.col("kept_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def passage_digests(documents: DataFrame) -> DataFrame:
    """``repeated_passages`` with its runs as text."""
    spans = F.expr("array_join(transform(runs, r -> concat(r.start, ':', r.end)), ',')")
    return repeated_passages(documents).withColumn("n_spans", F.size("runs").cast("long")).withColumn("spans", spans).drop("runs")

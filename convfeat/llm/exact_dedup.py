"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its bytes modulo four primes. Every chunk of a text is hashed
by itself; chunk hashes combine by shifting each by the length before it, so a huge text is hashed as
parallel chunks. Texts of equal fingerprint are compared chunk by chunk with one text of their class.

Cases: a null text counts as empty, and empty texts are equal to each other. A null ``doc_id`` stays
behind any number and is kept last. Of rows that tie in length and ``doc_id`` one stays. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, per_row, row_schema, text_bytes, text_of, written

CHUNK = 4096
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1193276557, 815160719, 1846371793, 402653171)
#: Bytes that do not count when texts are compared: 0x20 and 0x09-0x0D.
SPACES = (9, 10, 11, 12, 13, 32)
CLASS = ["fp1", "fp2", "n_bytes", "level"]
MEMBERS_PER_SALT = 512


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base % prime
    return out


POWERS = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]


def combine(left: tuple[int, int], right: tuple[int, int], which: int = 0) -> tuple[int, int]:
    """(hash, length) of a concatenation from those of its parts, modulo one of the primes."""
    prime = PRIMES[which]
    return (left[0] + right[0] * pow(BASES[which], left[1], prime)) % prime, left[1] + right[1]


def fingerprints(data: np.ndarray, offsets: np.ndarray, primes: tuple[int, ...] = PRIMES) -> np.ndarray:
    """(rows, primes) hashes: sum of (byte + 1) * base ** place."""
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = offsets[:-1][owner] + number * CHUNK
    out = np.zeros((len(lengths), len(primes)), np.uint64)
    if not len(starts):
        return out
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = data.astype(np.uint64) + np.uint64(1)
    full = np.flatnonzero(chunks)
    first = (np.cumsum(chunks) - chunks)[full]
    for k, prime in enumerate(primes):
        p = np.uint64(prime)
        powers = POWERS[k] if prime == PRIMES[k] else _powers(BASES[k], prime, CHUNK)
        hashes = np.add.reduceat(values * powers[place], starts) % p
        shifts = _powers(pow(BASES[k], CHUNK, prime), prime, int(chunks.max()))
        out[full, k] = np.add.reduceat(hashes * shifts[number] % p, first) % p
    return out


def _prints(primes: tuple[int, ...]):
    spaces = np.zeros(256, bool)
    spaces[list(SPACES)] = True

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(text_of(batch))
        keep = ~spaces[data]
        places = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=places[1:])
        body, ends = data[keep], places[offsets]
        view = memoryview(body)
        marks = fingerprints(body, ends, primes).astype(np.int64)
        digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(per_row((data & 0xC0) != 0x80, offsets)),
                pa.array(np.diff(ends)),
                pa.array(marks[:, 0] << 31 | marks[:, 1 % len(primes)]),
                pa.array(marks[:, 2 % len(primes)] << 31 | marks[:, 3 % len(primes)]),
                pa.array(digests, pa.string()),
            ],
            names=["row", "n_points", "n_bytes", "fp1", "fp2", "text_sha256"],
        )

    return prints


def _different(batches):
    """Ids of rows whose normalised text differs from their class's, found chunk by chunk."""
    for batch in batches:
        out = []
        for rid, text, other in zip(*(batch.column(n) for n in ("rid", "text", "rep_text"))):
            a, b = ((x.as_py() or "").encode().translate(None, bytes(SPACES)) for x in (text, other))
            if len(a) != len(b) or any(a[i : i + CHUNK] != b[i : i + CHUNK] for i in range(0, len(a), CHUNK)):
                out.append(rid.as_py())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["rid"])


def _mismatches(texts: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rid`` of rows that share a fingerprint with their class's first row but not its text.

    A class of any size is compared in salted parts, each with its own copy of the one text.
    """
    shared = classes.where("size > 1").withColumn("salts", F.expr(f"bigint(ceil(size / {MEMBERS_PER_SALT}))"))
    tags = rows.join(shared, CLASS).select(
        "rid", *CLASS, "rep_rid", "salts", F.pmod(F.hash("rid"), F.col("salts")).cast("int").alias("salt")
    )
    members = written(texts.select("rid", F.col("row.text").alias("text")).join(tags, "rid"), "members")
    reps = members.where("rid = rep_rid").select(
        *CLASS, F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), F.col("text").alias("rep_text")
    )
    pairs = members.where("rid <> rep_rid").join(reps, [*CLASS, "salt"])
    return pairs.select("rid", "text", "rep_text").mapInArrow(_different, "rid long")


def _classed(documents: DataFrame, primes: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows under a row id, and each row id with its class, which rows of equal text share."""
    rows = as_row(documents)
    fields = "n_points long, n_bytes long, fp1 long, fp2 long, text_sha256 string"
    made = map_texts(rows, _prints(primes), row_schema(rows, fields))
    texts = written(made.withColumn("rid", F.monotonically_increasing_id()), "prints")
    marks = texts.select("rid", "row.doc_id", "n_points", "n_bytes", "fp1", "fp2", "text_sha256").withColumn("level", F.lit(0))
    level = 0
    while True:
        classes = marks.groupBy(*CLASS).agg(
            F.count(F.lit(1)).alias("size"),
            F.min("rid").alias("rep_rid"),
            F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"),
        )
        wrong = written(_mismatches(texts, marks.where(F.col("level") == level), classes), "mismatches")
        if wrong.isEmpty():
            break
        level += 1
        moved = marks.join(wrong.withColumn("moved", F.lit(True)), "rid", "left")
        moved = moved.withColumn("level", F.when(F.col("moved"), level).otherwise(F.col("level"))).drop("moved")
        marks = written(moved, "levels")
    stays = classes.select(*CLASS, F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "size")
    return texts, marks.join(stays, CLASS)


def exact_duplicates(documents: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Every row of ``documents`` (``doc_id``, ``text``) with the row that stays for its text.

    ``primes`` are the moduli of the fingerprints; fewer or smaller ones only cost more comparisons.
    """
    _, classed = _classed(documents.select("doc_id", "text"), primes)
    return classed.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def kept_rows(documents: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """``documents`` with all its columns, one row of each text."""
    texts, classed = _classed(documents, primes)
    dropped = written(classed.where("rid <> keep_rid").select("rid"), "dropped")
    return texts.join(dropped, "rid", "left_anti").select("row.*")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
w AS (
  SELECT doc_id, body, row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM w
"""

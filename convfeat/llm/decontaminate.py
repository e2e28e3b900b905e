"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Texts become their lower-cased words with one blank before and after each word. A pattern is a window
of ten consecutive words of a benchmark item, or a whole item of fewer words. Per class of pattern
lengths a shift table over blocks of bytes says how far a search may skip; where it says zero, the
bucket of that block's hash selects the patterns that may occur, and bytes are compared directly.
Many stretches of text are searched in lockstep with numpy.

Cases: a null or wordless text has no words and is never hit; a null or wordless item gives no window;
an item with a null id marks words but is not counted or listed. Rows with equal ids are rows of their
own; items with equal ids count once. Extra columns pass through untouched. Empty tables give no hits.
A benchmark larger than ``BLOCK_OF_ITEMS`` bytes is searched in blocks, one pass over the documents
for each, so what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, row_schema, text_bytes, text_of, written

WINDOW = 10
#: Most bytes of benchmark text that are held by the driver and each worker at once.
BLOCK_OF_ITEMS = 8 << 20
#: Bytes of text that one lane of the search covers.
LANE = 2048
TABLE_BITS = 18
BLANK = 32

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as `` w1 w2 ... wn `` each; the bytes, the place of each word's blank, words per row."""
    lower = _LOWER[data]
    word = _WORD[lower]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    first = word & ~before
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=words[1:])
    per_text = words[offsets[1:]] - words[offsets[:-1]]
    # a byte moves by the word bytes before it, one blank for each word up to it, one for each text ended
    body = lower[word]
    starts = np.flatnonzero(first[word])
    text_of_word = np.repeat(np.arange(len(per_text)), per_text)
    blanks = starts + np.arange(len(starts)) + text_of_word
    ends = np.cumsum(per_text)
    size = len(body) + len(starts) + len(per_text)
    out = np.full(size + 8, BLANK, np.uint8)
    shift = np.zeros(len(body), np.int64)
    shift[starts] = 1
    shift[starts[np.diff(text_of_word, prepend=0) > 0]] += np.diff(text_of_word, prepend=0)[np.diff(text_of_word, prepend=0) > 0]
    out[np.arange(len(body)) + np.cumsum(shift)] = body
    return out[:size], blanks, np.diff(np.concatenate([[0], ends]))


def windows(text: str | None) -> list[bytes]:
    """The patterns of one item."""
    data, offsets = text_bytes(pa.array([text], pa.string()))
    out, blanks, _ = normal_words(data, offsets)
    raw, marks = out.tobytes(), [*blanks.tolist(), len(out) - 1]
    if len(marks) == 1:
        return []
    return [raw[marks[i] : marks[min(i + WINDOW, len(marks) - 1)] + 1] for i in range(max(1, len(marks) - WINDOW))]


@dataclass
class Group:
    """Patterns of similar length with the tables of their search."""

    least: int
    width: int
    shift: np.ndarray = field(repr=False)
    buckets: dict[int, list[tuple[bytes, int]]] = field(repr=False)


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` bytes as a number."""
    kind = np.dtype(f"<u{width}")
    if len(data) < width:
        return np.zeros(0, kind)
    return np.ndarray((len(data) - width + 1,), kind, buffer=data, strides=(1,))


def _slot(blocks: np.ndarray) -> np.ndarray:
    return ((blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build(patterns: list[bytes]) -> list[Group]:
    """Search tables for distinct patterns, one group for each power of two of their lengths."""
    sorted_out = defaultdict(list)
    for number, pattern in enumerate(patterns):
        sorted_out[min(len(pattern).bit_length(), 6)].append((pattern, number))
    groups = []
    for members in sorted_out.values():
        least = min(len(p) for p, _ in members)
        width = 8 if least >= 16 else 4 if least >= 6 else 2
        shift = np.full(1 << TABLE_BITS, least - width + 1, np.int32)
        buckets = defaultdict(list)
        for pattern, number in members:
            slots = _slot(_blocks(np.frombuffer(pattern[:least], np.uint8), width))
            np.minimum.at(shift, slots, np.arange(len(slots) - 1, -1, -1, dtype=np.int32))
            buckets[int(slots[-1])].append((pattern, number))
        groups.append(Group(least, width, shift, dict(buckets)))
    return groups


def search(data: np.ndarray, groups: list[Group]) -> list[tuple[int, int]]:
    """(start, pattern number) of every occurrence."""
    found, raw = [], data.tobytes()
    for group in groups:
        blocks = _blocks(data, group.width)
        # a lane looks for the windows that start in its stretch; at ``place`` stands a window's last block
        lead = group.least - group.width
        begin = np.arange(0, max(0, len(data) - group.least + 1), LANE)
        place, stop = begin + lead, np.minimum(begin + LANE + lead, len(data) - group.width + 1)
        while len(place):
            slots = _slot(blocks[place])
            skip = group.shift[slots]
            for at, slot in zip(place[skip == 0].tolist(), slots[skip == 0].tolist()):
                start = at - lead
                for pattern, number in group.buckets.get(slot, ()):
                    if raw.startswith(pattern, start):
                        found.append((start, number))
            place = place + np.maximum(skip, 1)
            going = place < stop
            place, stop = place[going], stop[going]
    return found


def _searcher(shared):
    """Adds, per row, the hit word ranges and the ids of items that occur, to those found so far."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, lengths, owners = shared.value
        data, offsets = text_bytes(text_of(batch))
        body, blanks, per_text = normal_words(data, offsets)
        ends = np.cumsum(per_text)
        hits, items = defaultdict(list), defaultdict(set)
        occurrences = search(body, groups)
        words = np.searchsorted(blanks, [start for start, _ in occurrences])
        rows = np.searchsorted(ends, words, "right")
        for (_, number), word, row in zip(occurrences, words.tolist(), rows.tolist()):
            hits[row].append((word - int(ends[row] - per_text[row]), lengths[number]))
            items[row].update(owners[number])
        before = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [[]] * batch.num_rows
        named = batch.column("items").to_pylist() if "hits" in batch.schema.names else [[]] * batch.num_rows
        spans, n_hit = [], []
        for i in range(batch.num_rows):
            merged = []
            for start, size in sorted([(x["start"], x["size"]) for x in before[i]] + hits.get(i, [])):
                if merged and start <= merged[-1]["start"] + merged[-1]["size"]:
                    merged[-1]["size"] = max(merged[-1]["size"], start + size - merged[-1]["start"])
                else:
                    merged.append({"start": start, "size": size})
            spans.append(merged)
            n_hit.append(sum(x["size"] for x in merged))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(per_text.astype(np.int64)),
                pa.array(n_hit, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))),
                pa.array([sorted(items.get(i, set()) | set(named[i])) for i in range(batch.num_rows)], pa.list_(pa.string())),
            ],
            names=["row", "n_words", "n_hit", "hits", "items"],
        )

    return run


def marked(documents: DataFrame, benchmark: DataFrame, block_of_items: int = BLOCK_OF_ITEMS) -> DataFrame:
    """``row`` (all columns), ``n_words``, ``n_hit``, ``hits`` (start, size in words), ``items`` (ids as text)."""
    spark = documents.sparkSession
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    volume, longest = named.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    # a block holds twice its share at most but for chance; one item longer than a block is a block of its own
    count = max(1, -(-2 * (volume or 0) // max(block_of_items, longest or 0))) if (volume or 0) > block_of_items else 1
    out = as_row(documents)
    fields = "n_words long, n_hit long, hits array<struct<start:long,size:long>>, items array<string>"
    for k in range(count):
        owners = defaultdict(set)
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else named
        for item, text in part.collect():
            for pattern in windows(text):
                owners[pattern].update([item] if item is not None else [])
        patterns = list(owners)
        lengths = [p.count(b" ") - 1 for p in patterns]
        shared = spark.sparkContext.broadcast((build(patterns), lengths, [sorted(owners[p]) for p in patterns]))
        out = map_texts(out, _searcher(shared), row_schema(out, fields))
        if k < count - 1:
            out = written(out, "searched")
    return out


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the number of hit words and the items that occur."""
    return marked(documents.select("doc_id", "text"), benchmark).select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with all columns, without those that hold any benchmark window."""
    return marked(documents, benchmark).where("n_hit = 0").select("row.*")


NO_ITEMS_SHA256 = hashlib.sha256(b"").hexdigest()

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM pats),
wins AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, i, item_id FROM wins JOIN pats USING (k, p)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

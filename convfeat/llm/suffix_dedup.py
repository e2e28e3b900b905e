"""Removal of repeated substrings with suffix arrays.

A byte goes if a ``width``-byte string that covers it also starts earlier: in a smaller ``doc_id``, or
further ahead in the same text. Strings are judged on the input, and never cross texts.

Equal strings must meet to be compared. Each window of ``width`` bytes has a mark, the least hash among
its ``GRAM``-byte grams, which equal windows share; windows in a row that share a mark form a piece.
Only pieces whose mark occurs more than once, about one piece per 35 bytes there, are shuffled by their
mark into shards of bounded size. A shard sorts its distinct pieces' suffixes by Larsson and Sadakane's
refinement (groups already told apart are left alone), finds the common prefixes of neighbours by
Kasai's method, in lockstep over pieces, and marks all but the earliest of each run that shares
``width`` bytes. A mark with very many pieces is spread over several shards; these send the earliest
window of each run on, and equal windows of several shards are merged by binary search among sorted
digests.

Texts are written once, bucketed by blocks of bounded size, and each later step joins to a block what
concerns it, without a shuffle of texts. Within a block a mark is one row, so no mark is hot.

Cases: a null text counts as empty; texts shorter than ``width`` keep all bytes. A null ``doc_id`` comes
after any number, and of rows with equal ids the one read first counts as smaller. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convfeat.llm.common import table_blocks, text_bytes, text_of, written

WIDTH = 100
GRAM = 32
BLOCK_OF_TEXT = 8 << 20
SHARD_BYTES = 3 << 20
PIECES_PER_SALT = 16_000
LONGEST_PIECE = 256
_RANDOM = np.random.default_rng(4711)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_STEP = _RANDOM.integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)


# ---- marks ---------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of ``gram`` bytes (a power of two)."""
    grams, size, level = _BYTE[data], 1, 0
    while size < gram:
        grams = grams[:-size] * _STEP[level] + grams[size:]
        size, level = size * 2, level + 1
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return grams ^ (grams >> np.uint64(29))


def window_marks(grams: np.ndarray, span: int) -> np.ndarray:
    """The mark of each window: the least of the ``span`` hashes in it."""
    least, size = grams, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (span - size)], least[span - size :]) if span > size else least


def times_inside(grams: np.ndarray, span: int, marks: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often each piece's mark occurs in it; twice, as in a periodic text, it may repeat windows of its own."""
    reach = size + span - 1
    heads = np.cumsum(reach) - reach
    take = np.arange(int(reach.sum())) + np.repeat(begin - heads, reach)
    if not len(take):
        return np.zeros(0, np.int64)
    return np.add.reduceat(grams[take].view(np.int64) == np.repeat(marks, reach), heads, dtype=np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM, counted: bool = False):
    """(mark, row, first window, number of windows) of runs of windows with one mark, cut at ``LONGEST_PIECE``; if asked, how often the mark occurs."""
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams, span = gram_hashes(data, gram), width - gram + 1
    marks = window_marks(grams, span)
    row = np.searchsorted(offsets, np.arange(len(marks)), "right") - 1
    fits = np.arange(len(marks)) + width <= offsets[row + 1]
    first = fits.copy()
    first[1:] &= (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    # runs end where the next begins or where windows stop fitting
    stops = np.append(starts[1:], len(marks))
    last = np.searchsorted(offsets, starts, "right")
    stops = np.minimum(stops, offsets[last] - width + 1)
    sizes = stops - starts
    cuts = -(-sizes // LONGEST_PIECE)
    owner = np.repeat(np.arange(len(starts)), cuts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = starts[owner] + at * LONGEST_PIECE
    size, mark = np.minimum(sizes[owner] - at * LONGEST_PIECE, LONGEST_PIECE), marks[begin].view(np.int64)
    times = times_inside(grams, span, mark, begin, size) if counted else None
    return mark, row[begin], begin, size, times


# ---- suffix arrays ---------------------------------------------------------------------


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Places at which a ``width``-byte string starts within a piece, sorted by that string.

    ``rank`` numbers the groups of places equal in ``h`` bytes. Each round doubles ``h`` (the last one
    overlaps) and sorts only places whose group has more than one member.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    room = np.repeat(ends, ends - starts) - np.arange(n)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    h = 8
    while h < width:
        step = min(h, width - h)
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero((sizes[rank] > 1) & (room >= h + step))
        if not len(open_):
            break
        # places short of room cannot start a window or be a part of one; they stay behind their group
        both = rank[open_] * (n + 1) + rank[open_ + step]
        sub = np.argsort(both)
        both = both[sub]
        fresh = np.ones(len(sub), bool)
        fresh[1:] = both[1:] != both[:-1]
        group = rank[open_[sub]]
        head = np.ones(len(sub), bool)
        head[1:] = group[1:] != group[:-1]
        # new numbers count up within each old group, after all groups before it
        inner = np.cumsum(fresh) - 1
        offset = inner - np.repeat(inner[head], np.diff(np.append(np.flatnonzero(head), len(sub))))
        wider = np.cumsum(sizes) - sizes
        rank = wider[rank]
        rank[open_[sub]] = wider[group] + offset
        h += step
    fits = np.flatnonzero(room >= width)
    return fits[np.argsort(rank[fits])]


def common_prefixes(data: np.ndarray, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bytes, up to ``width``, that each place of ``order`` shares with the one before it.

    Kasai's method: if a place shares h bytes with the one before it, the next place shares h - 1 at least
    with the one before that. This holds where the neighbour's next place is sorted too, and for h below
    ``width``, since places equal in all ``width`` bytes stand in any order; others count from zero. All
    pieces advance in lockstep, eight bytes at a time.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), "<u8", buffer=padded, strides=(1,))
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    sorted_too = np.zeros(n + 1, bool)
    sorted_too[order] = True
    shared = np.zeros(n + 1, np.int64)
    by_size = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[by_size], counts[by_size]
    length = np.zeros(len(firsts), np.int64)
    lanes = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")
    for step, going in enumerate(lanes.tolist()):
        place = firsts[:going] + step
        other = before[place]
        h = np.maximum(length[:going] - 1, 0)
        h[other < 0] = 0
        active = np.flatnonzero(other >= 0)
        while len(active):
            differ = words[place[active] + h[active]] ^ words[other[active] + h[active]]
            same = differ == 0
            low = np.where(same, np.uint64(1), differ & (~differ + np.uint64(1)))
            h[active] = np.minimum(h[active] + np.where(same, 8, np.log2(low.astype(np.float64)).astype(np.int64) // 8), width)
            active = active[same & (h[active] < width)]
        length[:going] = np.where((h < width) & sorted_too[np.maximum(other, -1) + 1], h, 0)
        shared[place] = h
    return shared[order]


def later_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray, width: int = WIDTH):
    """Of all windows of some pieces: places, whether an equal one comes earlier, whether it is its run's first.

    ``rank`` orders pieces as their texts do, and places inside a piece as they stand.
    """
    order = suffix_order(data, starts, ends, width)
    counts = ends - starts - width + 1
    shared = common_prefixes(data, order, starts, counts, width)
    new = shared < width
    if len(new):
        new[0] = True
    runs = np.flatnonzero(new)
    earliest = np.minimum.reduceat(rank[order], runs) if len(runs) else rank[:0]
    later = np.zeros(len(data), bool)
    later[order] = rank[order] != np.repeat(earliest, np.diff(np.append(runs, len(order))))
    return order, later


# ---- Spark -----------------------------------------------------------------------------


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            _, offsets = text_bytes(text_of(batch))
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                end = start + part.num_rows
                if size and size + offsets[end] - offsets[start] > limit:
                    block, size, row = block + 1, 0, 0
                size += int(offsets[end] - offsets[start])
                rids = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * part.num_rows, pa.int64()), rids, *part.columns], names=["block", "row", "doc_id", "text"]
                )

    return run


def _marks(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(found), pa.array(counts)], names=["block", "mark", "n"])

        for batch in batches:
            for part in table_blocks(batch, "block"):
                new = part.column("block")[0].as_py()
                if new != block:
                    if len(found):
                        yield out(len(found))
                    block, found, counts = new, found[:0], counts[:0]
                marks, _, _, _, times = pieces(*text_bytes(part.column("text")), width, gram, counted=True)
                found, places = np.unique(np.concatenate([found, marks]), return_inverse=True)
                counts = np.bincount(places, np.concatenate([counts, times]), len(found)).astype(np.int64)
        if len(found):
            yield out(len(found))

    return run


def _cut(width: int, gram: int, per_salt: int):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        schema = pa.schema([("mark", pa.int64()), ("salt", pa.int32()), ("salted", pa.bool_()), ("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("body", pa.binary())])
        if not marks.num_rows or not texts.num_rows:
            return schema.empty_table()
        known, total = marks.column("mark").to_numpy(), marks.column("total").to_numpy()
        order = np.argsort(known)
        known, total = known[order], total[order]
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in table_blocks(batch):
                data, offsets = text_bytes(part.column("text"))
                mark, row, begin, size, _ = pieces(data, offsets, width, gram)
                at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
                keep = known[at] == mark
                mark, row, begin, size, at = mark[keep], row[keep], begin[keep], size[keep], at[keep]
                salts = -(-total[at] // per_salt)
                ids = part.column("row").to_numpy()[row]
                salt = ((ids * 2654435761 + begin) >> 7) % salts
                view = memoryview(data)
                bodies = [bytes(view[a:b]) for a, b in zip(begin.tolist(), (begin + size + width - 1).tolist())]
                columns = [mark, salt.astype(np.int32), salts > 1, np.full(len(mark), part.column("block")[0].as_py()), ids]
                doc_ids = part.column("doc_id").take(pa.array(row))
                out.append(pa.Table.from_arrays([*map(pa.array, columns), doc_ids, pa.array(begin - offsets[row]), pa.array(bodies, pa.binary())], schema=schema))
        return pa.concat_tables(out)

    return run


def _searched(width: int):
    """Runs of later windows per piece; and, for salted marks, a digest for each run's first window."""

    def shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        doc_id = rows.column("doc_id")
        no_id = doc_id.is_null().to_numpy().astype(np.int64)
        block, row, start = (rows.column(n).to_numpy() for n in ("block", "row", "start"))
        turn = np.lexsort((start, row, block, doc_id.fill_null(0).to_numpy(), no_id))
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        # of equal pieces only the earliest is sorted; all windows of the others are later ones
        bodies = rows.column("body").combine_chunks()
        kind = bodies.dictionary_encode().indices.to_numpy()
        by_kind = np.lexsort((place, kind))
        copy = np.zeros(len(kind), bool)
        copy[by_kind[1:]] = kind[by_kind[1:]] == kind[by_kind[:-1]]
        sizes = pc.binary_length(bodies).to_numpy().astype(np.int64)
        yield batch_of(int(copy.sum()), block=block[copy], row=row[copy], start=start[copy], end=(start + sizes)[copy])
        rows, place, block, row, start = rows.filter(pa.array(~copy)).combine_chunks(), place[~copy], block[~copy], row[~copy], start[~copy]
        doc_id, bodies = rows.column("doc_id"), rows.column("body").combine_chunks()
        data, offsets = text_bytes(pa.Array.from_buffers(pa.string(), len(bodies), bodies.buffers(), offset=bodies.offset))
        starts, ends = offsets[:-1], offsets[1:]
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        rank = place[owner] * (LONGEST_PIECE + width) + np.arange(len(data)) - starts[owner]
        order, later = later_windows(data, starts, ends, rank, width)
        edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # later windows of neighbouring pieces never touch: the last width - 1 places of a piece start none
        own = owner[first] if len(first) else first
        base = start[own] - starts[own]
        yield batch_of(len(first), block=block[own], row=row[own], start=base + first, end=base + last + width - 1)
        salted = rows.column("salted").to_numpy(zero_copy_only=False)
        firsts = order[~later[order] & salted[owner[order]]]
        view = memoryview(data)
        for k in range(0, len(firsts), 50_000):
            some = firsts[k : k + 50_000]
            digest = np.frombuffer(b"".join(hashlib.blake2b(view[p : p + width], digest_size=16).digest() for p in some.tolist()), np.int64)
            own = owner[some]
            at = start[own] - starts[own] + some
            ids = doc_id.take(pa.array(own)).combine_chunks()
            yield batch_of(len(some), block=block[own], row=row[own], start=at, end=at + width, d1=digest[::2], d2=digest[1::2], doc_id=ids)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        names = ["block", "row", "start", "end", "d1", "d2", "doc_id"]
        given = [columns[c] if c in columns else pa.nulls(n, pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x), pa.int64()) for x in given], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column("mark").to_numpy() * 31 + batch.column("salt").to_numpy()
            bounds = np.append(np.flatnonzero(np.diff(keys)) + 1, batch.num_rows)
            body = np.cumsum([0] + [len(x) for x in batch.column("body").to_pylist()])
            begin = 0
            for bound in bounds.tolist():
                fresh = begin > 0 or not held or keys[0] != held_key
                if held and size + body[bound] - body[begin] > SHARD_BYTES and fresh:
                    yield from shard(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(begin, bound - begin))
                size += int(body[bound] - body[begin])
                begin = bound
            held_key = keys[-1]
            held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]]
        if held:
            yield from shard(pa.Table.from_batches(held))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by digest, then by text, all but the first of each digest."""
    last = None
    for batch in batches:
        d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
        # binary search for the first window with this d1; d2 settles the rest
        head = np.searchsorted(d1, d1, "left")
        again = (np.arange(len(d1)) > head) & (np.append(d2[:1] - 1, d2[:-1]) == d2)
        again[0] = last == (d1[0], d2[0])
        last = (d1[-1], d2[-1])
        if again.any():
            yield batch.select(["block", "row", "start", "end"]).filter(pa.array(again))


def _finished(texts: pa.Table, runs: pa.Table) -> pa.Table:
    row, start, end = (runs.column(n).to_numpy() for n in ("row", "start", "end"))
    turn = np.lexsort((start, row))
    row, start, end = row[turn], start[turn], end[turn]
    out = []
    for number, doc_id, text in zip(*(texts.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
        data = (text or "").encode()
        low, high = np.searchsorted(row, number, "left"), np.searchsorted(row, number, "right")
        spans: list[list[int]] = []
        for a, b in zip(start[low:high].tolist(), end[low:high].tolist()):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        bounds = [0, *(x for span in spans for x in span), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
        out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans), kept))
    columns = list(zip(*out)) if out else [()] * 7
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.string()), ("kept", pa.binary())]
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds, columns)})


def without_repeats(
    documents: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK_OF_TEXT, per_salt: int = PIECES_PER_SALT
) -> DataFrame:
    """Per row of ``documents`` (``doc_id``, ``text``): counts, removed ``spans`` in bytes, and the ``kept`` bytes.

    The result is written to the shared folder and the bucketed texts are dropped before the call returns.
    """
    spark = documents.sparkSession
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = given.mapInArrow(_blocks(block), "block long, row long, doc_id long, text string")
    cut.write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    texts = spark.table(name)
    marks = texts.select("block", "text").mapInArrow(_marks(width, gram), "block long, mark long, n long")
    # a block has one row for a mark, so no mark has more rows than there are blocks
    marks = marks.withColumn("total", F.sum("n").over(Window.partitionBy("mark"))).where("total > 1")
    asked = marks.groupBy("block", "mark").agg(F.max("total").alias("total")).select(F.col("block").alias("of"), "mark", "total")
    schema = "mark long, salt int, salted boolean, block long, row long, doc_id long, start long, body binary"
    found = texts.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_cut(width, gram, per_salt), schema)
    shards = found.repartition("mark", "salt").sortWithinPartitions("mark", "salt")
    kinds = "block long, row long, start long, end long, d1 long, d2 long, doc_id long"
    runs = written(shards.mapInArrow(_searched(width), kinds), "runs")
    spread = runs.where("d1 is not null").repartition("d1", "d2")
    spread = spread.sortWithinPartitions("d1", "d2", F.col("doc_id").isNull(), "doc_id", "block", "row", "start")
    merged = spread.mapInArrow(_merged, "block long, row long, start long, end long")
    removed = runs.where("d1 is null").select("block", "row", "start", "end").unionByName(merged)
    removed = removed.withColumnRenamed("block", "of")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary"
    out = written(spark.table(name).groupBy("block").cogroup(removed.groupBy("of")).applyInArrow(_finished, schema), "kept")
    spark.sql(f"DROP TABLE {name}")
    return out


def removal_digests(documents: DataFrame) -> DataFrame:
    """The counts and hashes of ``without_repeats``."""
    return without_repeats(documents).drop("kept")

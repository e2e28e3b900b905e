"""Language-model scores from a hierarchical Pitman-Yor model.

Every restaurant seats its customers by the Chinese-restaurant rule; each of its tables is a customer of
its parent. Each word before (the end before the first) has a restaurant for the word that follows; their
parent is one restaurant of words, which serves whole tokens. Its parent spells words: restaurants for each
pair of preceding bytes share, as parents, those of the last byte, which share one root over a uniform
choice. A word that training has not seen is the unknown token, as in the base score; its probability is
what the spellings of all known words leave. Seatings are drawn anew sweep by sweep: all customers of a dish are reseated given the seats
of all other dishes, in the state the last sweep left. The probability of a word is the average over
the sweeps kept.

Pairs of a word and the word before are dealt by the hash of both, so that no word gathers in one task; a part's
pairs, their seats and the tokens that ask for them stay together. Words are dealt by their own hash. A sweep
sends only numbers between the two, one array from each part to each shard of words and back, in an order that
both sides know; the texts themselves are read once. Every row that moves holds a packed array, so that a pair costs a
few bytes. How many parts there are follows from the size of the texts alone, and draws are seeded by part and
sweep, so scores depend on neither the layout of the rows nor the session. Only counts of byte contexts reach the
driver and are broadcast: at most 257 ** 3 cells whatever the corpus, in practice the pairs of bytes that words use.

Tokens are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased, and one end per text. Cases:
a null text counts as empty and has its end only. Rows with equal ids are rows of their own; a null
``doc_id`` counts as the empty text when rows are dealt. With no training rows every token is unknown
and certain. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convfeat.llm.common import remainder, text_bytes
from convfeat.session import scratch_path

#: Bytes of text in a block of documents, and to a part of the pairs.
BLOCK_OF_TEXT = 24 << 20
PART_OF_TEXT = 12 << 20
SWEEPS, BURN_IN = 3, 1
#: Strengths; the discounts of pairs and words are estimated from how many have one customer and two.
WORD_STRENGTH = 10.0
PAIR_STRENGTH = 5.0
BYTE_STRENGTH = 2.0
BYTE_DISCOUNT = (0.3, 0.5, 0.7)
END = 256
SYMBOLS = 257


def tokens(text: str | None) -> list[bytes]:
    """Words of a text and its end, the empty token."""
    return [*(text or "").encode().lower().split(), b""]


class Places(dict):
    """Numbers of words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


# ---- rows of packed arrays -----------------------------------------------------------

#: One row is about a part of the pairs or a shard of the words (``to``); ``kind`` says which columns it has.
ROW = pa.schema(
    [
        ("kind", pa.string()), ("to", pa.int64()), ("source", pa.int64()), ("ones", pa.int64()), ("twos", pa.int64()),
        *((name, pa.binary()) for name in ("words", "before", "dish", "count", "tables", "opened", "tokens", "parent", "base")),
        *((name, pa.binary()) for name in ("sizes", "pair", "doc", "held", "known", "score")),
        ("sources", pa.list_(pa.int64())), ("links", pa.list_(pa.binary())),
        ("old_tables", pa.list_(pa.binary())), ("old_opened", pa.list_(pa.binary())), ("old_parent", pa.list_(pa.binary())),
        ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
    ]
)
DDL = ", ".join(
    f"`{f.name}` {'array<' * (nested := pa.types.is_list(f.type))}"
    f"{ {'int64': 'bigint', 'bool': 'boolean'}.get(str(f.type.value_type if nested else f.type), str(f.type.value_type if nested else f.type)) }"
    f"{'>' * nested}"
    for f in ROW
)


def packed(values: np.ndarray) -> bytes:
    """An array compressed, its high bytes apart from its low ones; integers (none negative) in the least width that holds them."""
    if values.dtype.kind in "biu":
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return values.dtype.char.encode() + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind, size = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return values.astype(np.int64) if values.dtype.kind in "biu" else values.astype(np.float64)


def packed_words(words: list[bytes]) -> bytes:
    """Words, at least one; none holds a blank."""
    return packed(np.frombuffer(b" ".join(words), np.uint8))


def unpacked_words(data: bytes) -> list[bytes]:
    return unpacked(data).astype(np.uint8).tobytes().split(b" ")


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, ROW)


def _by_key(rows: DataFrame, run: Callable[[list[dict]], Iterable[dict]]) -> DataFrame:
    """``run`` over the rows with the same ``to``, in the order of ``source``."""

    def group(table: pa.Table) -> pa.Table:
        return _rows(list(run(table.sort_by("source").to_pylist())))

    return rows.groupBy("to").applyInArrow(group, DDL)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _shards(words: list[bytes], parts: int) -> np.ndarray:
    return (_hashes(words) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that needed them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _written(rows: DataFrame, path: str) -> DataFrame:
    """Rows as a table in the shared folder, a folder for each kind."""
    spark = rows.sparkSession
    with _shuffles_dropped(spark):
        rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _emptied(spark: SparkSession, path: str, kind: str) -> None:
    """Drops the rows of a kind that no later job reads."""
    spark.createDataFrame([], DDL).drop("kind").write.mode("overwrite").parquet(f"{path}/kind={kind}")


# ---- seating -----------------------------------------------------------------------


def seated(
    customers: np.ndarray, others: np.ndarray, base: np.ndarray, strength: float, discount: float, rng: np.random.Generator
) -> np.ndarray:
    """Tables that each dish's customers take, one after another, beside ``others`` tables of its restaurant.

    The first customer opens a table. Single customers sit down up to the sixteenth, then groups of a
    sixteenth of those seated, whose new tables are drawn from one binomial.
    """
    tables = (customers > 0).astype(np.int64)
    seats = tables.copy()
    going = np.flatnonzero(customers > 1)
    while len(going):
        n, t = seats[going], tables[going]
        group = np.minimum(np.maximum(1, n // 16), customers[going] - n)
        opens = (strength + discount * (others[going] + t)) * base[going]
        joins = np.maximum(n - discount * t, 1e-9)
        tables[going] = t + rng.binomial(group, opens / (opens + joins))
        seats[going] = n + group
        going = going[seats[going] < customers[going]]
    return tables


@dataclass
class Spelling:
    """Predictive probabilities of the byte restaurants: cells of the deepest ones, and what is left for their parents."""

    keys: np.ndarray
    direct: np.ndarray
    left: np.ndarray
    parent: np.ndarray

    @staticmethod
    def uniform() -> Spelling:
        none = np.zeros(0, np.int64)
        return Spelling(none, np.zeros(0), np.ones(SYMBOLS**2), np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS))

    @staticmethod
    def drawn(keys: np.ndarray, customers: np.ndarray, before: Spelling, rng: np.random.Generator) -> Spelling:
        """New seatings of all levels for the counts of (byte before last, last byte, symbol) cells."""
        if not len(keys):
            return Spelling.uniform()
        order = np.argsort(keys)
        keys, customers = keys[order], customers[order]
        pairs, cells = keys // SYMBOLS, keys % SYMBOLS**2
        others = np.bincount(pairs, minlength=SYMBOLS**2)[pairs]
        deep = seated(customers, others, before.parent.ravel()[cells], BYTE_STRENGTH, BYTE_DISCOUNT[2], rng)
        middle = np.bincount(cells, deep, SYMBOLS**2).astype(np.int64)
        last = np.arange(SYMBOLS**2) // SYMBOLS
        symbol = np.arange(SYMBOLS**2) % SYMBOLS
        kinds = np.bincount(last, middle > 0, SYMBOLS)
        uniform = np.full(SYMBOLS, 1 / SYMBOLS)
        root_guess = np.bincount(symbol, middle > 0, SYMBOLS) + BYTE_STRENGTH * uniform
        root_guess = root_guess / root_guess.sum()
        tables = seated(middle, kinds[last].astype(np.int64), root_guess[symbol], BYTE_STRENGTH, BYTE_DISCOUNT[1], rng)
        top = np.bincount(symbol, tables, SYMBOLS).astype(np.int64)
        top_tables = seated(top, np.full(SYMBOLS, (top > 0).sum()), uniform, BYTE_STRENGTH, BYTE_DISCOUNT[0], rng)
        root = top - BYTE_DISCOUNT[0] * top_tables + (BYTE_STRENGTH + BYTE_DISCOUNT[0] * top_tables.sum()) * uniform
        root = root / (BYTE_STRENGTH + top.sum())
        total, opened = np.bincount(last, middle, SYMBOLS), np.bincount(last, tables, SYMBOLS)
        share = (BYTE_STRENGTH + BYTE_DISCOUNT[1] * opened)[last] * root[symbol]
        parent = (middle - BYTE_DISCOUNT[1] * tables + share) / (BYTE_STRENGTH + total)[last]
        total, opened = np.bincount(pairs, customers, SYMBOLS**2), np.bincount(pairs, deep, SYMBOLS**2)
        direct = (customers - BYTE_DISCOUNT[2] * deep) / (BYTE_STRENGTH + total)[pairs]
        left = (BYTE_STRENGTH + BYTE_DISCOUNT[2] * opened) / (BYTE_STRENGTH + total)
        return Spelling(keys, direct, left, parent.reshape(SYMBOLS, SYMBOLS))

    def log_probability(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability from the cells of its symbols."""
        at = np.minimum(np.searchsorted(self.keys, cells), max(0, len(self.keys) - 1))
        direct = np.where(self.keys[at] == cells, self.direct[at], 0.0) if len(self.keys) else 0.0
        p = direct + self.left[cells // SYMBOLS] * self.parent.ravel()[cells % SYMBOLS**2]
        return np.add.reduceat(np.log(p), starts)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each symbol of each word (its bytes, then the end), and where each word starts."""
    data, offsets = text_bytes_of_binary(words)
    lengths = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(lengths))
    out = np.full(len(data) + len(lengths), END, np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    before = np.concatenate([[END], out[:-1]])
    before[starts] = END
    earlier = np.concatenate([[END], before[:-1]])
    earlier[starts] = END
    return (earlier * SYMBOLS + before) * SYMBOLS + out, starts


def text_bytes_of_binary(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.Array.from_buffers(pa.string(), len(words), words.buffers(), offset=words.offset))


# ---- passes over texts, pairs and words ------------------------------------------------


def _split(documents: DataFrame, block: int, parts: int) -> DataFrame:
    """For each block of documents a row with their ids, and for each part of the pairs the tokens that fall to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        size, words, found, doc_ids, flags = 0, Places(), [], [], []

        def dealt() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in found])
            dish = np.concatenate(found)
            before = np.concatenate([np.array([end], np.int32), dish[:-1]])
            doc = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
            held = np.repeat(np.array([bool(x) for x in flags]), lengths)
            names = np.array([*words, None], object)[:-1]
            hashes = _hashes(list(words))
            part = hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[dish] * np.uint64(0xC2B2AE3D27D4EB4F)
            part = ((part >> np.uint64(32)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            marked, place = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
            row = {"kind": "docs", "to": number % parts, "source": number, "doc_ids": doc_ids, "flags": flags, "count": packed(lengths)}
            yield from _rows([row]).to_batches()
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[p] : bounds[p + 1]]
                marked[before[at]] = marked[dish[at]] = True
                used = np.flatnonzero(marked)
                marked[used], place[used] = False, np.arange(len(used))
                yield from _rows(
                    [
                        {
                            "kind": "tokens", "to": p, "source": number, "words": packed_words(names[used].tolist()),
                            "before": packed(place[before[at]]), "dish": packed(place[dish[at]]),
                            "doc": packed(np.diff(doc[at], prepend=0)), "held": packed(held[at]),
                        }
                    ]
                ).to_batches()

        end = words[b""]
        for batch in batches:
            sizes = pc.binary_length(batch.column("text"))
            for doc_id, text, flag, length in zip(*(batch.column(n) for n in ("doc_id", "text", "held_out")), sizes):
                text = text.as_py()
                found.append(words.of(tokens(text)).astype(np.int32))
                doc_ids.append(doc_id.as_py())
                flags.append(flag.as_py())
                size += length.as_py() or 0
                if size >= block:
                    yield from dealt()
                    number, size, words, found, doc_ids, flags = number + 1, 0, Places(), [], [], []
                    end = words[b""]
        if found:
            yield from dealt()

    return documents.mapInArrow(run, DDL)


def _messages(part: int, sizes: np.ndarray, words: list[bytes] | None = None, **columns: np.ndarray) -> Iterator[dict]:
    """What a part says of its words, which are in the order of their shards, to each shard."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for q in np.flatnonzero(sizes).tolist():
        a, b = bounds[q : q + 2]
        more = {} if words is None else {"words": packed_words(words[a:b])}
        yield {"kind": "up", "to": q, "source": part, **more, **{n: packed(x[a:b]) for n, x in columns.items()}}


def _gathered(parts: int) -> Callable[[list[dict]], Iterator[dict]]:
    """The pairs of a part with their training counts, the tokens that ask for each, and what words learn from them."""

    def run(rows: list[dict]) -> Iterator[dict]:
        yield from (r for r in rows if r["kind"] == "docs")
        chunks = [r for r in rows if r["kind"] == "tokens"]
        if not chunks:
            return
        words = Places()
        places = [words.of(unpacked_words(r["words"])) for r in chunks]
        part, names = chunks[0]["to"], np.array([*words, None], object)[:-1]
        order = np.argsort(names)
        order = order[np.argsort(_shards(names[order].tolist(), parts), kind="stable")]
        names = names[order].tolist()
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        sizes = np.bincount(_shards(names, parts), minlength=parts)
        keys, counts, asked = [], [], []
        for r, place in zip(chunks, places):
            key = rank[place[unpacked(r["before"])]] << 32 | rank[place[unpacked(r["dish"])]]
            by_key = np.argsort(key)
            key, doc, held = key[by_key], np.cumsum(unpacked(r["doc"]))[by_key], unpacked(r["held"])[by_key]
            new = np.diff(key, prepend=-1) > 0
            keys.append(key[new])
            counts.append(np.add.reduceat(1 - held, np.flatnonzero(new)))
            asked.append((r["source"], packed(new), packed(doc)))
        bounds = np.cumsum([len(k) for k in keys])[:-1]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        before, dish = key >> 32, key & 0xFFFFFFFF
        for (block, new, doc), found in zip(asked, np.split(at, bounds)):
            pair = found[np.cumsum(unpacked(new)) - 1]
            yield {"kind": "asked", "to": part, "source": block, "pair": packed(np.diff(pair, prepend=0)), "doc": doc}
        yield {
            "kind": "pairs", "to": part, "ones": int((count == 1).sum()), "twos": int((count == 2).sum()), "sizes": packed(sizes),
            "before": packed(np.diff(before, prepend=0)), "dish": packed(dish), "count": packed(count),
        }
        seen = count > 0
        columns = {"tokens": np.bincount(dish, count, len(names)), "tables": np.bincount(dish, seen, len(names)), "opened": np.bincount(before, seen, len(names))}
        yield from _messages(part, sizes, names, **{n: x.astype(np.int64) for n, x in columns.items()})

    return run


def _met(rows: list[dict]) -> Iterator[dict]:
    """The words of a shard, with the places of each part's words among them."""
    words = Places()
    places = [words.of(unpacked_words(r["words"])) for r in rows]
    order = np.array(sorted(range(len(words)), key=list(words).__getitem__))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    links = [rank[x] for x in places]
    tokens, count, opened = (_summed(rows, links, n, len(words)) for n in ("tokens", "tables", "opened"))
    names = list(words)
    yield {
        "kind": "words", "to": rows[0]["to"], "source": -1, "words": packed_words([names[i] for i in order]),
        "sources": [r["source"] for r in rows], "links": [packed(x) for x in links],
        "ones": int((count == 1).sum()), "twos": int((count == 2).sum()), "tokens": packed(tokens), "count": packed(count),
        "opened": packed(opened), "tables": packed(np.minimum(count, 1)), "base": packed(np.zeros(len(words))),
    }


def _summed(rows: list[dict], links: list[np.ndarray], name: str, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for r, at in zip(rows, links):
        total[at] += unpacked(r[name])
    return total


def _cell_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the deepest byte restaurants: each word's spelling, once for each of its tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tables = unpacked(row["tables"])
                seated = np.flatnonzero(tables)
                if not len(seated):
                    continue
                names = unpacked_words(row["words"])
                cells, starts = spelled(pa.array([names[i] for i in seated], pa.binary()))
                times = np.repeat(tables[seated], np.diff(np.append(starts, len(cells))))
                new, places = np.unique(np.concatenate([keys, cells]), return_inverse=True)
                keys, counts = new, np.bincount(places, np.concatenate([counts, times]), len(new)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["cell", "n"])

    # bounded by the number of cells, 257 ** 3
    found = words.select("words", "tables").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return found.column("cell").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64)


@dataclass(frozen=True)
class Restaurant:
    """Totals of the restaurant of words."""

    customers: int
    tables: int
    discount: float

    def probability(self, count: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
        new = (WORD_STRENGTH + self.discount * self.tables) * base
        return (count - self.discount * tables + new) / (WORD_STRENGTH + self.customers)


def _discount(ones: int | None, twos: int | None) -> float:
    return min(max(ones / (ones + 2 * (twos or 0)), 0.1), 0.9) if ones else 0.5


def _words_sweep(
    words: DataFrame, ups: DataFrame | None, spelling: Spelling, tables: int, discount: float, seed: int, last: bool
) -> DataFrame:
    """Reseats the customers of every word: the tables that pairs have opened since (``ups``); the last sweep drops the texts."""
    shared = words.sparkSession.sparkContext.broadcast(spelling)

    def run(rows: list[dict]) -> Iterator[dict]:
        (row,), ups = [r for r in rows if r["kind"] == "words"], [r for r in rows if r["kind"] == "up"]
        own, count, opened = (unpacked(row[n]) for n in ("tables", "count", "opened"))
        if ups:
            links = dict(zip(row["sources"], row["links"]))
            places = [unpacked(links[r["source"]]) for r in ups]
            count, opened = (_summed(ups, places, n, len(own)) for n in ("tables", "opened"))
        cells, starts = spelled(pa.array(unpacked_words(row["words"]), pa.binary()))
        base = np.exp(shared.value.log_probability(cells, starts))
        rng = np.random.default_rng([seed, row["to"], 0])
        seats = seated(count, np.maximum(tables - own, 0), base, WORD_STRENGTH, discount, rng)
        yield {**row, "words": None if last else row["words"], "count": packed(count), "opened": packed(opened), "tables": packed(seats), "base": packed(base)}

    return _by_key(words if ups is None else words.unionByName(ups), run)


def _totals(words: DataFrame) -> tuple[int, ...]:
    """Over all words: tokens, known words, customers, tables and the spelling probability of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{n: unpacked(x) for n, x in row.items()} for row in batch.to_pylist()]
            values = {n: [int(r[n].sum()) for r in rows] for n in ("tokens", "count", "tables")}
            known = {"known": [int((r["tokens"] > 0).sum()) for r in rows], "mass": [float(r["base"][r["tokens"] > 0].sum()) for r in rows]}
            yield pa.RecordBatch.from_pydict(values | known)

    found = words.select("tokens", "count", "tables", "base").mapInArrow(run, "tokens long, count long, tables long, known long, mass double")
    return tuple(x or 0 for x in found.agg(*(F.sum(n) for n in ("tokens", "known", "count", "tables", "mass"))).first())


def _told(words: DataFrame, now: Restaurant, unknown: float) -> DataFrame:
    """What each part of the pairs hears of its words: probability, training count and tables opened behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, count, tables, base, opened = (unpacked(row[n]) for n in ("tokens", "count", "tables", "base", "opened"))
                # single precision: its error of 6e-8 is far below the spread of the draws
                parent = np.where(tokens > 0, now.probability(count, tables, base), unknown).astype(np.float32)
                for source, link in zip(row["sources"], row["links"]):
                    at = unpacked(link)
                    more = {"parent": packed(parent[at]), "tokens": packed(tokens[at]), "opened": packed(opened[at])}
                    yield from _rows([{"kind": "down", "to": source, "source": row["to"], **more}]).to_batches()

    return words.mapInArrow(run, DDL)


@dataclass
class Part:
    """A part of the pairs, and what its words' shards tell it."""

    number: int
    sizes: np.ndarray
    before: np.ndarray
    dish: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    parent: np.ndarray
    tokens: np.ndarray
    opened: np.ndarray
    old: list[tuple[bytes, bytes, bytes]]

    @staticmethod
    def of(rows: list[dict]) -> Part | None:
        pairs = [r for r in rows if r["kind"] == "pairs"]
        if not pairs:
            return None
        (own,), downs = pairs, [r for r in rows if r["kind"] == "down"]
        parent, tokens, opened = (np.concatenate([unpacked(r[n]) for r in downs]) for n in ("parent", "tokens", "opened"))
        count = unpacked(own["count"])
        seats = [r for r in rows if r["kind"] == "seats"]
        tables = unpacked(seats[0]["tables"]) if seats else np.minimum(count, 1)
        old = list(zip(seats[0]["old_tables"], seats[0]["old_parent"], seats[0]["old_opened"])) if seats else []
        before = np.cumsum(unpacked(own["before"]))
        return Part(own["to"], unpacked(own["sizes"]), before, unpacked(own["dish"]), count, tables, parent, tokens, opened, old)

    def probability(self, discount: float, tables: np.ndarray, parent: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """Of every pair; a word stands before as many tokens as it has itself."""
        new = (PAIR_STRENGTH + discount * opened[self.before]) * parent[self.dish]
        return (self.count - discount * tables + new) / (PAIR_STRENGTH + self.tokens[self.before])


def _pairs_sweep(rows: DataFrame, discount: float, keep: bool, seed: int) -> DataFrame:
    """Reseats the customers of every pair; ``keep`` keeps the state left before for the average."""

    def run(rows: list[dict]) -> Iterator[dict]:
        part = Part.of(rows)
        if part is None:
            return
        old = part.old + ([(packed(part.tables), packed(part.parent.astype(np.float32)), packed(part.opened))] if keep else [])
        rng = np.random.default_rng([seed, part.number, 1])
        others = part.opened[part.before] - part.tables
        tables = seated(part.count, others, part.parent[part.dish], PAIR_STRENGTH, discount, rng)
        columns = {f"old_{n}": [x[i] for x in old] for i, n in enumerate(("tables", "parent", "opened"))}
        yield {"kind": "seats", "to": part.number, "tables": packed(tables), **columns}
        size = len(part.parent)
        yield from _messages(
            part.number, part.sizes, tables=np.bincount(part.dish, tables, size).astype(np.int64), opened=np.bincount(part.before, tables, size).astype(np.int64)
        )

    return _by_key(rows, run)


def _answers(rows: DataFrame, discount: float, training: int, distinct: int) -> DataFrame:
    """Each block's documents hear from each part the sums over their tokens in it."""

    def run(rows: list[dict]) -> Iterator[dict]:
        part = Part.of(rows)
        if part is None:
            return
        p = part.probability(discount, part.tables, part.parent, part.opened)
        for tables, parent, opened in part.old:
            p += part.probability(discount, unpacked(tables), unpacked(parent), unpacked(opened))
        model = np.log10(p / (len(part.old) + 1))
        count = part.tokens[part.dish]
        base = np.log10((count + 0.5) / (training + 0.5 * (distinct + 1)))
        for r in (r for r in rows if r["kind"] == "asked"):
            at, doc = np.cumsum(unpacked(r["pair"])), unpacked(r["doc"])
            docs = np.flatnonzero(np.bincount(doc))
            known, base_score, score = (np.bincount(doc, x[at])[docs] for x in (count > 0, base, model))
            yield {
                "kind": "sums", "to": r["source"], "source": part.number, "doc": packed(docs),
                "known": packed(known.astype(np.int64)), "base": packed(base_score), "score": packed(score),
            }

    return _by_key(rows, run)


def _scored_block(training: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("source").to_pylist()
        (docs,) = (r for r in rows if r["kind"] == "docs")
        n_tokens = unpacked(docs["count"])
        known, base, score = np.zeros(len(n_tokens), np.int64), np.zeros(len(n_tokens)), np.zeros(len(n_tokens))
        for r in (r for r in rows if r["kind"] == "sums"):
            at = unpacked(r["doc"])
            known[at] += unpacked(r["known"])
            base[at] += unpacked(r["base"])
            score[at] += unpacked(r["score"])
        return pa.table(
            {
                "doc_id": pa.array(docs["doc_ids"], pa.int64()),
                "held_out": pa.array(docs["flags"], pa.bool_()),
                "n_tokens": n_tokens,
                "n_known": known,
                "train_tokens": np.full(len(n_tokens), training, np.int64),
                "base_score": base,
                "score": score,
            }
        )

    return run


def scores(documents: DataFrame, held_out: str = "held_out", block: int = BLOCK_OF_TEXT, sweeps: int = SWEEPS, part: int = PART_OF_TEXT) -> DataFrame:
    """Scores of every row (``doc_id``, ``text``), learned from rows whose flag ``held_out`` is false."""
    spark = documents.sparkSession
    given = documents.select(F.col("doc_id").cast("long"), "text", F.col(held_out).alias("held_out"))
    parts = 1 + (given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // part
    folder = scratch_path(spark, "language-model")
    of = lambda rows, kind, *columns: rows.where(F.col("kind") == kind).select("kind", "to", "source", *columns)

    def gathered(*rows: DataFrame) -> DataFrame:
        found = spark.createDataFrame([], DDL)
        for x in rows:
            found = found.unionByName(x, allowMissingColumns=True)
        return found

    whole = _written(_by_key(_split(given, block, parts), _gathered(parts)), f"{folder}/pairs")
    pairs = of(whole, "pairs", "before", "dish", "count", "sizes")
    pair_discount = _discount(*whole.where("kind = 'pairs'").agg(F.sum("ones"), F.sum("twos")).first())
    words = _written(_by_key(whole.where("kind = 'up'"), _met), f"{folder}/words")
    _emptied(spark, f"{folder}/pairs", "up")
    discount = _discount(*words.agg(F.sum("ones"), F.sum("twos")).first())
    n, v, _, before, _ = _totals(words)
    spelling, seats, ups, last = Spelling.uniform(), [], None, "words"
    for k in range(sweeps):
        if k:
            heard = gathered(pairs, *seats, _told(words, now, unknown))
            table = _written(_pairs_sweep(heard, pair_discount, k > BURN_IN, k), f"{folder}/seats-{k}")
            if seats:
                _emptied(spark, f"{folder}/seats-{k - 1}", "seats")
            seats, ups = [of(table, "seats", "tables", "old_tables", "old_opened", "old_parent")], table.where("kind = 'up'")
        keys, spelt = _cell_counts(words)
        spelling = Spelling.drawn(keys, spelt, spelling, np.random.default_rng([7, k]))
        words = _written(_words_sweep(words, ups, spelling, before, discount, k, k + 1 == sweeps), f"{folder}/words-{k}")
        _emptied(spark, f"{folder}/{last}", "words")
        if k:
            _emptied(spark, f"{folder}/seats-{k}", "up")
        last = f"words-{k}"
        _, _, total, before, mass = _totals(words)
        now = Restaurant(total, before, discount)
        unknown = float(now.probability(0, 0, max(1 - mass, 1e-12)))
    heard = gathered(pairs, *seats, of(whole, "asked", "pair", "doc"), _told(words, now, unknown))
    docs = of(whole, "docs", "doc_ids", "flags", "count").withColumn("to", F.col("source"))
    answers = _answers(heard, pair_discount, n, v).select("kind", "to", "source", "doc", "known", "base", "score")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.unionByName(answers, allowMissingColumns=True).groupBy("to").applyInArrow(_scored_block(n), schema)


def held_out_scores(documents: DataFrame) -> DataFrame:
    """Scores learned from the rows that are not held out."""
    return scores(documents.withColumn("held_out", remainder("doc_id", 5) == 1))

"""Language identification by cross parsing.

A suffix automaton of labelled text per language yields longest matches. A text is parsed against each
language: every phrase is the longest stretch that also occurs in that language's text. Phrases times
the bits of a place in the language's text estimate the text's cross entropy; the language needing the
fewest such bits wins. Symbols are lower-cased letters, with one gap for any run of other characters.

Learning takes a bounded sample: of each language the ``ROWS`` rows of smallest hash, ``PIECE``
characters of each, until ``SYMBOLS`` symbols. Predictions parse whole texts; a text is parsed in
stretches of ``STRETCH`` symbols, all in lockstep, and a phrase ends where its stretch ends.

Cases: a null text or one without a letter is ``und`` with score 0. Rows with null text or null
language teach nothing; a null ``doc_id`` counts as the empty text when rows are dealt. Equal costs go to
the first language by name. With nothing to learn from every text is ``und``. Rows with equal ids are
rows of their own, extra columns pass through untouched, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, remainder, row_schema, text_of

ROWS = 64
PIECE = 4000
SYMBOLS = 24_000
STRETCH = 512
UNDETERMINED = "und"
#: A text of an unknown language matches in stretches this short on average.
SHORTEST_PHRASE = 2.0
UNKNOWN, GAP = 0, 1


class Automaton:
    """Suffix automaton: every path from state 0 spells a substring."""

    def __init__(self, symbols: list[int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _extend(self, last: int, symbol: int) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.step[at]:
            self.step[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][symbol]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                copy = self._state(self.length[at] + 1, dict(self.step[target]), self.link[target])
                while at >= 0 and self.step[at].get(symbol) == target:
                    self.step[at][symbol] = copy
                    at = self.link[at]
                self.link[target] = self.link[new] = copy
        return new


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Per code point of the basic plane (and one for all others): letter or gap."""
    return np.array([UNKNOWN if chr(i).isalpha() else GAP for i in range(0x10000)], np.uint8)


class Model:
    """Parsing tables of all languages, side by side in one array.

    An entry holds the next state's place in the array and, in its low two bits, how many phrases end
    with the step: the one before it, and the step itself where its letter is unknown.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text.lower() if c.isalpha() and ord(c) < 0x10000})[:253]
        self.symbols = _kinds().copy()
        self.symbols[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.width = len(letters) + 2
        parts, self.roots, self.bits, base = [], [], [], 0
        for language in self.languages:
            learned = self.read([samples[language]])[0].tolist()[:SYMBOLS]
            states = Automaton(learned).step
            table = np.zeros((len(states), self.width), np.int64)
            for state, step in enumerate(states):
                table[state, list(step)] = list(step.values())
            # a missing step ends the phrase, and its symbol starts the next
            missing, table = table == 0, np.where(table == 0, table[0], table)
            ends = (missing & (np.arange(len(states)) > 0)[:, None]).astype(np.int64) + (missing & (table == 0))
            parts.append((((table * self.width + base) << 2) | ends).astype(np.int32).ravel())
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(learned))))
            base += table.size
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, how many each has, and whether it has a letter."""
        lowered = [text.lower() for text in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lowered], dtype=np.int64)])
        symbols = self.symbols[np.minimum(points, 0xFFFF)]
        keep = symbols != GAP
        letters = np.concatenate([[0], np.cumsum(keep)])
        keep[1:] |= symbols[:-1] != GAP
        firsts = offsets[:-1][offsets[:-1] < len(keep)]
        keep[firsts] = symbols[firsts] != GAP
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], np.diff(kept[offsets]), np.diff(letters[offsets]) > 0

    def phrases(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(languages, texts) phrases that each text needs."""
        pieces = -(-counts // STRETCH)
        owner = np.repeat(np.arange(len(counts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(counts) - counts)[owner] + number * STRETCH
        size = np.minimum(counts[owner] - number * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        place = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        total = np.zeros(place.shape, np.int32)
        going = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for step, lanes in enumerate(going.tolist()):
            entry = self.table[place[:, :lanes] + symbols[start[:lanes] + step]]
            total[:, :lanes] += entry & 3
            place[:, :lanes] = entry >> 2
        total += place != np.array(self.roots, np.int32)[:, None]
        out = np.zeros((len(self.languages), len(counts)))
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner[order], total[k], len(counts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and symbols per phrase of each text."""
        symbols, counts, letters = self.read(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        phrases = self.phrases(symbols, counts)
        cost = phrases * np.array(self.bits)[:, None]
        best = cost.argmin(0)
        score = 1 / np.exp2(np.maximum(cost.min(0) - cost, -1000)).sum(0)
        length = counts / np.maximum(phrases.min(0), 1)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, score, 0.0), np.where(letters, length, 0.0)


def learn(documents: DataFrame, rows: int = ROWS) -> Model:
    """A model of the languages in ``lang``, from a bounded sample of the rows given."""
    labelled = documents.where("text is not null and lang is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    named = labelled.select("lang", F.xxhash64("doc_id", "lang", "text").alias("pick"))
    picks = named.withColumn("place", place).where(F.col("place") <= rows).select("lang", "pick").distinct()
    picked = labelled.withColumn("pick", F.xxhash64("doc_id", "lang", "text")).join(F.broadcast(picks), ["lang", "pick"])
    texts = defaultdict(dict)
    # rows times languages, each of bounded length
    for row in picked.select("lang", "pick", F.substring("text", 1, PIECE).alias("piece")).distinct().collect():
        texts[row.lang][row.pick] = row.piece
    return Model({lang: "\n".join(found[k] for k in sorted(found)) for lang, found in texts.items()})


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns), ``lang_pred``, ``score``, ``phrase_length``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, length = shared.value.predict([text or "" for text in text_of(batch).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(length, pa.float64())],
            names=["row", "lang_pred", "score", "phrase_length"],
        )

    rows = as_row(documents)
    return map_texts(rows, run, row_schema(rows, "lang_pred string, score double, phrase_length double"))


def held_out_languages(documents: DataFrame) -> DataFrame:
    """Per document the predicted language, learned from the rows that are not held out."""
    held_out = remainder("doc_id", 4) == 2
    model = learn(documents.select("doc_id", "text", "lang").where(~held_out))
    out = identified(documents.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def identified_rows(documents: DataFrame) -> DataFrame:
    """``documents`` with all columns, without texts in none of the languages learned from them."""
    out = identified(documents, learn(documents))
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("phrase_length") >= SHORTEST_PHRASE)).select("row.*")

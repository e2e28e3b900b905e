"""Byte-level BPE encoding and decoding as a tree reduction.

A piece of text is halved down to short leaves, leaves are encoded by their merges, and two encoded
neighbours are joined by encoding a window around their border anew. The window grows until its outer
tokens agree with the tokens beside it: two tokens agree if encoding their bytes together gives the
same two tokens, and a sequence whose neighbours all agree is the encoding of its bytes, so tokens
outside the window are final. Decoding concatenates halves.

Cases: a null or empty text has no tokens. Rows with equal ids are rows of their own. Extra columns
pass through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, row_schema, text_of

#: Pieces up to this many bytes are encoded by plain merges.
LEAF = 32
#: Distinct pieces and distinct token pairs that a worker remembers.
REMEMBERED = 1 << 18
DECODED_AT_ONCE = 4096
NO_MERGE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _latin_class(test: Callable[[str], bool]) -> str:
    return "".join(f"\\x{i:02x}" for i in range(256) if test(chr(i)))


def latin_pattern(pattern: str) -> str | None:
    """``pattern`` for texts of code points below 256, with its classes spelled out for the faster matcher.

    None if the pattern has classes other than letters, numbers and white space.
    """
    letter = _latin_class(lambda c: unicodedata.category(c).startswith("L"))
    number = _latin_class(lambda c: unicodedata.category(c).startswith("N"))
    space = _latin_class(lambda c: regex.match(r"\s", c) is not None)
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    out = out.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]")
    return None if re.search(r"\\[A-Za-wyz]", out) else out


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_pieces = re.compile(latin).findall if latin else self.pieces
        self.piece = lru_cache(REMEMBERED)(self._piece)
        self.agree = lru_cache(REMEMBERED)(self._agree)

    def _merged(self, data: bytes) -> list[int]:
        """Plain merges, lowest rank first, leftmost of equal ranks."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NO_MERGE) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == NO_MERGE:
                break
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NO_MERGE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NO_MERGE)
        return [self.ranks[x] for x in parts]

    def _agree(self, left: int, right: int) -> bool:
        return self._merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            inner = self._merged(self.decode(left[len(left) - i :] + right[:j]))
            grow_left = i < len(left) and not self.agree(left[-i - 1], inner[0])
            grow_right = j < len(right) and not self.agree(inner[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + inner + right[j:]
            i = min(len(left), i * 2) if grow_left else i
            j = min(len(right), j * 2) if grow_right else j

    def tree(self, data: bytes) -> list[int]:
        """Encoding of ``data``: leaves by merges, then neighbours joined, level by level."""
        level = [self._merged(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            joined = [self.join(level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def _piece(self, text: str) -> bytes:
        """Ids of one match of the pattern as little-endian unsigned 32-bit integers."""
        data = text.encode()
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.tree(data), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, each match of the pattern by itself."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.piece, self.pieces(text)))
        return b"".join(map(self.piece, self.latin_pieces(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of a run of ids: those of its halves, concatenated."""
        ids = list(ids)
        if len(ids) <= DECODED_AT_ONCE:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def _codec(data: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(data), pattern)


def encoded(documents: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """``row`` (all columns) with ``n_tokens``, hashes of ids and decoded bytes and, if asked for, ``ids``.

    The ranks come from a vocabulary file of fixed size, which is broadcast.
    """
    spark = documents.sparkSession
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, pattern)
        n_tokens, ids_sha, decoded_sha, round_trip, kept = [], [], [], [], [b""]
        for text in text_of(batch).to_pylist():
            text = text or ""
            packed = codec.encode(text)
            ids = np.frombuffer(packed, "<u4").tolist()
            decoded = codec.decode(ids)
            n_tokens.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            round_trip.append(decoded == text.encode())
            if keep_ids:
                kept.append(packed)
        columns = {
            "row": batch.column("row"),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(decoded_sha, pa.string()),
            "round_trip": pa.array(round_trip, pa.bool_()),
        }
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4")))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = as_row(documents)
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return map_texts(rows, run, row_schema(rows, fields))


def token_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens and the hashes of ids and decoded bytes."""
    out = encoded(documents.select("doc_id", "text"), ranks_path, pattern, keep_ids=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


def tokenized_rows(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``documents`` with all columns, and their tokens; a token column replaces one of the same name."""
    made = encoded(documents, ranks_path, pattern)
    new = [c for c in made.columns if c != "row"]
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in new], *new)

"""Token counts without token ids: pieces are counted once per distinct pre-token.

A text is split the way its tokenizer splits it before the model runs: special strings, then the
normaliser (the library's) and the pre-tokeniser's split pattern, read from the tokenizer file;
its byte mapping is a bijection and is left to the counting of pieces. Every document becomes rows (row, pre-token, how often). The
distinct pre-tokens are tokenised once each and only their number of pieces is kept; that count is
joined to the per-document frequencies and summed. No token id is ever made.

The join is on the pre-token, which is as skewed as words are. The ``HEAVY_PARTS`` pre-tokens that
a bounded sample of the (document, pre-token) rows holds most often are encoded once and joined where
the documents lie; those rows combine per document before the final shuffle. All other rows are
shuffled by pre-token: that co-locates each pre-token's per-document frequencies with the one
task that encodes it. The sample only chooses the way a row takes; every row is counted.

Cases: a null text counts as empty and has 0 tokens, as has an empty or blank text. Special strings
inside a text (``<|startoftext|>``, ``<|endoftext|>`` for the word BPE) are one token each, as the
library does by default. Repeated rows and repeated or null ``doc_id`` are counted row by row; extra
columns travel in ``row`` and clash with nothing. An empty table gives an empty result. Texts of
any length are split whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, written

#: How many of the most frequent pre-tokens are broadcast with their counts. Their rows join where
#: they lie and combine per document before the shuffle.
HEAVY_PARTS = 1 << 16
#: Rows that the choice of the frequent pre-tokens is drawn from, about.
HEAVY_SAMPLE = 4_000_000


@lru_cache(2)
def _tokenizer(config: str):
    """The tokenizer, its special strings as one pattern, its split pattern, and the bare model.

    The bare model has no normaliser and only the byte mapping as pre-tokeniser, so a batch of
    distinct pre-tokens is encoded as they are, each one word.
    """
    import regex
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_str(config)
    settings = json.loads(config)
    specials = [t["content"] for t in settings.get("added_tokens", []) if t.get("special")]
    split = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [p["pattern"]["Regex"] for p in steps if p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed"]
    if len(patterns) != 1 or any(p.get("type") not in ("Split", "ByteLevel") for p in steps):
        raise ValueError("the counting needs a pre-tokeniser of one inverted Split and a ByteLevel step")
    bare = Tokenizer.from_str(config)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer, split, regex.compile(patterns[0]), bare, _normaliser(settings.get("normalizer"), tokenizer)


#: The normaliser that the Python form below stands for: NFC, white space runs to one blank, lower case.
_PLAIN = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _normaliser(setting: dict | None, tokenizer):
    """The file's normaliser as a function; the plain sequence in Python (half the cost), any other by the library.

    The library lower-cases character by character and Python applies the final-sigma rule, so a
    text with a capital sigma goes to the library.
    """
    if setting is None:
        return lambda text: text
    if setting.get("type") == "Sequence" and setting.get("normalizers") == _PLAIN:
        import regex

        blanks = regex.compile(r"\p{White_Space}+")

        def plain(text: str) -> str:
            if "\u03a3" in text:
                return tokenizer.normalizer.normalize_str(text)
            return blanks.sub(" ", unicodedata.normalize("NFC", text)).lower()

        return plain
    return tokenizer.normalizer.normalize_str


def pre_tokens(text: str | None, config: str) -> tuple[list[str], int]:
    """The pre-tokens of one text (before the byte mapping, a bijection) and the number of special strings."""
    _, split, pattern, _, normal = _tokenizer(config)
    text = text or ""
    parts, specials = ([text], 0) if split is None else (split.split(text), len(split.findall(text)))
    found: list[str] = []
    for part in parts:
        if part:
            found.extend(pattern.findall(normal(part)))
    return found, specials


def pieces(pre_token_list: list[str], config: str) -> list[int]:
    """How many tokens the model makes of each pre-token, in one batch."""
    bare = _tokenizer(config)[3]
    return [len(e.ids) for e in bare.encode_batch(pre_token_list, add_special_tokens=False)]


FREQUENCIES = "rid long, pre_token string, freq long, doc_id long, n_bytes long"


def _frequencies(source: DataFrame, config) -> DataFrame:
    """(rid, pre_token, freq) per distinct pre-token of a row, and two kinds of rows without a pre-token:
    the special strings of a row (``freq`` their number, one piece each) and one row per document
    (``n_bytes`` set, with ``doc_id``), so that no other copy of the documents is needed.

    ``source`` has rid, text, doc_id and n_bytes.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, tokens, freqs, special_rid, special_n = [], [], [], [], []
        for key, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
            found, specials = pre_tokens(text, config.value)
            counts = Counter(found)
            tokens.extend(counts.keys()), freqs.extend(counts.values()), owners.extend([key] * len(counts))
            if specials:
                special_rid.append(key), special_n.append(specials)
        none = lambda n: pa.nulls(n, pa.int64())
        parts = [
            pa.table({"rid": pa.array(owners, pa.int64()), "pre_token": pa.array(tokens, pa.string()), "freq": pa.array(freqs, pa.int64()),
                      "doc_id": none(len(owners)), "n_bytes": none(len(owners))}),
            pa.table({"rid": pa.array(special_rid, pa.int64()), "pre_token": pa.nulls(len(special_rid), pa.string()),
                      "freq": pa.array(special_n, pa.int64()), "doc_id": none(len(special_rid)), "n_bytes": none(len(special_rid))}),
            pa.table({"rid": batch.column("rid"), "pre_token": pa.nulls(batch.num_rows, pa.string()), "freq": none(batch.num_rows),
                      "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}),
        ]
        return pa.concat_tables(parts).combine_chunks().to_batches()[0]

    return map_texts(source.select("rid", "text", "doc_id", "n_bytes"), run, FREQUENCIES)


#: Longest pre-token that may be broadcast; longer frequent ones take the shuffle like the rest.
HEAVY_CHARS = 256


def _met(config):
    """Per task: rows of pre-tokens that the shuffle brought together, each distinct pre-token encoded once.

    All rows of one pre-token land in one task, so a cache per task counts every distinct
    pre-token once in the whole job.
    """

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            tokens = batch.column("pre_token")
            distinct = pc.unique(tokens).to_pylist()
            new = [t for t in distinct if t not in known]
            known.update(zip(new, pieces(new, config.value)))
            where = pc.index_in(tokens, value_set=pa.array(distinct, pa.string())).to_numpy(zero_copy_only=False)
            each = np.array([known[t] for t in distinct], np.int64)[where] if len(distinct) else np.zeros(0, np.int64)
            tokens_out = batch.column("freq").to_numpy(zero_copy_only=False) * each
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(tokens_out, pa.int64())], names=["rid", "part"])

    return run


def _heavy(frequencies: DataFrame, config, parts: int) -> DataFrame:
    """The ``parts`` pre-tokens that a sample of the rows holds most often, with their numbers of pieces."""

    def encoded(batches):
        for batch in batches:
            counts = pieces(batch.column("pre_token").to_pylist(), config.value)
            yield pa.RecordBatch.from_arrays([batch.column("pre_token"), pa.array(counts, pa.int64())], names=["pre_token", "n_pieces"])

    share = min(1.0, HEAVY_SAMPLE / max(1, frequencies.count()))
    drawn = frequencies.select("pre_token").sample(share, seed=11).where(F.length("pre_token") <= HEAVY_CHARS)
    most = drawn.groupBy("pre_token").count().where("count > 1").orderBy(F.desc("count"), "pre_token").limit(parts)
    return written(most.select("pre_token").mapInArrow(encoded, "pre_token string, n_pieces long"), "frequent")


def _counted(source: DataFrame, tokenizer_path: str, heavy_parts: int = HEAVY_PARTS) -> tuple[DataFrame, DataFrame]:
    """(documents: rid, doc_id, n_bytes; n_tokens by rid for rows with any token) of a ``source`` with rid and text.

    Frequent pre-tokens (at most ``heavy_parts``, each of at most ``HEAVY_CHARS`` characters) are
    encoded once and joined where the rows lie. All other rows are shuffled by pre-token, which
    brings each pre-token's rows to the task that encodes it once.
    """
    spark = source.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        config = spark.sparkContext.broadcast(file.read())
    frequencies = written(_frequencies(source, config), "pre-tokens")
    known = frequencies.where(F.col("pre_token").isNotNull()).select("rid", "pre_token", "freq")
    heavy = _heavy(frequencies, config, heavy_parts)
    near = known.join(F.broadcast(heavy), "pre_token").select("rid", (F.col("freq") * F.col("n_pieces")).alias("part"))
    rest = known.join(F.broadcast(heavy.select("pre_token")), "pre_token", "left_anti").repartition("pre_token")
    met = rest.mapInArrow(_met(config), "rid long, part long")
    specials = frequencies.where(F.col("pre_token").isNull() & F.col("freq").isNotNull()).select("rid", F.col("freq").alias("part"))
    summed = near.unionByName(met).unionByName(specials).groupBy("rid").agg(F.sum("part").alias("n_tokens"))
    documents = frequencies.where(F.col("n_bytes").isNotNull()).select("rid", "doc_id", "n_bytes")
    return documents, summed


def _finished(rows: DataFrame, summed: DataFrame, limit: int) -> DataFrame:
    out = rows.join(summed, "rid", "left").withColumn("n_tokens", F.coalesce(F.col("n_tokens"), F.lit(0).cast("long")))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit)).drop("rid")


def _source(rows: DataFrame, text: str, doc_id) -> DataFrame:
    return rows.select("rid", F.col(text).alias("text"), doc_id.cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 2048, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``row`` (all columns of ``documents``) with ``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    The rows are stored once with their number ``rid``, to be joined back. The tokenizer file is
    read once on the driver and broadcast (a fixed vocabulary, not data).
    """
    rows = written(as_row(documents).withColumn("rid", F.monotonically_increasing_id()), "token-rows")
    counted, summed = _counted(_source(rows, "row.text", F.lit(None)), tokenizer_path, heavy_parts)
    return _finished(rows.join(counted.select("rid", "n_bytes"), "rid"), summed, limit)


def token_count_digests(documents: DataFrame, tokenizer_path: str, limit: int = 2048, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document.

    The texts are read once, by the pre-token pass, which also leaves one row per document; no
    copy of the texts is stored and none goes through a join.
    """
    source = _source(documents.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "text", F.col("doc_id"))
    counted, summed = _counted(source, tokenizer_path, heavy_parts)
    return _finished(counted, summed, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")

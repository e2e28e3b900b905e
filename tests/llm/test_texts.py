"""Tokens, personal data, benchmark passages and the learned operators against brute force or held-out rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from convfeat.llm import bpe, decontaminate, langid, pii, pitman_yor, quality
from convfeat.llm.catalog import QUERIES, SQL
from convfeat.session import shared_dir
from tests.llm.helpers import awkward, by_id, frame, prose

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---- tokens ----------------------------------------------------------------------------


def encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(spark):
    texts = [*awkward(), (20, "  a\n\n b 's it's IT'S 123456 ½ ²  　 ́x 🙂🙂 <|endoftext|>"), (21, "=" * 3000 + "ab" * 999)]
    own = encoding()
    expected = {}
    for i, text in texts:
        ids = own.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        expected[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    found = bpe.token_digests(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    assert by_id(found, "n_tokens", "ids_sha256", "decoded_sha256") == expected
    kept = bpe.tokenized_rows(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in kept} == {i: own.encode_ordinary(t or "") for i, t in texts}


# ---- personal data -----------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    texts = [
        *awkward(),
        (20, "mail a.b@c.de. x@y a@b@c.org ..@a-.b- call +49 (30) 1234-567 or +1 2 3, host 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"),
        (21, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713, 5500000000000004 9999.1.1.1"),
        (22, "größe é@x.de é +4930123456789 DE89 3704 0044 0532 0130 00 ssn 123-45-6789"),
        (23, "@@@" * 500 + "1." * 2000 + "+" * 500 + "1 " * 3000),
    ]
    rows = {r.doc_id: r for r in pii.span_digests(frame(spark, texts)).collect()}
    for i, text in texts:
        base = [(m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
        base.sort(key=lambda x: (x[0], list(PATTERNS).index(x[1])))
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == k for x in base) for k in PATTERNS]
        assert {s for s in joined.split(",") if s} <= set(rows[i].spans.split(","))
    assert "iban:" in rows[22].spans and "ssn:" in rows[22].spans


def test_long_digit_runs_and_ibans_in_a_row(spark):
    """An ip part of 5,000 leading zeros is a valid base ip; two IBANs in a row, or one behind a failed candidate, are both found."""
    ip = "0" * 5000 + "1.2.3.4"
    two = "pay DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 now"
    behind = "XX11 AAAAAAAAAAA DE89 3704 0044 0532 0130 00"
    rows = {r.doc_id: r for r in pii.span_digests(frame(spark, [(1, ip), (2, two), (3, behind), (4, "9" * 6000 + ".1.1.1")])).collect()}
    assert rows[1].n_ip == 1 and f"ip:0:{len(ip)}" in rows[1].spans
    assert rows[4].n_ip == 0
    ibans = [(s.start, s.end) for s in pii.find(two) if s.kind == "iban"]
    assert [two[a:b] for a, b in ibans] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert [behind[s.start : s.end] for s in pii.find(behind) if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert rows[2].spans.count("iban:") == 2 and rows[3].spans.count("iban:") == 1


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


# ---- benchmark ---------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_expected(texts, items):
    patterns = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 9)) if w else ():
            patterns.setdefault(tuple(w[at : at + 10]), set()).add(item)
    out = {}
    for i, text in texts:
        w, hit, named = words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for at in range(len(w) - size + 1):
                if (p := tuple(w[at : at + size])) in patterns:
                    hit.update(range(at, at + size))
                    named |= patterns[p]
        ids = ",".join(sorted(str(x) for x in named if x is not None))
        out[i] = (len(w), len(hit), len(named - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_OF_ITEMS, 300])
def test_benchmark_passages(spark, block):
    """A block of 300 bytes makes several passes over the documents."""
    items = [
        (1, prose(40, 30)), (2, prose(41, 10)), (3, "Short One"), (4, None), (5, "?!"), (6, prose(41, 10)), (10, prose(42, 25)), (7, "zoë"),
        (None, prose(43, 12)),
    ]
    texts = [
        *awkward(), (20, "x " + prose(40, 30).upper() + ", y"), (21, "a " + prose(41, 10).replace(" ", "--") + " short one shortone"),
        (22, " ".join(prose(42, 25).split()[3:14])), (23, " ".join(prose(42, 25).split()[3:12])), (24, prose(43, 12)), (25, "Zoë zoëx"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.marked(frame(spark, texts), benchmark, block)
    expected = contamination_expected(texts, items)
    for r in marked.collect():
        ids = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert (r.n_words, r.n_hit, len(r["items"]), ids, r.n_hit > 0) == expected[r.row.doc_id], r.row.doc_id


def test_benchmark_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(frame(spark, awkward()), none).collect()} == {0}
    assert decontaminate.contamination(frame(spark, []), none).count() == 0
    df = frame(spark, awkward())
    items = spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")
    kept = decontaminate.clean_rows(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in awkward() if i not in (7, 8, 9)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    with duckdb.connect() as con:
        for view in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '/root/testdata/sf0.001/{view}.parquet'")
        expected = con.sql(SQL[name])
        found = QUERIES[name](spark, "/root/testdata/sf0.001").select(*expected.columns)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected.fetchall(), key=str)


# ---- learned operators ---------------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op6_langid"](spark, SF).collect()]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    judged = [(r.lang_pred, truth[r.doc_id]) for r in rows if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_language_cases(spark):
    found = by_id(langid.held_out_languages(frame(spark, [*awkward(), (20, "12 34 !")])), "lang_pred", "score")
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 20)) and found[1][0] == "en"
    assert langid.held_out_languages(frame(spark, [])).count() == 0


def test_longest_matches():
    """Phrases against a search for the longest match at each step."""
    learned, text = prose(50, 80), prose(51, 30)
    model = langid.Model({"a": learned})
    symbols, counts, _ = model.read([text])
    sample, s = bytes(model.read([learned])[0]), bytes(symbols)
    at = phrases = 0
    while at < len(s):
        size = 1
        while at + size < len(s) and s[at : at + size + 1] in sample:
            size += 1
        at, phrases = at + size, phrases + 1
    assert len(s) < langid.STRETCH and model.phrases(symbols, counts)[0, 0] == phrases


def test_language_model_base_scores(spark):
    texts = awkward()
    train, tokens = Counter(), {}
    for i, text in texts:
        tokens[i] = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]
        if remainder(i, 5) != 1:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    rows = pitman_yor.held_out_scores(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        mine = tokens[r.doc_id]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 5) == 1, len(mine), sum(train[t] > 0 for t in mine), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_language_model_beats_the_base(spark):
    """Perplexity of held-out texts, and blocks of another size leave base scores as they are."""
    rows = [r for r in QUERIES["op7_lm_score"](spark, SF).collect()]
    held_out = [r for r in rows if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)
    assert pitman_yor.held_out_scores(frame(spark, [])).count() == 0


def test_quality_of_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    rows = QUERIES["op9_quality"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    most = max(Counter(t for _, t in judged).values()) / len(judged)
    assert sum(a == b for a, b in judged) / len(judged) > max(0.75, most)


def test_quality_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.held_out_quality(frame(spark, awkward()), none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2 if i != 5 else None, 0) for i, _ in awkward()], "doc_id long, quality int, toxic int")
    assert quality.held_out_quality(frame(spark, awkward()), labels).count() == len(awkward())
    assert quality.held_out_quality(frame(spark, []), labels).count() == 0


def test_quality_learns_from_whole_texts(spark):
    """The sign of quality stands behind the first 6,000 characters of every text."""
    start = "the same opening of every text " * 200
    texts = [(i, start + ("good fine clean " if i % 2 else "spam junk noise ") * 300) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    rows = quality.held_out_quality(frame(spark, texts), labels).collect()
    held_out = [r for r in rows if r.held_out]
    assert len(held_out) > 40 and all(r.predicted == r.doc_id % 2 for r in held_out)


def test_quality_bound_on_repeated_ids(spark):
    texts = [(i % 20, f"{'good' if i % 2 else 'spam'} {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    network = quality.learn(frame(spark, texts), labels, rows=20)
    assert network.weights is not None


def test_language_model_reads_the_word_before(spark):
    """Words of equal counts: a pair seen in training outscores one that is not."""
    texts = [(i, "a b " * 5 if k % 2 else "c d " * 5) for k, i in enumerate(i for i in range(80) if remainder(i, 5) != 1)]
    first, second = [i for i in range(80) if remainder(i, 5) == 1][:2]
    texts += [(first, "a b"), (second, "a d")]
    rows = {r.doc_id: r for r in pitman_yor.held_out_scores(frame(spark, texts)).collect()}
    assert rows[first].held_out and rows[first].base_score == pytest.approx(rows[second].base_score, abs=0.1)
    assert rows[first].score > rows[second].score + 0.5


def shared_bytes(spark):
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))


def test_language_model_keeps_a_few_bytes_a_token(spark):
    """What stays in the shared folder of the pairs of all texts, and that no session setting is left behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shared_bytes(spark)
    scored = QUERIES["op7_lm_score"](spark, SF)
    kept = shared_bytes(spark) - before
    assert kept < 8 * sum(r.n_tokens for r in scored.collect()) and spark.conf.get(name) == setting


def test_language_model_layout(spark, setting):
    """Scores follow the texts alone: not their order, blocks, partitions or repeated and missing ids."""
    texts = [*awkward(), *((i, prose(i, 60)) for i in range(100, 130)), (100, prose(100, 60)), (None, prose(7, 40))]
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    read = lambda rows: sorted((str(r.doc_id), *(f"{r[c]:.6f}" for c in columns[1:])) for r in rows.collect())
    given = frame(spark, texts).withColumn("held_out", F.coalesce("doc_id", F.lit(1)) % 5 == 1)
    first = read(pitman_yor.scores(given, part=2000))
    setting("spark.sql.shuffle.partitions", "7")
    assert read(pitman_yor.scores(given.repartition(5), block=1000, part=2000)) == first and len(first) == len(texts)
    whole = read(pitman_yor.scores(given))
    assert [r[:6] for r in whole] == [r[:6] for r in first]


def test_language_model_without_training_rows(spark):
    rows = pitman_yor.scores(frame(spark, awkward()).withColumn("held_out", F.lit(True))).collect()
    assert len(rows) == len(awkward()) and all(r.train_tokens == r.n_known == 0 and r.score == pytest.approx(0, abs=1e-6) for r in rows)


def test_language_model_packs_arrays():
    for values in ([], [0], [1, 255], [3, 256, 70_000], [1 << 40, 7]):
        assert pitman_yor.unpacked(pitman_yor.packed(np.array(values, np.int64))).tolist() == values
    assert pitman_yor.unpacked(pitman_yor.packed(np.array([0.5, -1e-300]))).tolist() == [0.5, -1e-300]
    assert pitman_yor.unpacked_words(pitman_yor.packed_words([b"", "é".encode(), b"a"])) == [b"", "é".encode(), b"a"]

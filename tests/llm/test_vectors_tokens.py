"""Token counts, hard negatives and whitening against brute force, with the awkward cases."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convfeat.llm import hard_negatives, token_counts, whitening
from convfeat.llm.catalog import QUERIES
from tests.llm.helpers import awkward, frame

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
EMB = "vec_id long, embedding array<float>, label int, x string, rid long, score double"


def library_counts(texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("heavy_parts", [4096, 3])
def test_token_counts_equal_library(spark, heavy_parts):
    texts = awkward() + [(16, "a<|endoftext|>b <|startoftext|><|startoftext|>"), (17, "ÉCOLE  Straße\n\nit's 12,345 don't"), (1, "a repeated id"),
             (18, "ΣΟΦΟΣ Σ İstanbul ǅ ﬃ \x1c x\u3000y\u0085z e\u0301"), (19, "İstanbul ǅ ﬃ \x1c x\u3000y\u0085z e\u0301 ΑΒΓ ς")]
    out = token_counts.token_counts(frame(spark, texts), WORD_BPE, limit=100, heavy_parts=heavy_parts).collect()
    got = sorted((r.row.doc_id or -1, r.row.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in out)
    want = sorted((i or -1, t or "", len((t or "").encode()), n, n > 100) for (i, t), n in zip(texts, library_counts([t for _, t in texts])))
    assert got == want
    row_columns = {"doc_id", "text", "lang", "row", "rid", "score", "hits"}
    assert set(out[0].row.asDict()) == row_columns
    digests = token_counts.token_count_digests(frame(spark, texts), WORD_BPE, limit=100, heavy_parts=heavy_parts).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in digests) == sorted((i, b, n, o) for i, _, b, n, o in want)


def test_token_counts_join_many_frequent_pre_tokens_in_place(spark, monkeypatch):
    """20,000 pre-tokens of equal share are all met where their rows lie; a sketch of 10,000 left the rest to a shuffle."""
    tables = {}
    keep = token_counts.written
    monkeypatch.setattr(token_counts, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    words = ["".join("bcdfghjklm"[int(c)] + "a" for c in f"{i:05d}") for i in range(20_000)]
    texts = [" ".join(words[i % 20 :: 20]) for i in range(60)]
    out = token_counts.token_count_digests(frame(spark, list(enumerate(texts))), WORD_BPE).collect()
    assert [r.n_tokens for r in sorted(out, key=lambda r: r.doc_id)] == library_counts(texts)
    assert tables["frequent"].count() == 20_000


def test_token_counts_empty_table(spark):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert token_counts.token_count_digests(empty, WORD_BPE).count() == 0


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, lab, "extra", -1, 0.5) for i, v, lab in rows], EMB).repartition(3)


def random_rows(seed: int, n: int, width: int = 6, spread: int = 3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        vec = [rng.randint(-spread, spread) / 256 + 1e-6 for _ in range(width)]
        rows.append((10 * k, vec, rng.randint(0, 2)))
    return rows


def awkward_rows(seed: int):
    rows = random_rows(seed, 300)
    rows += [(5000, None, 1), (5010, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (5020, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (5030, [float("inf")] * 6, 2),
             (5040, [0.01] * 6, None), (None, [0.02] * 6, 1), (5050, [0.03, 0.01], 0)]
    rows += [rows[3], rows[10], rows[10]]  # repeated rows, anchors among them
    return rows


def brute_negatives(rows):
    usable = []
    for r, (vid, vec, label) in enumerate(rows):
        if vid is None or label is None or vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        label = (label + 1) % 10 if vid % 7 == 0 else label
        usable.append((r, vid, label, [math.floor(256 * float(np.float32(v))) for v in vec]))
    width = max((len(x) for *_, x in usable), default=0)
    usable = [(r, vid, lab, x + [0] * (width - len(x))) for r, vid, lab, x in usable]
    out = []
    for ar, aid, alab, ax in usable:
        if aid % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(ax, x)), vid, r, lab) for r, vid, lab, x in usable if r != ar), key=lambda t: (-t[0], t[1], t[2]))
        positives = [t for t in scored if t[3] == alab][:5]
        for ps, pid, *_ in positives:
            picked = [t for t in scored if t[3] != alab and 80 * ps <= 100 * t[0] <= 100 * ps][:5]
            out.extend((aid, pid, k + 1, t[1], ps, t[0]) for k, t in enumerate(picked))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1024, 8192, 256), (7, 40, 5)])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = awkward_rows(3)
    got = hard_negatives.hard_negatives(embeddings(spark, rows), *sizes).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)
    assert got


@pytest.mark.parametrize("sizes", [(1024, 8192, 256), (7, 40, 5)])
def test_hard_negatives_groups_meet_without_merged_partitions(spark, setting, sizes):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.shuffle.partitions", "7")
    rows = awkward_rows(5)
    got = hard_negatives.hard_negatives(embeddings(spark, rows), *sizes).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)


def test_hard_negatives_anchor_longer_than_the_rows_of_its_block():
    x = np.array([[1 << 26, 1 << 26]], np.int64)
    index = hard_negatives.Index(x, np.array([1]), np.array([0]), np.array([0]))
    q = np.array([1 << 40, 1 << 40], np.int64)
    assert int(index.scores(np.array([0]), q)[0]) == 2 << 66


def test_hard_negatives_wide_values_and_empty(spark):
    rows = [(100 * k, [random.Random(k).uniform(-1, 1) * 10**6 for _ in range(4)], k % 2) for k in range(40)]
    rows += [(100 * k + 1, [random.Random(k).uniform(-1, 1) * 10**6 for _ in range(4)], k % 3) for k in range(40)]
    got = hard_negatives.hard_negatives(embeddings(spark, rows), 3, 16, 4).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(embeddings(spark, rows).limit(0)).count() == 0


def brute_whitening(rows):
    xs = {}
    for vid, vec, _ in rows:
        if vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        xs[vid] = [math.floor(256 * float(np.float32(v))) for v in vec]
    width = max(len(x) for x in xs.values())
    xs = {k: x + [0] * (width - len(x)) for k, x in xs.items()}
    fit = np.array(sorted(set(map(tuple, xs.values()))), np.float64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return xs, n, sums, values[order], vectors[:, order]


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening_equal_brute_force(spark, seed):
    rows = awkward_rows(seed)
    rows = [(i if i is not None else 9999, v, lab) for i, v, lab in rows]
    got = whitening.whitened(embeddings(spark, rows)).collect()
    xs, n, sums, values, vectors = brute_whitening(rows)
    trace = values.sum()
    assert {r.vec_id for r in got} == set(xs) and {r.component for r in got} == {1, 2, 3, 4}
    for r in got:
        x = np.array(xs[r.vec_id], np.float64)
        assert r.n == n
        assert r.deviation == sum(int(n * a - s) ** 2 for a, s in zip(xs[r.vec_id], sums.astype(np.int64)))
        k = r.component - 1
        assert abs(r.explained - values[k] / trace) <= 1e-6 * values[k] / trace
        want = (x - sums / n) @ vectors[:, k] / math.sqrt(values[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-6
        assert r.identity_error < 1e-9
    by_component = {}
    for r in got:  # one sign per component for all rows
        x = np.array(xs[r.vec_id], np.float64)
        want = (x - sums / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            by_component.setdefault(r.component, set()).add(np.sign(want) == np.sign(r.whitened))
    assert all(len(v) == 1 for v in by_component.values())


def test_whitening_degenerate(spark):
    same = [(k, [0.5, 0.25, 0.0], 1) for k in range(5)]
    assert whitening.whitened(embeddings(spark, same)).count() == 0
    assert whitening.whitened(embeddings(spark, same).limit(0)).count() == 0
    line = [(k, [k / 256, 2 * k / 256, 0.0], 1) for k in range(6)]  # rank one: a single component
    got = whitening.whitened(embeddings(spark, line)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)


def test_lanczos_repeated_eigenvalues():
    rng = np.random.default_rng(0)
    basis, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    spectrum = np.array([9, 9, 9, 4, 4, 1, 1, 1, 0.5, 0.5, 0.1, 0.1])
    gram = basis @ np.diag(spectrum) @ basis.T
    sigma, right = whitening.bidiagonalise(lambda a: gram @ a, 12, math.sqrt(spectrum.sum()))
    assert np.allclose(sigma[:5] ** 2, [9, 9, 9, 4, 4])
    for k in range(5):
        assert np.allclose(gram @ right[:, k], sigma[k] ** 2 * right[:, k], atol=1e-9)


def test_queries_registered():
    assert {"op11_token_counts", "op12_hard_negatives", "op13_whitening"} <= set(QUERIES)

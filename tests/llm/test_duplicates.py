"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from convfeat.llm import chunk_dedup, exact_dedup, jaccard, suffix_dedup
from tests.llm.helpers import awkward, by_id, frame, prose


def exact_expected(texts):
    bodies = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts}
    points = {i: len(t or "") for i, t in texts}
    out = {}
    for i, body in bodies.items():
        same = [j for j, other in bodies.items() if other == body]
        keep = min(same, key=lambda j: (-points[j], j))
        out[i] = (keep, len(same), i == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3,)])
def test_exact_duplicates(spark, primes):
    """Three as the only modulus makes different texts collide, so the comparison must tell them apart."""
    texts = [x for x in awkward() if primes != (3,) or x[0] not in (10, 15)]
    found = exact_dedup.exact_duplicates(frame(spark, texts), primes)
    assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == exact_expected(texts)


def test_exact_duplicates_keep_all_columns(spark):
    df = frame(spark, awkward())
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in exact_expected(awkward()).items() if x[2])


def test_fingerprints_combine():
    data = np.frombuffer(prose(8, 4000).encode(), np.uint8)
    whole = exact_dedup.fingerprints(data, np.array([0, len(data)]))[0]
    for cut in (0, 1, 4096, 10_001):
        parts = exact_dedup.fingerprints(data, np.array([0, cut, len(data)]))
        for k in range(4):
            joined = exact_dedup.combine((int(parts[0, k]), cut), (int(parts[1, k]), len(data) - cut), k)
            assert joined == (int(whole[k]), len(data))


def n_grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_expected(texts):
    sets = {i: n_grams(t) for i, t in texts}
    links = {i: set() for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - group
            group |= fresh
            todo += fresh
        copies = [j for j in sets if sets[j] and sets[j] == sets[i]] or [i]
        others = {sets[j] for j in links[i]} - {sets[i]}
        out[i] = (min(group), len(group), min(copies), len(links[i]), len(others))
    return out


def near_texts():
    base = prose(20, 300).split()
    texts = [*awkward()]
    for k in range(40):
        changed = list(base)
        for at in range(k % 7):
            changed[(k * 13 + at * 41) % 300] = f"w{k}x{at}"
        texts.append((100 + k, " ".join(changed)))
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block):
    """Blocks of four rows make one group meet over many block pairs."""
    texts = near_texts()
    found = jaccard.near_duplicates(frame(spark, texts), block=block)
    assert by_id(found, "class_id", "group_size", "copy_id", "n_links", "n_class_links") == near_expected(texts)


def test_near_duplicates_leave_one_row_of_each_group(spark):
    df = frame(spark, near_texts())
    kept = jaccard.distinct_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[0] for x in near_expected(near_texts()).values()})


def test_banding_reaches_its_recall():
    bands, rows = jaccard.banding()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def removed_expected(texts, width=100):
    seen, out = set(), {}
    for i, text in sorted(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - width + 1):
            window = data[at : at + width]
            if window in seen:
                gone[at : at + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block, per_salt", [(8 << 20, 16_000), (3000, 1)])
def test_repeated_substrings(spark, block, per_salt):
    """Small blocks and salts of one piece make every repeat cross blocks and shards."""
    texts = [*awkward(), (16, "ab" * 300), (17, "q" + "ab" * 200), (18, prose(2, 40)[3:])]
    found = suffix_dedup.without_repeats(frame(spark, texts), block=block, per_salt=per_salt)
    assert by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_expected(texts)


def chunks_expected(texts):
    first, cut = {}, {}
    for i, text in sorted(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        ends = chunk_dedup.chunk_ends(data, np.array([0, len(data)])).tolist()
        cut[i] = [(a, b, data[a:b].tobytes()) for a, b in zip([0, *ends], ends)]
    out = {}
    for i in sorted(cut):
        runs = []
        for a, b, body in cut[i]:
            if body in first:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            first.setdefault(body, i)
        runs = [(a, b) for a, b in runs if b - a >= chunk_dedup.LEAST_RUN]
        out[i] = (len(cut[i]), sum(b - a for a, b in runs), runs)
    return out


def test_repeated_chunks(spark):
    found = chunk_dedup.repeated_passages(frame(spark, awkward()))
    rows = {r.doc_id: (r.n_chunks, r.n_removed, [(x.start, x.end) for x in r.runs]) for r in found.collect()}
    assert rows == chunks_expected(awkward())
    assert rows[8][1] > 250 and rows[7][1] == 0 and rows[5][1] > 0


def test_chunks_come_back_after_an_insertion():
    data = prose(30, 2000).encode()
    other = b"some new words here " + data

    def bodies(x):
        ends = chunk_dedup.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)])).tolist()
        return {x[a:b] for a, b in zip([0, *ends], ends)}

    assert len(bodies(data) - bodies(other)) <= 3


def test_repeated_chunks_keep_all_columns(spark):
    df = frame(spark, awkward())
    kept = chunk_dedup.deduplicated_rows(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert by_id(kept, "text")[2] == (None,)


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_duplicates, jaccard.near_duplicates, suffix_dedup.removal_digests, chunk_dedup.passage_digests],
)
def test_empty_tables_null_and_equal_ids(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    texts = [(None, prose(2, 40)), (None, None), (1, prose(2, 40)), (1, prose(2, 40)), (1, "")]
    assert sorted(str(r.doc_id) for r in operator(frame(spark, texts)).collect()) == ["1", "1", "1", "None", "None"]

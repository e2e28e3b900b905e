"""Padding, slicing and regrouping of list columns.

List elements are visited once: every helper maps over positions or elements of a column, or
of a value bound by :func:`let`, so nothing is recomputed per element.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, count

from convfeat.functions.ids import clean_id, clip_vocab

_names = count()


def fresh(kind: str) -> str:
    """A lambda variable no column or outer lambda uses."""
    return f"__{kind}{next(_names)}"


def positions(n: int) -> str:
    return f"sequence(0, {n - 1})"


def mapped(arr: str, body: Callable[[str], str]) -> str:
    x = fresh("x")
    return f"transform({arr}, {x} -> {body(x)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return f"get({mapped(f'array({value})', body)}, 0)"


def joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})"


def valid_length(arr: str, n: int) -> str:
    """min(size, n); a null list has length 0."""
    return f"int(greatest(least(coalesce(size({arr}), 0), {n}), 0))"


def pad_ids(arr: str, n: int, each: Callable[[str], str] | None = None) -> str:
    """First ``n`` ids, missing ones as 0, filled with 0 on the right; ``each`` maps the ids."""
    padded = mapped(positions(n), lambda i: clean_id(f"get({arr}, {i})"))
    return mapped(padded, each) if each else padded


def pad_raw(arr: str, n: int) -> str:
    """Like :func:`pad_ids`, but negative values stay."""
    return mapped(positions(n), lambda i: f"coalesce(bigint(get({arr}, {i})), 0L)")


def pad_floats(arr: str, n: int) -> str:
    """First ``n`` values, NaN included, filled with 0.0 on the right."""
    given = mapped(f"slice({arr}, 1, {n})", lambda x: f"coalesce(double({x}), 0D)")
    return f"concat(coalesce({given}, array()), array_repeat(0D, {n} - {valid_length(arr, n)}))"


def clip_vocab_array(arr: str, vocab: int, mode: str = "clip") -> str:
    return mapped(arr, lambda x: clip_vocab(x, vocab, mode))


def padding_mask(length: str, n: int) -> str:
    """true where a position lies behind the valid part."""
    return mapped(positions(n), lambda i: f"{i} >= {length}")


def latest_k(arr: str, length: str, k: int) -> str:
    """The last ``k`` elements of the valid part; all of it when it is shorter."""
    return f"slice({arr}, greatest({length} - {k}, 0) + 1, least({length}, {k}))"


def feature_slice(vector: str, span: tuple[int, int]) -> str:
    offset, length = span
    return f"slice({vector}, {offset + 1}, {length})"


def chunk_pad(vector: str, width: int, n: int) -> str:
    """``n`` equally long chunks of a vector of ``width``, the last one zero-filled."""
    chunk = -(-width // n)
    filled = f"concat(cast({vector} AS array<double>), array_repeat(0D, {chunk * n - width}))"
    return let(filled, lambda v: mapped(positions(n), lambda c: f"slice({v}, {c} * {chunk} + 1, {chunk})"))


def stack_segments(vector: str, lengths: list[int]) -> str:
    """Cut a vector into consecutive segments, each cleaned and zero-filled to the longest."""
    longest = max(lengths)
    starts = list(accumulate(lengths, initial=0))

    def cut_up(v: str) -> str:
        pieces = [
            f"concat({mapped(f'slice({v}, {start + 1}, {length})', finite)}, array_repeat(0D, {longest - length}))"
            for start, length in zip(starts, lengths)
        ]
        return f"array({', '.join(pieces)})"

    return let(vector, cut_up)


def finite(x: str, nan: float = 0.0, posinf: float = 0.0, neginf: float = 0.0) -> str:
    """Replace NaN and infinities; null counts as NaN."""
    if nan == posinf == neginf:  # one comparison, which null, NaN and infinities all fail
        return f"CASE WHEN abs(double({x})) < double('Infinity') THEN double({x}) ELSE double({nan}) END"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN double({nan}) WHEN {x} = double('Infinity') THEN double({posinf}) "
        f"WHEN {x} = double('-Infinity') THEN double({neginf}) ELSE double({x}) END"
    )

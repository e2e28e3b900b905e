"""Cleaning, vocabulary clipping, hashing and routing of id features."""

from __future__ import annotations

from convfeat.layout import ITEM_HASH_BUCKETS


def clean_id(x: str) -> str:
    """Missing (null, zero or negative) -> 0."""
    return f"greatest(bigint({x}), 0L)"


def clip_vocab(x: str, vocab: int, mode: str = "clip", name: str = "id") -> str:
    """Ids from ``vocab`` upwards become 0, or fail the job; no vocabulary forces 0."""
    if mode not in ("clip", "raise"):
        raise ValueError(f"unknown mode {mode!r}")
    if vocab <= 0:
        return "0L"
    beyond = "0L"
    if mode == "raise":
        beyond = f"bigint(raise_error(concat('{name}: ', string({x}), ' is not in [0, {vocab})')))"
    return f"CASE WHEN {x} >= {vocab} THEN {beyond} ELSE {x} END"


def hash_item(x: str, buckets: int = ITEM_HASH_BUCKETS) -> str:
    """Item id -> 1..buckets; missing -> 0."""
    return f"CASE WHEN {x} > 0 THEN pmod({x} - 1, {buckets}L) + 1 ELSE 0L END"


def hash_seq(x: str, buckets: int) -> str:
    """Sequence id -> 1..buckets (a different rule from items); missing -> 0."""
    return f"CASE WHEN {x} > 0 THEN pmod({x}, {buckets}L) + 1 ELSE 0L END"


def route_feature(
    domain: str,
    fid: int,
    vocab: int,
    skip_threshold: int,
    hash_buckets: int,
    allowlist: dict[str, set[int]],
    hash_all: bool = False,
) -> str:
    """Where the vectors of a feature come from: its own ``table``, a ``hash`` table, or ``zero``.

    An oversized feature is hashed when ``hash_all`` is set or ``allowlist`` names it by domain.
    """
    oversized = skip_threshold > 0 and vocab > skip_threshold
    if vocab > 0 and not oversized:
        return "table"
    allowed = hash_all or fid in allowlist.get(domain, ())
    return "hash" if oversized and hash_buckets > 0 and allowed else "zero"


def routed_id(x: str, route: str, hash_buckets: int) -> str:
    """The key to look up under a route of :func:`route_feature`."""
    if route == "table":
        return x
    if route == "hash":
        return hash_seq(x, hash_buckets)
    return "0L"

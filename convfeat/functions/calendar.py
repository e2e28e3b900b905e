"""Calendar ids of Unix seconds and buckets of time gaps."""

from __future__ import annotations

# Local time is a constant shift from UTC, without daylight saving.
LOCAL_SHIFT = 28_800
DAY = 86_400

# Upper edges, in seconds, of the time-gap buckets.
GAP_EDGES = (
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
)
GAP_BUCKETS = len(GAP_EDGES) + 1


def _of_day(ts: str) -> str:
    return f"pmod({ts} + {LOCAL_SHIFT}, {DAY}L)"


def hour_id(ts: str) -> str:
    """1..24."""
    return f"({_of_day(ts)} div 3600 + 1)"


def day_id(ts: str) -> str:
    """1..7, Monday = 1."""
    return f"(pmod(({ts} + {LOCAL_SHIFT} - {_of_day(ts)}) div {DAY} + 3, 7L) + 1)"


def weekend_id(ts: str) -> str:
    """1 = working day, 2 = weekend."""
    return f"CASE WHEN {day_id(ts)} >= 6 THEN 2L ELSE 1L END"


def daypart_id(ts: str) -> str:
    """1..4: night, morning, afternoon, evening."""
    return f"({_of_day(ts)} div 21600 + 1)"


def sample_clock(ts: str) -> list[str]:
    return [hour_id(ts), day_id(ts), weekend_id(ts), daypart_id(ts)]


def _bucket_of(gap: str, low: int, high: int) -> str:
    """Binary decision over the edges: how many of ``GAP_EDGES[low:high]`` lie below, plus low + 1."""
    if low == high:
        return f"{low + 1}L"
    middle = (low + high) // 2
    below, above = _bucket_of(gap, low, middle), _bucket_of(gap, middle + 1, high)
    return f"CASE WHEN {gap} <= {GAP_EDGES[middle]} THEN {below} ELSE {above} END"


def time_bucket(sample_ts: str, event_ts: str) -> str:
    """0 for a missing (zero) event time, else 1..63 growing with the gap; future events count as gap 0.

    The last edge never opens a bucket of its own: everything beyond the one before it shares 63.
    """
    found = _bucket_of(f"({sample_ts} - {event_ts})", 0, len(GAP_EDGES) - 1)
    return f"CASE WHEN {event_ts} = 0 THEN 0L ELSE {found} END"


def event_hour(ts: str) -> str:
    return f"CASE WHEN {ts} > 0 THEN {hour_id(ts)} ELSE 0L END"


def event_day(ts: str) -> str:
    return f"CASE WHEN {ts} > 0 THEN {day_id(ts)} ELSE 0L END"

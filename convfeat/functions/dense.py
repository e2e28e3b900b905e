"""Element-wise scaling of dense vectors."""

from __future__ import annotations

from convfeat.functions.arrays import finite, fresh, let, mapped


def nan_to_num(arr: str, nan: float = 0.0, posinf: float = 0.0, neginf: float = 0.0) -> str:
    return mapped(arr, lambda x: finite(x, nan, posinf, neginf))


def l2_normalize(arr: str, eps: float = 1e-6) -> str:
    """Cleaned vector divided by max(its norm, eps)."""

    def scaled(clean: str) -> str:
        acc, x = fresh("acc"), fresh("x")
        squares = f"aggregate({clean}, 0D, ({acc}, {x}) -> {acc} + {x} * {x})"
        norm = f"greatest(sqrt({squares}), double({eps}))"
        return let(norm, lambda by: mapped(clean, lambda y: f"{y} / {by}"))

    return let(nan_to_num(arr), scaled)


def log_clamp(arr: str, top: float = 20.0) -> str:
    """log1p of the cleaned, non-negative part, at most ``top``."""
    return mapped(arr, lambda x: f"least(log1p(greatest({finite(x)}, 0D)), double({top}))")


def smooth_clip(arr: str, limit: float = 3.0, scale: float = 1.0, bias: float = 0.0) -> str:
    """Squash into (-limit, limit) without a corner, then scale and shift."""
    clean = nan_to_num(arr, 0.0, limit, -limit)
    c, s, b = (f"double({v})" for v in (limit, scale, bias))
    return mapped(clean, lambda y: f"{y} / sqrt(1D + ({y} / {c}) * ({y} / {c})) * {s} + {b}")

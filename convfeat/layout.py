"""Declared feature layout of a sample table: which columns exist, how wide, which vocabulary.

Plain job parameters; nothing here touches Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

# Ids of the derived features, their vocabulary sizes, default sizes.
SAMPLE_CLOCK_FIDS = (1_200_001, 1_200_002, 1_200_003, 1_200_004)
SAMPLE_CLOCK_VOCABS = (24, 7, 2, 4)
ITEM_HASH_FID = 1_300_001
ITEM_HASH_BUCKETS = 50_000
EVENT_HOUR_FID = 1_400_001
EVENT_DAY_FID = 1_400_002
DEFAULT_MAX_LEN = 256


@dataclass(frozen=True)
class IdFeature:
    fid: int
    vocab: int
    dim: int = 1


@dataclass(frozen=True)
class DenseFeature:
    fid: int
    dim: int


@dataclass(frozen=True)
class SequenceDomain:
    name: str
    prefix: str
    ts_fid: int | None
    features: tuple[tuple[int, int], ...]
    max_len: int = DEFAULT_MAX_LEN

    def column(self, fid: int) -> str:
        return f"{self.prefix}_{fid}"

    @property
    def side_features(self) -> tuple[tuple[int, int], ...]:
        return tuple((fid, vocab) for fid, vocab in self.features if fid != self.ts_fid)


@dataclass(frozen=True)
class FeatureLayout:
    user_ids: tuple[IdFeature, ...] = ()
    item_ids: tuple[IdFeature, ...] = ()
    user_dense: tuple[DenseFeature, ...] = ()
    domains: tuple[SequenceDomain, ...] = ()
    sample_clock: bool = False
    event_clock: bool = False
    item_buckets: int = 0
    groups: dict[str, dict[str, tuple[int, ...]]] = field(default_factory=dict)

    # ---- columns ---------------------------------------------------------

    @staticmethod
    def id_column(side: str, fid: int) -> str:
        return f"{side}_int_feats_{fid}"

    @staticmethod
    def dense_column(fid: int) -> str:
        return f"user_dense_feats_{fid}"

    def input_columns(self) -> list[str]:
        """Every column the layout reads, in a stable order."""
        names = ["timestamp", "label_type", "user_id"]
        if self.item_buckets:
            names.append("item_id")
        names += [self.id_column("user", f.fid) for f in self.user_ids]
        names += [self.id_column("item", f.fid) for f in self.item_ids]
        names += [self.dense_column(f.fid) for f in self.user_dense]
        for domain in self.domains:
            names += [domain.column(fid) for fid, _ in domain.features]
            if domain.ts_fid is not None and domain.ts_fid not in dict(domain.features):
                names.append(domain.column(domain.ts_fid))
        return list(dict.fromkeys(names))

    # ---- flat vectors ----------------------------------------------------

    def side_features(self, side: str) -> list[IdFeature]:
        """Id features of a side with the derived ones appended."""
        if side == "user":
            extra = zip(SAMPLE_CLOCK_FIDS, SAMPLE_CLOCK_VOCABS) if self.sample_clock else ()
            return [*self.user_ids, *(IdFeature(fid, vocab) for fid, vocab in extra)]
        if side == "item":
            extra = [IdFeature(ITEM_HASH_FID, self.item_buckets + 1)] if self.item_buckets else []
            return [*self.item_ids, *extra]
        raise ValueError(f"unknown side {side!r}")

    def spans(self, side: str) -> dict[int, tuple[int, int]]:
        """fid -> (offset, length) in the flat vector of ``user``, ``item`` or ``dense``."""
        features = self.user_dense if side == "dense" else self.side_features(side)
        result: dict[int, tuple[int, int]] = {}
        offset = 0
        for feature in features:
            result[feature.fid] = (offset, feature.dim)
            offset += feature.dim
        return result

    def width(self, side: str) -> int:
        return sum(length for _, length in self.spans(side).values())

    # ---- groups ----------------------------------------------------------

    def feature_groups(self, side: str) -> list[list[int]]:
        """The declared groups of a side (one per fid if none are declared), in one pass.

        Derived fids (sample clock, item hash) leave the group that names them and close the last
        group, so the number of groups does not change; groups left empty drop out.
        """
        known = [f.fid for f in self.side_features(side)]
        derived = [fid for fid in known if fid in {*SAMPLE_CLOCK_FIDS, ITEM_HASH_FID}]
        declared = self.groups.get(side) or {str(fid): [fid] for fid in known}
        groups = []
        for fids in declared.values():
            strange = [fid for fid in fids if fid not in known]
            if strange:
                raise KeyError(f"group of side {side!r} names fid {strange[0]}, which the layout lacks")
            own = [fid for fid in fids if fid not in derived]
            if own:
                groups.append(own)
        if derived:
            groups[-1:] = [(groups[-1] if groups else []) + derived]
        return groups

    # ---- side files ------------------------------------------------------

    def to_json(self) -> str:
        return json.dumps(
            {
                "user_int": [[f.fid, f.vocab, f.dim] for f in self.user_ids],
                "item_int": [[f.fid, f.vocab, f.dim] for f in self.item_ids],
                "user_dense": [[f.fid, f.dim] for f in self.user_dense],
                "seq": {
                    d.name: {
                        "prefix": d.prefix,
                        "ts_fid": d.ts_fid,
                        "features": [list(pair) for pair in d.features],
                        "max_len": d.max_len,
                    }
                    for d in self.domains
                },
                "sample_clock": self.sample_clock,
                "event_clock": self.event_clock,
                "item_buckets": self.item_buckets,
                "groups": {side: {k: list(v) for k, v in g.items()} for side, g in self.groups.items()},
            }
        )

    @classmethod
    def from_json(cls, text: str, max_lens: dict[str, int] | None = None) -> FeatureLayout:
        """Read a schema side file; the derived-feature switches default to off when absent."""
        raw = json.loads(text)
        lens = max_lens or {}
        domains = tuple(
            SequenceDomain(
                name,
                spec["prefix"],
                spec["ts_fid"],
                tuple((fid, vocab) for fid, vocab in spec["features"]),
                lens.get(name, spec.get("max_len", DEFAULT_MAX_LEN)),
            )
            for name, spec in sorted(raw.get("seq", {}).items())
        )
        layout = cls(
            user_ids=tuple(IdFeature(*row) for row in raw.get("user_int", ())),
            item_ids=tuple(IdFeature(*row) for row in raw.get("item_int", ())),
            user_dense=tuple(DenseFeature(*row) for row in raw.get("user_dense", ())),
            domains=domains,
            sample_clock=raw.get("sample_clock", False),
            event_clock=raw.get("event_clock", False),
            item_buckets=raw.get("item_buckets", 0),
        )
        return layout.with_groups(raw.get("groups", {}))

    def with_groups(self, groups: dict[str, dict[str, list[int]]]) -> FeatureLayout:
        frozen = {
            side.removesuffix("_ns_groups"): {name: tuple(fids) for name, fids in table.items()}
            for side, table in groups.items()
            if not side.startswith("_")
        }
        return replace(self, groups=frozen)

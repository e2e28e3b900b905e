"""Small tables with the awkward cases, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, row int, rid long, score double, hits string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(words))


def frame(spark, texts: list[tuple[int | None, str | None]], parts: int = 3):
    """Texts under ids, with further columns whose names operators use themselves."""
    rows = [(i, text, None if k % 5 == 4 else "en", k, -k, 0.5, "x") for k, (i, text) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_id(df, *columns: str) -> dict:
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def awkward() -> list[tuple[int, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, a long text and one without spaces."""
    passage = prose(1, 60)
    return [
        (1, prose(2, 40)), (2, None), (3, ""), (4, " \t\n"), (5, prose(2, 40)), (6, prose(2, 40) + " "),
        (7, prose(3, 30) + " " + passage + " " + prose(4, 30)), (8, prose(5, 20) + " " + passage), (9, passage + " " + passage),
        (10, prose(6, 9000)), (11, "x" * 5000), (12, "Zoë größer façade 東京 12 über alles" * 5), (13, prose(7, 3)), (14, prose(7, 3).upper()),
        (15, prose(6, 9000) + " more"),
    ]

"""Small documents with every awkward case: nulls, empty and short texts, copies, near copies, repeated rows."""

from __future__ import annotations

import random

from sensorloom.llm.registry import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hashes string, pos int, block long"


def texts(seed: int = 1, count: int = 40) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]

    def prose(n: int) -> list[str]:
        return rng.choices(vocabulary, k=n)

    common = prose(70)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(count):
        words = prose(rng.choice([6, 30, 120, 300]))
        if i % 4 == 1:
            words = words[:20] + common + words[20:]
        rows.append((i, " ".join(words)))
    long = prose(3000)
    rows += [(100, " ".join(long)), (101, " ".join(long[:1500] + prose(2) + long[1500:]))]
    for i in range(110, 122):  # near copies
        words = list(long[:200])
        words[rng.randrange(200)] = "edit"
        rows.append((i, "\n".join(words)))
    rows += [(130 + i, rows[5][1]) for i in range(6)]  # copies
    rows += [(140, None), (141, ""), (142, " \t\n"), (143, "Word"), (144, "word"), (145, "two Words"), (None, rows[5][1]), (None, None)]
    rows += [rows[5], rows[5], (150, "a" * 400), (151, "x " * 300)]
    return rows


def documents(spark, rows=None):
    """The rows as documents, with extra columns named like columns that operators use."""
    prepare(spark)
    rows = texts() if rows is None else rows
    full = [(d, t, "en", f"s{(d or 0) % 3}" if (d or 0) % 7 else None, len(t or ""), "h", 1, 2) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def shown(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}

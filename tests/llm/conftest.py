from __future__ import annotations

import random

import pytest

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega straße señor été 漢字 x1 y2 z3").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else "") for _ in range(n))


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, repeated lines, NULLs, empty and long texts, equal ids."""
    rng = random.Random(seed)
    line = sentence(rng, 14)
    rows: list[tuple[int | None, str | None]] = [
        (1000, None), (1001, ""), (1002, "  \n\t "), (1003, "one"), (1004, "one"), (1005, "two words here"),
        (None, sentence(rng, 30)), (1006, sentence(rng, 6000)), (1007, "same " * 400), (1007, "same " * 400)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and i > 5:
            rows.append((i, rows[rng.randint(10, len(rows) - 1)][1]))
        elif kind < 0.4 and i > 5:
            words = (rows[rng.randint(10, len(rows) - 1)][1] or "a").split(" ")
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
        else:
            parts = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.4:
                parts.insert(rng.randint(0, len(parts)), line if rng.random() < 0.5 else line + " more")
            rows.append((i, "\n".join(parts)))
    return rows


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture
def frame(spark):
    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)
    return make


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def words(text: str | None) -> list[bytes]:
    return lower(text).split()

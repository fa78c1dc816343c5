"""Small tables with every awkward case."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _key string, fp string, size string, row_key string, base_email string, covered string, score string, shard string, times string"


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def vocabulary(rng: random.Random, letters: str) -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)]


def text_of(rng: random.Random, words: list[str], sentences: int) -> str:
    return " ".join(sentence(rng, words, rng.randint(5, 12)) for _ in range(sentences))


def awkward_rows() -> list[tuple]:
    """Ids, texts, languages and sources: copies, near copies, nulls, empty and blank texts, repeated rows, a very long text."""
    rng = random.Random(5)
    en, de = vocabulary(rng, "etaoinshr"), vocabulary(rng, "üölcmfwyp")
    rows = [(i, text_of(rng, en if i % 2 else de, rng.randint(2, 9)), "en" if i % 2 else "de", f"src{i % 3}") for i in range(40)]
    passage = text_of(rng, en, 6)
    rows += [(40 + i, f"{text_of(rng, en, 2)} {passage} {text_of(rng, en, 2)}", "en", "src0") for i in range(6)]
    copy = text_of(rng, de, 60)
    rows += [(50 + i, copy, "de", "src1") for i in range(12)]
    rows += [(70 + i, copy + " " + en[i], "de", "src1") for i in range(8)]
    rows += [(80, None, "en", "src2"), (81, "", None, "src2"), (82, " \t\n", "de", None), (83, "12345 !!", "en", None), (None, "No id here at all. Just words.", "en", None), (None, None, None, None)]
    rows += [(90, "Repeated row. It is here twice. Really the same words again and again in one place.", "en", "src0")] * 2
    rows += [(91, text_of(rng, en, 3000), "en", "src0"), (92, "A", "en", "src0"), (93, "x" * 200_000, "en", "src0"), (94, "Ünïcödé 😀 text with 😀 marks a@b.example 10.0.0.1.", "de", "src1")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, *["kept"] * 9) for r in awkward_rows()], DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)

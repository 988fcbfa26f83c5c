from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts() -> list[str | None]:
    """Empty, blank, short, long, repeated and nearly repeated texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, long = text(120), text(60), text(9000)
    near = base.split(" ")
    near[60] = "changed"
    out = [None, "", " \n\t", "one", "One", "two words", "a b c d e", "a  b c d E", base, base, base + " ", " ".join(near), long, long + " tail"]
    out += [f"{text(30)} {passage} {text(30)}" for _ in range(8)]
    out += [f"{passage[:150]} {text(50)}" for _ in range(3)]
    out += ["x" * 700, "ab" * 450, "don't <|endoftext|> 漢字  🙂  end\n\n", text(200), text(3)]
    out += [base.upper(), "\x1c a b \x85", "0 1 2 3 4 5 6 7 8 9"]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows.append((None, "null id text", "en", "s0", 1))
    rows.append((None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

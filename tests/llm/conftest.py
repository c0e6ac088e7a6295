import random

import pytest
from llm_helpers import frame

def words(rng, n, letters="aeioustrn"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with nulls, empties, long texts, copies, near copies and shared passages."""
    rng = random.Random(5)
    rows, passage = [], words(rng, 60)
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, words(rng, rng.randint(1, 120), "thentionas" if lang == "en" else "erschungzü"), lang, f"s{i % 3}"))
    for i in range(60, 70):
        rows.append((i, rows[i - 60][1], rows[i - 60][2], "s1"))  # exact copies
    for i in range(70, 84):  # near copies of one long text
        w = words(random.Random(1), 300).split()
        w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w), "en", "s0"))
    for i in range(84, 90):
        rows.append((i, words(rng, 20) + "\n" + passage + "\n" + words(rng, 10), "en", None))
    rows += [(90, None, "en", "s0"), (91, "", "de", "s1"), (92, " \t\n", None, "s2"), (93, "12 34 !!", None, None), (94, "ab", "en", "s0"), (95, "é", None, "s9"), (96, "Straße \U0001f600 <|end|> ΟΔΟΣ ½²", "de", "s1")]
    rows += [(97, words(rng, 4000), "en", "s2"), (98, "na " * 500, "en", "s2"), (99, "a" * 5000, "de", "s2")]
    rows += [(12, rows[12][1], rows[12][2], rows[12][3])]  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])

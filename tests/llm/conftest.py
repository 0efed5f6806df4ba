import random

import pytest

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "consetetur", "elitr", "sed", "diam", "nonumy", "eirmod", "tempor", "invidunt", "labore"]

#: Columns whose names the operators use themselves, or that differ from theirs in case only.
CLASHING = {"h1": 1, "salt": "x", "n": 2, "size": 3, "shard": 4, "part": 5, "lines": "y", "batch": 6, "norm": "z", "score": 0.5, "found": "f",
            "label_id": 7, "bands": 8, "carried": 9, "rank": 10, "DOC_ID": 11, "Text": "t"}


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    """(doc_id, text) rows as a table that also holds clashing columns."""

    def make(rows, partitions=3):
        schema = "doc_id long, text string, " + ", ".join(
            f"`{c}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for c, v in CLASHING.items())
        return spark.createDataFrame([(i, x, *CLASHING.values()) for i, x in rows], schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def mixed():
    """Prose with nulls, empty and very long texts, copies, near copies, repeated rows and shared passages."""
    rng = random.Random(5)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(3, 60))) for i in range(60)]
    rows += [(60 + i, rows[i % 7][1]) for i in range(25)]
    rows += [(90 + i, prose(rng, 8) + "\n" + passage + "\n" + prose(rng, 8)) for i in range(20)]
    rows += [(115 + i, rows[3][1].replace("ipsum", "IPSUM", 1) + f" extra{i}") for i in range(6)]
    rows += [(130, None), (131, ""), (132, None), (133, "   "), (134, "\n\n"), (135, "x"), (136, "é" * 40), (137, prose(rng, 6000)), (None, "no id"), (None, rows[0][1])]
    rows += [rows[5], rows[5], (140, "ﬁ ΑΣ Straße\x1cİ <|endoftext|> 日本 👍🏽")]
    rng.shuffle(rows)
    return rows

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with copies, shared passages, junk, personal data, odd characters, nulls and clashing columns."""
    import random

    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "stone", "river", "cloud", "über", "naïve", "日本", "1999", "it's", "Light", "SHADOW", "x"]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(passage).split()
            a = rng.randint(0, 30)
            parts.append(" ".join(words[a : a + rng.randint(4, 30)]))
            parts.append(" ".join(rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 15))))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts), f"s{i % 3}" if i % 7 else None))
    rows += [(200 + i, rows[3][1], "s0") for i in range(12)]
    rows += [(300, None, "s1"), (301, "", None), (302, " \t\n", "s2"), (303, "a" * 4000, "s0"), (304, "ab " * 800, "s0"), (305, "mail a@b.org from 10.0.0.1 card 4111 1111 1111 1111 call +1 (234) 567-8901 <|endoftext|>", "s1")]
    rows += [(None, "no name here", "s1"), (None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, text string, source string, size string, component_id string, block int").repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [r for r in docs.collect() if r.doc_id is not None]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

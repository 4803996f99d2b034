import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, size string, key string, g string, d string, fp string, score string, l_id string, pos string, tid string, block string, own string, weight string"


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "tion", "ing", "er", "an", "re", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, blank and very long texts, copies, near copies, repeated rows, planted words and secrets."""
    rng = random.Random(5)
    base = words(rng, 60)
    texts = [None, "", "  \n\t ", "one", "one two", base, base, base + " end", base.replace("the", "The", 1), words(rng, 20_000), "é" * 50, "token = abcdefgh1234 " + "AKIA" + "ABCD1234EFGH5678", "0123456789abcdef" * 3 + " x", "You idiot clown.\nFine words here."]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(60)]
    rows = [(k, t, "en", ("src%d" % (k % 3)) if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[20], (None, "no id " + base, None, None, None), (None, None, None, None, None), (21, "same id, other text", "en", "src1", 3)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([r + tuple("clash" for _ in range(14)) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

ODD = [None, "", " ", "\n\t", "a", "é 中 😀", "<|endoftext|> <\\| <|im_end|>", "x" * 3000, "one two three four five " * 300]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Émile", "x@y.org", "1.2.3.4", "+1 (212) 555-0123"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    out += [out[0], out[0], out[1] + " tail", out[2].upper()] + ODD
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

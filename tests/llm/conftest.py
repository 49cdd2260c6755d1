import random

import pytest
from pyspark.sql import types as T

# Extra columns bear names that the operators use themselves.
AWKWARD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in ("_metadata", "_id", "_text", "_doc", "_row", "count", "shard", "block", "_measured", "word")],
    ]
)


def prose(rng, n):
    syllables = "the an re ti on er st in ha ou ble ing ed ly és ñu".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward_rows():
    rng = random.Random(7)
    passage = prose(rng, 60)
    plain = [prose(rng, rng.randint(25, 90)) for _ in range(12)]
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "word", 5: plain[0], 6: plain[0], 7: plain[0].upper(), 8: "Ä" + plain[1], 9: "ä" + plain[1],
        10: plain[2] + "\n" + passage + "\n" + plain[3], 11: passage + " " + plain[4], 12: plain[5] + " " + passage,
        13: "\n".join([plain[6]] * 3), 14: prose(rng, 30_000), 15: "a" * 20_000, 16: "x\n" * 500, 17: "中文 😀 \u0085  <|endoftext|> </s>",
        18: "spam " * 300, 19: plain[7] + "\nA line that is common to many texts\nend", 20: plain[8] + "\n  a LINE that is common to many texts \t",
        21: "a line that is common to many texts", 22: plain[9], 23: " ".join(plain[9].split()[:-1] + ["other"]), 24: "\x00 nul \r\n\x0b\x0c",
    }
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if i % 7 == 0 else len(t or "")) for i, t in texts.items()]
    rows += [rows[4], rows[4], (10, plain[10], None, None, None), (None, plain[0], None, None, None), (None, None, None, None, None)]
    return [(*row, *["extra"] * 10) for row in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)

import random

import pytest
from conftest_llm import SCHEMA



def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages and lines, junk, odd white space, ties, repeated rows, nulls."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    shared = "\n".join("Shared " + prose(rng, 30) + "." for _ in range(3))
    rows = []
    for i in range(60):
        text = "\n".join("Start " + prose(rng, rng.randrange(5, 60)) + "." for _ in range(rng.randrange(1, 6)))
        if i % 7 == 0:
            text += " " + passage + " " + prose(rng, 20)
        if i % 9 == 0:
            text += "\n" + shared + "\n" + prose(rng, 4)
        rows.append([i, text])
    for i in range(60, 75):
        words = rows[i - 60][1].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append([i, " ".join(words)])
    rows += [[75, rows[3][1]], [76, rows[3][1].replace(" ", "  ")], [77, rows[3][1].upper()], [78, ""], [79, " \t\n\x0b "], [80, None], [81, "one"], [82, "two words"], [83, "a b c d"], [84, "ab c d"]]
    rows += [[85, "same same same same\n" * 40], [86, "$$$ ### x*** " * 60], [87, "É ñ 漢字 \U0001f600 ▁ \x00 é " * 20], [88, "x" * 5000], [89, "line\n" * 3000], [90, prose(rng, 4000)]]
    rows += [[91, passage], [91, passage], [None, passage + " tail"], [None, None], [92, "\n\n\n"]]
    return [(i, t, "en", None if i is None else f"s{i % 3}" if i % 2 else "big", len(t or "")) for i, t in rows]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3, "doc_id").sortWithinPartitions("doc_id", "text")


@pytest.fixture
def table_of(spark, tmp_path):
    """A table: its rows come in the same order each time it is read."""
    def make(df, name="t"):
        path = str(tmp_path / name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make

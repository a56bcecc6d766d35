import random

import pytest
from pyspark.sql import functions as F

#: Names the operators use themselves; every fixture carries them as extra columns.
CLASHING = ["batch", "id", "doc", "fp", "dest", "data", "size", "h", "slot", "copies", "position", "selected", "target", "row", "rank"]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, lang, source) rows, with clashing extra columns."""
    def make(rows):
        df = spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows],
                                   "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    return make


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "loser", "Straße", "日本", "a|b", "x%%%"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, base = say(70), say(260)
    rows = [(i, say(rnd.randint(1, 120)), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", "s2", None])) for i in range(60)]
    rows += [(100 + i, say(20) + "\n" + passage + "\n" + say(15), "en", "s0") for i in range(12)]
    for i in range(25):                                            # near copies
        s = base.split(" ")
        for _ in range(rnd.randint(0, 3)):
            s[rnd.randrange(len(s))] = rnd.choice(vocab)
        rows.append((200 + i, " ".join(s), "en", "s0"))
    rows += [(300, None, None, None), (301, "", "en", "s0"), (302, " \t\n ", "en", "s1"), (None, base, "en", None), (None, base, "en", None),
             (303, base, "de", "s0"), (303, base, "de", "s0"), (304, say(20000), "en", "s1"), (305, "q" * 3000, "en", "s1"),
             (306, "ab " * 1500, "en", "s2"), (307, "ab " * 1500 + "z", "en", "s2"), (308, "one", "en", "s2"), (309, "one two", "en", "s2"),
             (310, "line here\nline here\nline here\n" * 5, "en", "s0"), (311, "end <|endoftext|> of <|endof text|>", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(frame):
    return frame(odd_rows())


@pytest.fixture(scope="session")
def odd_list():
    return odd_rows()


@pytest.fixture(scope="session")
def none(frame):
    return frame([])

"""Small documents with every awkward case."""

import random

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(50))]) for _ in range(n))


def rows(seed=7):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 80)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[5], texts[3].upper(), texts[7] + " tail"]
    line = "  This Line is shared by many documents \t"
    texts += [f"{sentence(rng, 9)}\n{line}\n{sentence(rng, 9)}\n{line}" for _ in range(5)]
    texts += ["", None, "\n", " ", "a", "é ü ß 한국어　x", "x" * 300, "<|endoftext|> y  z\n\n q ", "▁ a", sentence(rng, 9000)]
    out = [(i, t, rng.choice(["en", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], (None, texts[8], None, None, None), (3, "another text under the same id", "en", "s", 1)]
    rng.shuffle(out)
    return out


def frame(spark, seed=7):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The same rows with more columns, named like those of results."""
    from pyspark.sql import functions as F

    more = ["size", "kept", "keep_id", "_id", "_text", "_len", "_hash", "_sha", "start", "n_lines", "n_tokens", "score"]
    return df.withColumns({n: F.lit("clash") for n in [*more, *names]})

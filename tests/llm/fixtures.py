"""Documents with everything that an operator has to stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd, n, vocabulary=4000):
    return " ".join("w" + format(rnd.randrange(vocabulary), "x") for _ in range(n))


def rows(seed=5):
    rnd = random.Random(seed)
    base = [words(rnd, rnd.randint(1, 160)) for _ in range(40)]
    shared = words(rnd, 120)
    texts = base + [base[3], base[3], base[7]]
    for i in range(8):
        parts = base[10].split(" ") if len(base[10]) > 300 else words(rnd, 150).split(" ")
        parts[rnd.randrange(len(parts))] = "edit"
        texts.append(" ".join(parts))
    texts += [f"{words(rnd, 30)}\n{shared}\n{words(rnd, 20)}" for _ in range(5)]
    texts += ["", "   \n\t ", "one", "two words", "A b C d", "a B c D", "é" * 300, words(rnd, 4000), "ab " * 900, "x" * 5000]
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", None]), len(t)) for i, t in enumerate(texts)]
    out += [(900, None, None, None, None), (None, words(rnd, 60), "en", "s1", None)]
    out += [out[0], out[5]]  # rows that are there twice
    return out


def documents(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA)


def clashing(docs):
    """The same with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    extra = ("kept", "n_words", "component", "component_id", "tkey", "spans", "size", "rate", "copies", "_copies", "_part", "digest", "ids")
    return docs.select("*", *(F.lit("clash").alias(c) for c in extra))


def key(row):
    return repr(tuple(row))

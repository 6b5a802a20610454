"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "river", "stone"]) + rng.choice("abcdefgh")
                    for _ in range(words))


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(40, 120)), "en", f"src{i % 3}") for i in range(40)]
    out += [(40, None, None, None), (41, "", "en", "src0"), (42, " \n\t ", "en", "src0"), (43, "one two", "en", "src1")]
    out += [(50 + i, out[3][1], "en", "src0") for i in range(4)]  # copies
    out += [(60, prose(rng, 20000), "de", "src1"), (61, "x" * 60000, "de", "src1"), (62, "la " * 5000, "de", "src1")]
    out += [out[5], out[5], (None, "an orphan row " * 9, "en", "src2")]  # repeated rows, no id
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in out]


def docs(spark, seed=1, extra=()):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows(seed), SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit(7))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

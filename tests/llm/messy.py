"""Small tables with everything that can be odd about documents, and plain models of the operators."""

import random

LETTERS = "ab cd ef gh ij kl mn op qr st uv wx yz Ä é 字 Ab CD x, y.".split()


def documents(seed=1, n=40):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, nulls, ties, repeated rows and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(30), line(25), line(60)]
    rows = []
    for i in range(n):
        text = "\n".join(line(rng.randint(0, 40)) for _ in range(rng.randint(1, 6)))
        if rng.random() < .4:
            text += "\n" + rng.choice(shared) + "\n" + rng.choice(shared)
        if rows and rng.random() < .3:
            text = rng.choice(rows)[1] or ""
            if rng.random() < .5:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "changed"
                text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(text)))
    rows += [(100, None, "en", "s1", None), (101, "", "en", "s2", 0), (102, " \t\n\r\x0b\f ", None, None, 6), (103, "one", "fr", "s1", 3),
             (104, shared[0] + "  " + shared[0], "en", "s2", None), (105, "one  two\tthree", "en", "s3", 1), (106, "onetwothree", "en", "s3", 1),
             (107, line(4000), "fr", "s1", 5), (108, "same words " * 400, "fr", "s1", 5), (None, shared[1], "en", "s1", 4), (None, "lost", "en", None, 4)]
    return rows + [rows[3], rows[3], (104, "another text of a repeated id", "en", "s2", None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """The documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    names = ["block", "body", "h", "n", "class", "key", "size", "digest", "kept", "mark", "doc", "pos", "rank", "gone", "ids", "bits", "bucket", "target"]
    return df.select("*", *[F.lit(f"extra {x}").alias(x) for x in names]).repartition(4)


def key(i):
    """Ids in their order, a null one last."""
    return (i is None, i or 0)


def words(text):
    return (text or "").encode().split()

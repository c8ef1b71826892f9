"""Small tables that every operator must take."""

import random

from pyspark.sql import functions as F

SYLLABLES = "an ble con der est for gan hil ion jen kar lum mor nat ost pre qui ran sol tur".split()
# Names that operators use for columns of their own.
CLASHES = ("bits", "key", "row", "slot", "class", "found", "a", "b", "rank", "prior", "blob",
           "todo", "order", "bucket", "place", "version", "spans", "hash", "component_id")


def prose(rng, words):
    made = ("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))
    text = ""
    for k, word in enumerate(made):
        text += word + ("\n" if k % 40 == 39 else " ")
    return text.strip()


def rows(seed=1, n=40):
    """(doc_id, text): prose, copies, near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 30)
    texts += [passage, f"{prose(rng, 20)} {passage} {prose(rng, 20)}", f"{passage} é {passage}"]
    texts += [texts[3], texts[3], texts[3].upper()]
    near = texts[5].split(" ")
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), "", " ", "\n", "é" * 60, "ü" * 49 + "é" * 60, "a", "中文 字 😀", "... 123 !"]
    texts += [prose(rng, 4000)]
    found = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    # Null texts, repeated rows, one id with two texts, and null ids.
    return found + [(500, None), (501, None), found[0], found[0], (found[1][0], "other text"),
                    (None, texts[2]), (None, None)]


def table(spark, made=None):
    """The rows as a documents table with extra columns of clashing names."""
    made = rows() if made is None else made
    frame = spark.createDataFrame(
        [(i, t, "en" if (i or 0) % 2 else None, None, None) for i, t in made],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return frame.select("*", *(F.lit("clash").alias(name) for name in CLASHES))


def empty(spark):
    return table(spark).limit(0)

"""Small documents with the cases every operator has to define: nulls, empty and long texts, ties, repeated rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the input.
CLASHING = ("id", "body", "key", "tie", "h", "at", "n", "cls", "spans", "blob", "p0", "members", "row", "score")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    shared = words(rng, 60)
    rows = []
    for i in range(n):
        text = words(rng, rng.choice([0, 1, 3, 19, 20, 21, 80, 200]))
        if i % 5 == 0:
            text = f"{text} {shared}" if i % 2 else f"{shared}\t{text}\n"
        rows.append((i, text))
    base = words(rng, 150)
    for i in range(8):
        near = base.split()
        for _ in range(rng.randrange(3)):
            near[rng.randrange(len(near))] = "changed"
        rows.append((n + i, " ".join(near)))
    rows += [(n + 10, None), (n + 11, ""), (n + 12, " \t\r\n "), (None, base), (n + 13, "été naïve — ñandú 漢字 😀 " * 30),
             (n + 14, words(rng, 30_000, 5_000)), (n + 15, "same " * 50), (n + 16, base)]
    rows.append(rows[3])
    return [(i, t, None if t is None else "en", "s", None if t is None else len(t)) for i, t in rows]


def with_clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])

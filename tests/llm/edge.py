"""Small tables with the awkward cases every operator must define."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, th string, "
        "length int, `range` int, h1 int")


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "THETA"]) + str(r.randrange(40))
            for _ in range(n)]


def texts():
    shared = "This passage is shared by many documents, word for word."
    out = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Two words"), (None, "a text without an id, kept whole"),
           (None, None), (7, " ".join(words(7, 5000))), (8, "x" * 30000), (9, "ties ties ties ties"),
           (9, "ties ties ties ties"), (9, "another text of the same id"), (10, "日本語 text 👍🏽 ½ ΑΣ"),
           (11, "<|endoftext|> inside <|startoftext|>"), (12, "\n\n" + shared + "\n\n")]
    for i in range(20, 40):
        out.append((i, "\n".join([" ".join(words(i, 30)), "  " + shared.upper() + " ", " ".join(words(i + 100, 12))])))
    base = words(5, 200)
    for i in range(50, 62):
        near = list(base)
        if i > 53:
            near[i] = "changed"
        out.append((i, " ".join(near)))
    return out


def docs(spark, rows=None):
    """The rows as a table of several partitions, with clashing other columns."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if n % 5 == 0 else "en", f"src{n % 3}", None if t is None else len(t), n, "c", "t", 1, 2, 3)
            for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3)

"""Small tables with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size long, label int, labels string"
PASSAGE = "this passage of well over one hundred bytes stands in several documents and has to go wherever it stands again, word for word."


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing columns."""
    long = words(9000, 1)
    rows = [
        (1, words(60, 2) + "\n" + PASSAGE, "en", "a"),
        (2, PASSAGE + "\n" + words(50, 3), "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n ", "en", "a"),
        (6, long, "de", "a"),
        (7, words(60, 2) + "\n" + PASSAGE, "en", "a"),
        (8, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 🙂 日本語\n" * 4, "de", None),
        (9, words(60, 2) + "\n" + PASSAGE + " end", "en", "c"),
        (9, words(60, 2) + "\n" + PASSAGE + " end", "en", "c"),
        (9, "other text under the same id " + words(30, 5), "en", "c"),
        (None, "no id " + words(40, 6), "fr", "b"),
        (None, None, None, None),
        (10, "Released under the MIT License.\nunder the MIT-license, under  the mit license", "en", "b"),
        (11, "the the the the the the the the the the the the the the the the the the the the the the", "en", "b"),
    ]
    full = [(*r, len(r[1] or ""), 0.5, False, 7, 1, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)

"""A small table of awkward documents and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _gone string, lines_removed int, score string"


def awkward():
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing extra columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "in", "er", "on", "é", "ñ", "an"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(9)
    rows = [(None, prose(30), None, None), (None, None, "en", "s1"), (1, None, None, "s1"), (2, "", "en", None), (3, " \n\t \r\n", "fr", "s2"),
            (4, "one", "en", "s1"), (5, "one two", "en", "s2"), (6, passage, "de", "s1"), (6, passage, "de", "s1"),
            (6, prose(20) + passage, "fr", "s2"), (7, prose(4000), "en", "s3"), (8, "ab" * 3000, "en", "s4"), (9, "\u0000\u0001x" * 80, "es", "s5")]
    rows += [(10 + i, f"{prose(25)}\n{line}\n{passage if i % 3 == 0 else prose(8)}\n", ["en", "fr"][i % 2], f"s{i % 7}") for i in range(30)]
    base = prose(120).split()
    for i in range(12):  # near copies
        w = list(base)
        w[i] = "changed"
        rows.append((100 + i, " ".join(w), "en", f"s{i % 4}"))
    rows += [(200 + i, rows[20][1], "en", "s0") for i in range(6)]  # exact copies
    return [(i, t, lang, s, None if t is None else len(t), 7, "x", 3, "z") for i, t, lang, s in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)

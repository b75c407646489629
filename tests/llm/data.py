"""Small documents with the awkward cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    rnd = random.Random(7)
    vocabulary = [a + b for a in ("ta", "re", "mo", "li", "su", "né") for b in ("n", "ck", "st", "l", "r", "çu")]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ".\n", ","]) for _ in range(n))

    base = [prose(rnd.randint(60, 160)) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1] + " tail", None, "", " \n\t ", "one", "one two", "a b c a b c a b c"]
    texts += [prose(4000), "same line of words here\n" * 30, "the shared notice of this host, all rights\n" + prose(80)]
    texts += ["the shared notice of this host, all rights\n" + prose(70 + i) for i in range(9)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[3])
    rows.append((None, base[2], None, None, None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)

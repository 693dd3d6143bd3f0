"""Documents with everything that has a defined result: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, ident string, cls string, kept string, _row string, n string, target string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); other columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows], SHAPE)


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, long = text(120), text(6000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s1"), (2, base.replace(" ", " \t\n"), "en", "s2"), (3, " ".join(near), "fr", None), (4, long, "en", "s1"), (5, "start " + long, "de", "s3"),
        (6, None, None, "s1"), (7, "", "en", "s2"), (8, " \t ", "fr", None), (9, "one two", "en", "s2"), (10, "One TWO", "en", "s2"), (11, "12 34 !!", None, "s4"),
        (None, base, "en", "s1"), (None, None, None, None), (13, text(80), "de", "s3"), (13, text(80), "de", "s3"), (14, "same same " * 60, "fr", "s5"),
        (15, text(40) + " " + " ".join(base.split()[10:60]), "en", "s6"), (16, "Ünï çode ÀÉ x y <|endoftext|> 日本 🙂 ''ll don't", "fr", "s\U0001f600"),
    ]
    return rows + [rows[12], rows[3], rows[8]]

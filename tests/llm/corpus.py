"""A small corpus with what the operators must bear: nulls, empty and long texts, copies, near copies, shared passages,
clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, size long, key string"


def _words(rng: random.Random, n: int, lang: str) -> list[str]:
    letters = {"en": "theandofis", "de": "ungeichtau"}[lang]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = " ".join(_words(rng, 60, "en"))
    base = _words(rng, 200, "en")
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = " ".join(_words(rng, rng.choice([1, 2, 5, 19, 40, 150]), lang))
        if i % 7 == 0:
            text += "\n" + passage
        if i % 10 == 3:
            copy = list(base)
            copy[rng.randrange(200)] = f"edit{i}"
            text, lang = " ".join(copy), "en"
        if i % 5 == 0:
            text += "\n  Shared LINE of text \nReleased under the MIT License.\n"
        out.append((i, text, lang, f"src{i % 4}", len(text), "x", 7, "k"))
    out += [(200, None, None, None, None, None, None, None), (201, "", "en", "src0", 0, None, None, None)]
    out += [(202, " \n\t ", "de", None, 4, "", 0, ""), (203, "1 2 3 !?", None, "src1", 8, "", 0, "")]
    out += [out[3], out[3], (204, out[5][1], "en", "src1", 1, "", 0, ""), (205, "lang " * 3000, "en", "src2", 1, "", 0, "")]
    return out


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

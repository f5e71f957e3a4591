"""Small documents with everything that may be missing, empty, repeated or very long."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, k1 string, spans int, before long, "
    "size string, no_source int, _hash int, node int, kept int, gone int, row string, doc int"
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Rows of ``SCHEMA``; the columns after n_chars have names that the operators use themselves."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    vocabulary += ["The", "of,", "a.", "it's", "12", "３", "漢字。"]

    def prose(k: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))

    passage = prose(70)
    texts: list[str | None] = [prose(rng.choice([1, 2, 3, 25, 120, 300])) for _ in range(n)]
    texts += [texts[3], texts[3], texts[4] + " end", texts[5].upper()]
    for i in (7, 11, 13):
        texts[i] = prose(30) + passage + prose(20)
    base = prose(200).split()
    for _ in range(6):
        copy = list(base)
        copy[rng.randrange(200)] = "changed"
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", "one", "two words", "x" * 50_000, prose(6_000), "| menu | home | about | more |", "$$$ ### %%%"]
    texts += ["la " * 100, "same line here\n" * 30, "a　b c \x1c d", "<|endoftext|> inside<|startoftext|>"]
    rows = [(i * 3, t, "en", rng.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "a"), (None, None, None, None), rows[8], rows[8], (rows[9][0], "other text", "en", "b")]
    rng.shuffle(rows)
    return [(*r, len(r[1] or ""), "x", 1, 2, "s", 3, 4, 5, 6, 7, "y", 8) for r in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)

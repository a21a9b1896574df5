"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, spans string, text2 string, size string, doc string"
SYLLABLES = ["ba", "de", "ki", "lo", "mu", "ra", "se", "ti", "vo", "zu"]


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def sentence(rng: random.Random, n: int | None = None) -> str:
    return " ".join(word(rng) for _ in range(n or rng.randint(3, 14))).capitalize() + rng.choice([".", ".", "!", "?", ""])


def text(rng: random.Random, n: int) -> str:
    return "".join(sentence(rng) + rng.choice([" ", " ", "\n"]) for _ in range(n)).strip()


def edit(rng: random.Random, value: str) -> str:
    words = value.split(" ")
    words[rng.randrange(len(words))] = word(rng)
    return " ".join(words)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = text(rng, 9)
    texts: list[str | None] = [text(rng, rng.randint(1, 14)) for _ in range(n)]
    texts += [texts[0]] * 5 + [edit(rng, texts[1]) for _ in range(6)]
    texts += [texts[2] + " " + passage + " " + texts[3], texts[4] + "\n" + passage, passage]
    texts += [None, None, "", "", " ", "\n\n \t", "ba", "Ba.", "ba ba ba ba ba ba ba ba", "é ü 漢字 \U0001f600 ß", "a  b   c\n\n\nd \n e\t\tf  ", text(rng, 900)]
    out = [(i, t, rng.choice(["en", "fr"]), rng.choice(["s1", "s1", "s2", "s3", None]), len(t or ""), 7, "x", t, "y", "z") for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5], None, None, None, None, None, None, None, None), (None, passage, "en", "s2", 1, 1, "q", None, None, None)]
    rng.shuffle(out)
    return out


def docs(spark, data=None, partitions: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(partitions).checkpoint()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

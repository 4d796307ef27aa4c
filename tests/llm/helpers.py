"""Small tables with every odd case, and brute-force helpers."""

from __future__ import annotations

import random

LONG = "word " * 30_000 + "end"
PASSAGE = " ".join(f"shared{i} passage{i * 7 % 13}" for i in range(45))


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("tor", "len", "mip", "gras", "ou", "élan", "straß") for b in ("a", "ing", "os", "ker", "ü")] + ["the", "of", "and", "a", "to", "la", "der"]
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one two", LONG, "a" * 5000, "<|endoftext|> special <|startoftext|>", "日本語 текст \U0001f600 é"]
    for _ in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) + "." for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), PASSAGE)
        texts.append("\n".join(lines))
    texts += rng.sample([t for t in texts if t], 8)
    words = texts[20].split(" ")
    words[3] = "changed"
    texts.append(" ".join(words))
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "a null id " * 10, "en", "s1", 100), (None, None, None, None, None), (9, "same id, other text " * 4, "en", "s1", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows=None):
    """The table, with columns whose names clash with those that operators make."""
    held = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return held.selectExpr("*", *[f"'x' AS {c}" for c in ("hash", "digest", "kept", "root", "node", "fingerprint", "row", "key", "did", "length", "piece")])


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)

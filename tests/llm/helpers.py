"""Documents for the tests: extra columns have names that operators might use themselves."""

import random

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, mark int, row int, score string, left string, n_lines int"


def frame(spark, rows, parts=3):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "k", 1, 2, "x", "l", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, n: int, words=None) -> str:
    words = words or [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "n", "lm")]
    return " ".join(rng.choice(words) for _ in range(n))

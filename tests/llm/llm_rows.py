"""Rows for the tests of this folder."""

import random

SHAPE = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, "
    "KEEP_ID string, run int, size int, own int, copy_key int, near_key int, mix_row int, label int, words int"
)


def row(doc_id, text, lang="en", source="a", extra=1):
    n = None if text is None else len(text)
    return (doc_id, text, lang, source, n, True, "x", *[extra] * 8)


def prose(seed, n=80):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(words)

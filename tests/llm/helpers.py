"""Invented prose for the tests."""

import random

SYLLABLES = ["ka", "ro", "min", "tel", "su", "var", "dol", "en", "pri", "gos", "lu", "ter"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


def edited(text: str, seed: int, every: int) -> str:
    r = random.Random(seed)
    words = text.split()
    return " ".join("x" + w if r.randrange(every) == 0 else w for w in words)

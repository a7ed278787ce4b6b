from __future__ import annotations

import random


def sentences(seed: int, n: int) -> str:
    """Words that differ from seed to seed, in sentences on lines of their own."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]
    return "".join(w + (".\n" if i % 12 == 11 else " ") for i, w in enumerate(words)).strip()


#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, "a"),
    (4, "word", "en", None),
    (5, sentences(5, 60_000), "en", "b"),
    (6, sentences(6, 80), "en", "b"),
    (6, sentences(6, 80), "en", "b"),
    (7, sentences(6, 80).upper(), "de", "b"),
    (None, sentences(8, 50), None, None),
    (None, None, None, None),
]

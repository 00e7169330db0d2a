"""Invented labelled text: words of a few syllables, some with words of a given list put in."""

import random

SYLLABLES = "ba ko ri tun mel sha or en lu di fa sto".split()


def documents(n: int, seed: int, bad: list[str], shout: bool = False) -> list[tuple[str, int]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
        y = int(i % 3 == 0)
        if shout and y == 0:
            words = [w.upper() + "!!" for w in words]
        elif y and bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words), y))
    return rows

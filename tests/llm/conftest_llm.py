"""Texts that several tests build their cases from."""

import random

SMALL = "/root/testdata/sf0.001"


def prose(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}x" for _ in range(n))


def near_group(n, words):
    """(id, text) of n versions of one text, each with a few words changed, some of them many."""
    base, out = prose(words, 1234, 5_000).split(), []
    for i in range(n):
        r, w = random.Random(i), list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = f"new{i % 11}"
        out.append((i, " ".join(w)))
    return out

"""Texts that the tests share."""

import random


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd characters, nulls and extremes; ids differ."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([1, 3, 4, 30, 120])) for _ in range(n)]
    passage = words(rng, 60)
    texts = list(base)
    for i in range(0, n, 4):
        parts = base[i].split()
        texts.append(base[i])
        parts[rng.randrange(len(parts))] = "Changed"
        texts.append(" ".join(parts))
    texts += [f"{words(rng, 40)} {passage} {words(rng, k)}" for k in (5, 20, 40)]
    texts += [None, "", " \t\n", "a", "x" * 5000, "ab" * 700, "Ünï çödé ☃ 漢字 " * 30, "don't <|endoftext|>  stop\n\n\n'll", words(rng, 6000)]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]

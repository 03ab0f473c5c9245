import random

import pytest

@pytest.fixture(scope="session")
def prose():
    """Texts with exact and near copies, null, empty and very long ones."""
    rnd = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rst"]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    out = [None, "", "  \n ", "one", "one two", "a b c d e", "Ab c d E f", "ab C d e F", "x" * 30000]
    passage = words(40)
    for _ in range(25):
        base = words(rnd.randint(20, 160))
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
        out.append(" ".join(words(rnd.randint(5, 60)) + passage))
    out += [" ".join(words(20000))] + out[:12]
    return out

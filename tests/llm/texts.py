"""Small fixtures: pseudo-random texts with copies, near copies and edge cases."""

import random


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(n=40, seed=1):
    """(doc_id, text): long and short texts, exact copies, near copies, shared passages, nulls, blanks, one very long text."""
    r = random.Random(seed)
    passage = words(30, 777)
    rows = [(i, " ".join(words(r.randrange(1, 120), 1000 + i, 5000))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(5)]
    base = words(200, 5, 5000)
    for i in range(6):
        near = list(base)
        near[7 + 20 * i] = f"changed{i}"
        rows.append((n + 10 + i, " ".join(near)))
    for i in range(6):
        rows.append((n + 20 + i, " ".join(words(15, 50 + i, 5000) + passage + words(15, 90 + i, 5000))))
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \n\t "), (n + 33, "Der " * 60), (n + 34, " ".join(words(9000, 3, 5000))),
             (n + 35, "Großes ßtück İstanbul   x y"), (n + 36, rows[3][1]), (n + 36, rows[3][1])]
    r.shuffle(rows)
    return rows

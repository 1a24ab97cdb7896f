"""Decontamination against brute force over all windows."""

import re

from affinity.llm import decontaminate as dc
from tests.llm.texts import documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, n=10):
    out = []
    grams = {}
    for item, text in items:
        w = split(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in lengths:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i:i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(make, docs, items, **settings):
    got = dc.decontaminate(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"), **settings)
    assert got.columns == ["doc_id", "n_words", "hit", "n_hit", "items"]
    rows = got.collect()
    for r in rows:
        assert sum(z - a for a, z in r.hit) == r.n_hit
        assert all(x[1] < y[0] for x, y in zip(r.hit, r.hit[1:]))
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str)


def cases():
    long_item, other = words(37, 1), words(24, 2)
    items = [(1, " ".join(long_item)), (2, " ".join(long_item)), (3, " ".join(other)), (4, "Tiny Item"), (5, None), (6, ""), (7, "!! --"),
             (8, "the the the the the the the the the the the the"), (9, " ".join(words(10, 3))), (10, " ".join(words(9, 4))), (3, " ".join(other))]
    docs = documents(15) + [
        (500, " ".join(words(20, 9) + long_item[5:15] + words(20, 10))), (501, " ".join(long_item[5:14])), (502, ", ".join(w.upper() for w in long_item)),
        (503, "x tiny ITEM y tiny. item"), (504, "the " * 30), (505, " ".join(long_item[:12] + ["gap"] + long_item[12:25])),
        (506, " ".join(other[3:20] + long_item[20:])), (507, " ".join(words(10, 3))), (508, " ".join(words(9, 4))),
        (509, " ".join(words(3000, 11) + long_item + words(3000, 12) + long_item[:11])), (None, " ".join(other)), (None, None),
        (510, "éte ÉTE İstanbul" + " the" * 10)]
    return docs, items


def test_matches_brute_force(make):
    docs, items = cases()
    assert run(make, docs, items) == brute(docs, items)


def test_blocks_and_other_sizes_agree(make):
    docs, items = cases()
    want = brute(docs, items)
    assert run(make, docs, items, block_rows=20) == want
    assert run(make, docs, items, k=4) == want
    assert run(make, docs, items, k=10) == want
    assert run(make, docs, items, window=6, k=3) == brute(docs, items, 6)


def test_empty_tables(make):
    docs, items = cases()
    assert run(make, [], items) == []
    assert run(make, docs, []) == brute(docs, [])
    assert run(make, docs, [(1, None)]) == brute(docs, [])


def test_drop(make):
    docs, items = cases()
    table = make(docs, "doc_id long, text string")
    kept = dc.drop_contaminated(table, make(items, "item_id long, text string"))
    assert kept.columns == table.columns
    hit = {d for d, _, n, _ in brute(docs, items) if n}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)


def test_main_path_runs_no_python(make):
    docs, items = cases()
    got = dc.decontaminate(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

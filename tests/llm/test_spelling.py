"""Spelling variants against a plain edit distance over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from affinity.llm import spelling as sp
from tests.llm.texts import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def counts(rows, typo=97):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if typo and h % typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def brute(rows, typo=97):
    n = counts(rows, typo)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def variants(seed=5, groups=12):
    """Texts of words with variants of one to three edits, in all places, with differing counts."""
    r = random.Random(seed)
    letters = "abcdeéßÀÿz"
    words = Counter()
    for g in range(groups):
        base = "".join(r.choice(letters) for _ in range(r.randrange(4, 12)))
        words[base] += r.randrange(20, 90)
        for _ in range(14):
            w = base
            for _ in range(r.randrange(1, 4)):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]])
            words[w] += r.randrange(1, 40)
    words["aaaaa"] += 9
    words["aaaaaa"] += 30
    words["aaaaaaa"] += 90
    words["AAAAAAAA"] += 270
    words["aaaab"] += 4
    words["baaaa"] += 4
    words["abcde"] += 5
    words["bacde"] += 50  # a swap is two edits
    tokens = [w for w, c in words.items() for _ in range(c)]
    r.shuffle(tokens)
    return [(i, " ".join(tokens[i::40])) for i in range(40)]


def run(make, rows, **settings):
    got = sp.group_variants(make(rows, "doc_id long, text string"), **settings).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}
    assert len(out) == len(got)
    return out


def rows():
    data = variants() + documents(30) + [(None, "Straße1Straße-straße Straßen " * 3), (None, "Àäöüÿ×÷ àäöüÿ×÷ " * 4), (77, "İstanbul ĳsland " * 5)]
    return data + data[:4]


def test_matches_all_pairs(make):
    want = brute(rows())
    assert run(make, rows()) == want
    assert sum(v[1] for v in want.values()) > 100 and any(v[2] and v[4] != v[2] for v in want.values())


def test_large_lists_are_split(make):
    for typo in (0, 7):
        assert run(make, rows(), block_words=3, typo=typo) == brute(rows(), typo)


def test_skipping_scan_equals_distance():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(300)})
    for queries in (words, words[::7], ["", "abab", "bbbbbbbbbbbb"]):
        got = {(words[i], queries[j]) for i, js in sp.near_in_list(words, queries) for j in js.tolist()}
        assert got == {(w, q) for w in words for q in queries if distance(w, q) == 1}
        behind = [["xyz" + w for w in some] for some in (words, queries)]
        assert got == {(words[i], queries[j]) for i, js in sp.near_in_list(*behind, 3) for j in js.tolist()}


def test_empty_table(make):
    assert run(make, []) == {} and run(make, [(1, None), (None, "")]) == {}

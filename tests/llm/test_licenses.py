"""License spans against a plain scan of every template at every word."""

import re
from collections import Counter

from affinity.llm import licenses as lc
from tests.llm.texts import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, templates, k, share):
    w = split(text)
    spans = []
    for t in templates:
        tw = split(t.text)
        size = min(len(tw), k)
        if not size:
            continue
        grams = {}
        for a in range(len(tw) - size + 1):
            grams.setdefault(tuple(tw[a:a + size]), []).append(a)
        votes = {}
        for p in range(len(w) - size + 1):
            for a in grams.get(tuple(w[p:p + size]), []):
                votes.setdefault(p - a, []).append((p, a))
        slack = 0 if t.base else len(tw) // 8
        region, last = [], None
        regions = []
        for d in sorted(votes):
            if last is None or d - last > slack:
                region = []
                regions.append(region)
            region.extend(votes[d])
            last = d
        for r in regions:
            cover = len({a for _, a in r}) / (len(tw) - size + 1)
            if cover >= share:
                spans.append((t, min(p for p, _ in r), max(p for p, _ in r) + size, cover))
    base = [s for s in spans if s[0].base]
    starts = [s[1] for s in base]
    notice = max([s[3] for s in spans if not s[0].base], default=0.0)
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[0].label for s in base})),
            ",".join(sorted({s[0].label for s in spans})), 0.5 + 0.5 * notice if spans else 0.0,
            tuple(sorted((s[0].label, s[1], s[2], s[3]) for s in spans)))


def rows():
    mit, gpl = lc.NOTICES[0].text, lc.NOTICES[3].text
    words = mit.split()
    edited = words[:12] + ["really", "quite"] + words[12:30] + words[32:]
    half = words[:len(words) // 3]
    texts = ["MIT License mit license, mit-license", "the general public license general public license", "Apache LICENSE",
             "licensed under CC BY-NC 4.0.", "licensed under cc by-nc-sa 4.0", mit, "x " * 500 + mit + " y" * 400 + gpl + mit, " ".join(edited),
             " ".join(half), "mit licenses mitlicense", "mit license" * 3000, "MİT license ﬁt mit license", "license", "mit", gpl * 200]
    data = documents(20) + [(100 + i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (None, "gpl"), (None, None)]
    return data + data[-5:]


def run(make, data, **settings):
    got = lc.scan_licenses(make(data, "doc_id long, text string"), **settings)
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
                    tuple(sorted((s.label, s["from"], s.to, s.cover) for s in r.spans))) for r in got.collect())


def test_matches_plain_scan(make):
    for templates, k, share in ((lc.PHRASES + lc.NOTICES, 4, 0.6), (lc.PHRASES + lc.NOTICES[:4], 3, 0.3)):
        want = Counter((d, *brute(t, templates, k, share)) for d, t in rows())
        assert run(make, rows(), templates=templates, k=k, share=share) == want


def test_edited_notice_is_one_span(make):
    got = {r.doc_id: r for r in lc.scan_licenses(make(rows(), "doc_id long, text string")).collect()}
    assert [s.label for s in got[107].spans] == ["mit"] and got[107].spans[0].cover < 1
    assert got[108].labels == "" and got[108].score == 0  # a third of the notice is none
    assert got[106].labels == "gpl,mit" and len([s for s in got[106].spans if s.label == "mit"]) == 2
    assert got[103].labels == "cc-by-nc" and got[104].labels == "cc-by-nc-sa"


def test_other_templates_and_shuffled_join(make, monkeypatch):
    mine = [lc.Template("a", "alpha beta"), lc.Template("none", " - "), lc.Template("b", "größe 12 gamma delta epsilon", True)]
    data = [(1, "alpha beta Größe"), (2, "größe 12 GAMMA delta epsilon"), (3, None)]
    want = Counter((d, *brute(t, mine, 4, 0.6)) for d, t in data)
    assert run(make, data, templates=mine) == want
    monkeypatch.setattr(lc, "BROADCAST_WORDS", -1)
    assert run(make, data, templates=mine) == want
    assert [r.labels for r in lc.scan_licenses(make(data, "doc_id long, text string"), templates=[]).collect()] == [""] * 3


def test_empty_table_and_no_python(make):
    assert not run(make, [])
    plan = lc.scan_licenses(make(rows(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

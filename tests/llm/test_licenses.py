"""License scans against plain substring search and a quadratic chain."""

from __future__ import annotations

import random
import re

import pytest

from nearby.llm import licenses as L
from nearby.llm.licence_texts import TEMPLATES
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_of(words):
    found = []
    for label, phrase in L.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return found


def stretches(words, licences):
    """Maximal matches of ``LEAST`` words or more: (last word, words, {licence: places of the last word})."""
    line = [" " + " ".join(t) + " " for t in licences]
    inside = lambda ws: any(" " + " ".join(ws) + " " in x for x in line)
    ms, length = [], 0
    for i in range(len(words)):
        length += 1
        while length and not inside(words[i - length + 1 : i + 1]):
            length -= 1
        ms.append(length)
    out = []
    for i, n in enumerate(ms):
        if n >= L.LEAST and (i + 1 == len(ms) or ms[i + 1] <= n):
            part = words[i - n + 1 : i + 1]
            out.append((i, n, {t: [k + n - 1 for k in range(len(ws) - n + 1) if ws[k : k + n] == part] for t, ws in enumerate(licences)}))
    return out


def most_covered(anchors, t, cost):
    """Words of the best way through a licence's anchors, steps back paid, cluster by cluster; quadratic."""
    own = []
    for last, n, places in anchors:
        if places.get(t):
            own.append((last, min(n, last - own[-1][0]) if own else n, places[t]))
    clusters = []
    for a in own:
        if not clusters or a[0] - a[1] - clusters[-1][-1][0] > L.GAP:
            clusters.append([])
        clusters[-1].append(a)
    out = []
    for c in clusters:
        done = []
        for last, n, places in c:
            done += [[(place, n + max([0, *(v for p, v in done_before if p <= place - n), *(v - cost for _, v in done_before)])) for place in places] for done_before in [list(done)]][0]
        out.append(max(v for _, v in done))
    return out


def variants(rng):
    names = [t for _, t in TEMPLATES]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(names).split()
            a, b = sorted(rng.sample(range(len(t) + 1), 2)) if rng.random() < 0.5 else (0, len(t))
            part = [w if rng.random() > 0.05 else "changed" for w in t[a:b]]
            if rng.random() < 0.3:
                part = part[len(part) // 2 :] + part[: len(part) // 2]
            words += part + ["filler"] * rng.choice([0, 1, 10, 60])
        yield " ".join(words)


def test_matching_statistics_and_chains():
    s = L.Scanner()
    licences = [plain_words(t) for _, t in TEMPLATES]
    for text in variants(random.Random(4)):
        n, base, anchors = s.scan(text)
        words = plain_words(text)
        assert n == len(words) and sorted((i, s.phrases[k][0]) for i, k in base) == sorted(base_of(words))
        brute = stretches(words, licences)
        mine = [(last, length, {t: sorted(p for u, p in s.places[state] if u == t) for t in range(len(licences))}) for last, length, state in anchors]
        assert mine == [(a, b, {t: sorted(ps) for t, ps in c.items()}) for a, b, c in brute]
        chains = s.chains(anchors)
        for t in range(len(licences)):
            cost = min(L.RESTART, len(licences[t]) // 2)
            values = most_covered(brute, t, cost)
            own = [c for c in chains if c.template == t]
            assert sum(c.covered for c in own) - cost * (len(own) - len(values)) == sum(values)
            assert all(a.last < b.first for a, b in zip(sorted(own, key=lambda c: c.first), sorted(own, key=lambda c: c.first)[1:]))


def test_whole_licences_are_found():
    s = L.Scanner()
    for k, (label, text) in enumerate(TEMPLATES):
        for whole in (text, f"before it stands this {text} and behind it that", text.upper()):
            spans = s.spans(s.chains(s.scan(whole)[2]))
            assert [x.label for x in spans] == [label] and spans[0].share == 1.0
        twice = s.spans(s.chains(s.scan(f"{text} {text}")[2]))
        assert [x.label for x in twice] == [label, label], label
        assert twice[0].last + 1 == twice[1].first


def test_long_text_of_many_copies():
    s = L.Scanner()
    text = " ".join([TEMPLATES[0][1]] * 300)
    assert len(s.spans(s.chains(s.scan(text)[2]))) == 300


def test_label_whole_table(spark, docs):
    rows = {r["doc_id"]: r for r in L.label_licenses(docs).collect()}
    for r in docs.collect():
        words = plain_words(r["text"])
        base, got = sorted(base_of(words)), rows[r["doc_id"]]
        labels = ",".join(sorted({label for _, label in base}))
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(words), len(base), labels)
        assert (got["first_word"], got["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(filter(None, labels.split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
        assert got["score"] == 1 or not base


@pytest.mark.parametrize(("text", "labels", "n_base"), [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 1), ("Licensed under CC BY 4.0.", "cc-by", 1), ("the MIT License, mit\nlicense", "mit", 2), ("Apache Licenses", "", 0), ("cc\x80by cc by", "cc-by", 1),
    ("see the GNU General Public License, version 3", "gpl", 1), ("GNU Lesser General Public License", "", 0), (None, "", 0), ("", "", 0), ("license", "", 0), ("mit mit license license", "mit", 1),
])
def test_short_texts(spark, text, labels, n_base):
    r = L.label_licenses(spark.createDataFrame([(1, text, None, None, None)], DOCS)).first()
    assert (r["labels"], r["n_base"]) == (labels, n_base)


def test_edges(spark, edges, none):
    assert L.label_licenses(edges).count() == edges.count() and L.label_licenses(none).count() == 0
    clash = edges.withColumnRenamed("lang", "spans").withColumnRenamed("source", "PHRASES")
    assert L.label_licenses(clash).count() == edges.count()
    own = L.scan(edges.select("doc_id", "text"), templates=(("own", "word3 of line 3 word4 of line 4"),)).where("size(spans) > 0").collect()
    assert {r["doc_id"] for r in own} == {4} and own[0]["spans"][0]["label"] == "own"

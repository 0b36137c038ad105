"""Cross-tokenizer alignment against both libraries on whole texts, byte by byte and pair by pair."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from nearby.llm import alignment
from tests.llm.conftest import DOCS

ODD = ["  two  spaces ", "\tTab first", "\n\nlines\n\nmore\n", "a \nb\n c", "a▁b", "▁", "<s> and </s> <unk>", "<|endoftext|>x", "<0x0A>", "naïve don't 'll 've", "日本語の文 と　空白", "x\x00y", "½ १२ ﬁ", "é", "\x1c\x85a\xa0b", " ", "\n", "a\r\nb", "word\n\x1cword", "𝒳𝒴 \U0001f600!", "tabs\tin words", "aaaa aaaaa aaaaaaaaa", "don't\ndon't\n don't"]


def tokens(aligner, text):
    """Ids of whole texts by the libraries alone, or none."""
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    raw = (" " + text).encode()
    whole = text and b"".join(aligner.bytes_a[i] for i in a) == raw and b"".join(aligner.bytes_b[i] for i in b) == raw
    return (a, b) if whole else ([], [])


def brute(aligner, rows):
    made = []
    for doc_id, text in rows:
        a, b = tokens(aligner, text or "")
        owner = lambda ids, size: [k for k, i in enumerate(ids) for _ in range(len(size[i]))]
        of_a, of_b = owner(a, aligner.bytes_a), owner(b, aligner.bytes_b)
        links = sorted(set(zip(of_a, of_b)))
        cuts = [k for k in range(len(of_a)) if k + 1 == len(of_a) or of_a[k] != of_a[k + 1] and of_b[k] != of_b[k + 1]]
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(a[i]) for i in dict.fromkeys(of_a[start : c + 1])) + "|" + ",".join(str(b[i]) for i in dict.fromkeys(of_b[start : c + 1])))
            start = c + 1
        made.append((doc_id, a, b, [(a[i], b[j]) for i, j in links], groups))
    counts = Counter(p for m in made for p in set(m[3]))
    best: dict[int, int] = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted((d, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, links, g in made), counts


@pytest.fixture(scope="module")
def aligner():
    v = alignment.public_vocabularies()
    return alignment.worker(v.a, v.b)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_align_whole_table(spark, docs, aligner):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(alignment.align(docs)) == brute(aligner, rows)[0]


@pytest.mark.parametrize("hot", [0, 3, 40, alignment.HOT])
def test_rare_pairs_are_joined(spark, aligner, hot):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i % 3, "the same words again, again") for i in range(7)] + [(200, None), (201, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    assert result(alignment.align(df, hot=hot)) == brute(aligner, rows)[0]


def test_pair_counts_and_groups(spark, docs, aligner):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = brute(aligner, rows)[1]
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in alignment.pair_counts(docs).collect()} == counts
    found = {r["doc_id"]: r["groups"] for r in alignment.groups(docs.select("doc_id", "text")).select("doc_id", "groups").collect()}
    for doc_id, text in rows[:50]:
        a, b = tokens(aligner, text or "")
        groups = found[doc_id] or []
        assert [x for g in groups for x in g["a"]] == a and [x for g in groups for x in g["b"]] == b


def test_flushed_sums_are_whole(spark, docs, aligner, monkeypatch):
    v = alignment.public_vocabularies()
    key = lambda df: {(r["same"], r["key"]): r["n"] for r in df.groupBy("same", "key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    whole = key(alignment.raw_counts(docs, v, "text"))
    monkeypatch.setattr(alignment, "BUFFER", 100)
    monkeypatch.setattr(alignment, "slices", lambda batches: (b.slice(i, 5) for b in batches for i in range(0, b.num_rows, 5)))
    assert key(alignment.raw_counts(docs, v, "text", most=50)) == whole


def test_edges(spark, edges, none, aligner):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    zero = lambda rows: sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)
    assert zero([tuple(r) for r in alignment.align(edges).collect()]) == zero(brute(aligner, [(-1 if i is None else i, t) for i, t in rows])[0])
    assert alignment.align(none).count() == 0
    assert alignment.pair_counts(none).count() == 0
    clash = edges.withColumn("n_a", edges["text"]).withColumn("KEY", edges["text"])
    assert alignment.align(clash).count() == edges.count()
    assert alignment.groups(clash).count() == edges.count()

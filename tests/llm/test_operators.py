"""Each operator against a brute-force version, and on the edges every operator must take."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from nearby.llm import bpe, common, elias_fano, fingerprints, mixing, pivot_links, quality_fm, quality_rules, simhash, token_store, topk_search, toxicity, warc, wordpiece_counts
from nearby.llm.common import fresh, new_folder
from nearby.llm.vocab import public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    """Extra columns named as the operators' own."""
    return df.withColumns({c: F.lit("mine") for c in ("score", "toxicity", "measures", "failures", "fp", "component_id", "n_tokens", "pass", "position", "block", "tie", "s", "winner", "n", "row", "rest", "full", "k0", "class", "cells", "hash", "vec", "copies", "page", "payload", "digest", "size")})


# 1


def brute_top(rows, k, every):
    """Every row but the query's own is a candidate, whatever ids repeat."""
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, mine) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for n, (i, v) in enumerate(ok) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_topk(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a hot vector: ties by id
    rows += [(500, None), (501, [1.0, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, [9.0] * 12), (504, [2.0, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(5)
    want = brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()], 10, 50)
    assert answers(topk_search.top_k(df, F.col("vec_id") % 50 == 0, 10, n_blocks=7, n_query_blocks=3)) == want
    assert answers(topk_search.top_k(df, F.col("vec_id") % 50 == 0, 10, lists=3)) == want


def test_topk_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i % 40, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]  # an id with five vectors each
    rows += [rows[3]] * 30 + [rows[0]] * 4 + [(100, [1.0, 1.0]), (1, [0.0, 0.0]), (1, [5.0, 5.0])]  # rows equal as a whole, queries among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()], 10, 20)
    assert answers(topk_search.top_k(df, F.col("vec_id") % 20 == 0, 10, n_blocks=3, n_query_blocks=2)) == want


def test_topk_few(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [-1.0, 0.5]), (100, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert answers(topk_search.search(df)) == brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()], 10, 100)
    assert topk_search.search(df.where("vec_id < 0")).count() == 0


# 2 and 5


@pytest.mark.parametrize("module,label,folds,held,least", [(toxicity, "toxic", 5, 0, 0.9), (quality_fm, "quality", 3, 1, 0.93)])
def test_classifiers(spark, module, label, folds, held, least):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet").where("doc_id < 6000")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)
    score = module.score_toxicity if label == "toxic" else module.score_quality
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [r for r in rows if r["held_out"]]
    good = sum(r["predicted"] == r[label] for r in test) / len(test)
    rare = 1 if label == "toxic" else 0
    caught = [r["predicted"] == rare for r in test if r[label] == rare]
    assert good >= least and sum(caught) / len(caught) >= 0.6


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality_fm.score_quality])
def test_classifier_edges(spark, edges, twice, none, labels, score):
    assert score(twice, labels).count() == twice.count()
    out = score(clashing(edges), labels).collect()
    assert len(out) == edges.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1 or score is quality_fm.score_quality
    assert score(none, labels).count() == 0 and score(edges, labels.where("false")).count() == edges.count()


def test_labelled_sample_is_bounded(spark, docs):
    """An id that repeats with many texts counts once."""
    rows = [(1, f"text {i}", "en", "a", 1) for i in range(50)] + [(i, "other", "en", "a", 1) for i in range(2, 9)]
    df, labels = spark.createDataFrame(rows, docs.schema), spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, toxic long")
    for most, n in ((2, 2), (100, 8)):
        sample = common.labelled_sample(df, labels, "toxic", "text", "doc_id", F.lit(True), most)
        assert sample.count() == n
    assert {r["order"] for r in sample.collect() if r["text"].startswith("text")} and sample.where("text like 'text%'").count() == 1


def test_ftrl_against_the_plain_update():
    """One coordinate at a time, as published: z += g - sigma * w, n += g * g, w of z and n."""
    rng, p = np.random.default_rng(2), toxicity.FtrlParams(bits=5, epochs=3, l1=1.0, alpha=0.5)
    rows = [(int(y), np.unique(rng.integers(0, 32, 6))) for y in rng.integers(0, 2, 40)]
    z, n, size = [0.0] * 33, [0.0] * 33, 32

    def weight(i):
        l1 = 0.0 if i == size else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for y, at in rows:
            at = [*at.tolist(), size]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
    m = toxicity.fit_ftrl(rows, p)
    assert np.allclose(m.dense(), [weight(i) for i in range(size)], atol=1e-5) and np.isclose(m.bias, weight(size))
    assert 0 < len(m.index) < size


def test_ftrl_is_sparse_and_finds_the_word():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        words = [f"w{j}" for j in rng.integers(0, 300, 30)] + (["awful"] if i % 3 == 0 else [])
        rows.append((int(i % 3 == 0), np.unique(toxicity.features(" ".join(words), 16)).astype(np.int64)))
    m = toxicity.fit_ftrl(rows, toxicity.FtrlParams(bits=16))
    w = m.dense()
    assert w[toxicity.features("awful", 16)[0]] > 1 and len(m.index) < 500


def test_fm_pair_sum_is_the_sum_of_pairs():
    rng = np.random.default_rng(1)
    v, w, x, at = rng.normal(size=(9, 3)), rng.normal(size=9), rng.random(4), np.array([1, 3, 4, 8])
    pairs = sum(x[i] * x[j] * (v[at[i]] @ v[at[j]]) for i in range(4) for j in range(i))
    assert np.isclose(quality_fm.FmModel(0.5, w, v, 3).raw(at, x), 0.5 + w[at] @ x + pairs)


# 3


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], list(range(0, 90_000, 17)), [0, 1 << 40], sorted(random.Random(1).randrange(1 << 33) for _ in range(5000))])
def test_elias_fano(values):
    raw = elias_fano.encode(np.array(values, np.uint64))
    s = elias_fano.Sequence(raw + b"more")
    assert s.size == len(raw) and s.n == len(values) and s.select(0, s.n).tolist() == values
    for a, b in ((0, 1), (1, 3), (511, 514), (1000, 1700), (s.n - 1, s.n)):
        a, b = max(0, min(a, s.n)), max(0, min(b, s.n))
        assert s.select(a, b).tolist() == values[a:b]
    if len(values) > 1000:
        assert len(raw) < len(values) * 8 / 2.5


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(name))


def test_token_store(spark, docs, edges):
    t = library("word_bpe_49k.json")
    for df in (docs, clashing(edges.where("doc_id is not null"))):
        got = {}
        for r in token_store.store_and_read(df).collect():
            got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])
        start, want = 0, defaultdict(list)
        for i, text in rows:
            ids = [*t.encode(text, add_special_tokens=False).ids, 2]
            want[i].append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_store_edges(spark, edges, twice, none):
    t = library("word_bpe_49k.json")
    want = sorted((r["doc_id"] or -1, 1 + len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in twice.collect())
    got = token_store.store_and_read(twice).orderBy("start").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    out = token_store.store_and_read(edges).orderBy("start").collect()
    assert [r["doc_id"] for r in out][:2] == [None, None] and len(out) == edges.count() and out[0]["start"] == 0
    assert token_store.store_and_read(none).count() == 0


def test_token_store_shares_words(monkeypatch):
    """Words with marks at their end cost no encoding of their own, and texts are those of the library whatever stands in them."""
    t, path = library("word_bpe_49k.json"), public_path("word_bpe_49k.json")
    token_store.worker.cache_clear()
    asked, each = [], token_store.WordEncoder.each
    monkeypatch.setattr(token_store.WordEncoder, "each", lambda self, words: asked.extend(words) or each(self, words))
    texts = ["steinein&&& Steinein!? steinein. steinein erntrend&&& ", None, "", " a'S b'tx. L'été!! x<|endoftext|>y <|startoftext|>. ", "\x1ca\x1d b\u3000c\x85d", "ΣΑΣ. İst. ŉa, ẞ! \u0301a. 12a a_b_c ---a a'. a.' ²a ⅷ x\u200b."]
    for rows in (texts[:1], texts, [], texts[2:3]):
        ids, counts = token_store.encode_column(pa.array(rows, pa.string()), path)
        want = [t.encode(x or "", add_special_tokens=False).ids for x in rows]
        assert [ids[b - n : b].tolist() for n, b in zip(counts, np.cumsum(counts))] == want
        if rows == texts[:1]:
            assert set(asked) <= {"&&&", "!?", "."}
    token_store.worker.cache_clear()


# 4


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rules(docs, edges, twice, none):
    for df in (docs, clashing(edges), twice):
        got = sorted((r["doc_id"] or -1, *(r[x] for x in quality_rules.MEASURES[:5])) for r in quality_rules.check_rules(df).collect())
        assert got == sorted((r["doc_id"] or -1, *brute_rules(r["text"])) for r in df.select("doc_id", "text").collect())
    assert quality_rules.check_rules(none).count() == 0


def test_repeated_words_of_a_long_text():
    words = [b"w%d" % (i % 5000) for i in range(60_000)]
    assert quality_rules.repeated_words(words) == 60_000
    assert quality_rules.repeated_words([b"%d" % i for i in range(60_000)]) == 0


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "a " * 40, " ".join(map(str, range(50))) + " 1 2 3 4 5 6 7 8", "a b c d e f g h", ""])
def test_repeated_words(text):
    assert quality_rules.repeated_words(text.encode().split()) == brute_rules(text)[4]


def test_ledger_policies_and_ablations(docs, none):
    led = quality_rules.ledger(docs.select("doc_id", "text")).select("doc_id", "failures").cache()
    rows = [r["failures"] for r in led.collect()]
    whole = quality_rules.mask(*quality_rules.POLICIES[2])
    for r in quality_rules.ablations(led, 2).collect():
        bit = quality_rules.mask(r["rule"])
        assert (r["n_failed"], r["n_failed_alone"], r["kept_without"]) == (sum(bool(f & bit) for f in rows), sum(f & whole == bit for f in rows), sum(f & whole & ~bit == 0 for f in rows))
    assert [r["kept_without"] for r in quality_rules.ablations(quality_rules.ledger(none), 2).collect()] == [0] * len(quality_rules.POLICIES[2])


def test_filter_keeps_columns_and_clean_rows(edges, labels):
    df = clashing(edges)
    assert simhash.drop_near_duplicates(df, similarity=0.8).columns == df.columns
    for out in (quality_rules.drop_failed(df), toxicity.drop_toxic(df, labels), simhash.drop_near_duplicates(df), mixing.remix(df)):
        assert out.columns == df.columns
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in df.select("doc_id").collect()}


# 6


def test_warc(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    big = "é" * 700
    extra = spark.createDataFrame([(9001, "http://a", big), (9002, None, big), (9003, "http://c", big), (9004, "x", None), (9005, "x", ""), (9006, "x", "WARC/1.1\r\n\r\n"), (None, "y", big), (9007, "z", "short"), (9008, "z", "short")], "page_id long, url string, html string")
    df = pages.union(extra).repartition(3)
    folder = new_folder(spark, "warc-test")
    manifest = warc.write(df, folder)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    top = {}
    for i, b in rows:
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    want = sorted((-1 if i is None else i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if top.get(b, i) != i else "response", top[b] if top.get(b, i) != i else None) for i, b in rows)
    for split in (1 << 24, 4096, 700):  # records longer than a range, ranges without a record
        got = warc.read(manifest, folder, split)
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read(manifest, folder).where("record_type = 'response' and page_id is not null").collect()}
    assert all(payloads[i] == b for i, b in rows if i in payloads)
    assert warc.archive_and_read(df.where("false")).count() == 0


def test_warc_edges(spark):
    long = "<p>" + "very long " * 400_000
    pages = clashing(spark.createDataFrame([(-4, "u", long), (7, "u", long), (7, "u", long), (8, None, None)], "page_id long, url string, html string"))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect())
    n = len(long)
    assert got == [(-4, n, "revisit", 7), (7, n, "response", None), (7, n, "response", None), (8, 0, "response", None)]


def test_warc_of_other_writers():
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    meta = b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\nabc"
    page = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Target-URI: http://a\r\nWARC-Payload-Digest: md5:00\r\n\r\nHTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    assert warc.parse(plain) is None and warc.parse(meta) is None
    assert warc.parse(page) == (None, "http://a", "response", None, b"hello", 5, hashlib.sha1(b"hello").hexdigest())


def test_warc_is_plain_gzip(spark, small):
    import gzip

    from nearby.sources.files import store

    folder = new_folder(spark, "warc-gzip")
    name = warc.write(spark.read.parquet(f"{small}/pages.parquet").limit(5), folder).first()["name"]
    fs, path = store(f"{folder}/{name}")
    with fs.open_input_file(path) as f:
        assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == 5


# 7


def brute_mixture(df, params):
    """Weights, permutations, passes and positions row by row, from the hashes that order blocks and documents."""
    n_words = lambda t: len(WORD.findall(t or ""))
    rows = [(r["source"], r["tie"], r["doc_id"], n_words(r["text"])) for r in df.withColumn("tie", mixing.tie_of(df, "doc_id", "text", params.seed)).collect()]
    tokens, size = Counter(), Counter()
    for s, _, _, n in rows:
        tokens[s] += n
        size[s] += 1
    counts = [t for t in tokens.values() if t]
    share = {s: t / sum(counts) for s, t in tokens.items() if t}

    def weights(a):
        z = sum(x**a for x in share.values())
        return {s: x**a / z for s, x in share.items()}

    def too_flat(a):
        w = weights(a)
        if params.entropy is not None:
            return -sum(x * np.log(x) for x in w.values()) > params.entropy
        passes = [w[s] / tokens[s] for s in w]
        return max(passes) / min(passes) > params.repetition * (1 + 1e-12)

    a = next((x for x in (0.0,) if len(counts) < 2 or not too_flat(x)), None)
    if a is None:
        low, a = 0.0, 1.0
        for _ in range(60):
            middle = (low + a) / 2
            low, a = (middle, a) if too_flat(middle) else (low, middle)
    w = weights(a)
    budget = params.budget or int(max(tokens[s] / w[s] for s in w) + 1e-6)
    out = []
    hashes = df.sparkSession.range(1)
    for s in size:
        take = int(budget * w.get(s, 0.0) + 1e-6)
        take = max(take, tokens[s]) if params.budget is None else take
        blocks = max(1, -(-size[s] // mixing.BLOCK))
        members = defaultdict(list)
        for source, tie, i, n in rows:
            if source == s:
                members[tie % blocks].append((tie, i, n))
        full = take // tokens[s] if tokens[s] else 1
        for p in range(full + (take > full * tokens[s])):
            order = [(r["h"], r["b"]) for r in hashes.select(F.explode(F.array(*(F.lit(b).cast("long") for b in members))).alias("b")).select("b", mixing.place(F.col("b"), F.lit(p), params.seed).alias("h")).collect()]
            at = p * tokens[s]
            for _, b in sorted(order):
                for tie in sorted({t for t, _, _ in members[b]}):
                    same = [(i, n) for t, i, n in members[b] if t == tie]
                    fits = p < full or at + sum(n for _, n in same) <= take
                    if not fits:
                        break
                    out += [(i, s, n, p, at / max(1, take)) for i, n in same]
                    at += sum(n for _, n in same)
                else:
                    continue
                break
    return sorted(out, key=repr)


def mixed(df, params):
    return sorted(((r["doc_id"], r["source"], r["n_tokens"], r["pass"], r["position"]) for r in mixing.mixture(df, params).collect()), key=repr)


@pytest.mark.parametrize("params", [mixing.MixParams(), mixing.MixParams(repetition=3.3), mixing.MixParams(entropy=1.2), mixing.MixParams(budget=7000, repetition=9.0)])
def test_mixing_against_brute_force(spark, docs, monkeypatch, params):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * (i % 7)), "en", "hot" if i % 3 else rng.choice(["a", "b", "b", "c", None]), 1) for i in range(900)]
    rows += [(None, "no id here", "en", "hot", 1)] * 40 + [(5, f"again {i}", "en", "a", 1) for i in range(9)] + [(6, "", "en", "empty", 1)]
    df = clashing(spark.createDataFrame(rows, docs.schema)).repartition(3)
    want = brute_mixture(df, params)
    got = mixed(df, params)
    assert [x[:4] for x in got] == [x[:4] for x in want] and np.allclose([x[4] for x in got], [x[4] for x in want])
    # the same uses, as whole rows
    uses = Counter((r["doc_id"], r["text"]) for r in mixing.remix(df, params).collect())
    expected = Counter()
    text_of = defaultdict(list)
    for r in df.collect():
        text_of[(r["doc_id"], r["source"], len(r["text"].split()))].append(r["text"])
    assert sum(uses.values()) == len(want) and Counter(i for i, _ in uses.elements()) == Counter(x[0] for x in want)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)  # too many sources to broadcast
    assert mixed(df, params) == got


def test_mixing_shares(spark, docs, edges, none):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "hot" if i % 3 else f"s{i % 30}", 1) for i in range(9000)]
    df = spark.createDataFrame(rows, docs.schema)
    out = mixing.mixture(df).collect()
    tokens, taken, uses = Counter(), Counter(), defaultdict(set)
    for i, text, _, s, _ in rows:
        tokens[s] += len(text.split())
    for r in out:
        taken[r["source"]] += r["n_tokens"]
        assert r["pass"] not in uses[r["doc_id"]] and 0 <= r["position"] <= 1
        uses[r["doc_id"]].add(r["pass"])
    assert set(uses) == {r[0] for r in rows}  # every document once at least
    rates = {s: taken[s] / tokens[s] for s in tokens}
    assert all(0.999 <= x <= 1.5 for x in rates.values()) and max(rates.values()) > 1.48 and abs(rates["hot"] - 1) < 1e-9
    assert {r["doc_id"] for r in mixing.mixture(edges).collect()} == {r["doc_id"] for r in edges.collect()} and mixing.mixture(none).count() == 0 and mixing.remix(none).count() == 0


# 8


def test_bpe(spark, docs, edges, twice, none):
    t = library("byte_bpe_50k.json")
    for df in (docs, clashing(edges), twice):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want.append((r["doc_id"] or -1, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
        got = [(r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df).collect()]
        assert sorted(got) == sorted(want)
    path = public_path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(edges.select("doc_id", "text"), path), path)
    assert all((r["text"] or "") == r["decoded"] for r in both.collect()) and bpe.round_trip(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bpe_on_odd_texts(seed):
    t, path, rng = library("byte_bpe_50k.json"), public_path("byte_bpe_50k.json"), random.Random(seed)
    alphabet = ["a", "the", "'s", "'ll", " ", "  ", "\n", "\t", "1", "２", "é", "½", "日", "\x1c", " ", "\xa0", "!", "<|endoftext|>", "😀", "S", "İ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(400)]
    assert bpe.encode_batch(texts, path) == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 9


def test_longest_match():
    rng = random.Random(5)
    for _ in range(60):
        pick = lambda n: {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(n)}
        initial, inside = pick(12), pick(12)
        automaton = wordpiece_counts.Automaton(initial, inside)
        for _ in range(200):
            word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            at, n = 0, 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (inside if at else initial)), None)
                if end is None:
                    n, at = 1 + wordpiece_counts.UNKNOWN, len(word)
                else:
                    at, n = end, n + 1
            assert automaton.count(word) == n


def test_token_counts(docs, edges, none):
    initial, inside = map(set, wordpiece_counts.pieces(public_path("piece_bpe_32k.model")))
    longest = max(map(len, initial | inside))

    def brute(word):
        at, n = 0, 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in (inside if at else initial)), None)
            if end is None:
                return 1, 1
            at, n = end, n + 1
        return n, 0

    for df in (docs.limit(60), clashing(edges.drop("n_chars")).drop("n_tokens")):
        for r in wordpiece_counts.count_tokens(df.select("doc_id", "text")).collect():
            counts = [brute(w) for w in WORD.findall(r["text"] or "")]
            assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(c for c, _ in counts), sum(u for _, u in counts))
    assert wordpiece_counts.count_tokens(none.select("text")).count() == 0


# 10


def brute_fingerprint(text):
    words = [w.encode().lower().decode() for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    """id -> smallest id reachable, over (id, fingerprint) rows."""
    ids = sorted({i for i, _ in prints if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    rows = [(i, f) for i, f in prints if i is not None]
    for n, (i, f) in enumerate(rows):
        for j, g in rows[:n]:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs, edges, none):
    for df in (docs, clashing(edges).where("doc_id is not null")):
        prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        want = brute_components(prints)
        got = simhash.near_duplicates(df).collect()
        assert sorted((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == sorted(prints)
        assert all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(none).count() == 0
    assert len(simhash.near_duplicates(edges).collect()) == edges.count()


@pytest.mark.parametrize("cell", [4, 64, 1024])
def test_links_in_hot_cells(spark, monkeypatch, cell):
    rng, seen = random.Random(9), set()
    centre = rng.getrandbits(64)
    while len(seen) < 260:  # a cloud around one fingerprint and chains away from it
        x = centre
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        seen.add(x)
    seen |= {rng.getrandbits(64) for _ in range(60)}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in seen]
    monkeypatch.setattr(pivot_links, "CELL", cell)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in pivot_links.links(df).collect()]
    from nearby.operators.components import connected_components

    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    got = defaultdict(set)
    for x in signed:
        got[found.get(x, x)].add(x)
    root = brute_components([(i, x & (1 << 64) - 1) for i, x in enumerate(signed)])
    want = defaultdict(set)
    for i, x in enumerate(signed):
        want[root[i]].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tables_are_distances(spark):
    rng = random.Random(2)
    x = [0, -1, *(rng.getrandbits(64) - (1 << 63) for _ in range(40))]
    fp = F.col("fp")
    rows = spark.createDataFrame([(v,) for v in x], "fp long").select("fp", F.array(*fingerprints.whole_table(fp)).alias("d"), F.array(*fingerprints.byte_tables(fp)).alias("t")).collect()
    table = fingerprints.as_table(*np.array([r["d"] for r in rows]).T)
    low = (1 << 64) - 1
    for r, distances in zip(rows, table):
        apart = [(r["fp"] ^ p) & low for p in fingerprints.pivots()]
        assert distances.tolist() == [a.bit_count() for a in apart]
        for b, packed in enumerate(r["t"]):
            assert [packed >> 4 * j & 15 for j in range(fingerprints.BYTE_PIVOTS)] == [(a >> 8 * b & 255).bit_count() for a in apart[: fingerprints.BYTE_PIVOTS]]


def test_pivots_never_lose_a_pair():
    rng = np.random.default_rng(4)
    left = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    x = np.concatenate([left, left ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))])
    table = np.bitwise_count(x[:, None] ^ np.array(fingerprints.pivots(), np.int64).view(np.uint64)).astype(np.int8)
    i, j = np.triu_indices(1000, 1)
    a, b = fingerprints.near(x.view(np.int64), table, i, j, 2)
    ok = np.bitwise_count(x[i] ^ x[j]) <= 2
    assert list(zip(a, b)) == list(zip(i[ok], j[ok])) and len(a) >= 500


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_drop_keeps_one_of_each_group(spark, docs, similarity):
    """Rows that repeat an id with unrelated texts are no copies; rows equal as a whole are, with an id or without."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one), (3, two), (None, one), (None, "c d e f g h"), (None, "c d e f g h"), (4, None), (5, ""), (5, "")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similarity=similarity).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in out)) == sorted([(1, one), (1, two), (0, "c d e f g h"), (4, "")])


def test_fresh_names():
    assert fresh("Score", ["SCORE", "score_"]) == "Score__"


# the pipeline


def test_pipeline(spark, small):
    """Each stage's decisions, from its own input, by brute force."""
    import corpus_pipeline
    from tests.llm.test_near_copies import brute_components as near_components

    docs, seen = spark.read.parquet(f"{small}/documents.parquet").limit(120).cache(), {}
    t = library("byte_bpe_50k.json")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, small)
        rows = out.collect()
        ids = Counter(r["doc_id"] for r in rows)
        if name == "toxicity":
            labels = spark.read.parquet(f"{small}/labels.parquet")
            want = Counter(r["doc_id"] for r in toxicity.score_toxicity(docs, labels).collect() if r["score"] < 0.5)
        elif name == "quality_rules":
            want = Counter()
            for r in before:
                words, chars, symbols, dup, repeat = brute_rules(r["text"])
                raw, lines = "".join(WORD.findall(r["text"])), [x for x in r["text"].split("\n") if WORD.search(x)]
                bad = words < 20 or 100 * repeat > 30 * words or 5 * symbols > words or 2 * dup > len(lines) or chars < 2 * words or chars > 16 * words
                bad = bad or 2 * sum("A" <= c <= "Z" for c in raw) > chars or 3 * raw.count("!") > words
                want[r["doc_id"]] += not bad
            want = +want
        elif name == "near_dedup":
            want = Counter(i for i, c in near_components([(r["doc_id"], r["text"]) for r in before]).items() if i == c)
        elif name == "source_mixture":
            want = Counter(x[0] for x in brute_mixture(docs, mixing.MixParams()))
        else:
            want = Counter(r["doc_id"] for r in before)
            encoded = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids for r in before}
            assert all(r["ids"] == encoded[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows)
        assert ids == want and sum(ids.values()) > 20, name
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out.checkpoint()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "source_mixture", "bpe"]


def test_pipeline_run(spark, small, edges, none, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).collect()
    assert out and {r["doc_id"] for r in out} < {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for n, df in enumerate((clashing(edges), none)):
        df.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert len(corpus_pipeline.run(spark, f"{tmp_path}/{n}").collect()) == 1 - n  # the long text alone has 20 words and repeats little

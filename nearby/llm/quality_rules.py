"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text. The ledger stores the measurements and one bit for
each rule that failed; policies are versioned sets of rules, applied later as masks, and an
ablation is a bitwise sum over the few distinct masks, with no second look at the texts.

Words are runs of characters other than space and U+0009..U+000D. Defined results: a null or
empty text has no words, all measurements 0 and fails ``few_words``; repeated rows are measured
each on its own; an empty table gives an empty ledger and ablations of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm.common import annotate, fresh, texts

WINDOW = 8
#: Fixed by the contract of the base measurements.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")
UPPER = bytes(range(65, 91))


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """Each rule's failure condition over the measurements. A rule's place is its bit and never changes; new rules go last."""
    words = m["n_words"]
    return {
        "few_words": words < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * words,
        "symbols": 5 * m["n_symbols"] > words,
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "short_words": m["word_chars"] < 2 * words,
        "long_words": m["word_chars"] > 16 * words,
        "capitals": 2 * m["n_capitals"] > m["word_chars"],
        "bangs": 3 * m["n_bangs"] > words,
        "too_long": words > 1_000_000,
    }


#: Version -> names of the rules that reject. Published versions stay as they are.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "bangs", "short_words", "long_words"),
}
LATEST = max(POLICIES)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in windows of ``width`` words found twice or more, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    span, odd = 1, np.uint64(0x9E3779B97F4A7C15)
    while span < width:
        step = min(span, width - span)
        h = (h[: len(h) - step] * odd ^ (h[: len(h) - step] >> np.uint64(29))) + h[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
        span += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    # hashes only propose; the words decide, window by window, on the numbers of distinct words
    edge, number = np.zeros(n + 1, np.int64), {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int32, n)
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)[at]
    _, which, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[times[which.reshape(-1)] > 1]
    edge[at] += 1
    np.subtract.at(edge, at + width, 1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes, splits at exactly space and 09-0D
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda chars: len(joined) - len(joined.translate(None, chars))
    continued = len(joined) - len(joined.translate(None, CONTINUATION))
    return len(words), len(joined) - continued, less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(UPPER), less(b"!")


CONTINUATION = bytes(range(0x80, 0xC0))


def ledger(docs: DataFrame, text_col: str = "text", measures: str = "measures", failures: str = "failures") -> DataFrame:
    """``docs`` with a struct of measurements and the bits of failed rules. One pass, no shuffle."""

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = [measure(t) for t in texts(column)]
        parts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        return [pa.StructArray.from_arrays(parts, names=list(MEASURES))]

    field = T.StructField(measures, T.StructType([T.StructField(x, T.LongType()) for x in MEASURES]))
    found = annotate(docs, [text_col], [field], compute)
    tests = rules({x: F.col(measures)[x] for x in MEASURES})
    bits = sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(tests.values())), F.lit(0).cast("long"))
    return found.withColumn(failures, bits)


def mask(*names: str) -> int:
    order = list(rules({x: F.lit(0) for x in MEASURES}))
    return sum(1 << order.index(x) for x in names)


def passes(failures: Column, version: int = LATEST) -> Column:
    return failures.bitwiseAND(F.lit(mask(*POLICIES[version])).cast("long")) == 0


def ablations(led: DataFrame, version: int = LATEST, failures: str = "failures") -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that stay if it is left out.

    At most 2**rules distinct masks are left after one map-side combined count.
    """
    whole = mask(*POLICIES[version])
    counts = led.groupBy(F.col(failures).bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    out = []
    for name in POLICIES[version]:
        bit = mask(name)
        out += [F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias(f"fail_{name}")]
        out += [F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias(f"only_{name}")]
    totals = counts.agg(F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"), *out)
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.coalesce(f"fail_{x}", F.lit(0)).alias("n_failed"), F.coalesce(f"only_{x}", F.lit(0)).alias("n_failed_alone"), (F.coalesce("kept", F.lit(0)) + F.coalesce(f"only_{x}", F.lit(0))).alias("kept_without")) for x in POLICIES[version])))
    return totals.select(each.alias("x")).select("x.*")


def check_rules(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """The digest of a ledger: measurements, base_failed and kept for each row of ``docs``."""
    led = ledger(docs.select("doc_id", "text")).drop("text")
    base = ~passes(F.col("failures"), 1)
    return led.select("doc_id", *(F.col("measures")[x].alias(x) for x in MEASURES[:5]), base.alias("base_failed"), (~base & passes(F.col("failures"), version)).alias("kept"), "failures")


def drop_failed(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """The rows of ``docs`` that pass the base policy and policy ``version``, with their own columns."""
    m, f = fresh("measures", docs.columns), fresh("failures", docs.columns)
    return ledger(docs, measures=m, failures=f).where(passes(F.col(f), 1) & passes(F.col(f), version)).drop(m, f)


#: DuckDB. Positions of 8-word windows that occur twice or more in a text, then the words they cover.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') as words from d),
base as (
  select doc_id, text, words, len(words) as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) as n_bangs
  from w),
grams as (select doc_id, i, array_to_string(words[i:i+7], chr(0)) as g
  from (select doc_id, words, unnest(range(1, n_words - 6)) as i from base where n_words >= 8)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, unnest(range(0, 8)) as t(k) group by doc_id),
m as (
  select b.doc_id, b.n_words::bigint as n_words, b.word_chars::bigint as word_chars, b.n_symbols::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
    len(lines) as n_lines, n_capitals, n_bangs
  from base b left join covered c using (doc_id)),
f as (
  select *, (n_words < 20)::bigint * 1 + (100 * n_repeat_words > 30 * n_words)::bigint * 2 + (5 * n_symbols > n_words)::bigint * 4
    + (2 * n_dup_lines > n_lines)::bigint * 8 + (word_chars < 2 * n_words)::bigint * 16 + (word_chars > 16 * n_words)::bigint * 32
    + (2 * n_capitals > word_chars)::bigint * 64 + (3 * n_bangs > n_words)::bigint * 128 + (n_words > 1000000)::bigint * 256 as failures
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & 3) <> 0 as base_failed, (failures & 255) = 0 as kept, failures
from f
"""

"""SimHash near-duplicates: fingerprints, and links between them found with pivot distance tables.

Equal fingerprints are one class from the start. Each class has its Hamming distances to reference fingerprints
as columns; classes meet by equal coordinates, pairs are discarded by the maximum coordinate difference, and
survivors verified (``pivot_links``). Links make components.

``drop_near_duplicates`` takes either links of fingerprints or, with ``similarity``, links of texts that share that
part of their shingles (``near_copies``; few such texts are within two bits).

Defined results: texts without a word (null and empty ones too) have fingerprint 0 and are linked
like any other; fewer than three words are one shingle; repeated rows share a class; documents with
a null id take part, but a component's id is the smallest id that isn't null (null if there is none).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm import fingerprints as fpr
from nearby.llm import near_copies
from nearby.llm.common import annotate, fresh, texts
from nearby.llm.pivot_links import links
from nearby.operators.components import connected_components

SHINGLE = 3


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", width: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of each whole text. No shuffle."""
    return annotate(docs, [text_col], [T.StructField(name, T.LongType())], lambda column: [pa.array([fpr.fingerprint(t, width) for t in texts(column)], pa.int64())])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, width: int = SHINGLE) -> DataFrame:
    """The kept columns of ``docs`` (its id by default), ``fp``, and ``component_id``: the smallest id reachable."""
    keep = [id_col] if keep is None else keep
    fp = fresh("fp", keep)
    marked = fingerprints(docs.select(*keep, *([] if text_col in keep else [text_col])), text_col, fp, width)
    marked = marked.select(*keep, fp).checkpoint()
    classes = marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("id")).checkpoint()
    joined = connected_components(links(classes))
    named = classes.join(joined, classes.fp == joined.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    label = named.join(smallest, "component").select(F.col("fp").alias("_class"), "component_id", F.col("component").alias("_component"))
    cid, component = fresh("component_id", [*keep, fp]), fresh("component", [*keep, fp, "component_id"])
    label = label.withColumnsRenamed({"component_id": cid, "_component": component})
    return marked.join(label, marked[fp] == F.col("_class")).drop("_class")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    found = components(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, width: int | None = None) -> DataFrame:
    """One row of each component, that of its smallest id, with the columns of ``docs``.

    Components are of fingerprints of ``width`` (3) words at most two bits apart; with ``similarity`` of texts that
    share that part of their shingles of ``width`` (5) words at least. Of rows of the smallest id the one whose text
    has the least hash stays; a component without an id keeps a row likewise; of rows equal in id and text one stays.
    """
    columns = {id_col: F.col(id_col), text_col: F.col(text_col), fresh("hash", [id_col, text_col]): near_copies.text_hash(text_col)}
    rows, h = docs.select(*(c.alias(n) for n, c in columns.items())), list(columns)[2]
    if similarity is not None:
        found = near_copies.components(rows, id_col, text_col, [id_col, h], similarity, width or near_copies.SHINGLE)
    else:
        found = components(rows, id_col, text_col, [id_col, h], width or SHINGLE)
    return near_copies.keep_first(docs, found, id_col, text_col, h, found.columns[-1])

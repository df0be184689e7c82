"""Splitters and embeddings as functions of SQL: table functions for LATERAL joins, by name, and a vector function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.functions.tokens import HELD_LETTERS, cut_by_length, letter_pairs
from quarryloom.operators import chunking

PIECES = "piece int, start int, text string"


def _table_function(cut):
    """A table function over cut(text, size, overlap) -> (start, piece) pairs; null texts have no pieces."""

    class Split:
        def eval(self, text: str, size: int, overlap: int):
            for n, (start, piece) in enumerate(cut(text or "", size, overlap)):
                yield n, start, piece

    return F.udtf(Split, returnType=PIECES, useArrow=True)


def _windows(text: str, size: int, overlap: int):
    return [(k, text[k : k + size]) for k in range(0, max(len(text), 1), size - overlap)]


#: Splitters by name: each takes a text, a size and an overlap.
SPLITTERS = {
    "split_recursive": lambda text, size, overlap: chunking.recursive_pieces(text, size, overlap),
    "split_textbook": lambda text, size, overlap: chunking.recursive_pieces(text, size, overlap, chunking.TEXTBOOK_SEPARATORS),
    "split_structure": lambda text, size, overlap: chunking.structure(text, size),
    "split_window": _windows,
}
#: Components of `embed`.
WIDTH = 32


def _vectors(texts: pd.Series) -> pd.Series:
    whole, known, out = [t or "" for t in texts], {}, []
    for low, high in cut_by_length(whole, HELD_LETTERS):
        v = letter_pairs(whole[low:high], WIDTH, 0, known)
        out += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    """Makes all splitters and embed(text) known to the session's SQL."""
    for name, cut in SPLITTERS.items():
        spark.udtf.register(name, _table_function(cut))
    spark.udf.register("embed", F.pandas_udf(_vectors, T.ArrayType(T.DoubleType())))


def split_sql(spark: SparkSession, docs, name: str, size: int, overlap: int):
    """Pieces of every document by a splitter that is named, through SQL."""
    register(spark)
    return spark.sql(f"SELECT d.doc_id, s.piece, s.start, s.text FROM {{docs}} d, LATERAL {name}(d.text, {int(size)}, {int(overlap)}) s", docs=docs)

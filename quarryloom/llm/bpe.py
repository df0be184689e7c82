"""Byte-level BPE encoding and decoding.

A text longer than `chunk_chars` is cut into chunks that overlap. The chunks are dealt over the cluster and
pre-tokenised on their own, starting in the middle of the text; the boundaries that two neighbours both found in their
overlap are where they have resynchronised, and the text is divided there. The pieces are encoded in parallel once
more and their ids joined in order. Decoding concatenates the bytes of the ids.

Null texts count as empty, which have no ids. Rows keep their other columns, whatever their names; repeated rows stay
repeated. A text is limited by what one row may hold, and a chunk pair that never resynchronises (one pre-token longer
than the overlap, such as a long run of white space) is merged into one piece, so ids never depend on the chunk size.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import textbytes as tb
from quarryloom.sources.tables import table

CHUNK_CHARS, OVERLAP_CHARS = 32768, 1024
_encodings: dict = {}


def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file, made once in each Python process."""
    if (ranks_path, pattern) not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path, pattern]


def boundaries(text: str, pattern: str, offset: int = 0) -> list[int]:
    """Ends of the pre-tokens of `text` after which a cut changes nothing: the pre-token ends in a printing character,
    so no look-ahead for white space is involved. Positions are moved by `offset`."""
    import regex

    return [m.end() + offset for m in regex.finditer(pattern, text) if not text[m.end() - 1].isspace()]


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks; each but the first starts `overlap` before the end of the one before it."""
    return [(s, text[max(0, s - overlap) : s + size]) for s in range(0, max(len(text), 1), size)]


def stitch(spans: list[tuple[int, list[int], list[int]]], length: int) -> list[int]:
    """Cuts of a text from (start, first boundaries, last boundaries) of its chunks in order: for each pair of
    neighbours the first boundary that both have; none if they have not met."""
    cuts = []
    for (_, _, left), (_, right, _) in zip(spans, spans[1:], strict=False):
        met = sorted(set(left) & set(right))
        if met and met[0] > (cuts[-1] if cuts else 0):
            cuts.append(met[0])
    return [0, *cuts, length]


def whole_piece_ids(enc, pattern: str, piece: str) -> list[int]:
    """Ids of a piece. A long one is pre-tokenised here, as the library's own pattern overflows the stack on a long run of
    white space, and its pre-tokens go through the merge ranks one by one."""
    if len(piece) <= CHUNK_CHARS:
        return enc.encode_ordinary(piece)
    import regex

    return [i for m in regex.finditer(pattern, piece) for i in enc._encode_single_piece(m.group())]


def _row(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, with_decoded: bool = False) -> DataFrame:
    """Adds `ids`: the token ids of `text` as little-endian unsigned 32-bit integers in one binary value. with_decoded also
    adds what `decode` would, in the same pass."""
    from pyspark.sql import types as T

    plain = df.withColumn("_long", F.coalesce(F.length(text) > chunk_chars, F.lit(False)))
    added = ["ids", "decoded"] if with_decoded else ["ids"]
    names = [c for c in df.columns if c not in added]
    out_schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, T.BinaryType()) for c in added])

    def short(batches):
        enc = encoding(ranks_path, pattern)
        for b in tb.slices(batches, column=text):
            ids = [enc.encode_ordinary(t or "") for t in b.column(text).to_pylist()]
            out = [pa.array([_row(i) for i in ids], pa.binary())]
            if with_decoded:
                out.append(pa.array([enc.decode_bytes(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, [*names, *added])

    def cut(batches):
        for b in batches:
            for key, t in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True):
                parts = chunks(t, chunk_chars, overlap_chars)
                for s, part in parts:
                    yield pa.RecordBatch.from_pylist([{"_key": key, "start": s, "length": len(t), "part": part}], schema=cut_arrow)

    def pretokenise(batches):
        for b in batches:
            for r in b.to_pylist():
                s, from_, end = r["start"], max(0, r["start"] - overlap_chars), max(0, r["start"] - overlap_chars) + len(r["part"])
                found = boundaries(r["part"], pattern, from_)
                inner = [x for x in found if x < end]
                head, tail = [x for x in inner if x <= s] if s else [], [x for x in inner if x >= end - overlap_chars]
                yield pa.RecordBatch.from_pylist([{"_key": r["_key"], "start": s, "length": r["length"], "head": head, "tail": tail, "part": r["part"][s - from_ :]}], schema=pre_arrow)

    def join_pieces(pdf):
        pdf = pdf.sort_values("start")
        cuts = stitch([(r.start, list(r.head), list(r.tail)) for r in pdf.itertuples()], int(pdf.length.iloc[0]))
        whole = "".join(pdf.part)
        import pandas as pd

        return pd.DataFrame({"_key": pdf._key.iloc[0], "start": cuts[:-1], "part": [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})

    def join_ids(pdf):
        import pandas as pd

        return pd.DataFrame({"_key": [pdf._key.iloc[0]], "ids": [b"".join(pdf.sort_values("start").piece_ids)]})

    def encode_piece(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = pa.array([_row(whole_piece_ids(enc, pattern, t)) for t in b.column("part").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("start"), ids], ["_key", "start", "piece_ids"])

    cut_arrow = pa.schema([("_key", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("part", pa.string())])
    pre_arrow = pa.schema([("_key", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("part", pa.string())])
    done = plain.where(~F.col("_long")).select(*names).mapInArrow(short, out_schema)
    # Equal texts have equal ids: a text is named by its digest, which needs no unique key and survives recomputation.
    long = plain.where("_long").select(*names).withColumn("_key", F.sha2(F.col(text).cast("binary"), 256))
    parts = long.select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"]).mapInArrow(cut, "_key string, start long, length long, part string")
    pre = parts.repartition("_key", "start").mapInArrow(pretokenise, "_key string, start long, length long, head array<long>, tail array<long>, part string")
    pieces = pre.groupBy("_key").applyInPandas(join_pieces, "_key string, start long, part string")
    coded = pieces.repartition("_key", "start").mapInArrow(encode_piece, "_key string, start long, piece_ids binary")
    ids = coded.groupBy("_key").applyInPandas(join_ids, "_key string, ids binary")
    rest = long.join(ids, "_key").select(*names, "ids")
    return done.unionByName(decode(rest, ranks_path, pattern) if with_decoded else rest)


def decode(df: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """Adds `decoded`: the bytes that the ids stand for, concatenated; null ids give no bytes."""
    from pyspark.sql import types as T

    names = [c for c in df.columns if c != "decoded"]

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for b in tb.slices(batches, column=ids):
            out = pa.array([enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [out], [*names, "decoded"])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())]))


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(docs, *public_ranks(), with_decoded=True).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

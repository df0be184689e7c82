"""Removal of repeated passages by longest-previous-factor arrays over partitioned suffix order.

A passage of `length` bytes that occurs twice has the same anchor (see `anchors`) at the same distance in both places,
so only suffixes that begin in windows of one anchor can share `length` bytes. This splits the suffix array of the
corpus into independent parts:

1. Every text is cut into runs of windows with one anchor. Runs whose anchor stands nowhere else go; of the others,
   equal ones are counted by hash before any text moves. All windows of a run that occurs again are repeated.
2. Anchors with several different runs remain. One copy of each of their runs is fetched, and the runs of an anchor
   are brought together in blocks of bounded size. In a block, the suffixes at the anchors are sorted and their longest
   common prefixes, and those of the reversed texts before the anchors, say which windows can have a partner at all.
   The suffixes at these windows are sorted by their first `length` bytes; among equal ones the previous smaller
   positions give the earlier matches.
3. An anchor with more than `hot_runs` different runs is not brought together: its runs are cut into `pieces` of so
   many windows, equal ones counted by hash, the pieces that share all but their ends into smaller ones and these into
   single windows, counted in the same way. So no group, however large, meets in one task.

With keep="first" a window is removed if an equal one begins earlier (by `order`, row, position); with keep="none" if an
equal one begins anywhere else. Matches never cross documents; windows are judged on the input.

Null texts are empty; texts shorter than `length` keep all bytes. Repeated rows are copies like any other. Rows are
known by file and place in it, or by a number that is saved with them once, so that every job names them alike however
the input is split. A null `order` stands before all others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import anchors
from quarryloom.llm import textbytes as tb
from quarryloom.llm.storage import file_row, maybe_among, saved, temporary
from quarryloom.sources.tables import table

LENGTH, HOT_RUNS = 400, 128
#: Windows of the pieces into which the runs of an anchor with many of them are cut, ever smaller ones.
PIECES = (16, 4)
#: Passages of "over 50 words" have so many at least. Words are compared as codes of so many bytes, and anchors are so many.
PASSAGE_WORDS, WORD_BYTES, WORD_GRAM = 51, 8, 3
BLOCK_BYTES = 2 << 20
_RUN = "ord long, rid long, s int, a int, e int"
_FETCHED = f"key long, full long, {_RUN}, n long, data binary"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def symbols(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What a column's texts are made of, bytes or the 64-bit hashes of their words, and where each text begins."""
    flat, offsets = tb.texts(column)
    if width == 1:
        return flat, offsets
    start, end, number = tb.words(flat, offsets, tb.NOT_SPACE)
    return tb.span_hash(tb.prefix_hash(flat), start, end), tb.by_text(number, len(column))


def _find_runs(length: int, width: int):
    def run(batches):
        for b in tb.slices(batches):
            n, s, e, a, gram, full = anchors.runs(*symbols(b.column("text"), width), length, anchors.GRAM if width == 1 else WORD_GRAM)
            rid, order = (np.asarray(b.column(c).fill_null(0)) for c in ("rid", "ord"))
            yield pa.RecordBatch.from_arrays([_signed(gram), _signed(full), _signed(order[n]), _signed(rid[n]), *(pa.array(x, pa.int32()) for x in (s, a, e))], ["key", "full", "ord", "rid", "s", "a", "e"])

    return run


def _fetch(length: int, piece: int, width: int):
    """Bytes of each wanted run; for a run of a hot anchor the hashes of its pieces instead."""

    def run(batches):
        for b in tb.slices(batches):
            flat, offsets = symbols(b.column("text"), width)
            prefix = tb.prefix_hash(flat)
            out = {k: [] for k in ("key", "full", "ord", "rid", "s", "a", "e", "n", "data")}
            raw = flat.tobytes()
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                at = int(offsets[i])
                rid = b.column("rid")[i].as_py()
                for w in wanted:
                    if not w["hot"]:
                        rows = [(w["key"], 0, w["s"], w["e"], raw[(at + w["s"]) * width : (at + w["e"] + length) * width])]
                    else:
                        # Pieces are cut at fixed distances from the anchor, so equal text is cut alike everywhere.
                        low, high = w["a"] - w["e"], w["a"] - w["s"]
                        rows = []
                        for j in range(low // piece, high // piece + 1):
                            p, q = w["a"] - min(high, piece * (j + 1) - 1), w["a"] - max(low, piece * j)
                            ends = np.array([[w["a"] - piece * j, w["a"] - piece * (j + 1) + 1 + length], [p, q + length]]) + at
                            ends[0] = np.clip(ends[0], at + p, at + q + length)
                            core, full = tb.span_hash(prefix, ends[:, 0], ends[:, 1]).view(np.int64)
                            rows.append((int(core), int(full), p, q, None))
                    for key, full, p, q, data in rows:
                        for k, v in zip(out, (key, full, w["ord"], rid, p, w["a"], q, w["n"], data), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("full", pa.int64()), ("ord", pa.int64()), ("rid", pa.int64()), ("s", pa.int32()), ("a", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))

    return run


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows of two byte matrices."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def neighbour_match(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with any other of its group: the suffix-order neighbours have it."""
    best = np.zeros(len(rows), np.int64)
    if len(rows) < 2:
        return best
    strings = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((strings, group))
    lcp = common_prefix(rows[order[1:]], rows[order[:-1]])
    lcp[group[order[1:]] != group[order[:-1]]] = 0
    best[order[1:]] = lcp
    best[order[:-1]] = np.maximum(best[order[:-1]], lcp)
    return best


def repeated_windows(data: list[bytes], group: np.ndarray, s: np.ndarray, a: np.ndarray, e: np.ndarray, copies: np.ndarray, rank: np.ndarray, length: int, keep_first: bool, width: int = 1):
    """(run number, window start) of the windows of each run that have an earlier (or any other) equal one in its group.
    rank orders the runs; copies: in how many places the run stands. Windows begin at multiples of `width` bytes."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    room = np.concatenate([flat, np.zeros(length, np.uint8)])
    reach = np.arange(length)
    right_length, left_length = e + length - a, a - s
    anchor = base[:-1] + left_length
    right = np.where(reach < right_length[:, None], room[np.minimum(anchor[:, None] + reach, len(room) - 1)], 0)
    left = np.where(reach < left_length[:, None], room[np.maximum(anchor[:, None] - 1 - reach, 0)], 0)
    lcp, lcs = np.minimum(neighbour_match(right, group), right_length), np.minimum(neighbour_match(left, group), left_length)
    # A window d bytes before the anchor needs d equal bytes on the left and the rest on the right.
    low, high = np.maximum(a - e, length - lcp), np.minimum(left_length, lcs)
    low, high = -(-low // width) * width, high // width * width
    size = np.maximum((high - low) // width + 1, 0)
    run = np.repeat(np.arange(len(data)), size)
    if not len(run):
        return run, run
    d = high[run] - width * (np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size))
    strings = np.lib.stride_tricks.sliding_window_view(room, length)
    out = []
    order0 = np.lexsort((d, group[run]))
    run, d = run[order0], d[order0]
    same = np.concatenate([[0], np.flatnonzero((np.diff(group[run]) != 0) | (np.diff(d) != 0)) + 1])
    step = 0
    while step < len(same):
        first = same[step]
        stop = max(step + 1, int(np.searchsorted(same, first + 16384, "right")) - 1)
        last = same[stop] if stop < len(same) else len(run)
        r, dist = run[first:last], d[first:last]
        rows = np.ascontiguousarray(strings[anchor[r] - dist])
        keys = rows.view(f"S{length}").ravel()
        order = np.lexsort((rank[r], keys, dist, group[r]))
        r, dist, rows = r[order], dist[order], rows[order]
        new = np.ones(len(r), bool)
        new[1:] = (common_prefix(rows[1:], rows[:-1]) < length) | (group[r[1:]] != group[r[:-1]]) | (dist[1:] != dist[:-1])
        if keep_first:
            hit = ~new
        else:
            at = np.cumsum(new) - 1
            hit = np.bincount(at, weights=copies[r])[at] > 1
        out.append((r[hit], a[r[hit]] - dist[hit]))
        step = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(length: int, keep_first: bool, width: int):
    """Reads fetched runs sorted by anchor, a block of whole groups at a time."""

    def solve(pending: pa.Table):
        c = {k: np.asarray(pending.column(k).combine_chunks()) for k in ("key", "ord", "rid", "s", "a", "e", "n")}
        s, a, e = (c[k].astype(np.int64) * width for k in "sae")
        rank = np.empty(len(s), np.int64)
        rank[np.lexsort((s, c["rid"], c["ord"]))] = np.arange(len(s))
        run, start = repeated_windows(pending.column("data").to_pylist(), c["key"], s, a, e, c["n"], rank, length * width, keep_first, width)
        start = start // width
        order = np.lexsort((start, run))
        run, start = run[order], start[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(run)) - 1 if len(run) else first
        return pa.RecordBatch.from_arrays([pa.array(c["rid"][run[first]], pa.int64()), pa.array(start[first], pa.int32()), pa.array(start[last], pa.int32())], ["rid", "s", "e"])

    def go(batches):
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                held.append(b)
                size += b.nbytes
                if size < BLOCK_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                key = np.asarray(table.column("key").combine_chunks())
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(x.nbytes for x in held)
        if held and sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return go


def _again(members: DataFrame, classes: DataFrame, on: list[str], keep_first: bool) -> DataFrame:
    """Members (rid, s, e) of classes that occur more than once; without the first of each if it is to stay."""
    many = classes.where("n > 1")
    if not keep_first:
        return members.join(many.select(*on), on).select("rid", "s", "e")
    many = many.select(*on, F.col("first.rid").alias("_rid"), F.col("first.s").alias("_s"))
    return members.join(many, on).where("rid != _rid OR s != _s").select("rid", "s", "e")


def _one_of(keep_first: bool) -> Column:
    """The first member of a class; any one where none is to stay, which needs no sort."""
    columns = ("ord", "rid", "s", "a", "e")
    return (F.min(F.struct(*columns)) if keep_first else F.struct(*(F.first(c).alias(c) for c in columns))).alias("first")


def _fetched(texts: DataFrame, wanted: DataFrame, length: int, piece: int, width: int) -> DataFrame:
    """wanted: key, the columns of a run, n, hot. See `_fetch`."""
    listed = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "ord", "s", "a", "e", "n", "hot")).alias("wanted"))
    return saved(maybe_among(texts, "rid", wanted.select("rid"))[0].join(listed, "rid").mapInArrow(_fetch(length, piece, width), _FETCHED), "fetched")


def repeated(texts: DataFrame, *, length: int = LENGTH, keep: str = "first", hot_runs: int = HOT_RUNS, pieces: tuple[int, ...] = PIECES, width: int = 1) -> DataFrame:
    """texts: rid (unique), ord (long), text. Returns rid, s, e: ranges of window starts whose windows are repeated. With
    the `width` of word codes, length, s and e count words."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    keep_first = keep == "first"
    runs = saved(texts.mapInArrow(_find_runs(length, width), f"key long, full long, {_RUN}"), "runs")
    # Most anchors stand alone: the keys are counted first, so that few whole runs have to move.
    often = saved(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    runs = maybe_among(runs, "key", often)[0]
    classes = runs.groupBy("key", "full").agg(F.count("*").alias("n"), _one_of(keep_first))
    several = classes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    classes = saved(classes.join(several, "key", "left").where("n > 1 OR c IS NOT NULL"), "classes")
    out = _again(runs, classes, ["key", "full"], keep_first)
    wanted = classes.where("c > 1").select("key", "first.*", "n", (F.col("c") > hot_runs).alias("hot"))
    fetched = _fetched(texts, wanted, length, pieces[0], width)
    blocks = fetched.where("data IS NOT NULL").repartition("key").sortWithinPartitions("key")
    out = out.unionByName(blocks.mapInArrow(_blocks(length, keep_first, width), "rid long, s int, e int"))
    if classes.where(F.col("c") > hot_runs).isEmpty():
        return out
    found = fetched.where("data IS NULL")
    for piece in (*pieces[1:], 1):
        kinds = found.groupBy("key", "full").agg(F.sum("n").alias("n"), _one_of(keep_first))
        shared = kinds.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        kinds = saved(kinds.join(shared, "key", "left").where("n > 1 OR c IS NOT NULL"), "pieces")
        out = out.unionByName(_again(found, kinds, ["key", "full"], keep_first))
        found = _fetched(texts, kinds.where("c > 1").select("key", "first.*", "n", F.lit(True).alias("hot")), length, piece, width)
    counted = found.groupBy("key").agg(F.sum("n").alias("n"), _one_of(keep_first))
    return out.unionByName(_again(found, counted, ["key"], keep_first))


def merged(ranges: list | None, length: int) -> list[list[int]]:
    """The bytes that the windows of `ranges` cover, as maximal stretches."""
    out: list[list[int]] = []
    for r in sorted((r["s"], r["e"] + length) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return out


def _cut(carried: list[str], length: int, as_text: bool, by_words: bool):
    """Removes what the ranges cover, bytes or whole words with what stands between them; where text is wanted, what is
    left of characters that were cut goes too. Passages are counted by their own ranges of words."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in tb.slices(batches):
            kept, removed, spans, passages = [], [], [], []
            for text, ranges, repeats in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist(), b.column("repeats").to_pylist(), strict=True):
                text, held = text or b"", merged(ranges, length)
                if by_words and held:
                    start, end, _ = tb.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), tb.NOT_SPACE)
                    held = [[int(start[i]), int(end[j - 1])] for i, j in held]
                edges = [0, *(x for r in held for x in r), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(sum(j - i for i, j in held))
                spans.append([{"start": i, "end": j} for i, j in held])
                passages.append(len(merged(repeats, PASSAGE_WORDS)))
            texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), texts, pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(passages, pa.int64())], [*carried, "kept", "n_removed", "spans", "n_passages"])

    return run


def dedup(
    docs: DataFrame, *, order: str = "doc_id", text: str = "text", row: Column | None = None, columns: list[str] | None = None, as_text: bool = False, length: int = LENGTH, by_words: bool = False, count_passages: bool = False, **options
) -> DataFrame:
    """Adds kept (the remaining bytes, or with as_text their characters), n_removed and spans (removed byte ranges) to
    `columns` of docs (all by default).

    row: a number for each row that is the same however the rows are split and read, such as storage.file_row() for a
    table read from files; without it the rows are numbered once and saved. by_words: `length` counts words (between white
    space), which are compared one by one whatever stands between them. count_passages: adds n_passages, the number of
    stretches of over 50 words that `keep` would have removed by words; no byte is removed for them.
    """
    from pyspark.sql import types as T

    columns = list(docs.columns if columns is None else columns)
    fields = {c: f"_c{i}" for i, c in enumerate(columns)}
    base = docs.select((F.monotonically_increasing_id() if row is None else row).alias("rid"), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))).alias("ord"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in fields.items()))
    with temporary(docs.sparkSession) as keep:
        if row is None:
            base = keep(base, "numbered")
        plain = base.select("rid", "ord", "text")
        found = repeated(plain, length=length, width=WORD_BYTES, **options) if by_words else repeated(plain, length=length, **options)
        kinds = {"ranges": found}
        if count_passages:
            kinds["repeats"] = repeated(plain, length=PASSAGE_WORDS, width=WORD_BYTES, **options)
        whole = reduce(DataFrame.unionByName, (df.select("rid", *(F.struct("s", "e").alias(k) if k == name else F.lit(None).cast("struct<s:int,e:int>").alias(k) for k in ("ranges", "repeats"))) for name, df in kinds.items()))
        ranges = keep(whole.groupBy("rid").agg(*(F.collect_list(k).alias(k) for k in ("ranges", "repeats"))), "ranges")
    base = base.drop("ord")
    touched, rest = maybe_among(base, "rid", ranges.select("rid"))
    none = F.lit(None).cast(ranges.schema["ranges"].dataType)
    base = touched.join(ranges, "rid", "left").unionByName(rest.withColumns({"ranges": none, "repeats": none}))
    added = T.StructType.fromDDL(f"kept {'string' if as_text else 'binary'}, n_removed long, spans array<struct<start:long,end:long>>, n_passages long")
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in fields.items()] + added.fields)
    out = base.mapInArrow(_cut(list(fields.values()), length, as_text, by_words), schema)
    return out.select(*(F.col(n).alias(c) for c, n in fields.items()), *(c for c in added.names if c != "n_passages" or count_passages))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a 400-byte string found twice, and the digest of the others; n_passages tells
    of its repeated passages of over 50 words, which may be shorter than 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs, columns=["doc_id"], keep="none", row=file_row(), count_passages=True)
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")

"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles; two are linked if the sets overlap in `percent` of their union or
more. Equal sets are collapsed first. Each remaining set walks several independent trees: at a node it takes `branches`
coordinates of its minwise signature, picked by the node, and goes on to the child named by the value there. Similar sets
share paths. With two branches a pair at 0.8 shares a node of a tree at depth three or more with a chance of 0.94, so
all five trees miss it once in a million times. Then:

* nodes of at most `small` sets are compared exhaustively;
* larger nodes branch further, which scatters sets that share only a passage;
* what is still large at the last depth are families of near copies. The set that is in most of a family's nodes, its
  centre, is compared with all members; members that this leaves outside the centre's component are compared with the
  whole family, in blocks of bounded size, by an inverted index over the shingles, which gives exact overlaps and emits
  one link per member and component instead of all pairs.

Every link is confirmed on the full sets; signatures only discard pairs that they estimate four standard
deviations or more below the threshold. Components come from all links.

Null and empty texts, and texts without words, have empty sets and link with nothing. Rows are not merged: repeated rows
get the same component. Documents that share an id count as one document. Rows with a null id take no part: their component is null and they are kept.
Other columns play no role in `mark` and pass through `dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import textbytes as tb
from quarryloom.functions.graph import components
from quarryloom.llm.storage import maybe_among, saved, temporary
from quarryloom.sources.shared import sorted_in
from quarryloom.sources.tables import table

WORDS, PERCENT = 5, 80
TREES, BRANCHES, DEPTH, LAST_DEPTH, SMALL = 5, 2, 3, 6, 24
BINS = 128
BLOCK_SHINGLES = 400_000
#: Bits, at most a million rows that are broadcast, that tell the documents whose sets are compared from others.
NEEDED_BITS = 1 << 26
_LOWER = tb.lower_table()


def _donors() -> np.ndarray:
    """For each bin the order in which other bins stand in for it when it is empty."""
    keys = tb.mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS)
    return np.argsort(keys, axis=1)


_DONORS = _donors()


def sets(flat: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    flat = _LOWER[flat]
    start, end, number = tb.words(flat, offsets, tb.NOT_SPACE)
    word = tb.span_hash(tb.prefix_hash(flat), start, end)
    h, number = tb.shingles(word, tb.by_text(number, len(offsets) - 1), words)
    order = np.lexsort((h, number))
    h, number = h[order], number[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
    return h[new], tb.by_text(number[new], len(offsets) - 1)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits for each of 128 bins: of the smallest hash in the bin, or of the bin that stands in for it."""
    n = len(bounds) - 1
    number = np.repeat(np.arange(n), np.diff(bounds))
    place = number * BINS + (h >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = place[1:] != place[:-1]
    out, filled = np.zeros(n * BINS, np.uint16), np.zeros(n * BINS, bool)
    out[place[first]] = (tb.mix(h[first]) >> np.uint64(48)).astype(np.uint16)
    filled[place[first]] = True
    row, column = np.nonzero(~filled.reshape(n, BINS) & (np.diff(bounds) > 0)[:, None])
    for k in range(BINS):
        if not len(row):
            break
        donor = row * BINS + _DONORS[column, k]
        ok = filled[donor]
        out[row[ok] * BINS + column[ok]] = out[donor[ok]]
        row, column = row[~ok], column[~ok]
    return out.reshape(n, BINS)


def packed(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash: two sets of 20,000 agree by chance in one of them once in a million times."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sketch(words: int):
    def run(batches):
        for b in tb.slices(batches):
            h, bounds = sets(*tb.texts(b.column("text")), words)
            size = np.diff(bounds)
            sums = [np.concatenate([[0], np.cumsum(m, dtype=np.uint64)]) for m in (tb.mix(h), tb.mix(h ^ np.uint64(0xA5A5F00DC3C35A5A)))]
            mark = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
            sig = signatures(h, bounds)
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), binary(mark), binary(sig)], ["id", "n", "mark", "sig"])

    return run


def _shingled(words: int):
    def run(batches):
        for b in tb.slices(batches):
            h, bounds = sets(*tb.texts(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([packed(h[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["id", "shingles"])

    return run


def _likely(percent: int):
    """Pairs whose signatures do not rule a link out; small sets, whose signatures say little, all stay."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BINS) for c in ("sig_a", "sig_b"))
            least = np.minimum(np.asarray(b.column("n_a")), np.asarray(b.column("n_b")))
            most = np.maximum(np.asarray(b.column("n_a")), np.asarray(b.column("n_b")))
            # Four standard deviations or more of what the bins, fewer in small sets, can err by.
            margin = np.where(least < 64, 100, np.where(least < 256, 22, 16))
            ok = (100 * least >= percent * most) & ((x == y).mean(axis=1) * 100 >= percent - margin)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in "ab"], ["a", "b"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for b in batches:
            a, c, keep = b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), []
            for x, y in zip(a, c, strict=True):
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in "ab"], ["a", "b"])

    return run


def _family_links(percent: int):
    def run(pdf):
        import pandas as pd

        members, outside = pdf[~pdf.asking].reset_index(drop=True), pdf[pdf.asking]
        out = []
        if len(members) and len(outside):
            data = [unpacked(x) for x in members.shingles]
            size = np.array([len(x) for x in data])
            token, owner = np.concatenate(data), np.repeat(np.arange(len(data)), size)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for u in outside.itertuples():
                own = unpacked(u.shingles)
                left = np.searchsorted(token, own)
                count = np.searchsorted(token, own, "right") - left
                at = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(data))
                hit = np.flatnonzero((100 * both >= percent * (size + len(own) - both)) & (members.id.to_numpy() != u.id))
                if len(hit):
                    found = members.iloc[hit].drop_duplicates("component")
                    out += [(u.id, x) for x in found.id]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _children(rows: DataFrame, branches: int) -> DataFrame:
    """id, node, sig -> the nodes one level deeper."""
    out = rows.withColumn("branch", F.explode(F.array(*map(F.lit, range(branches)))))
    at = F.pmod(F.xxhash64("node", "branch"), F.lit(BINS)).cast("int") * 2 + 1
    return out.select("id", F.xxhash64("node", "branch", F.substring("sig", at, F.lit(2))).alias("node"), "sig")


def candidates(reps: DataFrame, *, trees: int, branches: int, depth: int, last_depth: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of small nodes, rows (centre, id) of the families that stay large)."""
    rows = reps.select("id", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), "sig").select("id", F.xxhash64("tree").alias("node"), "sig")
    pairs = None
    for level in range(depth, last_depth + 1):
        for _ in range(depth if level == depth else 1):
            rows = _children(rows, branches)
        if level > depth:
            rows = rows.select("id", "node").distinct()
        rows = rows.select("id", "node")
        full = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = saved(rows.join(sorted_in(full), "node"), "nodes")
        ids = F.array_sort(F.collect_set("id"))
        few = rows.where(F.col("n") <= small).groupBy("node").agg(ids.alias("ids"))
        all_pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        found = few.select(F.inline(all_pairs))
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = rows.where(F.col("n") > small).select("id", "node")
        if level < last_depth:
            rows = rows.join(sorted_in(reps.select("id", "sig")), "id")
    share = rows.groupBy("id").agg(F.count("*").alias("share"))
    known = saved(rows.join(sorted_in(share), "id"), "large")
    centre = known.groupBy("node").agg(F.max(F.struct("share", "id")).alias("c"))
    family = known.join(sorted_in(centre), "node").select(F.col("c.id").alias("centre"), F.col("c.share").alias("weight"), "id").distinct()
    family = saved(family, "families")
    # A centre that is a member of a weightier family brings its own members there.
    for _ in range(2):
        above = family.groupBy("id").agg(F.max(F.struct("weight", "centre")).alias("top")).select(F.col("id").alias("centre"), F.col("top.centre").alias("new"), F.col("top.weight").alias("new_weight"))
        family = family.join(sorted_in(above), "centre").select(F.col("new").alias("centre"), F.col("new_weight").alias("weight"), "id").distinct()
    return pairs, saved(family.select("centre", "id"), "families")


def links(reps: DataFrame, texts: DataFrame, *, words: int, percent: int, trees: int = TREES, branches: int = BRANCHES, depth: int = DEPTH, last_depth: int = LAST_DEPTH, small: int = SMALL) -> DataFrame:
    """(a, b) of linked sets, enough of them to connect what is connected. reps: id, n, sig; texts: id, text."""
    spark = reps.sparkSession
    side = lambda k: sorted_in(reps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")))
    with temporary(spark) as keep:
        pairs, family = candidates(reps, trees=trees, branches=branches, depth=depth, last_depth=last_depth, small=small)
        family = keep(family, "families")
        stars = family.where("centre != id").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
        pairs = pairs.unionByName(stars).distinct()
        likely = keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent), "a long, b long"), "likely")
    with temporary(spark) as keep:
        return keep(_confirm(likely, family, reps, texts, words=words, percent=percent), "links")


def _confirm(likely: DataFrame, family: DataFrame, reps: DataFrame, texts: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Links among the likely pairs, then between members outside their family's component and the family."""
    needed = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(family.select("id")).distinct()
    # The joins below leave out the few sets that are not needed, so texts are not shuffled to find these.
    some = maybe_among(texts, "id", needed, NEEDED_BITS)[0]
    shingled = saved(some.mapInArrow(_shingled(words), "id long, shingles binary"), "sets")
    side = lambda k: sorted_in(shingled.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}")))
    first = saved(likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    if family.isEmpty():
        return first
    component = components(first, saved)
    named = family.join(sorted_in(component), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_centre = component.select(F.col("id").alias("centre"), F.col("component").alias("main"))
    named = named.join(sorted_in(of_centre), "centre", "left").withColumn("asking", F.col("component") != F.coalesce("main", "centre"))
    named = saved(named.select("centre", "id", "component", "asking").join(sorted_in(reps.select("id", "n")), "id"), "members")
    size = named.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("all_blocks"), F.ceil(F.sum(F.when(F.col("asking"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES).alias("ask_blocks")).where("ask_blocks > 0")
    named = named.join(size, "centre").join(sorted_in(shingled), "id")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    columns = ["centre", "x", "y", "id", "component", "asking", "shingles"]
    all_rows = named.withColumn("y", own("all_blocks")).withColumn("x", spread("ask_blocks")).withColumn("asking", F.lit(False))
    ask_rows = named.where("asking").withColumn("x", own("ask_blocks")).withColumn("y", spread("all_blocks"))
    blocks = all_rows.select(*columns).unionByName(ask_rows.select(*columns))
    second = blocks.groupBy("centre", "x", "y").applyInPandas(_family_links(percent), "a long, b long")
    return first.unionByName(second)


def mark(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """A row for each row of docs: its id, n_shingles, component_id (smallest id reachable over links) and kept (whether
    that is its own id)."""
    with temporary(docs.sparkSession) as keep:
        texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        sketch = saved(texts.mapInArrow(_sketch(words), "id long, n long, mark binary, sig binary"), "sketches")
        known = sketch.where("n > 0 AND id IS NOT NULL")
        reps = saved(known.groupBy("mark").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
        found = links(reps.select("id", "n", "sig"), texts, words=words, percent=percent, **options)
        # Different texts under one id are one document, so their sets meet.
        twice = known.groupBy("id").agg(F.min("mark").alias("m"), F.max("mark").alias("k")).where("m != k").select("id")
        rep = reps.select("mark", F.col("id").alias("rep"))
        same = known.select("id", "mark").join(sorted_in(twice), "id").join(sorted_in(rep), "mark").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b")
        named = components(found.unionByName(same), saved).withColumnRenamed("id", "rep")
        label = rep.join(sorted_in(named), "rep", "left").select("mark", F.coalesce("component", "rep").alias("component"))
        out = sketch.select("id", "n", "mark").join(sorted_in(label), "mark", "left")
        component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
        marked = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))
        return keep(marked, "marked")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each component: that with the smallest id, once. Rows with a null id stay."""
    marked = mark(docs, doc_id=doc_id, **options)
    gone = marked.where("NOT kept").select(F.col(doc_id).alias("_gone")).distinct()
    again = marked.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("_again"))
    maybe, rest = maybe_among(docs, doc_id, gone.unionByName(again.withColumnRenamed("_again", "_gone")))
    left = maybe.join(sorted_in(gone), F.col(doc_id) == F.col("_gone"), "left_anti")
    once = left.join(sorted_in(again), F.col(doc_id) == F.col("_again"), "left_anti")
    first = left.join(sorted_in(again), F.col(doc_id) == F.col("_again"), "left_semi").dropDuplicates([doc_id])
    return rest.unionByName(once).unionByName(first)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under links of 0.8 on four-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, words=4)

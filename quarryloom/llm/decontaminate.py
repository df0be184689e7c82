"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised (A-Z lower-cased, words of letters, digits and non-ASCII characters) and their word sequences
put into one suffix automaton. Documents stream through it: at each word it gives the longest suffix that occurs in
some item, so a match of `window` words or more marks those words. An item shorter than the window, but not empty, is
one window of its own.

Items are read by the driver only in blocks of at most `block_chars` characters (a larger single item is a block of
its own), whose automata are kept in flat arrays; every block passes over all documents, so any number of items is matched.
After every `CHAIN` blocks the documents are saved, so that no task holds more automata than that at once.
Null texts have no words. Items whose id or text is null are left out. Rows of documents pass through one by one, so
repeated rows, null ids and other columns stay; columns `n_words`, `spans` and `items` are replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm import textbytes as tb
from quarryloom.llm.storage import saved
from quarryloom.sources.tables import table

WINDOW, BLOCK_CHARS, CHAIN = 13, 1_000_000, 4
_LOWER = tb.lower_table()


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch of texts, their bounds by text, and the first and last byte of each word."""
    flat, offsets = tb.texts(column)
    flat = _LOWER[flat]
    start, end, number = tb.words(flat, offsets, tb.ALPHANUMERIC)
    return tb.span_hash(tb.prefix_hash(flat), start, end), tb.by_text(number, len(offsets) - 1), start - offsets[number], end - offsets[number]


class _Growing:
    """A generalised suffix automaton while words are added to it."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, last: int, c: int) -> int:
        """The state of the word sequence that led to `last`, followed by c."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, follow: dict, link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy


class Automaton:
    """Suffix automaton over the word sequences of several items, with the items in which each window occurs, in arrays:
    transitions in order of state and word, items by state."""

    def __init__(self, sequences: list[np.ndarray], names: list, window: int):
        self.window, self.names = window, names
        self.vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        self.width = max(len(self.vocabulary), 1)
        coded = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        made = _Growing()
        for s in coded:
            last = 0
            for c in s:
                last = made.add(last, c)
        self.link, self.length = array("i", made.link), array("i", made.length)
        self.steps = array("q", (v * self.width + c for v, follow in enumerate(made.next) for c in sorted(follow)))
        self.targets = array("i", (follow[c] for follow in made.next for c in sorted(follow)))
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: The suffix of exactly `window` words of each state, where it has that many.
        self.cut = array("i", [-1]) * len(self.length)
        for v in by_length:
            if self.length[v] >= window:
                self.cut[v] = v if self.length[self.link[v]] < window else self.cut[self.link[v]]
        #: (words, item) of the short items that end at a state.
        self.short: dict[int, set] = {}
        ends = set()
        for k, s in enumerate(coded):
            v = 0
            for i, c in enumerate(s):
                v = made.next[v][c]
                if i + 1 >= window:
                    ends.add((self.cut[v], k))
            if 0 < len(s) < window:
                self.short.setdefault(v, set()).add((len(s), k))
        found = np.array(sorted(ends), np.int64).reshape(-1, 2)
        self.first_item = array("i", np.searchsorted(found[:, 0], np.arange(len(self.length) + 1)).tolist())
        self.item = array("i", found[:, 1].tolist())
        self.nearest_short = array("i", [-1]) * len(self.length)
        for v in by_length[1:]:
            self.nearest_short[v] = v if v in self.short else self.nearest_short[self.link[v]]
        self.shortest = min([window, *(len(s) for s in coded if len(s))])
        pairs = [np.array(s[:-1], np.int64) * self.width + np.array(s[1:], np.int64) for s in coded if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def step(self, v: int, c: int) -> int:
        """The state after the word c, or -1."""
        key = v * self.width + c
        at = bisect_left(self.steps, key)
        return self.targets[at] if at < len(self.steps) and self.steps[at] == key else -1

    def runs(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the words, and starts and ends of the stretches of a text whose neighbouring words all stand
        together in some item; only there can a match longer than one word be."""
        if not len(word) or not len(self.vocabulary):
            z = np.zeros(0, np.int64)
            return z, z, z
        code = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == word
        joined = np.zeros(len(word) + 1, bool)
        both = np.flatnonzero(known[:-1] & known[1:]) + 1
        if len(self.pairs):
            pair = code[both - 1] * self.width + code[both]
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[near] == pair]] = True
        joined[bounds] = False
        start = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        keep = end - start >= self.shortest
        return code, start[keep], end[keep]

    def walk(self, code: list[int]):
        """(position after the last word, words of the window, item numbers) of every window that occurs."""
        v = matched = 0
        for i, c in enumerate(code, 1):
            new = self.step(v, c)
            while new < 0 and v:
                v = self.link[v]
                matched = self.length[v]
                new = self.step(v, c)
            if new >= 0:
                v, matched = new, matched + 1
            if matched >= self.window:
                state = self.cut[v]
                yield i, self.window, self.item[self.first_item[state] : self.first_item[state + 1]]
            u = self.nearest_short[v]
            while u > 0:
                for words, k in self.short[u]:
                    if words <= matched:
                        yield i, words, (k,)
                u = self.nearest_short[self.link[u]] if self.link[u] > 0 else -1


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int):
    """The items as bounded lists of (id, text)."""
    items = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total, longest = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    n = max(1, -(-total // block_chars))
    while True:
        of = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        if n == 1 or items.groupBy(of).agg(F.sum(F.length("text") + 64).alias("s")).agg(F.max("s")).first()[0] <= max(2 * block_chars, longest + 64):
            break
        n *= 2
    for k in range(n):
        yield [(r["id"], r["text"]) for r in items.where(of == k).collect()]


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, spans (array of word and byte ranges inside windows, ascending, apart) and items (ids of the items
    with a window in the text, ascending). `keep`: the other columns to pass on, all by default."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")]
    carried = list(dict.fromkeys([*names, text]))
    id_field = items.schema[item_id]
    span = T.StructType([T.StructField(x, T.LongType()) for x in ("first_word", "end_word", "first_byte", "end_byte")])
    extra = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(id_field.dataType))]
    out_schema = T.StructType([docs.schema[c] for c in carried] + extra)
    out = docs.select(*carried, F.lit(0).cast("long").alias("n_words"), F.lit([]).cast(T.ArrayType(span)).alias("spans"), F.lit([]).cast(T.ArrayType(id_field.dataType)).alias("items"))
    for k, block in enumerate(blocks(items, item_id, item_text, block_chars)):
        if k and k % CHAIN == 0:
            out = saved(out, "matched")
        hashes, bounds, _, _ = normalised(pa.array([t for _, t in block], pa.string()))
        machine = Automaton([hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], [i for i, _ in block], window)
        out = out.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(machine), text, carried), out_schema)
    return out.select(*names, "n_words", "spans", "items")


def _matcher(shared, text: str, carried: list[str]):
    def run(batches):
        machine = shared.value
        for whole in batches:
            for b in tb.slices([whole.rename_columns(["text" if c == text else f"_{c}" for c in whole.schema.names])]) if whole.num_rows else [whole]:
                b = b.rename_columns(whole.schema.names)
                word, bounds, first, last = normalised(b.column(text))
                code, starts, ends = machine.runs(word, bounds)
                number = np.searchsorted(bounds, starts, "right") - 1
                hit, found = {}, {}
                for n, s, e in zip(number.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    for i, words, items in machine.walk(code[s:e].tolist()):
                        hit.setdefault(n, []).append((s + i - words - int(bounds[n]), s + i - int(bounds[n])))
                        found.setdefault(n, set()).update(items)
                spans, items = [b.column(c).to_pylist() if len(b.column("spans").flatten()) else [[]] * b.num_rows for c in ("spans", "items")]
                for n, ranges in hit.items():
                    at = int(bounds[n])
                    ranges = sorted(ranges + [(x["first_word"], x["end_word"]) for x in spans[n]])
                    merged = [ranges[0]]
                    for x, y in ranges[1:]:
                        if x <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                        else:
                            merged.append((x, y))
                    spans[n] = [{"first_word": x, "end_word": y, "first_byte": int(first[at + x]), "end_byte": int(last[at + y - 1])} for x, y in merged]
                    items[n] = sorted({machine.names[k] for k in found[n]} | set(items[n]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in carried] + [pa.array(np.diff(bounds), pa.int64()), pa.array(spans, b.schema.field("spans").type), pa.array(items, b.schema.field("items").type)],
                    [*carried, "n_words", "spans", "items"],
                )

    return run


def remove(docs: DataFrame, items: DataFrame, *, text: str = "text", max_words: int = 0, min_coverage: float = 0.05, drop_above: float = 1.0, **options) -> DataFrame:
    """Documents without the spans that exceed `max_words` words, in documents of which at least `min_coverage` is
    covered; a document covered beyond `drop_above` goes whole. The columns stay as they were."""
    found = find(docs, items, text=text, **options)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    found = found.withColumn("_covered", F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0)).where(F.col("_covered") <= drop_above)
    data = F.col(text).cast("binary")
    cut = F.filter("spans", lambda s: s["end_word"] - s["first_word"] > max_words)
    edges = F.transform(F.concat(F.lit([0]).cast("array<long>"), F.transform(cut, lambda s: s["end_byte"])), lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get(F.transform(cut, lambda s: s["first_byte"]), i), F.octet_length(F.col(text)).cast("long")).alias("b")))
    kept = F.array_join(F.transform(edges, lambda e: F.substring(data, e["a"].cast("int") + 1, (e["b"] - e["a"]).cast("int")).cast("string")), "")
    return found.withColumn(text, F.when((F.col("_covered") >= min_coverage) & (F.size("spans") > 0), kept).otherwise(F.col(text))).select(*docs.columns)


def judged(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`find` with the number of covered words and whether they are a twentieth of the document or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return find(docs, items, **options).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items, the items, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged(docs, items, keep=["doc_id"]).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")

"""Segmentation of Chinese runs: the most likely path through the lattice of dictionary words.

A run of characters is cut into words of a dictionary with frequencies, or single characters, so that the product of the
words' shares is greatest; a character that is no word counts as seen once, and of equal paths the one with the longer
words first is taken. A dictionary of bounded size goes to every task as a tree of its words in sorted arrays, in which all
places of many runs are looked up at once; texts are not shuffled. A larger one is joined: every stretch of a run that may
be a word meets the dictionary by an equi-join, and the words found are brought together by run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.sources.shared import saved, temporary

RUN = "[一-鿿]+"
#: Words of a dictionary that is sent to every task at most: a tree takes 16 bytes for each different beginning of a word,
#: some 40 bytes a word.
SENT_WORDS = 8_000_000
#: Characters of runs that are cut at once.
HELD_CHARACTERS = 1 << 18


def best_path(run: str, share: dict[str, float], longest: int, least: float) -> list[str]:
    """Words of the best path. share: logarithm of each word's share; least: that of an unknown character."""
    n = len(run)
    score, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best = (-math.inf, 0)
        for size in range(1, min(longest, n - i) + 1):
            weight = share.get(run[i : i + size], least if size == 1 else None)
            if weight is not None:
                best = max(best, (round(weight + score[i + size], 9), size))
        score[i], step[i] = best
    out, at = [], 0
    while at < n:
        out.append(run[at : at + step[at]])
        at += step[at]
    return out


class Tree:
    """The words of a dictionary by their beginnings: level n holds, in order, those of n + 1 characters as the number of the
    shorter beginning on the level before and the last character, with the word's share, or NaN if it is none."""

    def __init__(self, words: pa.Array, freq: np.ndarray, least: float):
        self.least, self.levels = least, []
        code, size = characters(words)
        start = np.cumsum(size) - size
        # As best_path adds them up, to the last digit.
        share = np.array([math.log(f) + least for f in freq.tolist()])
        left, node = np.arange(len(size)), np.zeros(len(size), np.int64)
        for n in range(int(size.max(initial=0))):
            left = left[size[left] > n]
            keys, at = np.unique((node[left] << 21) | code[start[left] + n], return_inverse=True)
            node[left] = at
            shares = np.full(len(keys), np.nan)
            ends = left[size[left] == n + 1]
            shares[node[ends]] = share[ends]
            self.levels.append((keys, shares))

    def cut(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many characters the word has that begins at each place, if the best path comes by. code: the characters of
        runs, one run after the other; size: characters of each run. The paths are those of `best_path`."""
        end = np.repeat(np.cumsum(size), size)
        room = end - np.arange(len(code))
        weight = np.full((max(len(self.levels), 1), len(code)), -np.inf)
        weight[0] = self.least
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for n, (keys, shares) in enumerate(self.levels):
            inside = room[at] > n
            at, node = at[inside], node[inside]
            key = (node << 21) | code[at + n]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            at, node = at[known], place[known]
            word = ~np.isnan(shares[node])
            weight[n, at[word]] = shares[node[word]]
        # Runs are walked from their ends, all at once, the longest first: what is `r` characters from its end stands together,
        # run by run, so that a step reads and writes stretches of arrays.
        rank = np.argsort(np.argsort(-size, kind="stable"), kind="stable")
        alive = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0)) + 1), side="left")
        alive[0] = len(size)
        start = np.append(0, np.cumsum(alive))
        place = start[room] + np.repeat(rank, size)
        laid = np.empty((len(weight), start[-1]))
        laid[:, place] = weight
        score, step = np.zeros(start[-1]), np.ones(start[-1], np.int64)
        for r in range(1, len(alive)):
            low, m = start[r], alive[r]
            longest = min(len(weight), r)
            total = laid[:longest, low : low + m]
            for n in range(longest):
                after = start[r - n - 1]
                total[n] += score[after : after + m]
            total = rounded(total)
            # Of equal ones the longer word.
            step[low : low + m] = longest - total[::-1].argmax(0)
            score[low : low + m] = total.max(0)
        return step[place]


def rounded(x: np.ndarray) -> np.ndarray:
    """Rounded to nine digits as Python's `round` does it, which numpy's does not near the middle of two values."""
    scaled = x * 1e9
    near = np.rint(scaled)
    out = near / 1e9
    with np.errstate(invalid="ignore"):  # no word
        unsure = np.abs(np.abs(scaled - near) - 0.5) < 1e-2
    out[unsure] = [round(v, 9) for v in x[unsure].tolist()]
    return out


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one after the other, and how many each has."""
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), size


def _by_tree(shared):
    """The words of the runs of each text, in order. Texts go through in slices of bounded length."""

    def run(batches):
        tree = shared.value
        for whole in batches:
            # Left out here, as a filter of the plan would find the runs twice.
            whole = whole.filter(pc.greater(pc.list_value_length(whole.column("runs")), 0))
            total = np.cumsum(np.asarray(pc.list_value_length(whole.column("runs"))).astype(np.int64))
            sizes = pc.utf8_length(whole.column("runs").flatten())
            upto = np.append(0, np.cumsum(np.asarray(sizes).astype(np.int64)))[total]
            low = 0
            while low < whole.num_rows:
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HELD_CHARACTERS, side="right")))
                b = whole.slice(low, high - low)
                low = high
                runs = b.column("runs").flatten()
                code, size = characters(runs)
                step = tree.cut(code, size)
                text, starts, at = "".join(runs.to_pylist()), [], 0
                steps = step.tolist()
                while at < len(steps):
                    starts.append(at)
                    at += steps[at]
                starts = np.array([*starts, len(steps)], np.int64)
                words = pa.array([text[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.string())
                of_run = np.searchsorted(starts, np.append(0, np.cumsum(size)))
                of_text = np.append(0, np.cumsum(np.asarray(pc.list_value_length(b.column("runs"))).astype(np.int64)))
                cut = pa.ListArray.from_arrays(pa.array(of_run, pa.int32()), words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), cut)], ["doc_id", "runs"])

    return run


def segment_texts(texts: DataFrame, dictionary: DataFrame, *, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, runs): for each text that has runs of Chinese characters, the words of each run, in order. texts: doc_id,
    text; dictionary: word, freq. Words without characters or with a frequency below one are no words, and rows of one word
    are added up."""
    spark = texts.sparkSession
    with temporary(spark) as keep:
        words = dictionary.where("length(word) > 0 AND freq > 0").groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
        words = keep(words, "words")
    total, longest, n = words.agg(F.sum("freq"), F.max(F.length("word")), F.count("*")).first()
    least, longest = -math.log(max(total or 1.0, 1.0)), longest or 1
    runs = texts.select("doc_id", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"))
    kind = "doc_id long, runs array<array<string>>"
    if n <= sent_words:
        held = words.select("word", "freq").toArrow().combine_chunks()
        word = pa.concat_arrays(held.column("word").chunks) if held.num_rows else pa.array([], pa.string())
        return runs.mapInArrow(_by_tree(spark.sparkContext.broadcast(Tree(word, np.asarray(held.column("freq")), least))), kind)
    runs = runs.select("doc_id", F.posexplode("runs").alias("run", "chars"))
    at = F.explode(F.sequence(F.lit(1), F.length("chars")))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("chars") - F.col("at") + 1)))
    parts = runs.withColumn("at", at).withColumn("size", size).select("doc_id", "run", F.expr("substring(chars, at, size)").alias("word"))
    edges = parts.join(words, "word").select("doc_id", "run", F.struct("word", (F.log("freq") + least).alias("share")).alias("e")).distinct()
    known = edges.groupBy("doc_id", "run").agg(F.collect_list("e").alias("known"))

    def by_run(batches):
        for b in batches:
            found = [best_path(x, {e["word"]: e["share"] for e in known or ()}, longest, least) for x, known in zip(b.column("chars").to_pylist(), b.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("run"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "run", "words"])

    cut = runs.join(known, ["doc_id", "run"], "left").select("doc_id", "run", "chars", "known").mapInArrow(by_run, "doc_id long, run int, words array<string>")
    ordered = F.array_sort(F.collect_list(F.struct("run", "words")))
    return cut.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["words"]).alias("runs"))


def segment(texts: DataFrame, dictionary: DataFrame, *, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, run, words): the words of each run of Chinese characters, by the run's number in its text; see
    `segment_texts`. Null texts have no runs."""
    return segment_texts(texts, dictionary, sent_words=sent_words).select("doc_id", F.posexplode("runs").alias("run", "words"))

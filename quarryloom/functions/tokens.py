"""Column functions on text: tokens, stop words, normalising, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Term patterns (the second for the characters of Chinese, whose bigrams are terms).
TERM = r"[A-Za-z0-9][\p{L}\p{N}_-]*"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]+"
WORD = r"[\p{L}\p{N}_]+"
#: Words that are no terms of the index.
INDEX_STOPWORDS = """
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些
所以 因为 但是 而且 或者 如果 虽然 然而 可以 能 将 把 被 让 给 对 从 以 与 及 等 之 其 中 为 而 于 并
""".split()
#: Words that are no keywords of a query.
CHINESE_STOPWORDS = """
如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否
的 地 得 了 着 过 吗 呢 吧 啊 呀
在 于 和 与 或 及 并 而 但 但是 因为 所以 如果 那么 虽然 然而
我 你 他 她 它 我们 你们 他们 这 那 这个 那个 这些 那些 这里 那里
很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以 应该 必须
是 有 做 进行 使用 通过
个 种 类
？ 。 ！ ， 、
""".split()
ENGLISH_STOPWORDS = """
a an the
in on at to for of with by from as into about through between after before
and or but if then because while although
i you he she it we they this that these those what which who whom whose
is am are was were be been being have has had do does did will would could should may might must can
get use make
how why when where
not no yes so very just also too
""".split()


def terms(text: Column, min_length: int = 2) -> Column:
    """Lower-case index terms in order; runs of Chinese characters give their bigrams."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    kept = F.filter(F.concat(latin, F.coalesce(pairs, F.array().cast("array<string>"))), lambda t: (F.length(t) >= min_length) & ~t.isin(*INDEX_STOPWORDS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """The set of lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


#: Characters whose pairs a task counts at once.
HELD_LETTERS = 1 << 19


def letter_pairs(texts: list[str], width: int, seed: int, known: dict[int, int], single: bool = False) -> np.ndarray:
    """A row for each text: how many of its pairs of neighbouring characters fall into each of `width` buckets, a power of
    two, by xxhash64 with a seed; with `single`, a text of one character counts that. known: buckets of pairs met before,
    which the caller keeps."""
    import xxhash

    size = np.array([len(t) for t in texts], np.int64)
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    inside = row[1:] == row[:-1]
    kinds, number = np.unique(((point[:-1] << 21) | point[1:])[inside], return_inverse=True)
    if len(known) > 1 << 20:
        known.clear()
    for k in kinds.tolist():
        if k not in known:
            known[k] = xxhash.xxh64_intdigest((chr(k >> 21) + chr(k & 0x1FFFFF)).encode("utf-8", "surrogatepass"), seed=seed) % width
    bucket = np.array([known[k] for k in kinds.tolist()], np.int64)[number]
    out = np.bincount(row[:-1][inside] * width + bucket, minlength=len(texts) * width).reshape(len(texts), width).astype(float)
    for k in np.flatnonzero(size == 1) if single else ():
        out[k, xxhash.xxh64_intdigest(texts[k].encode("utf-8", "surrogatepass"), seed=seed) % width] += 1
    return out


def cut_by_length(texts: list[str], most: int):
    """(from, to) of stretches of texts of at most so many characters, or of one text."""
    low = total = 0
    for k, t in enumerate(texts):
        if k > low and total + len(t) > most:
            yield low, k
            low, total = k, 0
        total += len(t)
    if low < len(texts):
        yield low, len(texts)

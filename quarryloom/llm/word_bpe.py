"""BPE with word ends: a backtracking encoder, and decoding by an offset table.

Each piece of a text (see `pieces`) is encoded on its own. A reversed Aho-Corasick automaton of all tokens gives the
longest token that starts at each place, in one pass. The encoder goes from left to right, always tries the longest
token first, and checks it against the token before it in the table of compatible pairs: two tokens may stand side by
side only if merging in order of rank never joins across them. Where no token fits, the last one is taken back and
shortened; a place that has failed is never tried again, since the encoding of what stands before it is unique. So the
result is that of merging by rank, in linear time, for pieces of any length.

Null texts count as empty, which have no ids. Rows keep their other columns, whatever their names; repeated rows stay
repeated. Very long texts are read in slabs that end before a blank, so that what is held besides the text is bounded.
Special tokens whose strings stand in a text become their ids, as in the library. Ids beyond the vocabulary decode to
nothing.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm import textbytes as tb
from quarryloom.sources.tables import table

#: Texts are read in slabs of so many characters, and one blank-free stretch more. So many words and pairs are remembered.
SLAB_CHARS, REMEMBERED_WORDS, REMEMBERED_CHARS, REMEMBERED_PAIRS = 1 << 16, 1 << 18, 48, 1 << 20
#: Below these characters the text stands for itself under NFC, and lower-casing looks at one character at a time.
_BEYOND = re.compile("[\u0300-\U0010ffff]")
_models: dict = {}


class WordBpe:
    """One tokenizer file: its vocabulary by symbols, its merges, and the encoder's tables.

    A symbol is a byte, or a byte that ends a word; tokens and pieces are strings of symbols. The file lists the bytes,
    the bytes at word ends, then one token for each merge, in the order of merging: an id says when a token arises."""

    def __init__(self, path: str):
        import ahocorasick
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        of_char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        symbol = {vocab[c]: chr(b) for c, b in of_char.items()} | {vocab[c + end]: chr(b + 256) for c, b in of_char.items()}
        self.base, self.parts, self.merged = len(symbol), {}, {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if not max(left, right) < whole == self.base + len(self.parts):
                raise ValueError(f"{path}: ids do not follow the order of merging")
            self.parts[whole], self.merged[left, right] = (left, right), whole
            symbol[whole] = symbol[left] + symbol[right]
        self.own = tokenizers.Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        import regex

        self.pattern = regex.compile(split)
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split), "removed", invert=True)

        self.size = {t: len(s) for t, s in symbol.items()}
        whole = set(range(self.base))  # tokens that merging by rank gives for their own symbols; no other ever arises
        for t, (a, b) in self.parts.items():
            if a in whole and b in whole and self._apart(a, b, below=True):
                whole.add(t)
        # Strings are kept backwards: what ends at a place backwards begins there, and the longest is found first.
        self.backwards = {symbol[t][::-1]: t for t in whole}
        self.longest_first = ahocorasick.Automaton()
        for backwards, t in self.backwards.items():
            self.longest_first.add_word(backwards, t)
        self.longest_first.make_automaton()
        by_symbols = {symbol[t]: t for t in whole}
        self.shorter = {t: next((by_symbols[symbol[t][:n]] for n in range(len(symbol[t]) - 1, 0, -1) if symbol[t][:n] in by_symbols), None) for t in whole}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

        texts = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        strings = [texts.get(i, "").encode() + b" " * (i in texts) for i in range(max(texts) + 1)]
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)

    def _apart(self, left: int, right: int, below: bool = False) -> bool:
        """Whether no merge ever joins across two neighbours, seen by undoing the merges inside them, latest first: at
        each moment the two parts that meet at the boundary must not merge before they are used up. Of equal merges the
        one further left is first. `below` leaves out the merge of the two themselves."""
        used_left = used_right = 1 << 62
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and not below and joined < used_left and joined <= used_right:
                return False
            below = False
            if left < self.base and right < self.base:
                return True
            if left > right:
                used_left, left = left, self.parts[left][1]
            else:
                used_right, right = right, self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def piece_ids(self, piece: str) -> array:
        """Ids of one piece, by backtracking."""
        data = piece.encode().decode("latin-1")
        symbols = chr(ord(data[-1]) + 256) + data[-2::-1]
        token = self.backwards.get(symbols)
        if token is not None:
            return array("I", (token,))
        n = len(data)
        first, last = [None] * n, n - 1
        for end, token in self.longest_first.iter(symbols):
            if first[last - end] is None:
                first[last - end] = token
        size, shorter, known = self.size, self.shorter, self.pairs.get
        out, at, failed = array("I"), 0, bytearray(n + 1)
        token, before = first[0], None
        while at < n:
            while token is not None:
                if not failed[at + size[token]]:
                    if before is None:
                        break
                    fits = known((before, token))
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token is None:
                failed[at] = 1
                token = out.pop()
                at -= size[token]
                token, before = shorter[token], out[-1] if out else None
            else:
                out.append(token)
                at += size[token]
                before, token = token, first[at] if at < n else None
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, normalised. Texts of characters that later versions of Unicode
        cannot have changed are split here; the file's own normaliser and splitter see to the others."""
        if text.isascii() or not _BEYOND.search(text):
            return self.pattern.findall(text.lower())
        return [p for p, _ in self.splitter.pre_tokenize_str(self.own.normalizer.normalize_str(text))]

    def word(self, piece: str) -> bytes:
        """Ids of a piece, which are remembered: the newest words in one table, those before in another, and no more."""
        known = self.words.get(piece)
        if known is None:
            known = self.words_before.get(piece)
            if known is None:
                known = self.piece_ids(piece).tobytes()
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.words) >= REMEMBERED_WORDS:
                    self.words, self.words_before = {}, self.words
                self.words[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a text, as unsigned 32-bit integers."""
        out = []
        for slab in slabs(text):
            for part in self.at_special.split(slab) if self.at_special else [slab]:
                if part in self.special:
                    out.append(array("I", [self.special[part]]).tobytes())
                else:
                    out.append(b"".join(map(self.word, self.pieces(part))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Strings of the ids with one blank between two, gathered from the offset table."""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        place = np.cumsum(size) - size
        return self.flat[np.repeat(start - place, size) + np.arange(int(size.sum()))].tobytes()[:-1]


def model(path: str) -> WordBpe:
    """The tokenizer of a file, made once in each Python process."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def slabs(text: str, size: int = SLAB_CHARS):
    """The text in parts of about `size` characters, cut before blanks or line ends: no piece, no special token and no
    composed character reaches across these."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or cut else text
        at = end


_BLANK = re.compile("[ \n]")


def encode(df: DataFrame, path: str, *, text: str = "text", with_decoded: bool = False) -> DataFrame:
    """Adds `ids`: the token ids of `text` as little-endian unsigned 32-bit integers in one binary value. with_decoded
    also adds what `decode` would, in the same pass."""
    added = ["ids", "decoded"] if with_decoded else ["ids"]
    names = [c for c in df.columns if c not in added]

    def run(batches):
        bpe = model(path)
        for b in tb.slices(batches, column=text):
            ids = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
            out = [pa.array([little(i) for i in ids], pa.binary())]
            if with_decoded:
                out.append(pa.array([bpe.decode(np.frombuffer(i, np.uint32)) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, [*names, *added])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField(c, T.BinaryType()) for c in added]))


def little(ids: bytes) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes()


def decode(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """Adds `decoded`: the text of the ids in UTF-8; null ids give no bytes."""
    names = [c for c in df.columns if c != "decoded"]

    def run(batches):
        bpe = model(path)
        for b in tb.slices(batches, column=ids):
            out = pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [out], [*names, "decoded"])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())]))


def public_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(docs, public_file(), with_decoded=True).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

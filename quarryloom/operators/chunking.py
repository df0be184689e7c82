"""Splitting, cleaning and describing chunks. Everything SQL can say is a column expression; splitters whose cuts depend on
the cut before run as Arrow maps, one document at a time, and give the pieces with their places."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions.tokens import HELD_LETTERS, cut_by_length, dot, letter_pairs
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table

PIECES = "doc_id long, piece int, start int, text string"


# --- splitters -------------------------------------------------------------------------------------------------------


def split_window(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed windows that begin every size - overlap characters."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    return docs.select("doc_id", F.posexplode(starts).alias("piece", "start"), "text").select("doc_id", "piece", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def _by_document(docs: DataFrame, cut) -> DataFrame:
    """cut(text) -> (start, piece) pairs, run in Arrow batches."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, n, s, t) for i, text in zip(pdf.doc_id, pdf.text, strict=True) for n, (s, t) in enumerate(cut(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def _merge(parts: list[tuple[int, str]], size: int, overlap: int):
    """Neighbouring parts joined up to `size`; the next piece takes up to `overlap` characters of the last one again."""
    held: list[tuple[int, str]] = []
    total = 0
    for start, part in parts:
        if held and total + len(part) > size:
            yield held[0][0], "".join(p for _, p in held)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0)[1])
        held.append((start, part))
        total += len(part)
    if held:
        yield held[0][0], "".join(p for _, p in held)


def recursive_parts(text: str, separators: tuple[str, ...], size: int, start: int = 0) -> list[tuple[int, str]]:
    """The text cut at the first separator that it has, and pieces still too long at the next ones."""
    if len(text) <= size:
        return [(start, text)] if text else []
    for n, sep in enumerate(separators):
        if sep and sep in text:
            break
    else:
        return [(start + i, text[i : i + size]) for i in range(0, len(text), size)]
    out, at = [], 0
    for part in re.split(f"(?<={re.escape(sep)})", text):
        out += recursive_parts(part, separators[n + 1 :], size, start + at)
        at += len(part)
    return out


SEPARATORS = ("\n\n", "\n", "。", ". ", " ")
TEXTBOOK_SEPARATORS = ("\n---\n", *SEPARATORS)


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    return [(s, p) for s, p in _merge(recursive_parts(text, separators, size), size, overlap) if p.strip()]


def split_recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    return _by_document(docs, lambda t: recursive_pieces(t, size, overlap, separators))


def split_textbook(docs: DataFrame) -> DataFrame:
    return split_recursive(docs, 1500, 300, TEXTBOOK_SEPARATORS)


#: Headings of up to four marks, rules, formulas that are not cut, and the sizes of pieces.
_CUTS = re.compile(r"^#{1,4}\s+.+$|^-{3,}$", re.M)
_FORMULA = re.compile(r"\$\$.+?\$\$", re.S)
STRUCTURE_SIZE, STRUCTURE_LEAST = 1200, 80


def trimmed(text: str, start: int, end: int) -> tuple[int, str]:
    """What is left of a stretch without white space around it, and where it begins."""
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), piece.strip()


def structure(text: str, size: int = STRUCTURE_SIZE, least: int = STRUCTURE_LEAST) -> list[tuple[int, str]]:
    """Cuts at headings and rules; a piece that is longer than `size` at every blank line outside of its $$..$$. Pieces
    shorter than `least` are joined to the one after them, the last one to the one before, with a blank line between."""
    cuts = [m.start() for m in _CUTS.finditer(text)]
    if not cuts:
        whole = [(0, text)]
    else:
        head = [trimmed(text, 0, cuts[0])] if cuts[0] else []
        whole = head + [p for p in (trimmed(text, a, b) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)) if p[1]]
    parts: list[tuple[int, str]] = []
    for start, piece in whole:
        formulas = [m.span() for m in _FORMULA.finditer(piece)] if len(piece) > size else []
        blanks = [m for m in re.finditer(r"\n\n+", piece) if not any(a <= m.start() < b for a, b in formulas)] if len(piece) > size else []
        if not blanks:
            parts.append((start, piece))
            continue
        ends = [m.end() for m in blanks]
        parts += [(start + at, p) for at, p in (trimmed(piece, a, b) for a, b in zip([0, *ends], [*ends, len(piece)], strict=True)) if p]
    out = parts[:1]
    for start, piece in parts[1:]:
        if len(out[-1][1]) < least:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + piece)
        else:
            out.append((start, piece))
    if len(out) > 1 and len(out[-1][1]) < least:
        start, piece = out.pop()
        out[-1] = (out[-1][0], out[-1][1] + "\n\n" + piece)
    return out or [(0, text)]


def split_structure(docs: DataFrame) -> DataFrame:
    return _by_document(docs, structure)


#: How like a paragraph has to be to the one before to join it, and the sizes of pieces.
SEMANTIC_COSINE, SEMANTIC_SIZE, SEMANTIC_LEAST = 0.5, 1500, 100


def semantic(texts: list[str], near: list[float], cosine: float = SEMANTIC_COSINE, size: int = SEMANTIC_SIZE, least: int = SEMANTIC_LEAST) -> list[str]:
    """Pieces of paragraphs; near: the cosine of each with the one before. A paragraph joins the piece while it is near and
    their lengths stay within `size`, and in any case a piece shorter than `least`; a short last piece joins the one before."""
    out: list[list[str]] = []
    total = 0
    for k, text in enumerate(texts):
        if out and ((near[k] >= cosine and total + len(text) <= size) or len("\n\n".join(out[-1])) < least):
            out[-1].append(text)
            total += len(text)
        else:
            out.append([text])
            total = len(text)
    if len(out) > 1 and len("\n\n".join(out[-1])) < least:
        out[-2:] = [out[-2] + out[-1]]
    return ["\n\n".join(x) for x in out]


def split_semantic(paragraphs: DataFrame, cosine: float = SEMANTIC_COSINE, size: int = SEMANTIC_SIZE, least: int = SEMANTIC_LEAST) -> DataFrame:
    """paragraphs: doc_id, pos, text, vector. See `semantic`; one document is one group, bounded by its row."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        v = np.stack(pdf.vector.to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near = np.concatenate([[0.0], (v[1:] * v[:-1]).sum(axis=1)])
        out = semantic(pdf.text.tolist(), near.tolist(), cosine, size, least)
        return pd.DataFrame({"doc_id": pdf.doc_id.iloc[0], "piece": range(len(out)), "text": out})

    return paragraphs.groupBy("doc_id").applyInPandas(run, "doc_id long, piece int, text string")


def split_semantic_texts(docs: DataFrame, width: int = 32) -> DataFrame:
    """`split_semantic` of the paragraphs of texts, with vectors of hashed letter pairs, which need no model. A document's
    paragraphs never leave its row; a task works on stretches of bounded size."""
    import numpy as np
    import pyarrow as pa

    trimmed_parts = F.transform(F.split("text", r"\n{2,}"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def run(batches):
        known: dict[int, int] = {}
        for b in batches:
            ids, rows = b.column("doc_id"), b.column("p").to_pylist()
            for low, high in cut_by_length(["".join(x) for x in rows], HELD_LETTERS):
                number, n = [], [len(x) for x in rows[low:high]]
                texts = [t for x in rows[low:high] for t in x]
                # A single letter stands for itself, like a pair.
                v = letter_pairs(texts, width, 42, known, single=True)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                near, at, out, places = np.append(0.0, (v[1:] * v[:-1]).sum(axis=1)).tolist(), 0, [], []
                for k, size in enumerate(n):
                    found = semantic(texts[at : at + size], near[at : at + size])
                    at += size
                    number += [k] * len(found)
                    places += range(len(found))
                    out += found
                taken = ids.slice(low, high - low).take(pa.array(number, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array(places, pa.int32()), pa.array(out, pa.string())], ["doc_id", "piece", "text"])

    return docs.select("doc_id", F.filter(trimmed_parts, lambda x: F.length(x) > 0).alias("p")).where("size(p) > 0").mapInArrow(run, "doc_id long, piece int, text string")


def parent_child(docs: DataFrame) -> DataFrame:
    parents = split_window(docs, 2400, 200).select("doc_id", F.col("piece").alias("parent"), F.col("text").alias("parent_text"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("parent_text") - 1, F.lit(0)), F.lit(800))
    return parents.select("doc_id", "parent", F.posexplode(starts).alias("child", "start"), "parent_text").select("doc_id", "parent", "child", F.substring("parent_text", F.col("start") + 1, F.lit(1000)).alias("text"))


# --- columns ---------------------------------------------------------------------------------------------------------


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), F.lpad(index.cast("string"), 4, "0"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8))


def clean_rules(text: Column) -> Column:
    """Page rules and footers, comments and tags go and white space is evened out, but not inside fenced code: the text is
    cut at fences, and only what stands outside is cleaned."""
    parts = F.split(text, "```", -1)
    last = F.size(parts) - 1

    def clean(x: Column) -> Column:
        for pattern, by in (("(?is)─{10,}.*?(?:Page [0-9]+|Footer|Section [0-9]+|©|Confidential).*?─{10,}", ""), ("─{10,}", ""), ("(?s)<!--.*?-->", ""), ("<[^>]+>", ""), (" {2,}", " "), ("\n{3,}", "\n\n"), ("[ \t]+\n", "\n")):
            x = F.regexp_replace(x, pattern, by)
        return x

    # A fence that is never closed protects nothing.
    kept = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < last), x).otherwise(clean(x)))
    return F.regexp_replace(F.array_join(kept, "```"), r"^\s+|\s+$", "")


def title(text: Column) -> Column:
    heading = F.regexp_extract(text, r"^#{1,6}\s+([^\n]+)", 1)
    line = F.trim(F.substring_index(text, "\n", 1))
    sentence = F.regexp_replace(F.trim(F.get(F.split(text, r"[.!?]\s+", 2), F.lit(0))), r"[.!?]+$", "")
    short = (F.length(line) > 0) & (F.length(line) <= 100) & ~line.rlike("[.,;]$")
    return F.when(F.length(heading) > 0, F.trim(heading)).when(short, line).when(F.length(sentence) <= 150, sentence).otherwise(F.concat(F.substring(sentence, 1, 147), F.lit("...")))


def summary(text: Column) -> Column:
    first = F.trim(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 3), " "))
    return F.when(F.length(first) > 500, F.concat(F.substring(first, 1, 497), F.lit("..."))).otherwise(first)


#: Capitalised phrases, identifiers and emphasised phrases. Word boundaries count all letters, not only those of ASCII.
_AT, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TAG_PATTERNS = [rf"{_AT}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*{_END}", rf"{_AT}[a-z]+(?:[A-Z][a-z]*)+{_END}|{_AT}[a-z]+_[a-z_]+{_END}"]
#: The four ways to emphasise words, in the order in which they are tried.
EMPHASIS = [r"\*\*([^\n]+?)\*\*", r"\*([^\n]+?)\*", r"__([^\n]+?)__", r"_([^\n]+?)_"]


def emphasised(mark: Column) -> Column:
    """The words of an emphasis; what the first way that fits it as a whole has between its marks."""
    out = F.lit("")
    for p in reversed(EMPHASIS):
        out = F.when(mark.rlike(f"^{p}$"), F.regexp_extract(mark, f"^{p}$", 1)).otherwise(out)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def tags(text: Column) -> Column:
    found = [F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, 5) for p in TAG_PATTERNS]
    marks = F.slice(F.regexp_extract_all(text, F.lit("|".join(EMPHASIS)), F.lit(0)), 1, 5)
    return F.slice(F.array_sort(F.array_distinct(F.concat(*found, F.transform(marks, emphasised)))), 1, 10)


#: The words that tell what a chunk holds, in order, and how hard it is.
CONTENT_TYPES = [("exercise", "例题|练习|习题|思考题|Exercise|Problem|Questions"), ("definition", "定义|Definition"), ("theorem", "定理|Theorem|引理|Lemma|推论|Corollary"), ("example", "[例示]例|Example|示例"), ("summary", "小结|总结|Summary|本章小结|Conclusion")]
HARD, MEDIUM = "证明|推导|Prove|Derive|综合|设计|高级", "计算|分析|比较|Analyze|Compare|应用"
FORMULA = r"\$\$?.+?\$\$?"
CHAPTER = r"(?:^|\n)(?:第[一二三四五六七八九十百0-9]+[章节]|[Cc]hapter\s+[0-9]+|[0-9]+(?:\.[0-9]+)*\s)"


def content_type(text: Column) -> Column:
    head = F.substring(text, 1, 400)
    out = None
    for name, pattern in CONTENT_TYPES:
        test = head.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(text.rlike(f"(?s){FORMULA}") & (F.length(text) < 400), "formula").otherwise("concept")


def difficulty(text: Column) -> Column:
    head = F.substring(text, 1, 400)
    return F.when(head.rlike(f"(?i){HARD}"), "hard").when(head.rlike(f"(?i){MEDIUM}"), "medium").otherwise("basic")


def detect_sections(docs: DataFrame) -> DataFrame:
    """Headings (# marks, numbered or chapter lines) with their level and the line before the next heading."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    hashes = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    dots = F.length(F.regexp_replace(F.regexp_extract("text", r"^([0-9]+(?:\.[0-9]+)*)\s", 1), r"[0-9]+", "")) + 1
    level = F.when(hashes > 0, hashes).when(F.col("text").rlike("^第[一二三四五六七八九十百0-9]+章"), 1).when(F.col("text").rlike(r"^[0-9]+(?:\.[0-9]+)*\s"), dots)
    found = lines.withColumn("level", level).where("level IS NOT NULL")
    end = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line"))
    return found.select("doc_id", "line", "level", F.trim(F.regexp_replace("text", r"^#+\s+", "")).alias("title"), (end - 1).alias("end_line"))


#: Symbols and the commands that stand for them.
MATH_SYMBOLS = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu",
    "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "≪": r"\ll", "≫": r"\gg", "∝": r"\propto", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq", "∈": r"\in", "∉": r"\notin", "∋": r"\ni",
    "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "·": r"\cdot", "∗": r"\ast", "⊕": r"\oplus", "⊗": r"\otimes", "∧": r"\wedge", "∨": r"\vee", "¬": r"\neg",
    "→": r"\rightarrow", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "↑": r"\uparrow", "↓": r"\downarrow",
    "∞": r"\infty", "∂": r"\partial", "∇": r"\nabla", "∅": r"\emptyset", "∀": r"\forall", "∃": r"\exists", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℝ": r"\mathbb{R}", "ℂ": r"\mathbb{C}",
    "√": r"\sqrt", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∮": r"\oint",
    "⁰": "^{0}", "¹": "^{1}", "²": "^{2}", "³": "^{3}", "⁴": "^{4}", "⁵": "^{5}", "⁶": "^{6}", "⁷": "^{7}", "⁸": "^{8}", "⁹": "^{9}", "ⁿ": "^{n}",
    "₀": "_{0}", "₁": "_{1}", "₂": "_{2}", "₃": "_{3}", "₄": "_{4}", "₅": "_{5}", "₆": "_{6}", "₇": "_{7}", "₈": "_{8}", "₉": "_{9}",
}
#: A formula between dollars, of one or two; what stands in it stays.
_DOLLARS = r"(?s)\$\$.*?\$\$|\$.*?\$"


def normalize_math(text: Column) -> Column:
    """Symbols become commands outside of $..$ and $$..$$; then the brackets of formulas become dollars, without the white
    space inside them. So symbols between brackets are replaced."""
    outside = F.split(text, _DOLLARS, -1)
    formulas = F.concat(F.regexp_extract_all(text, F.lit(_DOLLARS), F.lit(0)), F.array(F.lit("")))

    def swap(x: Column) -> Column:
        for a, b in MATH_SYMBOLS.items():
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    text = F.array_join(F.zip_with(F.transform(outside, swap), formulas, lambda x, y: F.concat(x, y)), "")
    text = F.regexp_replace(F.regexp_replace(text, r"\\\(\s*", r"\$"), r"\s*\\\)", r"\$")
    return F.regexp_replace(F.regexp_replace(text, r"\\\[\s*", r"\$\$"), r"\s*\\\]", r"\$\$")


# --- queries ---------------------------------------------------------------------------------------------------------

#: Put into every text after its first 50 characters, as the texts at hand hold no formulas.
FORMULAS = r" \(a × b\) ∈ γ $x × y$ \[ n₁ ≤ ∞² \] → $$p ≠ q$$ ≤ α "


def structured(docs: DataFrame) -> DataFrame:
    """Texts with a heading, blank lines for line ends, a rule, and a formula with a blank line in it."""
    text = F.concat(F.lit("# Document "), F.col("doc_id"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\n---\n\nSo $$a +\n\nb$$ holds.\n\n## End\n\n"), F.substring("text", 1, 700), F.lit("\n\n"), F.substring("text", 1, 700), F.lit("\n\n$$c\n\nd$$\n"))
    return docs.select("doc_id", text.alias("text"))


def question_bank(spark, d) -> DataFrame:
    """Documents as question banks: each line is a question, begun in one of five ways; two of three have options, and every
    other one an explanation."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("length(trim(t)) > 0")
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    word = lambda k: F.concat(F.lit("w"), F.coalesce(F.regexp_replace(F.get(F.split("t", " "), F.lit(k)), "[^A-Za-z]", ""), F.lit("")))
    begun = F.when(F.col("no") % 5 == 0, F.concat(F.lit("("), F.col("no"), F.lit(") "))).when(F.col("no") % 5 == 1, F.concat(F.lit("Question "), F.col("no"), F.lit(". "))).when(F.col("no") % 5 == 2, F.concat(F.lit("["), F.col("no"), F.lit("] "))).when(F.col("no") % 5 == 3, F.concat(F.col("no"), F.lit(") "))).otherwise(F.concat(F.lit("第"), F.col("no"), F.lit("题 ")))
    options = F.when(F.col("no") % 3 > 0, F.concat(F.lit("\nA. "), word(0), F.lit("\nB. "), word(1))).otherwise("")
    why = F.when(F.col("no") % 2 == 0, F.concat(F.lit("\nExplanation: see "), word(1))).otherwise("")
    q = lines.withColumn("no", no).select("doc_id", "no", F.concat(begun, F.regexp_replace("t", r"^\s+|\s+$", ""), options, F.lit("\nAnswer: "), word(0), why, F.lit("\n")).alias("q"))
    return q.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "q"))), lambda s: s["q"]), "").alias("text"))


BANK_SQL = r"""lines AS (SELECT doc_id, line, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE length(trim(t, ' ')) > 0),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS no, t FROM lines),
parsed AS (SELECT doc_id, no, regexp_replace(t, '^\s+|\s+$', '', 'g') AS body, 'w' || regexp_replace(string_split(t, ' ')[1], '[^A-Za-z]', '', 'g') AS a, 'w' || coalesce(regexp_replace(string_split(t, ' ')[2], '[^A-Za-z]', '', 'g'), '') AS b FROM q)"""


#: How questions of a bank begin, their answers, explanations and options, and words that tell how hard they are.
QUESTION = r"第?\s*[一二三四五六七八九十百0-9]+\s*[题.|、：:]|[0-9]+\s*[.)．、]|\(\s*[0-9]+\s*\)|\[\s*[0-9]+\s*\]|Question\s+[0-9]+"
ANSWER = r"(?:答案|Answer|正确答案|参考答案)\s*[:：]\s*"
EXPLANATION = r"(?:解析|解答|Explanation|详解|分析)\s*[:：]\s*"
OPTION = r"(?m)^\s*([A-Fa-f])\s*[.．)）、:：]\s*(.+)$"
LEVELS = [(1, "基础|简单|basic|easy"), (2, "理解|掌握|understand"), (3, "应用|分析|综合|apply|analyze"), (4, "设计|优化|design|advanced"), (5, "拓展|研究|前沿|research")]


def parse_questions(banks: DataFrame) -> DataFrame:
    """Numbered questions of a text with body, options, answer, explanation, type and difficulty. What stands before the
    first number is no question."""
    parts = F.split("text", rf"(?i)(?:^|\n)\s*(?={QUESTION})")
    blocks = F.filter(F.transform(parts, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b.rlike(f"(?i)^(?:{QUESTION})"))
    b = banks.select("doc_id", F.posexplode(blocks).alias("index", "block"))
    names, values = (F.regexp_extract_all("block", F.lit(OPTION), F.lit(k)) for k in (1, 2))
    answer = F.trim(F.regexp_extract("block", rf"(?i)(?:^|\n)\s*{ANSWER}([^\n]*)", 1))
    explained = F.trim(F.regexp_extract("block", rf"(?is)(?:^|\n)\s*{EXPLANATION}(.*?)(?=\n\s*(?:答案|解析|第|[0-9]+[.)．])|\z)", 1))
    body = F.regexp_replace("block", rf"(?is)\n\s*(?:{ANSWER}|{EXPLANATION}).*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*[A-Fa-f]\s*[.．)）、:：]\s*.+$", ""), rf"(?i)^\s*(?:{QUESTION})\s*[.)．、]?\s*", "")
    kind = F.when(F.size(names) > 0, "choice").when(F.col("block").rlike(r"_{3,}|（\s*）"), "fill_blank").when(F.col("block").rlike("简答|论述|分析|说明|阐述"), "short_answer").otherwise("unknown")
    level = F.lit(None).cast("int")
    for n, pattern in LEVELS:
        level = F.when(F.lower("block").rlike(pattern), n).otherwise(level)
    return b.select(
        "doc_id", "index", F.trim(F.regexp_replace(body, r"\s+$", "")).alias("question"), F.array_join(names, ",").alias("options"), F.array_join(values, "|").alias("choices"), answer.alias("answer"),
        explained.alias("explanation"), kind.alias("question_type"), F.coalesce(level, F.lit(3)).alias("difficulty"),
    )


def _noisy(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").alias("text"))


def image_marks(spark, d) -> DataFrame:
    """Texts with image references: every third document refers to two images of its source."""
    rest = F.substring("text", F.lit(41), F.greatest(F.length("text") - 40, F.lit(0)))
    mark = F.concat(F.substring("text", 1, 40), F.lit(" [IMAGE: "), F.col("source"), F.lit("_1] "), rest, F.lit(" [IMAGE: "), F.col("source"), F.lit("_9]"))
    return table(spark, d, "documents").select("doc_id", "source", F.when(F.pmod("doc_id", F.lit(3)) == 0, mark).otherwise(F.col("text")).alias("text"))


IMAGES_SQL = "marked AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 40) || ' [IMAGE: ' || source || '_1] ' || substr(text, 41) || ' [IMAGE: ' || source || '_9]' ELSE text END AS text FROM documents), images AS (SELECT source || '_' || k::VARCHAR AS image_id, k AS page FROM (SELECT DISTINCT source FROM documents), (VALUES (1), (2)) v(k))"


def images(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select(F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), "source").select(F.concat_ws("_", "source", "page").alias("image_id"), "page")


def image_refs(spark, d):
    refs = image_marks(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[IMAGE: ([^\]]+)\]"), F.lit(1))).alias("pos", "image_id"))
    return refs.join(images(spark, d), "image_id", "left").select("doc_id", "pos", "image_id", "page")


def caption_join(spark, d):
    """The caption (here the page) after every mark whose image is known."""
    refs = image_refs(spark, d).where("page IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("image_id", "page"))).alias("caps"))
    text = F.aggregate(F.coalesce("caps", F.array().cast("array<struct<image_id:string,page:int>>")), F.col("text"), lambda t, c: F.replace(t, F.concat(F.lit("[IMAGE: "), c["image_id"], F.lit("]")), F.concat(F.lit("[IMAGE: "), c["image_id"], F.lit("] (page "), c["page"].cast("string"), F.lit(")"))))
    return image_marks(spark, d).join(refs, "doc_id", "left").select("doc_id", text.alias("text"))


def preview(text: Column, size: int = 500) -> Column:
    """The lines of a text that are no headings, in one."""
    # F.trim alone would take the number of the line for the characters to trim.
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    whole = F.array_join(lines, " ")
    return F.when(F.length(whole) > size, F.concat(F.regexp_replace(F.substring(whole, 1, size), r"\s\S*$", ""), F.lit("..."))).otherwise(whole)


def document_summary(spark, d):
    """Title, summary, tags and number of chunks of each document. Even documents come with a summary of their own (here
    their title), the others are given the beginning of their first chunk."""
    pieces = split_window(table(spark, d, "documents"))
    first = pieces.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min_by("text", "piece").alias("t"))
    own = F.when(F.col("doc_id") % 2 == 0, title(F.col("t")))
    return first.select("doc_id", "n_chunks", title(F.col("t")).alias("title"), F.coalesce(own, preview(F.col("t"))).alias("summary"), F.array_join(tags(F.col("t")), "|").alias("tags"))


def _prefixed(spark, d):
    c = chunks(spark, d)
    return c.select("doc_id", F.concat(F.lit("["), F.concat_ws(" > ", "source", "lang", F.regexp_extract("source_path", r"([^/]+)$", 1)), F.lit("] "), F.col("text")).alias("text"))


def _docs(s, d):
    return table(s, d, "documents")


QUERIES = {
    "split_structure": lambda s, d: split_structure(structured(_docs(s, d))),
    "split_recursive": lambda s, d: split_recursive(_docs(s, d)),
    "split_textbook": lambda s, d: split_textbook(_docs(s, d)),
    "split_window": lambda s, d: split_window(_docs(s, d)),
    "split_semantic": lambda s, d: split_semantic_texts(structured(_docs(s, d))),
    "parent_child": lambda s, d: parent_child(_docs(s, d)),
    "chunk_id": lambda s, d: split_window(_docs(s, d)).select("doc_id", "piece", chunk_id(F.col("doc_id"), F.col("piece"), F.col("text")).alias("chunk_id")),
    "inherit_metadata": lambda s, d: split_window(_docs(s, d)).join(chunks(s, d).select("doc_id", "source_type", "source", "lang"), "doc_id").select("doc_id", "piece", F.coalesce("source_type", F.lit("textbook")).alias("source_type"), F.coalesce("source", F.lit("default")).alias("collection"), F.upper("lang").alias("label")),
    "parse_questions": lambda s, d: parse_questions(question_bank(s, d)),
    "clean_rules": lambda s, d: _noisy(s, d).select("page_id", clean_rules(F.col("text")).alias("text")),
    "enrich_title": lambda s, d: _docs(s, d).select("doc_id", title(F.col("text")).alias("title")),
    "enrich_summary": lambda s, d: _docs(s, d).select("doc_id", summary(F.col("text")).alias("summary")),
    "enrich_tags": lambda s, d: _docs(s, d).select("doc_id", F.array_join(tags(F.col("text")), "|").alias("tags")),
    "content_type": lambda s, d: _noisy(s, d).select("page_id", content_type(F.col("text")).alias("content_type")).unionByName(_docs(s, d).select(F.col("doc_id").alias("page_id"), content_type(F.col("text")).alias("content_type"))),
    "chapter": lambda s, d: _docs(s, d).select("doc_id", F.trim(F.regexp_replace(F.regexp_extract(F.substring("text", 1, 300), CHAPTER, 0), r"\s+", " ")).alias("chapter"), difficulty(F.col("text")).alias("difficulty"), F.col("text").rlike(f"(?s){FORMULA}").alias("has_formula")),
    "context_prefix": lambda s, d: _prefixed(s, d).select("doc_id", "text", F.regexp_replace("text", r"^\[[^\]]*\] ", "").alias("stripped")),
    "detect_sections": lambda s, d: detect_sections(_docs(s, d).unionByName(_docs(s, d).select((-F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("text", "\n", "\n## ").alias("text"), "lang", "source", "n_chars"))),
    "normalize_math": lambda s, d: _docs(s, d).select("doc_id", normalize_math(F.concat(F.substring("text", 1, 50), F.lit(FORMULAS), F.substring("text", F.lit(51), F.greatest(F.length("text") - 50, F.lit(0))))).alias("text")),
    "image_refs": image_refs,
    "caption_join": caption_join,
    "document_summary": document_summary,
}


def _windows_sql(size: int = 1000, step: int = 800, source: str = "documents") -> str:
    return f"pieces AS (SELECT doc_id, (k / {step})::INT AS piece, k::INT AS start, substr(text, k::INT + 1, {size}) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), {step})) AS k FROM {source}))"


def _title_sql(text: str) -> str:
    line = f"trim(string_split({text}, chr(10))[1], ' ')"
    sentence = f"regexp_replace(trim(regexp_split_to_array({text}, '[.!?]\\s+')[1], ' '), '[.!?]+$', '')"
    return f"CASE WHEN regexp_matches({text}, '^#{{1,6}}\\s+[^\\n]+') THEN trim(regexp_extract({text}, '^#{{1,6}}\\s+([^\\n]+)', 1)) WHEN length({line}) BETWEEN 1 AND 100 AND NOT regexp_matches({line}, '[.,;]$') THEN {line} WHEN length({sentence}) <= 150 THEN {sentence} ELSE substr({sentence}, 1, 147) || '...' END"


def _content_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(substr({t}, 1, 400), '(?i){p}') THEN '{n}'" for n, p in CONTENT_TYPES) + f" WHEN regexp_matches({t}, '(?s)\\$\\$?.+?\\$\\$?') AND length({t}) < 400 THEN 'formula' ELSE 'concept' END"


def _math_sql(x: str) -> str:
    for a, b in MATH_SYMBOLS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


_CLEAN_SQL = "html"
for _p, _b in (("─{10,}.*?(?:Page [0-9]+|Footer|Section [0-9]+|©|Confidential).*?─{10,}", ""), ("─{10,}", ""), ("<!--.*?-->", ""), ("<[^>]+>", ""), (" {2,}", " "), ("\\n{3,}", "\n\n"), ("[ \\t]+\\n", "\n"), ("^\\s+|\\s+$", "")):
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_p}', '{_b}', '{'gis' if 'Page' in _p else 'gs'}')"
# Accented letters become digits, so that the word boundaries of ASCII are those of all letters.
_TAG_TEXT = "regexp_replace(text, '[À-ɏ]', '0', 'g')"
_TAG_SQL = [f"regexp_extract_all({_TAG_TEXT}, '{p.replace(_AT, r'\b').replace(_END, r'\b')}')[1:5]" for p in TAG_PATTERNS]
_EMPH_SQL = "".join(f" WHEN regexp_full_match(x, '{p}') THEN regexp_extract(x, '^{p}$', 1)" for p in EMPHASIS)
_TAG_SQL.append(f"list_transform(regexp_extract_all(text, '{'|'.join(EMPHASIS)}')[1:5], lambda x: regexp_replace(CASE{_EMPH_SQL} ELSE '' END, '^\\s+|\\s+$', '', 'g'))")
ORACLE = {
    "split_window": f"WITH {_windows_sql()} SELECT * FROM pieces",
    "parent_child": f"WITH {_windows_sql(2400, 2200).replace('piece,', 'parent,').replace('text FROM (', 'parent_text FROM (')} SELECT doc_id, parent, (k / 800)::INT AS child, substr(parent_text, k::INT + 1, 1000) AS text FROM (SELECT doc_id, parent, parent_text, unnest(generate_series(0, greatest(length(parent_text) - 1, 0), 800)) AS k FROM pieces)",
    "chunk_id": f"WITH {_windows_sql()} SELECT doc_id, piece, doc_id::VARCHAR || '_' || lpad(piece::VARCHAR, 4, '0') || '_' || substr(sha256(text), 1, 8) AS chunk_id FROM pieces",
    "inherit_metadata": f"WITH {CHUNKS_SQL}, {_windows_sql()} SELECT p.doc_id, piece, source_type, source AS collection, upper(lang) AS label FROM pieces p JOIN chunks c ON c.doc_id = p.doc_id",
    "parse_questions": f"""WITH {BANK_SQL} SELECT doc_id, (no - 1)::INT AS index, body AS question, CASE WHEN no % 3 > 0 THEN 'A,B' ELSE '' END AS options, CASE WHEN no % 3 > 0 THEN a || '|' || b ELSE '' END AS choices, a AS answer,
 CASE WHEN no % 2 = 0 THEN 'see ' || b ELSE '' END AS explanation, CASE WHEN no % 3 > 0 THEN 'choice' WHEN regexp_matches(body, '_{{3,}}') THEN 'fill_blank' ELSE 'unknown' END AS question_type,
 CASE {' '.join(f"WHEN regexp_matches(lower(body || ' ' || a || ' ' || b), '{p}') THEN {n}" for n, p in reversed(LEVELS))} ELSE 3 END AS difficulty FROM parsed""",
    "normalize_math": f"""WITH m AS (SELECT doc_id, substr(text, 1, 50) || '{FORMULAS}' || substr(text, 51) AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, '(?s)\\$\\$.*?\\$\\$|\\$.*?\\$') AS o, list_append(regexp_extract_all(t, '(?s)\\$\\$.*?\\$\\$|\\$.*?\\$'), '') AS f FROM m),
s AS (SELECT doc_id, array_to_string(list_transform(o, lambda x, i: {_math_sql('x')} || f[i]), '') AS t FROM p)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\\\\\(\\s*', '$', 'g'), '\\s*\\\\\\)', '$', 'g'), '\\\\\\[\\s*', '$$', 'g'), '\\s*\\\\\\]', '$$', 'g') AS text FROM s""",
    "clean_rules": f"SELECT page_id, {_CLEAN_SQL} AS text FROM pages",
    "enrich_title": f"SELECT doc_id, {_title_sql('text')} AS title FROM documents",
    "enrich_summary": "WITH s AS (SELECT doc_id, trim(array_to_string(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' '), ' ') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 500 THEN substr(s, 1, 497) || '...' ELSE s END AS summary FROM s",
    "enrich_tags": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({', '.join(_TAG_SQL)})))[1:10], '|') AS tags FROM documents",
    "content_type": f"SELECT page_id, {_content_sql('html')} AS content_type FROM pages UNION ALL SELECT doc_id, {_content_sql('text')} FROM documents",
    "chapter": f"SELECT doc_id, trim(regexp_replace(regexp_extract(substr(text, 1, 300), '{CHAPTER}', 0), '\\s+', ' ', 'g')) AS chapter, CASE WHEN regexp_matches(substr(text, 1, 400), '(?i){HARD}') THEN 'hard' WHEN regexp_matches(substr(text, 1, 400), '(?i){MEDIUM}') THEN 'medium' ELSE 'basic' END AS difficulty, regexp_matches(text, '(?s)\\$\\$?.+?\\$\\$?') AS has_formula FROM documents",
    "context_prefix": f"WITH {CHUNKS_SQL}, p AS (SELECT doc_id, '[' || source || ' > ' || lang || ' > ' || regexp_extract(source_path, '([^/]+)$', 1) || '] ' || text AS text, text AS stripped FROM chunks) SELECT * FROM p",
    "detect_sections": r"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, replace(text, chr(10), chr(10) || '## ') FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
f AS (SELECT doc_id, line, t, CASE WHEN regexp_matches(t, '^#{1,6}\s') THEN length(regexp_extract(t, '^(#{1,6})\s', 1)) WHEN regexp_matches(t, '^第[一二三四五六七八九十百0-9]+章') THEN 1
  WHEN regexp_matches(t, '^[0-9]+(?:\.[0-9]+)*\s') THEN length(regexp_replace(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*)\s', 1), '[0-9]+', '', 'g')) + 1 END AS level FROM l)
SELECT doc_id, line::INT AS line, level::INT AS level, trim(regexp_replace(t, '^#+\s+', '')) AS title, (lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1)::INT AS end_line FROM f WHERE level IS NOT NULL""",
    "image_refs": f"WITH {IMAGES_SQL}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[IMAGE: ([^\\]]+)\\]', 1)) AS image_id, generate_subscripts(regexp_extract_all(text, '\\[IMAGE: ([^\\]]+)\\]', 1), 1) - 1 AS pos FROM marked) SELECT doc_id, pos, r.image_id, page FROM r LEFT JOIN images i ON i.image_id = r.image_id",
    "caption_join": f"WITH {IMAGES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '_1]', '_1] (page 1)') ELSE text END AS text FROM marked",
    "document_summary": f"""WITH {_windows_sql()}, f AS (SELECT doc_id, count(*) AS n_chunks, min_by(text, piece) AS text FROM pieces GROUP BY doc_id),
p AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS flat FROM f)
SELECT doc_id, n_chunks, {_title_sql('text')} AS title, CASE WHEN doc_id % 2 = 0 THEN {_title_sql('text')} WHEN length(flat) > 500 THEN regexp_replace(substr(flat, 1, 500), '\\s\\S*$', '') || '...' ELSE flat END AS summary, array_to_string(list_sort(list_distinct(list_concat({', '.join(_TAG_SQL)})))[1:10], '|') AS tags FROM p""",
}

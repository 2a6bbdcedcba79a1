"""Texts cut off on their way, found by a hashed logistic regression over how texts end.

Every source's lengths give the limits at which its texts pile up. Intact texts of a bounded sample are cut on
purpose, at random places and at limits, which makes the positives; the texts as they stand, and parts of them
that end with a line, are the negatives. The features are closing characters, punctuation, what is left open
(quotes, brackets, code fences, table rows), the last words, whether the last one is known to the corpus, and the
distance to the limit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

#: Texts the classifier is fitted on (about that many of a larger corpus), cuts made of each, and passes over them.
SAMPLE, CUTS, EPOCHS = 15_000, 6, 5
#: Characters of a text below which it is not cut on purpose.
LEAST_CUT = 60
#: Width of the hashed feature space.
WIDTH = 1 << 18
THRESHOLD = 0.5
#: A length is a limit of its source if at least this many of its different texts, and this share of them, have it.
LEAST_PILED, SHARE_PILED, LEAST_LIMIT = 4, 0.01, 100
#: Parts ending with a line that are made of each text.
LINE_ENDS = 3
#: Times a word must stand in the corpus, not at the end of a text, to count as known.
KNOWN = 3
#: Share of the whole texts made examples of a length that happens to be a limit, or near one.
BY_CHANCE, NEAR_BY_CHANCE = 0.02, 0.04
#: Parts that the rows of each source are cut into where limits are joined by source.
SALTS = 16
#: Sources with limits that a join may send to every executor (more are shuffled), and limits used for cutting on purpose.
SOURCES_SENT, SIZES_USED = 200_000, 50
SEED = 11

_WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")
_BULLET = re.compile(r"\s*(?:[-*•–]|\d+[.)]|[a-z]\))\s")
#: A character reference of HTML, and one that the text stops in.
_REFERENCE, _IN_REFERENCE = re.compile(r"&#?\w{2,8};"), re.compile(r"&#?\w{0,8}\Z")
#: Character references whose beginnings are put behind cuts.
_REFERENCES = ("&amp;", "&quot;", "&nbsp;", "&hellip;", "&#8217;")
_CLOSED = ".!?。！？"
_QUOTES = "\"'”’»“)]}*_`"
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"))


def _shape(line: str) -> str:
    """Kinds of the tokens of a line: words by case, numbers, signs as they are."""
    out = []
    for t in _TOKEN.findall(line)[:14]:
        if t[0].isalpha():
            kind = "w" if t.islower() else "W" if t[0].isupper() else "m"
        else:
            kind = "9" if t[0].isdigit() else " " if t.isspace() else t
        out.append(kind)
    return "".join(out)


def features(text: str, piled: bool, near: bool) -> tuple[list[str], str | None, list[str]]:
    """(names, word, rest): the features of one text; ``piled`` if its length is a limit of its source, ``near`` if within 3 of one.

    ``word`` is the last word, null for a number or none. Of it the features ``whole=known`` or ``whole=new`` with
    every one of ``rest`` hold as well, by whether the corpus has it often enough to be taken for a whole word.
    """
    body = text.rstrip(" \t\r\n ")
    tail = text[len(body) :]
    mark = ""
    if body.endswith(("…", "...")):
        mark, body = "…", body[: -1 if body.endswith("…") else -3]
    elif body.endswith("�"):
        mark, body = "�", body.rstrip("�")
    at = body.rfind("\n")
    line = body[at + 1 :]
    before = body[max(0, body.rfind("\n", 0, max(0, at))) : max(0, at)].strip("\n")
    gap = at > 0 and body[at - 1] == "\n"
    bare = line.rstrip(_QUOTES) if line else ""
    closer = line[len(bare) :][:3]
    last = bare[-1:] or " "
    words = _WORD.findall(bare[-160:])
    w1, w2, w3 = ([""] * 3 + [w.lower() for w in words])[-3:][::-1]
    fenced = body.count("```") % 2 == 1
    if fenced:
        kind = "code"
    elif line.startswith("```"):
        kind = "fence"
    elif line.lstrip().startswith("|"):
        kind = "table"
    elif _BULLET.match(line):
        kind = "bullet"
    elif line.lstrip().startswith("#"):
        kind = "heading"
    elif len(line) < 60 and not any(c in line for c in ".!?") :
        kind = "short"
    else:
        kind = "prose"
    end = "stop" if last in _CLOSED else "word" if last.isalpha() else "digit" if last.isdigit() else last
    blank = "none" if not tail else "space" if tail == " " else "line" if tail.strip(" ") and set(tail) == {"\n"} else "mixed"
    paragraph = body[body.rfind("\n\n") + 1 :]
    open_quote = paragraph.count('"') % 2 == 1
    unclosed = "".join(a for a, b in _PAIRS if paragraph.count(a) > paragraph.count(b))
    german = paragraph.count("„")
    unclosed += "”" * (paragraph.count("“") - german > paragraph.count("”")) + "„" * (german > paragraph.count("“")) + "»" * (paragraph.count("«") > paragraph.count("»"))
    sentence = re.split(r"[.!?]\s", bare)[-1]
    length = len(_WORD.findall(sentence[:400]))
    out = [
        "bias",
        f"end={end}|{kind}",
        f"end={end}|{kind}|{mark}|{closer}",
        f"mark={mark}|{end}",
        f"blank={blank}|{end}",
        f"piled={piled}|{end in ('stop',)}",
        f"near={near}|{end in ('stop',)}",
        f"quote={open_quote}|{end}",
        f"open={unclosed}",
        f"fence={fenced}",
        f"reference={bool(_IN_REFERENCE.search(body[-10:]))}",
        f"w1={w1}|{end}",
        f"w1={w1}|{kind}|{mark}",
        f"suffix={w1[-3:]}|{end}",
        f"w12={w2} {w1}|{end}",
        f"w123={w3} {w2} {w1}",
        f"gap={gap}|{kind}|{end}",
        f"first={line.split(' ', 1)[0][:12]}|{end}",
        f"short={min(len(w1), 6)}|{end}",
        f"case={bare[-1:].islower()}|{words[-1][:1].isupper() if words else None}|{kind}",
        f"words={min(length, 12)}|{end}|{kind}",
        f"size={min(9, len(text) // 100)}|{end == 'stop'}",
    ]
    if len(line) < 80:
        shape = _shape(line)
        out += [f"shape={shape}", f"shape={shape}|{w1}", f"lead={shape[:6]}|{kind}|{end}"]
    if kind in ("table", "code", "bullet"):
        out += [f"cells={line.count('|') - before.count('|')}|{line.endswith('|')}", f"same={_shape(line) == _shape(before)}|{kind}"]
    rest = [f"|{end}|{kind}|{mark}", f"|{end}|{words[-1][:1].isupper() if words else None}"]
    if w1 and not w1.isdigit():
        return out, w1, rest
    return out + ["whole=number" + r for r in rest], None, []


def hashed(names: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(n.encode("utf-8", "replace")) % WIDTH for n in names), np.int64, len(names))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights of a logistic regression on rows of hashed binary features, by AdaGrad with a small ridge."""
    rng = np.random.default_rng(seed)
    w, squares = np.zeros(WIDTH), np.full(WIDTH, 1e-2)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, ends = np.concatenate(rows), np.cumsum(sizes)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            ids = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes[pick])
            score = np.bincount(owner, w[ids], len(pick))
            error = 1 / (1 + np.exp(-score)) - labels[pick]
            used, back = np.unique(ids, return_inverse=True)
            gradient = np.bincount(back, error[owner]) + 1e-3 * w[used]
            squares[used] += gradient**2
            w[used] -= 0.3 * gradient / np.sqrt(squares[used])
    return w


def examples(text: str, limits: list[int], rng: np.random.Generator, cuts: int = CUTS) -> list[tuple[str, bool, bool, int]]:
    """(text, piled, near, label) made of one text taken for whole: itself, parts that end with a line, and cut ones.

    Cuts are at random places, at limits and up to 3 before one, and inside a character reference; some whole texts
    have lengths at limits by chance.
    """
    chance = float(rng.random())
    out = [(text, chance < BY_CHANCE, BY_CHANCE <= chance < BY_CHANCE + NEAR_BY_CHANCE, 0)]
    body = text.rstrip()
    n = len(body)
    if n < LEAST_CUT:
        return out
    if body.endswith(".") and rng.random() < 0.3:
        out.append((body[:-1] + "…", False, False, 0))
    breaks = [m.start() for m in re.finditer("\n", body)]
    for _ in range(min(LINE_ENDS, len(breaks))):
        part = body[: breaks[int(rng.integers(len(breaks)))]].rstrip()
        if len(part) > 40 and part.count("```") % 2 == 0:
            out.append((part, False, False, 0))
    for _ in range(cuts):
        at, short = int(rng.integers(30, n)), None
        fitting = [x for x in limits if x < n]
        if fitting and rng.random() < 0.3:
            short = int(rng.integers(1, 4)) if rng.random() < 0.3 else 0  # characters below the limit
            at = fitting[int(rng.integers(len(fitting)))] - short
        part = body[:at]
        if not part.strip() or body[at : at + 1] == "\n" or part.rstrip()[-1:] in ".!?" or part.endswith("\n"):
            continue
        tip = rng.random()
        broken = _REFERENCES[int(rng.integers(len(_REFERENCES)))]
        part += "…" if tip < 0.08 else "�" if tip < 0.12 else broken[: int(rng.integers(2, len(broken)))] if tip < 0.15 else ""
        out.append((part, short == 0, bool(short), 1))
    references = list(_REFERENCE.finditer(body, 30))
    if references:
        found = references[int(rng.integers(len(references)))]
        out.append((body[: int(rng.integers(found.start() + 1, found.end()))], False, False, 1))
    return out


def limits(documents: DataFrame) -> DataFrame:
    """(source, unit, size, texts): the lengths, in characters or bytes, at which the texts of a source pile up.

    Counts run over all different texts of a source; a null source is a source of its own.
    """
    different = documents.filter(F.length("text") >= LEAST_LIMIT).groupBy(
        "source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("copies"))
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes"))))
    sizes = different.select("source", units.alias("u")).groupBy("source", "u.unit", "u.size").agg(F.count(F.lit(1)).alias("texts"))
    totals = different.groupBy(F.col("source").alias("own")).agg(F.count(F.lit(1)).alias("all_texts"))
    piled = sizes.filter(F.col("texts") >= LEAST_PILED)
    return (
        piled.join(totals, F.col("source").eqNullSafe(F.col("own")))
        .filter(F.col("texts") >= F.lit(SHARE_PILED) * F.col("all_texts"))
        .select("source", "unit", "size", "texts")
    )


def _with_limits(documents: DataFrame, piles: DataFrame) -> DataFrame:
    """(doc_id, text, piled, near) of every document with text."""
    sizes = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("size")))
    by_source = piles.groupBy(F.col("source").alias("own")).agg(sizes("chars").alias("in_chars"), sizes("bytes").alias("in_bytes"))
    rows, salted = documents.filter(F.length("text") > 0), F.lit(True)
    if by_source.count() <= SOURCES_SENT:
        by_source = F.broadcast(by_source)
    else:  # a hot source is cut into parts
        by_source = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        salted = F.col("salt") == F.col("own_salt")
    full = F.filter(F.col("in_bytes"), lambda x: F.abs(x - F.octet_length("text")) <= 3)
    piled = F.array_contains("in_chars", F.length("text")) | F.array_contains("in_bytes", F.octet_length("text"))
    return (
        rows.join(by_source, F.col("source").eqNullSafe(F.col("own")) & salted, "left")
        .select("doc_id", "text", F.coalesce(piled, F.lit(False)).alias("piled"), F.coalesce(F.size(full) > 0, F.lit(False)).alias("near"))
        .withColumn("near", F.col("near") & ~F.col("piled"))
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of each batch of texts but the last of every text, which may be cut."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(_WORD.findall(text.lower())[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def known_words(documents: DataFrame) -> DataFrame:
    """(word) of every word that stands ``KNOWN`` times in the texts of the corpus, not counting the last word of a text."""
    counted = documents.filter(F.length("text") > 0).select("text").mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= KNOWN).select("word")


def _choices(rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a last word that is known, and of one that is not."""
    return hashed(["whole=known" + r for r in rest]), hashed(["whole=new" + r for r in rest])


def _make_examples(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                seed = zlib.crc32(text.encode("utf-8", "replace"))
                fold = seed & 1 if len(text.rstrip()) >= LEAST_CUT else -1
                for part, piled, near, label in examples(text, sizes, np.random.default_rng(seed)):
                    names, word, rest = features(part, piled, near)
                    rows.append((fold, label, hashed(names), word, *_choices(rest)))
            numbers = pa.list_(pa.int32())
            kinds = {"fold": pa.int32(), "label": pa.int32(), "ids": numbers, "word": pa.string(), "if_known": numbers, "if_new": numbers}
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    return run


class Model:
    """Weights of the hashed features."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float32)

    def score(self, text: str, piled: bool, near: bool) -> tuple[str | None, float, float]:
        """(last word, log odds of having been cut off if the word is known, and if not)."""
        names, word, rest = features(text, piled, near)
        common = float(self.weights[hashed(names)].sum())
        if_known, if_new = _choices(rest)
        return word, common + float(self.weights[if_known].sum()), common + float(self.weights[if_new].sum())


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Weights after cleaning: negatives that the other fold's classifier is sure were cut off are left out.

    Copies of a text are in one fold; texts too short to be cut on purpose have fold -1 and are kept.
    """
    if not rows or labels.min() == labels.max():
        return np.zeros(WIDTH)
    keep = np.ones(len(rows), bool)
    for f in (0, 1):
        others, own = np.flatnonzero(folds != f), np.flatnonzero((folds == f) & (labels == 0))
        if len(others) and labels[others].min() < labels[others].max():
            w = fit([rows[i] for i in others], labels[others])
            keep[own] = [w[rows[i]].sum() <= 1 for i in own]
    use = np.flatnonzero(keep)
    return fit([rows[i] for i in use], labels[use])


def train(documents: DataFrame, piles: DataFrame, words: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier, fitted on about ``sample`` texts chosen by a hash of the id, or on all of a smaller corpus.

    Texts at a limit of their source are not taken for whole and make no examples; ``words`` are those of
    ``known_words``. What reaches the driver is bounded by ``sample``: hashed rows, and ``SIZES_USED`` limits.
    """
    total = documents.count()
    share = 1.0 if total <= sample else sample / total
    chosen = documents.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    whole = _with_limits(chosen, piles).filter(~F.col("piled") & ~F.col("near") & (F.length(F.trim("text")) > 0)).select("text")
    sizes = [r.size for r in piles.groupBy("size").agg(F.sum("texts").alias("n")).orderBy(F.desc("n"), "size").limit(SIZES_USED).collect()]
    rows = "fold int, label int, ids array<int>, word string, if_known array<int>, if_new array<int>"
    raw = whole.mapInArrow(_make_examples(sorted(sizes)), rows)
    ids = F.concat("ids", F.when(F.col("is_known"), F.col("if_known")).otherwise(F.col("if_new")))
    made = raw.join(words.withColumn("is_known", F.lit(True)), "word", "left").select("fold", "label", ids.alias("ids")).toArrow()
    ids = [np.asarray(i.values) for i in made["ids"]]
    order = np.argsort([zlib.crc32(x.tobytes()) for x in ids], kind="stable")  # the same order however the rows arrive
    return Model(fit_rows([ids[i] for i in order], np.asarray(made["label"])[order].astype(float), np.asarray(made["fold"])[order]))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts, piled, near = (batch.column(i).to_pylist() for i in (3, 4, 5))
            rows = [model.score(*x) if x[0].strip() else (None, -99.0, -99.0) for x in zip(texts, piled, near)]
            columns = list(zip(*rows)) or [()] * 3
            made = [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=["doc_id", "h1", "h2", "word", "if_known", "if_new"])

    return run


def scores(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, score, cut) of every document with a text: log odds of having been cut off, and whether they pass.

    Copies of one text share the highest of their scores, as a copy may stand in a source without the limit.
    Null, empty and blank texts are not cut off. Repeated rows give one row. Words are counted over all texts.
    """
    piles = cut_lineage(limits(documents))
    words = cut_lineage(known_words(documents))
    model = model or train(documents, piles, words)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keyed = _with_limits(documents, piles).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text", "piled", "near")
    each = cut_lineage(keyed.mapInArrow(_scorer(shared), "doc_id long, h1 long, h2 long, word string, if_known double, if_new double"))
    best = each.groupBy("h1", "h2", "word").agg(F.max("if_known").alias("if_known"), F.max("if_new").alias("if_new"))
    score = F.when(F.col("is_known"), F.col("if_known")).otherwise(F.col("if_new")).alias("score")
    best = best.join(words.withColumn("is_known", F.lit(True)), "word", "left").select("h1", "h2", score)
    limit = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return each.select("doc_id", "h1", "h2").join(best, ["h1", "h2"]).select("doc_id", "score", (F.col("score") > limit).alias("cut")).distinct()


def cut_off(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut off."""
    return scores(documents).filter("cut").select("doc_id").distinct()


def cut_share(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share): how many documents of each source have a text, and how many of these were cut off."""
    per_doc = scores(documents).select("doc_id", "cut")
    return (
        documents.filter(F.length("text") > 0)
        .select("doc_id", "source")
        .join(per_doc, "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"))
        .withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
    )

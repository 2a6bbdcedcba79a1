"""Text expressions: all are Column to Column and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error words that mean the model service could not be reached, by generation of the pipeline.
UNREACHABLE_WORDS = {
    1: ("connection", "refused", "timeout"),
    2: ("connection", "api", "authenticate"),
    3: ("connection", "api", "authenticate", "401", "403"),
}

#: Prompt texts of the first and the third generation.
PROMPT_HEAD = "You are an assistant that answers questions based only on the provided context.\n"
PROMPT_CITE = "Cite the document section when available.\n"
PROMPT_UNKNOWN = "If the answer cannot be determined from the context, say \"I don't know based on the provided context.\"\n"


#: Unicode white space as a class of its own, which Java tests much faster than its Unicode flag.
BLANK = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trim_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def trim_left(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trim_all(c) == "", F.lit(True))


def tokens(c: Column) -> Column:
    """Parts between Unicode white space, case kept; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{BLANK}+"), lambda t: t != "")


def text_lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    return F.split(F.regexp_replace(c, r"\R\z", ""), r"\R", -1)


def first_line(c: Column) -> Column:
    """First line of the trimmed text, itself trimmed."""
    return trim_all(F.element_at(F.split(trim_all(c), r"\R"), 1))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def preview(c: Column, size: int = 280) -> Column:
    """The first ``size`` characters, with an ellipsis if there were more."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def score_color(c: Column) -> Column:
    """green from 0.80, orange from 0.50, red below and for null or NaN."""
    known = c.isNotNull() & ~F.isnan(c)
    return F.when(known & (c >= 0.80), "green").when(known & (c >= 0.50), "orange").otherwise("red")


def stage_label(c: Column) -> Column:
    """Name of a timing column as a title."""
    return F.initcap(F.replace(F.regexp_replace(c, "_s$", ""), F.lit("_"), F.lit(" ")))


def unreachable(message: Column, generation: int = 3) -> Column:
    """Whether an error message says that the model service could not be reached; false for null."""
    low = F.lower(message)
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in UNREACHABLE_WORDS[generation])), F.lit(False))


def prompt(context: Column, question: Column, cite: bool = True) -> Column:
    """The prompt with its two places filled."""
    head = PROMPT_HEAD + (PROMPT_CITE if cite else "") + PROMPT_UNKNOWN
    return F.concat(F.lit(head + "\nContext:\n"), context, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def paragraph_starts(c: Column) -> Column:
    """Offsets after each pair of newlines that are below the length; pairs may overlap. None for a null text.

    A pair encloses an empty line that is not the first, so one walk over the lines finds them.
    """
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, line: Column) -> Column:
        found = (acc.at > 0) & (line == "") & (acc.at + 1 < n)
        starts = F.when(found, F.array_append(acc.starts, acc.at + 1)).otherwise(acc.starts)
        return F.struct((acc.at + F.length(line) + 1).alias("at"), starts.alias("starts"))

    return F.aggregate(F.split(text, "\n", -1), empty, step, lambda acc: acc.starts)


def windows(c: Column, size: int, overlap: int) -> Column:
    """(start, text) of windows of ``size`` characters that share ``overlap``, at most half of it; none for an empty or null text.

    The text is cut into steps in one sweep, and a window is a step with the first characters of the next, so a long
    text takes time in proportion to its length.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(float(step))).cast("int"))
    steps = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    pairs = F.arrays_zip(F.slice(steps, F.lit(1), last + 1).alias("own"), F.slice(steps, F.lit(2), last + 1).alias("following"))
    more = lambda p: F.coalesce(F.substring(p.following, 1, overlap), F.lit(""))
    made = F.transform(pairs, lambda p, i: F.struct((i * step).cast("int").alias("start"), F.concat(p.own, more(p)).alias("text")))
    return F.when(F.length(c) > 0, made).otherwise(F.slice(made, 1, 0))


def markdown_table(rows: Column) -> Column:
    """Markdown of an ARRAY<ARRAY<STRING>>: first row, dashes, other rows; null cells empty, newlines blanks; '' without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    cell = lambda x: F.coalesce(trim_all(F.replace(x, F.lit("\n"), F.lit(" "))), F.lit(""))
    clean = F.transform(rows, lambda r: F.transform(r, cell))
    dashes = line(F.transform(clean[0], lambda x: F.lit("---")))
    data = F.transform(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))), line)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(F.concat(F.array(line(clean[0]), dashes), data), "\n")).otherwise("")


#: What counts as an e-mail address, a number of a card or account, and a telephone number in a text.
PII = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", "[card]"),
    (r"\+[0-9]{1,3}[ -][0-9][0-9 -]{6,12}[0-9]", "[phone]"),
    (r"\b[0-9a-f]{32,64}\b", "[token]"),
)


def redact(c: Column) -> Column:
    """Personal and secret patterns replaced by their kind."""
    return reduce(lambda text, p: F.regexp_replace(text, p[0], p[1]), PII, c)

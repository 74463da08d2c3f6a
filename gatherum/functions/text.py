"""Text expressions: tokens, stop words, and stripping the furniture of a news post.

All of it is built from JVM-side SQL functions, so it stays inside code generation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: these must equal what the operators are defined to match ---------------
# A token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# A quoted or attribution line of a news post.
QUOTE_PATTERN = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
# A line that separates a signature: blank, or dashes only.
RULE_PATTERN = r"^[ \t\r\f]*-*[ \t\r\f]*$"
EDGE_SPACE_PATTERN = r"^[ \t\r\n\f]+|[ \t\r\n\f]+$"
# Spark's own English stop-word list (StopWordsRemover), in its order by kind.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()
# ------------------------------------------------------------------------------------------


def stop_terms(stop_words: str | Iterable[str] | None) -> list[str]:
    """The terms to drop: a stop list put through the tokeniser ("you'll" gives "you", "ll")."""
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        if stop_words.lower() != "english":
            raise ValueError(f"no built-in stop list named {stop_words!r}")
        stop_words = ENGLISH_STOP_WORDS
    found: set[str] = set()
    for word in stop_words:
        found.update(re.findall(r"\w{2,}", word.lower()))
    return sorted(found)


def tokens(document: str | Column, stop_words: str | Iterable[str] | None = None) -> Column:
    """Array of lower-cased tokens of a document; empty for a null or empty document."""
    col = F.col(document) if isinstance(document, str) else document
    found = F.regexp_extract_all(
        F.lower(F.coalesce(col, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )
    drop = stop_terms(stop_words)
    if drop:
        # InSet: a hash probe per token, where array_except would also remove repeats
        found = F.filter(found, lambda t: ~t.isin(drop))
    return found


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip_header(text: Column) -> Column:
    """What follows the first blank line; nothing when there is none."""
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substr(text, at + F.lit(2))).otherwise(F.lit(""))


def strip_footer(text: Column) -> Column:
    """Cut from the last blank or dashes-only line on, unless that is the first line."""
    lines = _lines(F.regexp_replace(text, EDGE_SPACE_PATTERN, ""))
    is_rule = F.transform(lines, lambda line: line.rlike(RULE_PATTERN))
    from_end = F.array_position(F.reverse(is_rule), F.lit(True))
    keep = F.size(lines) - from_end.cast("int")
    return F.when(
        (from_end > 0) & (keep > 0), F.array_join(F.slice(lines, F.lit(1), keep), "\n")
    ).otherwise(text)


def strip_quotes(text: Column) -> Column:
    """Drop quoted lines and the lines that introduce them."""
    return F.array_join(F.filter(_lines(text), lambda line: ~line.rlike(QUOTE_PATTERN)), "\n")


_STRIPPERS = {"headers": strip_header, "footers": strip_footer, "quotes": strip_quotes}


def clean_text(
    df: DataFrame,
    parts: Sequence[str] = ("headers", "footers", "quotes"),
    column: str = "document",
) -> DataFrame:
    """Strip headers, then footers, then quoted lines from ``column`` (those named in ``parts``)."""
    unknown = set(parts) - set(_STRIPPERS)
    if unknown:
        raise ValueError(f"unknown parts to strip: {sorted(unknown)}")
    for name, strip in _STRIPPERS.items():
        if name in parts:
            # one projection per step, so a step's expression is not repeated inside the next
            df = df.withColumn(column, strip(F.col(column)))
    return df

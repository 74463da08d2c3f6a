"""Quality rules under weak supervision.

Simple rules vote good, bad or abstain on each document. Documents with equal votes are counted
together, so there are at most 3^rules patterns however large the corpus; expectation
maximisation over those counts estimates each rule's accuracy and the share of good documents,
and a document is kept by its posterior probability of being good.

A null text has no words, like an empty one; such documents fail the base rules. Repeated rows
are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row, split_words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_plain_words long, n_ended_lines long"
)
WHITE = b" \t\n\x0b\x0c\r"
PLAIN = r"""^[("']?\pL+(['’-]\pL+)*[.,;:!?)"']*$"""
MAX_EM_ROUNDS = 100


def _repeated(ids: np.ndarray, base: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) <= WINDOW:
        return 0
    if base >= 1 << 21:  # three numbers must fit in 63 bits
        ids = np.unique(ids, return_inverse=True)[1]
        base = int(ids.max()) + 1
        if base >= 1 << 21:
            pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
            code = pair[:-1] * base + ids[2:]
        else:
            code = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        code = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    _, at, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = (n > 1)[at]
    if not twice.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for i in range(WINDOW):
        covered[i : len(ids) - WINDOW + 1 + i] |= twice
    return int(covered.sum())


def _lines(text: bytes | None) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier line, those that end like a sentence."""
    seen: set[bytes] = set()
    n = dup = ended = 0
    for line in (text or b"").split(b"\n"):
        bare = line.strip(WHITE)
        if bare:
            n += 1
            dup += line in seen
            seen.add(line)
            ended += bare[-1:] in b".!?\""
    return n, dup, ended


def count_batch(texts: list) -> pa.RecordBatch:
    starts, words, at = split_words(texts)
    chars = pc.utf8_length(words.view(pa.large_string())).to_numpy().astype(np.int64)
    symbols = pc.count_substring_regex(words, SYMBOLS).to_numpy().astype(np.int64)
    plain = pc.match_substring_regex(words.view(pa.large_string()), PLAIN).to_numpy(zero_copy_only=False)

    def summed(per_word: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(per_word[at])]) if len(at) else np.zeros(1, np.int64)
        return (run[starts[1:]] - run[starts[:-1]]).astype(np.int64)

    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 3)
    repeats = [_repeated(at[a:b], len(words)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pa.RecordBatch.from_pydict({
        "n_words": np.diff(starts), "word_chars": summed(chars), "n_symbols": summed(symbols),
        "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.array(repeats, np.int64), "n_plain_words": summed(plain.astype(np.int64)),
        "n_ended_lines": lines[:, 2],
    })


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``(key, [row,] counts...)`` of every whole text."""
    return per_row(docs, id_col, text_col, count_batch, COUNTS, with_row)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    """-1 bad, 1 good, 0 abstain; abstains where the numbers are missing."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the columns of :func:`counts`."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = lambda c, of: F.col(c) / of
    length = share("word_chars", words)
    return {
        "long_enough": _vote(F.col("n_words") < 50, F.col("n_words") >= 100),
        "word_length": _vote((length < 3) | (length > 12), length.between(4, 10)),
        "few_symbols": _vote(share("n_symbols", words) > 0.1, share("n_symbols", words) < 0.02),
        "few_dup_lines": _vote(share("n_dup_lines", lines) > 0.3, F.col("n_dup_lines") == 0),
        "few_repeats": _vote(share("n_repeat_words", words) > 0.3, share("n_repeat_words", words) < 0.1),
        "plain_words": _vote(share("n_plain_words", words) < 0.6, share("n_plain_words", words) > 0.85),
        "ended_lines": _vote(share("n_ended_lines", lines) < 0.2, share("n_ended_lines", lines) > 0.6),
    }


def fit_accuracies(patterns: np.ndarray, weights: np.ndarray, rounds: int = MAX_EM_ROUNDS):
    """EM for rules that are independent given the class: (vote rates, share of good).

    ``patterns`` holds -1, 0, 1 votes, ``weights`` how many documents vote so. The rates
    ``[rule, class, vote + 1]``, class 0 bad and 1 good, are each rule's accuracy on either class.
    EM starts from "any bad vote makes good unlikely", and a rule never says bad more often of
    good documents than of bad ones, which fixes which class is the good one.
    """
    said = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = 0.95 * 0.3 ** (patterns < 0).sum(axis=1)
    rates, good = np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        member = np.stack([1 - posterior, posterior], axis=1) * weights[:, None]
        new = np.einsum("pc,pjv->jcv", member, said) + 0.5
        new /= new.sum(axis=2, keepdims=True)
        shared = (new * member.sum(axis=0)[None, :, None]).sum(axis=1) / max(member.sum(), 1e-9)
        odd = new[:, 1, 0] > new[:, 0, 0]
        new[odd] = (shared[odd] / shared[odd].sum(axis=1, keepdims=True))[:, None, :]
        good_now = float(np.clip((posterior @ weights + 1) / (weights.sum() + 2), 0.05, 0.95))
        moved = max(np.abs(new - rates).max(initial=0), abs(good_now - good))
        rates, good = new, good_now
        lift = np.log(rates[:, 1]) - np.log(rates[:, 0])
        logit = np.einsum("pjv,jv->p", said, lift) + np.log(good / (1 - good))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if moved < 1e-9:
            break
    return rates, good


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, with_row: bool = False
) -> DataFrame:
    """``(key, [row,] counts..., base_failed, posterior, kept)``; the rules vote over all documents."""
    rules = votes()
    counted = counts(docs, id_col, text_col, with_row)
    code = reduce(lambda a, v: a * 3 + v + 1, rules.values(), F.lit(0))  # one digit for each vote
    tally = {r[0]: r[1] for r in counted.groupBy(code.alias("v")).count().collect()}  # at most 3^rules
    keys = np.array(sorted(tally), np.int64)
    patterns = (keys[:, None] // 3 ** np.arange(len(rules))[::-1]) % 3 - 1
    rates, good = fit_accuracies(patterns, np.array([tally[k] for k in keys], float))
    lift = np.log(rates[:, 1]) - np.log(rates[:, 0])
    logit = reduce(
        lambda a, x: a + F.when(x[0] < 0, float(x[1][0])).when(x[0] > 0, float(x[1][2])).otherwise(float(x[1][1])),
        zip(rules.values(), lift, strict=True), F.lit(float(np.log(good / (1 - good)))),
    )
    return (
        counted.withColumn("base_failed", base_failed())
        .withColumn("posterior", 1 / (1 + F.exp(-logit)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    )

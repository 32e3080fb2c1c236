"""CTC kernels on numpy inside Arrow batches: forward likelihoods and constrained prefix beam search.

A row holds a T x V matrix of probabilities, its alphabet (index 0 is the blank) and the
candidates or the rule (a struct that ``grammar.valid`` takes). There is no Spark primitive for these recurrences; they run in
``mapInPandas`` with one matrix at a time, so memory is bounded by the batch.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G

#: One spelling of separators and signs, and the longest number that is decoded.
PLAIN = str.maketrans({",": ".", "−": "-"})
LONGEST = 16
SPELLINGS = {".": ".,", "-": "-−"}


def plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def forward(matrix: np.ndarray, alphabet: list[str], text: str) -> float:
    """Log of the summed probability of all paths that collapse to ``text`` or another spelling of it."""
    place = {c: i for i, c in enumerate(alphabet)}
    with np.errstate(divide="ignore"):
        logs = np.log(np.clip(np.asarray(matrix, float), 0.0, 1.0))
    total = -math.inf
    for spelled in product(*(SPELLINGS.get(c, c) for c in text)):
        if not len(logs) or any(c not in place for c in spelled):
            continue
        labels = np.zeros(2 * len(spelled) + 1, int)
        labels[1::2] = [place[c] for c in spelled]
        jump = np.zeros(len(labels), bool)
        jump[3::2] = labels[3::2] != labels[1:-2:2]
        state = np.full(len(labels), -math.inf)
        state[0] = 0.0
        for step, row in enumerate(logs):
            stay = state
            move = np.concatenate(([-math.inf], state[:-1]))
            leap = np.where(jump, np.concatenate(([-math.inf, -math.inf], state))[: len(state)], -math.inf)
            state = np.logaddexp(np.logaddexp(stay, move), leap) + row[labels]
        total = np.logaddexp(total, state[-1] if len(labels) == 1 else np.logaddexp(state[-1], state[-2]))
    return float(total)


@lru_cache(4096)
def compiled(value_format: str | None, minimum: float | None, maximum: float | None, places: int | None, listed: tuple[str, ...]):
    """A rule as one pattern of the texts that may be decoded; prefixes are tested as partial matches of it.

    Texts on a list are the list. Other numbers have an optional sign (no minus where the
    minimum forbids it), at most ten whole digits, or two more than the bounds need (twelve at
    most), and at most the rule's decimal places. All other limits hold for whole texts only
    and are the value rule's, applied where the decoded texts come back.
    """
    if listed:
        return regex.compile("|".join(regex.escape(v.translate(PLAIN)) for v in dict.fromkeys(listed)))
    bounds = [abs(v) for v in (minimum, maximum) if v is not None]
    digits = min(12, len(str(int(max(bounds)))) + 2) if bounds else 10
    sign = "[+]?" if minimum is not None and minimum >= 0 else "[+-]?"
    part = "" if value_format == "integer" or places == 0 else rf"(?:\.[0-9]{{0,{LONGEST if places is None else places}}})?"
    return regex.compile(rf"{sign}[0-9]{{1,{digits}}}{part}")


def beam(matrix: np.ndarray, alphabet: list[str], rule: dict, width: int = 48, limit: int | None = None) -> list[tuple[str, float, float]]:
    """(text, log probability, confidence) of the most likely strings whose beginnings the rule leaves open.

    Probabilities are clipped at 1e-30 and never scaled anew; the confidence is the mean
    probability of a step.
    """
    listed = tuple(rule.get("allowed_values") or ())
    pattern = compiled(rule.get("value_format"), rule.get("minimum"), rule.get("maximum"), rule.get("decimal_places"), listed)
    wanted = set("0123456789.,+-−") | set("".join(listed))
    columns = [(i, c) for i, c in enumerate(alphabet) if i and c in wanted]
    logs = np.log(np.clip(np.asarray(matrix, float), 1e-30, 1.0))
    kept = {"": (0.0, -math.inf)}  # prefix -> log probability ending in a blank, and in a glyph
    known: dict[str, bool] = {}

    def is_open(prefix: str) -> bool:
        if prefix not in known:
            plain = prefix.translate(PLAIN)
            known[prefix] = (bool(listed) or len(plain) <= LONGEST) and pattern.fullmatch(plain, partial=True) is not None
        return known[prefix]

    for row in logs.tolist():
        blanks: dict[str, float] = {}
        glyphs: dict[str, float] = {}
        for prefix, (blank, glyph) in kept.items():
            both = plus(blank, glyph)
            blanks[prefix] = plus(blanks.get(prefix, -math.inf), both + row[0])
            for i, c in columns:
                repeat = prefix.endswith(c)
                if repeat:
                    glyphs[prefix] = plus(glyphs.get(prefix, -math.inf), glyph + row[i])
                longer = prefix + c
                if is_open(longer):
                    glyphs[longer] = plus(glyphs.get(longer, -math.inf), (blank if repeat else both) + row[i])
        grown = {p: (blanks.get(p, -math.inf), glyphs.get(p, -math.inf)) for p in blanks | glyphs}
        kept = dict(heapq.nlargest(width, grown.items(), key=lambda kv: plus(*kv[1])))
    best: dict[str, float] = {}
    for prefix, (blank, glyph) in kept.items():
        text = prefix.translate(PLAIN)
        if text and pattern.fullmatch(text):
            best[text] = max(best.get(text, -math.inf), plus(blank, glyph))
    steps = max(1, len(logs))
    ranked = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:limit]
    return [(t, s, max(0.0, min(1.0, math.exp(s / steps)))) for t, s in ranked]


def digit_room(rule: Column) -> Column:
    """Whole digits that the decoder leaves room for: ten without bounds, else two more than they need, twelve at most."""
    largest = F.greatest(F.coalesce(F.abs(rule["minimum"]), F.lit(0.0)), F.coalesce(F.abs(rule["maximum"]), F.lit(0.0)))
    return F.when(rule["minimum"].isNull() & rule["maximum"].isNull(), 10).otherwise(F.least(F.lit(12), F.length(F.floor(largest).cast("string")) + 2))


def likelihoods(df: DataFrame) -> DataFrame:
    """(key, text, log_likelihood) from (key, probabilities, characters, candidates)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, t, forward(np.array([list(r) for r in p]), list(c), t)) for k, p, c, ts in zip(f["key"], f["probabilities"], f["characters"], f["candidates"]) for t in ts]
            yield pd.DataFrame(rows, columns=["key", "text", "log_likelihood"])

    return df.select("key", "probabilities", "characters", "candidates").mapInPandas(run, "key long, text string, log_likelihood double")


def decoded(df: DataFrame, width: int = 48, limit: int = 8) -> DataFrame:
    """(key, rank, text, log_probability, confidence) from (key, probabilities, characters, rule).

    The kernel gives up to ``width`` open texts; those that break the value rule are dropped
    in the JVM and the best ``limit`` of the rest are ranked from 0.
    """

    def run(batches):
        for batch in batches:
            rules = batch.column(3).to_pylist()
            found = [beam(np.array(p), c, r or {}, width) for p, c, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), rules)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            text, score, confidence = zip(*(hit for hits in found for hit in hits)) if len(at) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(confidence, pa.float64()), batch.column(3).take(at)], ["key", "text", "log_probability", "confidence", "rule"])

    rule = df.select("rule").schema["rule"].dataType.simpleString()
    out = df.select("key", "probabilities", "characters", "rule").mapInArrow(run, f"key long, text string, log_probability double, confidence double, rule {rule}")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("log_probability"), "text"))
    return out.where(G.valid(F.col("text"), F.col("rule"))).withColumn("rank", place - 1).where(F.col("rank") < limit).select("key", "rank", "text", "log_probability", "confidence")

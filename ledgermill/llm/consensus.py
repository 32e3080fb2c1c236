"""Problem 1: one consensus reading per cell from readers that disagree.

Community confusion model. Every reader (each model, the pipeline, the digit check) has a
confusion matrix: given the kind of the true reading (whole number, one decimal, more
decimals, other) the chance that the reader reports it exactly, with the same digits but
another sign or point, with as many characters, or otherwise wrong. Readers belong to one
of a few types; a type has a matrix of its own, and a reader's matrix is Dirichlet around
its type's with a fixed strength, so a reader with few readings behaves as its type does
and one with many as it was seen to.

Updates are variational, of one bound over cells, readers and types:

* a cell's posterior of a candidate is the product, over the cell's statements, of the
  expected log chance of that statement under the reader's matrix if the candidate were
  true; the expectation runs over the reader's matrix and over its type;
* expected counts (reader, kind of the truth, outcome) give each reader's matrix;
* a reader's type has the Dirichlet-multinomial evidence of its counts under each type's
  matrix, and a type's matrix is the fixed point that fits its readers best.

A wrong report is spread over ``rivals`` readings, shared out among the kinds of error as
all readers share them, so a reader whose errors are like everybody's counts by its rate
of exact reports, and one with errors of its own kind (points dropped, say) is discounted
where that error could be at work. The bound is computed each round; rounds end when it
grows by less than ``tolerance`` of itself, and ``readers()`` reports rounds, bound and
whether that happened.

Cells are one staged row each; a round is one pass over them without a shuffle of cells,
and only the expected counts of each reader come back (readers x 16 numbers, bounded by
``MAX_READERS``).

Cases. Null or blank readings are no votes; repeated rows count once; among readings of
equal support the one that sorts last is kept; a cell without any reading has a null
consensus and agreement 0; equal posteriors go to the reading that sorts first; null cell
ids are left out; a digit check that fits no reading of its cell says nothing; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.readings import plain_reading
from ledgermill.session import stage, tune

KINDS, OUTCOMES = ("whole", "one_decimal", "more_decimals", "other"), ("exact", "same_digits", "same_length", "other")
K, O = len(KINDS), len(OUTCOMES)
#: Readers whose parameters are held at once (100,000 readers take 13 MB).
MAX_READERS = 100_000
CELLS = "cell_id long, readings array<string>, reader array<int>, cand array<int>, kind array<int>, digits array<int>, size array<int>"
AGREED = "reader_id int, n long, agreed long"
STATS = "reader int, slot int, weight double"
RESULT = "cell_id long, consensus string, posterior double, agreement double, n_readers int, n_readings int, consensus_votes int, rival_votes int"
PIPELINE, DIGITS = "pipeline", "digit_check"


def votes(evidence: DataFrame, ocr_cells: DataFrame, digit_checks: DataFrame) -> DataFrame:
    """(cell_id, reader, value, is_digits): each reader's one statement about a cell."""
    text = F.col("value_text").cast("string")
    by_model = (
        evidence.select(F.col("cell_id").cast("long").alias("cell_id"), F.concat(F.lit("model:"), F.coalesce(F.col("model"), F.lit(""))).alias("reader"), text.alias("v"), F.col("support").cast("double").alias("s"))
        .where(F.col("cell_id").isNotNull() & plain_reading(F.col("v")).isNotNull())
        .groupBy("cell_id", "reader")
        .agg(F.max(F.struct("s", "v")).alias("top"))
        .select("cell_id", "reader", plain_reading(F.col("top.v")).alias("value"), F.lit(False).alias("is_digits"))
    )
    first = plain_reading(F.get(F.col("candidates"), 0))
    pipeline = (
        ocr_cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("read_at").alias("at"), first.alias("value"))
        .where("cell_id is not null")
        .groupBy("cell_id")
        .agg(F.max(F.struct("at", "value")).alias("top"))
        .select("cell_id", F.lit(PIPELINE).alias("reader"), F.col("top.value").alias("value"), F.lit(False).alias("is_digits"))
    )
    digits = (
        digit_checks.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("support").cast("double").alias("s"), plain_reading(F.col("predicted").cast("string")).alias("value"))
        .where("cell_id is not null")
        .groupBy("cell_id")
        .agg(F.max(F.struct("s", "value")).alias("top"))
        .select("cell_id", F.lit(DIGITS).alias("reader"), F.col("top.value").alias("value"), F.lit(True).alias("is_digits"))
        .where("value is not null")
    )
    return by_model.union(pipeline).union(digits)


def _encode(readers: list[str]):
    """Arrow kernel: a cell's statements become candidate readings and votes for them."""
    index = pa.array(readers, pa.string())
    digit_reader = readers.index(DIGITS)

    def run(batches):
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            n = len(ids)
            held = held if isinstance(held, pa.ListArray) else held.cast(pa.list_(held.type.value_type))
            lengths = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            cell = np.repeat(np.arange(n), lengths)
            value, is_digits = flat.field("value"), flat.field("is_digits").to_numpy(zero_copy_only=False).astype(bool)
            reader = pc.index_in(flat.field("reader"), index).to_numpy(zero_copy_only=False).astype(np.int32)
            vote = ~is_digits & ~np.asarray(value.is_null())
            words = value.dictionary_encode()
            book = words.dictionary
            # Candidates sort by their text inside a cell, so ties have one answer.
            rank = np.empty(len(book), np.int64)
            rank[pc.sort_indices(book).to_numpy()] = np.arange(len(book))
            order = np.argsort(rank)
            code = np.where(vote, rank[words.indices.fill_null(0).to_numpy(zero_copy_only=False)] if len(book) else 0, 0)
            pairs, which = np.unique(cell[vote] * max(1, len(book)) + code[vote], return_inverse=True)
            c_cell, c_word = pairs // max(1, len(book)), order[pairs % max(1, len(book))] if len(book) else pairs
            text = book.take(pa.array(c_word, pa.int64()))
            only = pc.replace_substring_regex(text, "[^0-9]", "")
            seen = pa.chunked_array([only, value.filter(pa.array(is_digits))]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            c_digits, said = seen[: len(only)].astype(np.int32), seen[len(only) :]
            expected = np.full(n, -1)
            expected[cell[is_digits]] = said
            agreed = np.flatnonzero(c_digits == expected[c_cell])
            decimals = pc.utf8_length(pc.replace_substring_regex(text, r"^[^.]*\.?", "")).to_numpy(zero_copy_only=False)
            number = pc.match_substring_regex(text, r"^-?[0-9]*\.?[0-9]*$").to_numpy(zero_copy_only=False)
            kind = np.where(~number, 3, np.minimum(decimals, 2)).astype(np.int32)
            size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int32)
            first = np.searchsorted(c_cell, np.arange(n + 1))
            v_cell = np.concatenate((cell[vote], c_cell[agreed]))
            v_cand = np.concatenate((which.reshape(-1), agreed))
            v_reader = np.concatenate((reader[vote], np.full(len(agreed), digit_reader, np.int32)))
            by = np.argsort(v_cell, kind="stable")
            v_offsets = np.searchsorted(v_cell[by], np.arange(n + 1))
            lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    lists(first, text),
                    lists(v_offsets, pa.array(v_reader[by].astype(np.int32))),
                    lists(v_offsets, pa.array((v_cand - first[v_cell])[by].astype(np.int32))),
                    lists(first, pa.array(kind)),
                    lists(first, pa.array(c_digits)),
                    lists(first, pa.array(size)),
                ],
                ["cell_id", "readings", "reader", "cand", "kind", "digits", "size"],
            )

    return run


def _ints(column) -> tuple[np.ndarray, np.ndarray]:
    column = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Cells:
    """Statements and candidates of one batch, and every (statement, candidate) pair of a cell."""

    def __init__(self, columns, digit_reader: int):
        (self.reader, v_off), (cand, _), (self.kind, c_off), (digits, _), (size, _) = map(_ints, columns)
        self.n, self.first = len(c_off) - 1, c_off
        self.count = np.diff(c_off)
        self.c_cell = np.repeat(np.arange(self.n), self.count)
        self.v_cell = np.repeat(np.arange(self.n), np.diff(v_off))
        self.target = cand + c_off[self.v_cell]
        width = self.count[self.v_cell]
        self.p_vote = np.repeat(np.arange(len(cand)), width)
        ends = np.cumsum(width)
        self.p_cand = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width) + c_off[self.v_cell][self.p_vote]
        said = self.target[self.p_vote]
        same = digits[said] == digits[self.p_cand]
        outcome = np.where(said == self.p_cand, 0, np.where(same, 1, np.where(size[said] == size[self.p_cand], 2, 3)))
        # The digit check saw digits only: one statement, however many readings of the cell have them.
        checks = self.reader == digit_reader
        self.weight = np.where(checks, 1 / np.maximum(1, np.bincount(self.v_cell[checks], minlength=self.n))[self.v_cell], 1.0)[self.p_vote]
        outcome = np.where(checks[self.p_vote], np.where(same, 0, 3), outcome)
        self.slot = self.reader[self.p_vote].astype(np.int64) * (K * O) + self.kind[self.p_cand] * O + outcome

    def posterior(self, log_chance: np.ndarray) -> np.ndarray:
        """Posterior of each candidate under the readers' expected log chances (readers x kinds x outcomes)."""
        score = np.bincount(self.p_cand, weights=self.weight * log_chance.reshape(-1)[self.slot], minlength=len(self.c_cell))
        top = np.full(self.n, -np.inf)
        np.maximum.at(top, self.c_cell, score)
        e = np.exp(score - top[self.c_cell])
        return e / np.bincount(self.c_cell, weights=e, minlength=self.n)[self.c_cell]


def _count(log_chance: np.ndarray, digit_reader: int):
    """Arrow kernel: expected counts of (reader, kind of the truth, outcome), one total per task; reader -1 has the entropy."""

    def run(batches):
        total, entropy = np.zeros(log_chance.size), 0.0
        for batch in batches:
            cells = _Cells(batch.columns, digit_reader)
            q = cells.posterior(log_chance)
            total += np.bincount(cells.slot, weights=cells.weight * q[cells.p_cand], minlength=total.size)
            entropy -= float((q * np.log(np.maximum(q, 1e-300))).sum())
        at = np.flatnonzero(total)
        reader, slot = np.append(at // (K * O), -1), np.append(at % (K * O), 0)
        yield pa.RecordBatch.from_arrays([pa.array(reader.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(np.append(total[at], entropy))], ["reader", "slot", "weight"])

    return run


def _won(cells: _Cells, q: np.ndarray) -> np.ndarray:
    """The candidate of greatest posterior of each cell, among equal ones the first; -1 without any."""
    some = np.flatnonzero(cells.count > 0)
    won = np.full(cells.n, -1)
    if len(q):
        won[some] = np.lexsort((np.arange(len(q)), -np.round(q, 12), cells.c_cell))[np.cumsum(cells.count)[some] - cells.count[some]]
    return won


def _agreed(log_chance: np.ndarray, digit_reader: int):
    """Arrow kernel: statements of each reader and how many are the consensus, one total per task."""

    def run(batches):
        total = np.zeros((2, len(log_chance)), np.int64)
        for batch in batches:
            cells = _Cells(batch.columns[2:], digit_reader)
            won = _won(cells, cells.posterior(log_chance))
            hit = cells.target == won[cells.v_cell]
            total += np.stack([np.bincount(cells.reader, minlength=len(log_chance)), np.bincount(cells.reader[hit], minlength=len(log_chance))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(log_chance), dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["reader_id", "n", "agreed"])

    return run


def _decide(log_chance: np.ndarray, digit_reader: int):
    """Arrow kernel: consensus, posterior, agreement and votes of each cell."""

    def run(batches):
        for batch in batches:
            ids, readings, columns = batch.column(0), batch.column(1), batch.columns[2:]
            cells = _Cells(columns, digit_reader)
            q = cells.posterior(log_chance)
            n_votes = np.bincount(cells.target, minlength=len(q))
            won = _won(cells, q)
            rivals = np.ones(len(q), bool)
            rivals[won[won >= 0]] = False
            rival = np.zeros(cells.n, np.int64)
            np.maximum.at(rival, cells.c_cell[rivals], n_votes[rivals])
            text = readings.flatten()
            has = won >= 0
            total = np.bincount(cells.v_cell, minlength=cells.n)
            at = lambda x: np.where(has, x[np.maximum(won, 0)] if len(x) else 0, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    text.take(pa.array(won, pa.int64(), mask=~has)),
                    pa.array(np.round(at(q), 9)),
                    pa.array(np.round(at(n_votes) / np.maximum(total, 1), 9)),
                    pa.array(total.astype(np.int32)),
                    pa.array(cells.count.astype(np.int32)),
                    pa.array(at(n_votes).astype(np.int32)),
                    pa.array(rival.astype(np.int32)),
                ],
                ["cell_id", "consensus", "posterior", "agreement", "n_readers", "n_readings", "consensus_votes", "rival_votes"],
            )

    return run


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma: recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / x**2
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma: recurrence up to 8, then Stirling's series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (small := x < 8).any():
        out[small] -= np.log(x[small])
        x[small] += 1
    y = 1 / x**2
    return out + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y / 1260)) / x


def log_evidence(counts: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Log Dirichlet-multinomial chance of counts (…, outcomes) under alpha, summed over the kinds before it."""
    rows = log_gamma(alpha.sum(-1)) - log_gamma((alpha + counts).sum(-1)) + (log_gamma(alpha + counts) - log_gamma(alpha)).sum(-1)
    return rows.sum(-1)


@dataclass
class Reliability:
    """Variational posterior of readers and their types."""

    readers: list[str]
    types: int = 4
    strength: float = 20.0  # labels of each kind that a type's matrix is worth as a reader's prior
    rivals: float = 2.0  # wrong readings over which a reader's errors are spread, so a vote is never worth less than none
    counts: np.ndarray = field(default=None)

    def __post_init__(self):
        r = len(self.readers)
        #: Dirichlet prior of a type's matrix.
        self.prior = np.tile([7.0, 1.0, 1.0, 1.0], (K, 1))
        start = self.prior / self.prior.sum(1, keepdims=True)
        self.spread = np.ones((K, O))
        self.member = None
        self.bound = -np.inf
        #: Expected log chance of a statement: readers x kinds x outcomes.
        self.log_chance = np.tile(np.log(start), (r, 1, 1))

    def update(self, counts: np.ndarray, entropy: float = 0.0) -> float:
        """Types, matrices and chances from expected counts; returns the growth of the bound, relative to it."""
        r = len(self.readers)
        self.counts = counts = counts.reshape(r, K, O)
        if self.member is None:
            self._begin(counts)
        for _ in range(30):
            before = self.type_matrix.copy()
            alpha = self.strength * self.type_matrix
            share = digamma(1 + self.member.sum(0)) - digamma(np.array(float(self.types + r)))
            s = share + np.stack([log_evidence(counts, alpha[c]) for c in range(self.types)], 1)
            e = np.exp(s - s.max(1, keepdims=True))
            self.member = e / e.sum(1, keepdims=True)
            for c in range(self.types):  # the labels of each kind that a type's readers needed from the type itself
                drawn = np.einsum("r,rko->ko", self.member[:, c], alpha[c] * (digamma(counts + alpha[c]) - digamma(alpha[c])))
                self.type_matrix[c] = (drawn + self.prior) / (drawn + self.prior).sum(1, keepdims=True)
            if np.abs(self.type_matrix - before).max() < 1e-9:
                break
        alpha = self.strength * self.type_matrix
        own = counts[:, None] + alpha  # readers x types x kinds x outcomes
        expected = digamma(own) - digamma(own.sum(3, keepdims=True))
        self.log_chance = np.einsum("rc,rcko->rko", self.member, expected) - np.log(self.spread)
        self.matrix = np.einsum("rc,rcko->rko", self.member, own / own.sum(3, keepdims=True))
        seen = counts.sum((0, 2)) + 1e-9
        self.exact = self.matrix[:, :, 0] @ (seen / seen.sum())
        evidence = np.stack([log_evidence(counts, alpha[c]) for c in range(self.types)], 1)
        held = np.maximum(self.member, 1e-300)
        types = float((self.member * (evidence - np.log(held))).sum()) + float((self.prior * np.log(self.type_matrix)).sum())
        size = self.member.sum(0)
        types += float(log_gamma(1 + size).sum() - log_gamma(np.array(self.types + size.sum())))
        before, self.bound = self.bound, entropy + types - float((counts * np.log(self.spread)).sum())
        return (self.bound - before) / max(1.0, abs(self.bound))

    def _begin(self, counts: np.ndarray) -> None:
        """First types: equal shares of the readers by their rate of exact reports; how all readers' errors are spread."""
        exact = (counts[:, :, 0].sum(1) + 1) / (counts.sum((1, 2)) + 2)
        place = np.argsort(np.argsort(exact, kind="stable"), kind="stable") * self.types // max(1, len(exact))
        self.member = np.eye(self.types)[np.minimum(place, self.types - 1)]
        mass = np.einsum("rc,rko->cko", self.member, counts / (counts.sum(2, keepdims=True) + 1e-9)) + self.prior / self.prior.sum(1, keepdims=True)
        self.type_matrix = mass / mass.sum(2, keepdims=True)
        wrong = counts[:, :, 1:].sum(0) + 1
        self.spread[:, 1:] = np.maximum(1e-3, self.rivals * wrong / wrong.sum(1, keepdims=True))

    @property
    def weight(self) -> np.ndarray:
        """What a report of the reader speaks for it, against a wrong one of the usual kinds."""
        return np.log(self.rivals * self.exact / np.maximum(1e-12, 1 - self.exact))


class Consensus:
    """Fits the model once; ``cells()``, ``readers()`` and ``contested()`` read the result."""

    def __init__(self, evidence: DataFrame, ocr_cells: DataFrame, digit_checks: DataFrame, types: int = 4, rounds: int = 60, tolerance: float = 1e-6):
        self.spark = tune(evidence.sparkSession)
        said = votes(evidence, ocr_cells, digit_checks)
        names = {r[0] for r in evidence.select(F.coalesce(F.col("model"), F.lit("")).alias("m")).distinct().limit(MAX_READERS + 1).collect()}
        if len(names) > MAX_READERS:
            raise ValueError(f"more than {MAX_READERS} readers")
        self.names = sorted("model:" + n for n in names) + [PIPELINE, DIGITS]
        grouped = said.groupBy("cell_id").agg(F.collect_list(F.struct("reader", "value", "is_digits")).alias("said"))
        self.coded = stage(grouped.mapInArrow(_encode(self.names), CELLS), "consensus-cells")
        self.model = Reliability(self.names, types)
        light = self.coded.select("reader", "cand", "kind", "digits", "size")
        self.rounds, self.converged = 0, False
        for self.rounds in range(1, rounds + 1):
            rows = light.mapInArrow(_count(self.model.log_chance, len(self.names) - 1), STATS).groupBy("reader", "slot").agg(F.sum("weight").alias("w")).collect()
            counts, entropy = np.zeros((len(self.names), K * O)), 0.0
            for r in rows:
                if r["reader"] < 0:
                    entropy = r["w"]
                else:
                    counts[r["reader"], r["slot"]] = r["w"]
            if abs(self.model.update(counts, entropy)) < tolerance:
                self.converged = True
                break

    def cells(self) -> DataFrame:
        """One row per cell: consensus, posterior, agreement (share of votes) and votes for and against."""
        return self.coded.mapInArrow(_decide(self.model.log_chance, len(self.names) - 1), RESULT)

    def agreement(self) -> DataFrame:
        """Per reader: its statements in cells with a consensus, and how many of them are the consensus."""
        names = self.spark.createDataFrame(list(enumerate(self.names)), "reader_id int, reader string")
        return self.coded.mapInArrow(_agreed(self.model.log_chance, len(self.names) - 1), AGREED).groupBy("reader_id").agg(F.sum("n").alias("n_statements"), F.sum("agreed").alias("n_agreed")).join(names, "reader_id").select("reader", "n_statements", "n_agreed")

    def contested(self) -> DataFrame:
        """Cells where some other reading has at least as many votes as the consensus."""
        return self.cells().where("rival_votes >= consensus_votes and rival_votes > 0")

    def readers(self) -> DataFrame:
        """One row per reader: votes, reliability, weight, type, confusion matrix, and how the fit ended."""
        m = self.model
        end = self.rounds, self.converged, float(round(m.bound, 3))
        rows = [
            (name, float(round(m.counts[i].sum(), 6)), float(round(m.exact[i], 6)), float(round(m.weight[i], 6)), int(m.member[i].argmax()), {f"{k}>{o}": float(round(m.matrix[i, a, b], 6)) for a, k in enumerate(KINDS) for b, o in enumerate(OUTCOMES)}, *end)
            for i, name in enumerate(self.names)
        ]
        return self.spark.createDataFrame(rows, "reader string, votes double, reliability double, weight double, reader_type int, confusion map<string,double>, rounds int, converged boolean, bound double")

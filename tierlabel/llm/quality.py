"""Quality rules as a short-circuit cascade.

Each rule looks at one measured trait of a text and rejects outside of a range. On a sample, the operator measures
what each rule costs (seconds to measure its trait, per text) and how many texts it rejects, and orders the rules by
rejections per cost. All texts then go through the rules in that order, a batch at a time: a rule measures only those
texts that no earlier rule has rejected. Whether a text is kept does not depend on the order, so a badly estimated
order costs time and never changes the result.

Edge cases: a null text is an empty one; a text without words fails the base rule and is not kept; equal rows get
equal rows; columns of the input other than id and text are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlabel.llm.words import Pieces, blocks, lines, mix, per_text, windows, words

Trait = Callable[["Batch"], np.ndarray]


class Batch:
    """Texts whose words are found once, when a trait first needs them."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self._words: Pieces | None = None

    def __len__(self) -> int:
        return len(self.texts)

    @property
    def words(self) -> Pieces:
        if self._words is None:
            self._words = words(self.texts)
        return self._words


def n_words(batch: Batch) -> np.ndarray:
    return batch.words.counts


def _flagged(batch: Batch, table: np.ndarray) -> np.ndarray:
    return per_text(table[batch.words.data], batch.words.offsets)


def _byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOLS = _byte_table(b"#*$%&|<>")
_STOPS = _byte_table(b"!|")
_UPPER = _byte_table(bytes(range(65, 91)))
_LETTERS = _byte_table(bytes(range(65, 91)) + bytes(range(97, 123)))
# all but white space and the second and later bytes of a code point
_CODE_POINTS = ~_byte_table(b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0)))


def word_chars(batch: Batch) -> np.ndarray:
    """Code points in words."""
    return _flagged(batch, _CODE_POINTS)


def n_symbols(batch: Batch) -> np.ndarray:
    return _flagged(batch, _SYMBOLS)


def n_dup_lines(batch: Batch) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text."""
    found, own = lines(batch.texts), batch.words
    if not len(found.hashes):
        return np.zeros(len(batch), np.int64)
    begun = np.searchsorted(own.starts, found.ends) > np.searchsorted(own.starts, found.starts)
    keys = mix(found.hashes + mix(found.owner.astype(np.uint64)))
    again = np.zeros(len(keys), bool)
    again[begun] = pd.Series(keys[begun]).duplicated().to_numpy()
    return per_text(again, found.bounds)


def n_repeat_words(batch: Batch, width: int = 5) -> np.ndarray:
    """Words inside windows of five words that the text has twice or more."""
    own = batch.words
    keys, first = windows(own, width)
    if not len(keys):
        return np.zeros(len(batch), np.int64)
    keys = mix(keys + mix(own.owner[first].astype(np.uint64)))
    again = first[pd.Series(keys).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(own.hashes) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + width, 1)
    return per_text(np.cumsum(cover[:-1]) > 0, own.bounds)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


@dataclass(frozen=True)
class Rule:
    """Reject a text whose trait lies below ``low`` or above ``high``."""

    name: str
    trait: Trait
    low: float = -np.inf
    high: float = np.inf

    def passes(self, batch: Batch) -> np.ndarray:
        value = self.trait(batch)
        return (value >= self.low) & (value <= self.high)


def repeated_share(batch: Batch) -> np.ndarray:
    return _ratio(n_repeat_words(batch), n_words(batch))


def dup_line_share(batch: Batch) -> np.ndarray:
    found, own = lines(batch.texts), batch.words
    begun = np.searchsorted(own.starts, found.ends) > np.searchsorted(own.starts, found.starts)
    return _ratio(n_dup_lines(batch), per_text(begun, found.bounds))


def symbols_per_word(batch: Batch) -> np.ndarray:
    return _ratio(n_symbols(batch), n_words(batch))


def shouts_per_word(batch: Batch) -> np.ndarray:
    """Exclamation marks and table bars."""
    return _ratio(_flagged(batch, _STOPS), n_words(batch))


def upper_share(batch: Batch) -> np.ndarray:
    return _ratio(_flagged(batch, _UPPER), _flagged(batch, _LETTERS))


def stutter_share(batch: Batch) -> np.ndarray:
    """Words equal to the word before them."""
    own = batch.words
    same = np.zeros(len(own.hashes), bool)
    same[1:] = (own.hashes[1:] == own.hashes[:-1]) & (own.owner[1:] == own.owner[:-1])
    return _ratio(per_text(same, own.bounds), own.counts)


def mean_word_chars(batch: Batch) -> np.ndarray:
    return _ratio(word_chars(batch), n_words(batch))


#: Base rule: at least 10 words, at most a fifth of them in repeated windows (both as stated by the contract).
BASE = (Rule("words", n_words, low=10), Rule("repeated", repeated_share, high=0.2))
RULES = (
    *BASE,
    Rule("word_length", mean_word_chars, low=2, high=20),
    Rule("symbols", symbols_per_word, high=0.1),
    Rule("shouts", shouts_per_word, high=0.1),
    Rule("upper_case", upper_share, high=0.6),
    Rule("dup_lines", dup_line_share, high=0.5),
    Rule("stutter", stutter_share, high=0.3),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    cost: float  # seconds per text
    selectivity: float  # share of texts rejected


def estimate_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000, seed: int = 7
) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows, which decide nothing but the order of rules.

    Finding the words is shared by all rules and belongs to no rule's cost. The driver gets a row per rule.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for _, texts in blocks(table.column(0)):
                batch = Batch(texts)
                batch.words  # noqa: B018
                out = []
                for i, rule in enumerate(rules):
                    begun = time.perf_counter()
                    passed = rule.passes(batch)
                    out.append((i, time.perf_counter() - begun, int((~passed).sum()), len(batch)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["rule", "seconds", "rejected", "n"])

    n = docs.count()
    if not n:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    sample = docs.select(text_col).sample(min(1.0, sample_rows / n), seed)
    rows = sample.mapInArrow(measure, "rule long, seconds double, rejected long, n long")
    totals = {r["rule"]: r for r in rows.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "n")]).collect()}
    if not totals:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    return [Estimate(r.name, totals[i]["seconds"] / totals[i]["n"], totals[i]["rejected"] / totals[i]["n"]) for i, r in enumerate(rules)]


def plan_rules(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """The rules by rejections per second, most first; ties keep the given order."""
    gain = {e.rule: e.selectivity / max(e.cost, 1e-12) for e in estimates}
    return sorted(rules, key=lambda r: -gain[r.name])


def run_cascade(batch: Batch, rules: Sequence[Rule]) -> tuple[np.ndarray, list[str | None]]:
    """Which texts pass all rules, and the rule that rejected each other one."""
    kept, reason = np.ones(len(batch), bool), [None] * len(batch)
    alive = np.arange(len(batch))
    for rule in rules:
        if not len(alive):
            break
        passed = rule.passes(batch)
        for i in alive[~passed]:
            reason[i] = rule.name
        kept[alive[~passed]] = False
        if not passed.all():
            alive = alive[passed]
            batch = Batch(batch.texts.take(pa.array(np.flatnonzero(passed))))
    return kept, reason


def assess(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000
) -> DataFrame:
    """Per row: id, the base counts, ``base_failed``, ``kept`` and ``rejected_by`` (the cascade's rule).

    One pass over the texts, no shuffle.
    """
    ordered = plan_rules(rules, estimate_rules(docs, rules, text_col, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for first, texts in blocks(table.column(1)):
                batch = Batch(texts)
                n, repeated = n_words(batch), n_repeat_words(batch)
                kept, reason = run_cascade(batch, ordered)
                failed = (n < 10) | (100 * repeated > 20 * n)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column(0).slice(first, len(batch)),
                        *[pa.array(x.astype(np.int64)) for x in (n, word_chars(batch), n_symbols(batch), n_dup_lines(batch), repeated)],
                        pa.array(failed),
                        pa.array(kept & ~failed),
                        pa.array(reason, pa.string()),
                    ],
                    names,
                )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [id_col, *counts, "base_failed", "kept", "rejected_by"]
    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The documents that pass all rules, columns unchanged: one pass, no shuffle, real short circuit."""
    ordered = plan_rules(rules, estimate_rules(docs, rules, text_col, sample_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for first, texts in blocks(table.column(at)):
                kept, _ = run_cascade(Batch(texts), ordered)
                yield table.slice(first, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)

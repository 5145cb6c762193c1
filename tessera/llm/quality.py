"""Quality rules as a short-circuit cascade.

Each rule looks at one text and may reject it. On a sample, each rule's cost and share of rejections are measured;
the rules then run in the order of rejections per cost, and a text's first rejection ends its turn. The order
changes the time, never the verdict, so the sample's size is a matter of speed alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept_rows, keyed_text

#: Texts that costs and selectivities are measured on, about.
SAMPLE_ROWS = 2_000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class View:
    """One text and what rules ask of it; each answer is computed once."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * len(known) + ids[1:]
        if len(known) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
        _, of, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[of] > 1
        inside = np.zeros(n, dtype=bool)
        for shift in range(3):
            inside[shift : n - 2 + shift] |= twice
        return int(inside.sum())

    @cached_property
    def upper_words(self) -> int:
        return sum(w.isupper() for w in self.text.split())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], bool]


def share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


#: Thresholds are on shares, so that they hold for texts of any length and language.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda v: v.n_symbols > 0.2 * max(1, v.n_words)),
    Rule("word_length", lambda v: not 2.0 * v.n_words <= v.word_chars <= 14.0 * v.n_words),
    Rule("exclamations", lambda v: v.text.count("!") > 0.3 * max(1, v.n_words)),
    Rule("ellipses", lambda v: v.text.count("...") + v.text.count("…") > 0.3 * max(1, len(v.lines)) and len(v.lines) > 3),
    Rule("bullets", lambda v: len(v.lines) > 3 and share(sum(line.lstrip(BLANKS)[:1] in ("-", "*", "•", "·") for line in v.lines), len(v.lines)) > 0.9),
    Rule("repeated_lines", lambda v: share(v.n_dup_lines, len(v.lines)) > 0.5),
    Rule("upper_case", lambda v: v.upper_words > 0.5 * max(1, v.n_words) and v.n_words > 5),
    Rule("letters", lambda v: sum(map(str.isalpha, v.text)) < 0.5 * v.word_chars),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
    Rule("few_distinct_words", lambda v: v.n_words > 20 and len(set(v.words)) < 0.02 * v.n_words),
)


def from_words(rule: Rule, least: int) -> Rule:
    """The rule for texts of ``least`` words or more; it rejects no shorter one."""
    return Rule(rule.name, lambda v: v.n_words >= least and rule.rejects(v))


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule on a sample of about ``sample_rows`` texts."""
    texts = keyed_text(docs, id_col, text_col)
    every = max(1, docs.count() // max(1, sample_rows))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(sample_rows)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        sums = {rule.name: [0.0, 0, 0] for rule in rules}
        for _, text in rows:
            for rule in rules:
                view = View(text)
                view.words  # noqa: B018  shared by nearly all rules, so not one rule's cost
                began = time.perf_counter()
                rejected = rule.rejects(view)
                held = sums[rule.name]
                held[0] += time.perf_counter() - began
                held[1] += rejected
                held[2] += 1
        yield from ((name, *held) for name, held in sums.items())

    parts = arrow_rows(sample, "name string, seconds double, rejected long, texts long", run)
    return [(r["name"], r["seconds"] / max(1, r["texts"]), r["rejected"] / max(1, r["texts"])) for r in parts.groupBy("name").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("texts").alias("texts")).collect()]


def ordered(figures: list[tuple[str, float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by rejections per cost, best first; unmeasured ones last, in their own order."""
    worth = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in figures}
    return sorted(rules, key=lambda rule: -worth.get(rule.name, -1.0))


def first_rejection(view: View, rules: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(view)), None)


def verdict(view: View, order: Sequence[Rule], min_words: int, most_repeated: int) -> str | None:
    """The rule that rejects a text, the base first; None if none does."""
    if base_failed(view, min_words, most_repeated):
        return "base"
    return first_rejection(view, order)


def base_failed(view: View, min_words: int, most_repeated: int) -> bool:
    return view.n_words < min_words or 100 * view.n_repeat_words > most_repeated * view.n_words


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, *, min_words: int = 50, most_repeated: int = 50, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``judge`` keeps.

    A null text counts as empty and goes, unless ``min_words`` is 0; rows with one text stay or go together, whatever their ids; an empty
    table gives none; a column of ``docs`` named like a measure is left as it is. Ties between rules in the cascade can't change a verdict.
    """
    order = ordered(measured(docs, rules, sample_rows, id_col=id_col, text_col=text_col), rules)

    def keeps(texts: Iterator[str]) -> Iterator[bool]:
        return (verdict(View(text), order, min_words, most_repeated) is None for text in texts)

    return kept_rows(docs, keeps, text_col)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, *, min_words: int = 50, most_repeated: int = 50, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of each text.

    A text fails the base with fewer than ``min_words`` words or with more than ``most_repeated`` percent of its words
    in repeated windows of three. ``kept`` is the verdict of base and cascade, ``rule`` the rule that rejected (which
    of several depends on the measured order). Null and empty texts have no words. Repeated rows give repeated
    results, an empty table gives none, other columns are left aside.
    """
    order = ordered(measured(docs, rules, sample_rows, id_col=id_col, text_col=text_col), rules)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            v = View(text)
            rule = verdict(v, order, min_words, most_repeated)
            yield doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, rule == "base", rule is None, rule

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rule string"
    return arrow_rows(keyed_text(docs, id_col, text_col), schema, run)

"""Quality rules as a short-circuit cascade (operator 6).

Each rule rejects a document by a few of its features; a feature is computed
when the first rule asks for it.  Before the run, every rule's cost and
rejection rate are measured on a bounded sample, and the cascade tries the
rules by falling rejection per cost and stops at the first that rejects.  The
order changes the time, never the verdict.

Defined cases: a null or empty text has no words and is rejected by the base
rule; rows are judged one by one, so repeated rows get the same verdict; an
empty table gives an empty result (and leaves the rules in their given order);
extra columns of any name are not looked at.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import freeing

SAMPLE = 200          # documents on which costs and rejections are estimated
ROWS = 256
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """A text's features, each computed once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str) -> int:
        value = getattr(Features, "_" + name)(self)
        self.__dict__[name] = value
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, n, last = Counter(windows), 0, -1
        for i, x in enumerate(windows):
            if seen[x] > 1:
                n += i + 2 - max(i - 1, last)
                last = i + 2
        return n

    def _n_upper(self) -> int:
        return sum(map(self.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def _n_lower(self) -> int:
        return sum(map(self.text.count, "abcdefghijklmnopqrstuvwxyz"))

    def _n_marks(self) -> int:
        return self.text.count("!")


@dataclass(frozen=True)
class Rule:
    """``rejects`` decides on a document's features."""

    name: str
    rejects: Callable[[Features], bool]


def base_failed(f: Features) -> bool:
    """Too short, or more than half of its words in repeated windows."""
    return f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words


RULES = (
    Rule("base", base_failed),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("word_length", lambda f: f.word_chars < 3 * f.n_words or f.word_chars > 12 * f.n_words),
    Rule("dup_lines", lambda f: 100 * f.n_dup_lines > 50 * max(1, len(f.lines))),
    Rule("upper_case", lambda f: f.n_upper > f.n_lower),
    Rule("exclamations", lambda f: 100 * f.n_marks > 50 * f.n_words),
)


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """``rules`` by falling rejection per cost on a sample of texts.

    Costs are taken on fresh features, so each rule pays for what it needs.
    """
    if not texts:
        return tuple(rules)
    ratio = {}
    for r in rules:
        began = time.perf_counter()
        hits = sum(bool(r.rejects(Features(t))) for t in texts)
        ratio[r.name] = hits / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -ratio[r.name]))


def first_rejection(f: Features, rules: tuple[Rule, ...]) -> str | None:
    """The name of the first rule in order that rejects, or None."""
    return next((r.name for r in rules if r.rejects(f)), None)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, features: tuple[str, ...] = (), id_col: str = "doc_id",
            text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, the asked ``features``, base_failed, kept) of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [r.name for r in order_rules([r[0] for r in src.select("text").limit(sample).collect()], rules)]

    @freeing
    def run(batches):
        by = {r.name: r for r in rules}
        order = tuple(by[n] for n in names)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                all_f = [Features(t) for t in part.column(1).to_pylist()]
                kept = [first_rejection(f, order) is None for f in all_f]
                cols = [pa.array([getattr(f, n) for f in all_f], pa.int64()) for n in features]
                base = pa.array([base_failed(f) for f in all_f], pa.bool_())
                yield pa.record_batch([part.column(0), *cols, base, pa.array(kept, pa.bool_())],
                                      ["doc_id", *features, "base_failed", "kept"])

    kind = src.schema["doc_id"].dataType.simpleString()
    asked = "".join(f"{n} long, " for n in features)
    return src.mapInArrow(run, f"doc_id {kind}, {asked}base_failed boolean, kept boolean")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    at = docs.columns.index(text_col)
    names = [r.name for r in order_rules([r[0] for r in docs.select(text_col).limit(sample).collect()], rules)]

    @freeing
    def run(batches):
        by = {r.name: r for r in rules}
        order = tuple(by[n] for n in names)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                mask = [first_rejection(Features(t), order) is None for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

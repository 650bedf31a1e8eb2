"""Quality rules, applied as a short-circuit cascade ordered by rejections per cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Of the sample that costs are measured on.
SEED = 20_240

BASE_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


class Measures:
    """What the rules ask of one text.  Each figure is computed when first asked for, and then kept."""

    def __init__(self, text: str, words: list[str] | None = None):
        self.text = text
        self._words = words
        self._known: dict[str, float] = {}

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = WORD.findall(self.text)
        return self._words

    def get(self, name: str) -> int:
        if name not in self._known:
            self._known[name] = getattr(self, "_" + name)()
        return self._known[name]

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return sum(map(len, self.words))

    def _n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    def _n_exclaims(self) -> int:
        return self.text.count("!")

    def _lines(self) -> int:
        lines = [x for x in self.text.split("\n") if WORD.search(x)]
        self._known["n_dup_lines"] = len(lines) - len(set(lines))
        return len(lines)

    def _n_dup_lines(self) -> int:
        self.get("lines")
        return self._known["n_dup_lines"]

    def _n_upper(self) -> int:
        return sum(map(str.isupper, self.words))

    def _n_lettered(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or w[:-1].isalpha() or any(map(str.isalpha, w)))

    def _top_word(self) -> int:
        return Counter(self.words).most_common(1)[0][1] if self.words else 0

    def _n_repeat_words(self) -> int:
        words = self.words
        n = len(words)
        if n < 4:
            return 0
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        marked = bytearray(n)
        for i, w in enumerate(windows):
            if found[w] > 1:
                marked[i : i + 3] = b"\1\1\1"
        return sum(marked)


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text where `rejects` is true."""

    name: str
    rejects: Callable[[Measures], bool]


#: The default cascade.  Thresholds are shares of words or of lines.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda m: 10 * m.get("n_symbols") > m.get("n_words")),
    Rule("exclaims", lambda m: 5 * m.get("n_exclaims") > m.get("n_words")),
    Rule("capitals", lambda m: 2 * m.get("n_upper") > m.get("n_words")),
    Rule("word_length", lambda m: not 2 * m.get("n_words") <= m.get("word_chars") <= 14 * m.get("n_words")),
    Rule("letters", lambda m: 10 * m.get("n_lettered") < 7 * m.get("n_words")),
    Rule("dup_lines", lambda m: 10 * m.get("n_dup_lines") > 6 * m.get("lines")),
    Rule("top_word", lambda m: 10 * m.get("top_word") > 3 * m.get("n_words")),
    Rule("repeats", lambda m: 2 * m.get("n_repeat_words") > m.get("n_words")),
)


#: The base rule, as two rules that a cascade can order among the others.
BASE: tuple[Rule, ...] = (
    Rule("base_words", lambda m: m.get("n_words") < 50),
    Rule("base_repeats", lambda m: 100 * m.get("n_repeat_words") > 50 * m.get("n_words")),
)


def estimate_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> list[str]:
    """Names of the rules by falling rejections per second, measured on the executors over about `sample_rows` texts.

    The texts are drawn from all of df, each with the same chance.  A text is split into words before the clock runs,
    as every order of rules needs them; what rules share otherwise is charged to each.  The order changes the cost of
    the cascade only: a text is kept if no rule rejects it, in any order.  Only the sums go to the driver.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for x in texts(batch.column("text")):
                split = Measures(x).words
                for i, rule in enumerate(rules):
                    held = Measures(x, split)
                    began = time.perf_counter()
                    hits[i] += rule.rejects(held)
                    cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "cost": cost, "hits": hits})

    own = df.select(F.col(text).cast("string").alias("text"))
    rows = own.count()
    sampled = own.sample(min(1.0, sample_rows / rows), SEED) if rows else own
    found = (
        sampled.mapInArrow(measure, "rule long, cost double, hits long")
        .groupBy("rule")
        .agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"))
        .collect()
    )
    by = {r.rule: ((r.hits + 0.5) / (r.cost + 1e-9)) for r in found}
    return [rules[i].name for i in sorted(range(len(rules)), key=lambda i: (-by.get(i, 0.0), i))]


def base_failed(m: Measures) -> bool:
    return any(rule.rejects(m) for rule in BASE)


def cascade(held: list[Measures], ordered: list[Rule]) -> list[bool]:
    """Whether each text is kept; a rule sees only what those before it have kept."""
    alive = list(range(len(held)))
    for rule in ordered:
        alive = [i for i in alive if not rule.rejects(held[i])]
    kept = [False] * len(held)
    for i in alive:
        kept[i] = True
    return kept


def _ordered(names: list[str], rules: tuple[Rule, ...]) -> list[Rule]:
    by = {r.name: r for r in rules}
    return [by[n] for n in names]


def quality_table(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512
) -> DataFrame:
    """One row for each row of df: the base figures of its whole text and the verdict of base rule and cascade.

    A null or empty text has no words: all figures are 0, base_failed is true and kept false.  A null doc_id
    stays null; repeated rows give repeated rows; other columns of df are not read.  An empty table gives none.
    """
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = _ordered(estimate_order(df, "text", rules, sample_rows), rules)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 20):
                held = [Measures(x) for x in texts(part.column("text"))]
                failed = [base_failed(m) for m in held]
                verdict = iter(cascade([m for m, f in zip(held, failed, strict=True) if not f], ordered))
                out = {"doc_id": part.column("doc_id")}
                out |= {k: pa.array([m.get(k) for m in held], pa.int64()) for k in figures}
                out |= {"base_failed": pa.array(failed, pa.bool_()), "kept": pa.array([not f and next(verdict) for f in failed], pa.bool_())}
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, BASE_SCHEMA)


def keep_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """The rows of df, with all its columns, whose text passes the base rule and the cascade, as one ordered cascade.

    Null, empty and short texts go, as the base rule rejects them; rows with null ids stay if their text does;
    repeated rows get the same verdict each; an empty table gives no rows.
    """
    ordered = _ordered(estimate_order(df, text, (*BASE, *rules), sample_rows), (*BASE, *rules))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in text_chunks(numbered, str(place), 1 << 20):
                held = [Measures(x) for x in texts(part.column(place))]
                yield part.filter(pa.array(cascade(held, ordered), pa.bool_())).rename_columns(batch.schema.names)

    return df.mapInArrow(run, df.schema)

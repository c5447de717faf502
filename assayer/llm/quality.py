"""Quality rules as a short-circuit cascade ordered by measured cost and selectivity.

Each rule is a Column that is true where a text must go. On a sample every rule is timed, without the
start of its job, and its rejections are counted; costs within a factor of two count as equal. The cascade
asks the rule with the most rejections per second first and stops at the first that rejects. Its words are
split once for all rules. The verdict is that of all rules together whatever the order,
so a different machine may order them differently and still keep the same documents.

NULL and empty texts have no words and are rejected as too short. Long texts are measured whole.
Repeated rows are judged one by one. Columns of the input are kept as they are; the names of the
columns that are added can be chosen, and an existing column of that name is replaced.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import BLANKS, LOWER, UPPER, bound, chars_among, chars_outside, covered, fingerprint, kept, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows on which cost and selectivity are estimated; all rows are judged.
SAMPLE_ROWS = 2000
#: Timed runs of a rule, of which the fastest counts, and the least seconds told apart.
RUNS, RESOLUTION = 3, 0.01


@dataclass(frozen=True)
class Measures:
    """What rules may ask of a text. From a text, each is computed only where a rule needs it."""

    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column
    n_repeat_words: Column
    n_shouts: Column
    n_upper: Column
    n_lower: Column

    @classmethod
    def of_text(cls, text: Column, tokens: Column | None = None) -> Measures:
        tokens = words(text) if tokens is None else tokens
        lines = F.filter(F.split(whole(text), "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        long = {
            "n_words": F.size(tokens),
            "word_chars": chars_outside(text, BLANKS),
            "n_symbols": chars_among(text, SYMBOLS),
            "n_lines": F.size(lines),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeat_words(tokens, WINDOW),
            "n_shouts": chars_among(text, "!"),
            "n_upper": chars_among(text, UPPER),
            "n_lower": chars_among(text, LOWER),
        }
        return cls(**{name: c.cast("bigint") for name, c in long.items()})

    @classmethod
    def of_columns(cls) -> Measures:
        return cls(**{name: F.col(name) for name in cls.__dataclass_fields__})


def repeat_words(tokens: Column, size: int) -> Column:
    """Words inside windows of ``size`` words found at least twice in the text.

    Hashes of the windows tell most texts that repeat nothing; only the others sort their windows,
    and those are compared as text.
    """
    return bound(tokens, lambda t: _repeat_words(t, size))


def _repeat_words(tokens: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(tokens) - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)]))
    in_order = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, size), " ").alias("w"), i.alias("i"))))

    def repeated(sorted_windows):
        at = lambda k: F.get(sorted_windows, k)
        twice = lambda k: (at(k)["w"] == at(k - 1)["w"]) | (at(k)["w"] == at(k + 1)["w"])
        index = F.sequence(F.lit(0), F.size(sorted_windows) - 1)
        return F.sort_array(F.transform(F.filter(index, lambda k: F.coalesce(twice(k), F.lit(False))), lambda k: at(k)["i"]))

    exact = bound(in_order, lambda s: covered(repeated(s), size))
    some = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(tokens) <= size, F.lit(0).cast("bigint")).when(some, exact).otherwise(F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


#: Rules every document must pass whatever else is asked.
BASE = (
    Rule("short", lambda m: m.n_words < 10),
    Rule("repeats", lambda m: m.n_repeat_words * 100 > m.n_words * 20),
)
RULES = (
    Rule("symbols", lambda m: m.n_symbols * 10 > m.n_words),
    Rule("shouts", lambda m: m.n_shouts * 5 > m.n_words),
    Rule("capitals", lambda m: m.n_upper > m.n_lower),
    Rule("copied_lines", lambda m: m.n_dup_lines * 10 > m.n_lines * 3),
    Rule("short_words", lambda m: m.word_chars < m.n_words * 2),
    Rule("long_words", lambda m: m.word_chars > m.n_words * 20),
)


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    rejected: float
    seconds: float

    @property
    def worth(self) -> float:
        """Rejections per second, with the seconds as a power of two, so that noise seldom changes an order."""
        return self.rejected / 2.0 ** round(math.log2(max(self.seconds, RESOLUTION)))


def sample_of(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` documents chosen by the hash of their text, the same on every run."""
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0
    picked = docs.select(F.col(text).alias("text"))
    if share < 1.0:
        picked = picked.where(F.pmod(fingerprint(F.col("text"), F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    return kept(picked, "rule-sample")


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[RuleEstimate]:
    """Share of rejections and seconds of each rule on a sample, judged alone, beyond those of a rule that only reads."""
    sample = sample_of(docs, text, rows)

    def timed(rejects: Column) -> tuple[float, float]:
        job, fastest = sample.agg(F.avg(rejects.cast("double")).alias("share")), math.inf
        share = job.first()["share"] or 0.0  # the first run compiles
        for _ in range(RUNS):
            began = time.perf_counter()
            job.first()
            fastest = min(fastest, time.perf_counter() - began)
        return share, fastest

    start = timed(F.octet_length(whole(F.col("text"))) < 0)[1]
    judged = [(rule.name, *timed(rule.rejects(Measures.of_text(F.col("text"))))) for rule in rules]
    return [RuleEstimate(name, share, max(0.0, seconds - start)) for name, share, seconds in judged]


def ordered(rules: Sequence[Rule], estimates: Sequence[RuleEstimate]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(rules: Sequence[Rule], measures: Measures) -> Column:
    """The name of the first rule that rejects, NULL where none does. Later rules are then not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(verdict)
    return verdict


def first_reason(rules: Sequence[Rule], text: Column) -> Column:
    """The cascade on a text whose words are split once."""
    return bound(words(text), lambda tokens: cascade(rules, Measures.of_text(text, tokens)))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE + RULES, rejected_by: str = "rejected_by", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents with the rule that rejects them, if any, after ordering the rules on a sample."""
    order = ordered(rules, estimate(docs, rules, text, rows))
    return docs.withColumn(rejected_by, first_reason(order, F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE + RULES) -> DataFrame:
    """The documents no rule rejects, with their own columns."""
    order = ordered(rules, estimate(docs, rules, text))
    return docs.where(first_reason(order, F.col(text)).isNull())


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every measure of every document, the base verdict and the cascade's verdict."""
    order = ordered(rules, estimate(docs, rules, text))
    tokenised = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), words(F.col(text)).alias("tokens"))
    measures = Measures.of_text(F.col("text"), F.col("tokens"))
    measured = tokenised.select("doc_id", *[getattr(measures, name).alias(name) for name in Measures.__dataclass_fields__])
    columns = Measures.of_columns()
    base_failed = BASE[0].rejects(columns) | BASE[1].rejects(columns)
    first = cascade(order, columns)
    return measured.withColumn("base_failed", base_failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(first.isNull()))

"""Secret scans: fixed patterns, plus sliding-window entropy over candidate strings.

Candidates are long runs of key characters. Over each, a window of WINDOW characters slides; the
counts of its characters and the sum of c * log2(c) are kept up to date as one character enters and
one leaves, which gives the window's Shannon entropy. A candidate is a secret from its first to its
last window above the limit of its character class (hex, upper case and digits, mixed), unless an
allow-list pattern fits it. A slug, a counting string or a marked example within a candidate silences
itself only: what is left of the candidate without these, and without the words before it, is scanned on
its own. Spans are code points, end exclusive.

NULL texts are empty and have no spans. Texts of any length are scanned whole; positions follow from
the lengths of the pieces between matches. Repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import bound, free, matches, whole

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character above which a window of a class looks random: about one in a hundred windows of
#: evenly drawn characters is below (hex 1.0 %, A-Z0-9 0.9 %, A-Za-z0-9 0.6 %). Words are left to ALLOWED.
LIMITS = {"hex": 2.9, "upper": 3.4, "mixed": 3.6}
# The characters of keys, in the order of their codes in the counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Never secrets by entropy alone: words without digits, numbers, UUIDs, words with short numbers, paths and slugs, counting
#: strings, marked examples.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[/_=-]*(?:(?:[A-Z]?[a-z]++)++[0-9]{0,4}(?:[/_=-]++|$))++$",
    r"^[A-Za-z]*([/_-]+[A-Za-z]+){3,}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"EXAMPLE|example",
)
#: Patterns of ALLOWED that fit the whole candidate; the others may stand beside a secret.
WHOLE = 4
# The slug pattern without its open end: fits the same candidates, but needs no stack for long ones.
PARTLY = tuple(p.replace("{3,}", "{3}") for p in ALLOWED[WHOLE:])
#: What is blanked within a candidate, by length.
MARKS = {"0123456789|abcdefghij|ABCDEFGHIJ": 10, "EXAMPLE|example": 7}
#: Keys of manuals end like this.
MARKED = r"[A-Za-z0-9+]EXAMPLE(KEY)?$"
#: Words and separators before the random part, as in key names and paths.
HEAD = r"^(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})?[/_=-])++"


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs are matched whole, so asking for the length in the pattern is the same as dropping shorter matches.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Matches of a pattern as (start, rank, end, hit); ``keep`` filters by a second group."""
    found = matches(text, pattern)
    extra = matches(text, pattern, 2) if keep else found
    pieces = F.split(whole(text), pattern, -1)
    long = lambda c: c.cast("bigint")
    step_type = "struct<start:bigint,rank:int,end:bigint,hit:string,extra:string>"

    def place(state, x):
        start = state["at"] + long(F.length(x["piece"]))
        end = start + long(F.length(x["hit"]))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["hit"].alias("hit"), x["extra"].alias("extra"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    zero = F.struct(long(F.lit(0)).alias("at"), F.array().cast(f"array<{step_type}>").alias("out"))
    rows = F.slice(F.arrays_zip(pieces.alias("piece"), found.alias("hit"), extra.alias("extra")), F.lit(1), F.size(found))
    placed = F.aggregate(rows, zero, place, lambda s: s["out"])
    if keep:
        placed = F.filter(placed, lambda s: keep(s["extra"]))
    return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["hit"].alias("hit")))


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,rank:int,end:bigint,hit:string>>")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, unsorted."""
    some = lambda pattern: whole(text).rlike(pattern)
    assign = F.when(some(ASSIGN), _spans(text, ASSIGN, 0, lambda value: F.length(value) >= 6)).otherwise(_none())
    access = F.when(whole(text).contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(some(HEX), _spans(text, HEX, 2)).otherwise(_none())
    return F.concat(assign, access, hexes)


def class_limit(candidate: Column) -> Column:
    """Bits per character above which a window of this candidate counts, by its character class."""
    return (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(LIMITS["hex"]))
        .when(candidate.rlike("^[A-Z0-9]+$"), F.lit(LIMITS["upper"]))
        .otherwise(F.lit(LIMITS["mixed"]))
    )


def random_part(candidate: Column) -> Column:
    """(first, last) offsets of the windows of a candidate above its limit, NULL if none is."""
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))

    def over(codes):
        def slide(state, i):
            enters, leaves = F.get(codes, i), F.get(codes, i - WINDOW)
            had = F.get(state["counts"], enters)
            grown = state["s"] + weight(had + 1) - weight(had)
            counts = F.transform(state["counts"], lambda c, k: F.when(k == enters, c + 1).otherwise(c))
            # What leaves is counted after what enters, so equal characters cancel.
            left = F.when(leaves == enters, had + 1).otherwise(F.get(state["counts"], leaves))
            s = F.when(leaves.isNull(), grown).otherwise(grown + weight(left - 1) - weight(left))
            counts = F.when(leaves.isNull(), counts).otherwise(F.transform(counts, lambda c, k: F.when(k == leaves, c - 1).otherwise(c)))
            random = (i >= WINDOW - 1) & (F.round(s, 9) <= state["most"])
            start = (i - (WINDOW - 1)).cast("int")
            return F.struct(
                counts.alias("counts"),
                s.alias("s"),
                state["most"].alias("most"),
                F.when(random & state["first"].isNull(), start).otherwise(state["first"]).alias("first"),
                F.when(random, start).otherwise(state["last"]).alias("last"),
            )

        nothing = F.lit(None).cast("int")
        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
            F.lit(0.0).alias("s"),
            # entropy >= limit, as a bound on the sum of c * log2(c)
            F.round((F.log2(F.lit(float(WINDOW))) - class_limit(candidate)) * WINDOW, 9).alias("most"),
            nothing.alias("first"),
            nothing.alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return bound(codes, over)


def entropy_spans(text: Column) -> Column:
    """Spans of candidates that look random, unsorted."""
    placed = _spans(text, CANDIDATE, 3)
    suspects = F.filter(placed, lambda s: ~_any_of(s["hit"], (*ALLOWED[:WHOLE], *PARTLY)))

    def cut(s):
        def span(p):
            ends = (s["start"] + p["first"]).alias("start"), (s["start"] + p["last"] + WINDOW).alias("end")
            return F.when(p["first"].isNotNull(), F.struct(ends[0], s["rank"].alias("rank"), ends[1], s["hit"].alias("hit")))

        return bound(random_part(s["hit"]), span)

    beside = F.filter(placed, lambda s: ~_any_of(s["hit"], (*ALLOWED[:WHOLE], MARKED)) & _any_of(s["hit"], PARTLY))
    parts = F.filter(F.flatten(F.transform(beside, _rests)), lambda s: (F.length(s["hit"]) >= WINDOW) & ~_any_of(s["hit"], ALLOWED[:WHOLE]))
    found = F.filter(F.transform(F.concat(suspects, parts), cut), lambda s: s.isNotNull())
    return F.when(whole(text).rlike("[0-9]") & whole(text).rlike(CANDIDATE), found).otherwise(_none())


def _rests(s: Column) -> Column:
    """What is left of a candidate without marks, and without the words before it."""
    blanked = s["hit"]
    for pattern, length in MARKS.items():
        blanked = F.regexp_replace(blanked, pattern, " " * length)

    def rest(run):
        head = F.length(F.regexp_extract(run["hit"], HEAD, 0))
        hit = F.substr(run["hit"], head + 1)
        return F.struct((s["start"] + run["start"] + head).alias("start"), s["rank"].alias("rank"), (s["start"] + run["end"]).alias("end"), hit.alias("hit"))

    return F.transform(_spans(blanked, CANDIDATE, 3), rest)


def _any_of(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """Documents with their base spans and all spans, each an array of (start, rank, end, hit) by start, then kind."""
    found = docs.withColumn(base, F.sort_array(base_spans(F.col(text))))
    return found.withColumn(spans, F.sort_array(F.concat(F.col(base), entropy_spans(F.col(text)))))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state, s):
        between = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.concat(state["out"], F.array(between, F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] < state["at"], state["out"]).otherwise(fresh).alias("out"))

    done = F.aggregate(spans, zero, cut)
    joined = bound(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, (d["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with their secrets replaced; all columns stay as they are but for the text."""
    base, spans = free(docs, "base_spans"), free(docs, "secret_spans")
    found = scan(docs, text, base, spans)
    return found.withColumn(text, redacted(F.col(text), F.col(spans))).drop(base, spans)

"""Text measures as Column expressions, and the written tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import run_dir

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(text, F.lit(""))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    return matches(text, WORD)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(whole(text), UPPER, LOWER)


def chars_outside(text: Column, chars: str) -> Column:
    """Code points that are not among ``chars``."""
    return F.length(F.translate(whole(text), chars, ""))


def chars_among(text: Column, chars: str) -> Column:
    return F.length(whole(text)) - chars_outside(text, chars)


def free(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fingerprint(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def unit_draw(*keys: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def covered(starts: Column, lengths: Column | int) -> Column:
    """Positions covered by spans given as an ascending array of starts, or of (start, length) structs."""
    long = lambda n: F.lit(n).cast("bigint")
    start = (lambda s: s) if not isinstance(lengths, str) else (lambda s: s["start"])
    length = (lambda s: long(lengths)) if not isinstance(lengths, str) else (lambda s: s[lengths])

    def step(state, s):
        begin, end = start(s).cast("bigint"), (start(s) + length(s)).cast("bigint")
        fresh = F.greatest(long(0), end - F.greatest(begin, state["until"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(end, state["until"]).alias("until"))

    zero = F.struct(long(0).alias("n"), long(0).alias("until"))
    return F.aggregate(starts, zero, step, lambda state: state["n"])


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. Inside lambdas a repeated expression would run per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Words of 64 bits of a sieve at most. Beyond 16 bits a key it lets more rows through instead of growing.
SIEVE = 1 << 20


def sieved(rows: DataFrame, key: Column, keys: DataFrame, mark: str, most: int = SIEVE) -> DataFrame:
    """The rows with ``mark``: true where the hash ``key`` may be among those in the one column of ``keys``, else false.

    Every hash sets two bits of one word, and the words are broadcast, ``most`` at most. So rows that are surely not
    among the keys need no join that moves them, however many keys there are; at 16 bits a key about one other
    row in a hundred is marked, and looking up the marked ones is left to the caller.
    """
    count = min(most, 1 << max(4, (keys.count() // 4).bit_length()))
    bit = lambda h, at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    bits = lambda h: bit(h, 40).bitwiseOR(bit(h, 50))
    word = lambda h: h.bitwiseAND(F.lit(count - 1).cast("bigint"))
    own, place, held = (free(rows, name) for name in ("sieve_key", "sieve_place", "sieve_bits"))
    hashed = keys.toDF("h")
    table = hashed.groupBy(word(F.col("h")).alias(place)).agg(F.bit_or(bits(F.col("h"))).alias(held))
    placed = rows.withColumn(own, key).withColumn(place, word(F.col(own))).join(F.broadcast(table), place, "left")
    among = F.coalesce(F.col(held).bitwiseAND(bits(F.col(own))) == bits(F.col(own)), F.lit(False))
    return placed.withColumn(mark, among).drop(own, place, held)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that later work starts from files."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Benchmark decontamination: test n-grams as a broadcast hash table, scanned by windows of training words.

Texts are lower-cased (A-Z) and cut into words. Every window of ``size`` words of a benchmark item, or
the whole item if it is shorter, is hashed; the windows of every document are hashed the same way by
doubling (2 words, 4, 8, ...). A bit array of the test hashes passes the few that may hit on to the
broadcast table, where they are looked up and verified word by word. The table holds windows only; the
items they come from are joined afterwards, once per distinct set of windows, however many items share one.

The table of windows is counted before it is broadcast. Above ``block`` windows it is dealt into blocks
of at most about that many by hash, and the documents are scanned once per block, so the size of what is
broadcast has a fixed bound whatever the benchmark's size.

NULL and empty texts have no words and no windows. Rows equal in id and text are one document and get
the same answer each. Ids may be NULL; items without id are hit, but not named. An empty benchmark hits
nothing. Texts of any length are scanned whole. Other columns of any name stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import bound, covered, fingerprint, free, kept, lower_ascii, matches, sieved, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of one broadcast table; with its words one takes a few hundred bytes.
BLOCK = 100_000


def normal_words(text: Column) -> Column:
    return matches(lower_ascii(text), WORD)


def _with_hashes(df: DataFrame, tokens: str, sizes: list[int]) -> DataFrame:
    """Adds h<n>: an array of the hashes of all windows of n words, for every n in sizes."""
    made = {1}
    df = df.withColumn("h1", F.transform(tokens, lambda w: F.xxhash64(w)))

    def need(df, n):
        if n in made:
            return df
        half = 1 << ((n - 1).bit_length() - 1)  # the largest power of two below n
        df = need(need(df, half), n - half)
        left, right = F.col(f"h{half}"), F.col(f"h{n - half}")
        count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        made.add(n)
        return df.withColumn(f"h{n}", F.zip_with(F.slice(left, 1, count), F.slice(right, half + 1, count), lambda a, b: F.xxhash64(a, b)))

    return reduce(need, sizes, df)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: the distinct windows (window, len, hash, gram), and the items of each as (window, item)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), normal_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("words"))
    distinct = grams.select("words").distinct().withColumn("len", F.size("words")).withColumn("window", F.monotonically_increasing_id())
    sizes = list(range(1, size + 1))
    own = F.coalesce(*[F.when(F.col("len") == n, F.get(F.col(f"h{n}"), F.lit(0))) for n in sizes])
    hashed = _with_hashes(distinct, "words", sizes)
    windows = kept(hashed.select("window", "len", own.alias("hash"), F.array_join("words", " ").alias("gram")), "benchmark-windows")
    held = grams.where("item is not null").select("item", F.array_join("words", " ").alias("gram")).distinct()
    return windows, kept(held.join(windows, "gram").select("window", "item"), "benchmark-items")


def _bit_test(hashes: list[int]):
    """A test on a hash that is true for all given ones and for few others, from a literal bit array.

    The array has 16 to 32 bits per hash, so for one block of windows it stays below half a megabyte. A hash
    sets two bits of its word, so about one other hash in a hundred passes.
    """
    slots = 1 << max(4, (len(hashes) // 4).bit_length())
    bits = [0] * slots
    for h in hashes:
        bits[h & (slots - 1)] |= 1 << ((h >> 40) & 63) | 1 << ((h >> 50) & 63)
    signed = ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)
    array = F.split(F.lit(signed), ",").cast("array<bigint>")  # folded into a literal when the plan is made
    slot = lambda h: h.bitwiseAND(F.lit(slots - 1)).cast("int")
    bit = lambda h, at: F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int")
    is_set = lambda h, at: F.call_function("getbit", F.get(array, slot(h)), bit(h, at)) == 1
    return lambda h: is_set(h, 40) & is_set(h, 50)


def _candidates(n: int, likely) -> Column:
    """Windows of n words that pass the test, as (hash, span, words)."""
    marked = F.transform(F.col(f"h{n}"), lambda h, i: F.when(likely(h), F.struct(h.alias("hash"), i.alias("start"))))
    some = F.filter(marked, lambda x: x.isNotNull())
    span = lambda x: F.struct(x["start"].cast("bigint").alias("start"), F.lit(n).cast("bigint").alias("len"))
    gram = lambda x: F.array_join(F.slice("w", x["start"] + 1, n), " ")
    return F.transform(some, lambda x: F.struct(x["hash"].alias("hash"), span(x).alias("span"), gram(x).alias("words")))


def hits(docs: DataFrame, windows: DataFrame, block: int = BLOCK, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two written tables: every row as (doc_id, print, n_words), and the documents with hits as (doc_id, print, spans, windows).

    Spans are an ascending array of (start, len) in words, windows one of the windows' numbers. A block of windows is one
    pass over the texts, which writes what may hit; the first one also counts the words.
    """
    blocks = max(1, -(-windows.count() // block))
    sizes = sorted(r[0] for r in windows.select("len").distinct().collect()) or [size]  # at most ``size`` numbers
    tokens = docs.select("doc_id", fingerprint(F.col("text")).alias("print"), normal_words(F.col("text")).alias("w"))
    hashed = _with_hashes(tokens, "w", sizes)
    passes, found = [], []
    for b in range(blocks):
        table = windows.where(F.pmod("hash", F.lit(blocks)) == b)
        likely = _bit_test([r[0] for r in table.select("hash").distinct().collect()])  # one block: about ``block`` numbers at most
        grams = F.concat(*[_candidates(n, likely) for n in sizes])
        passes.append(kept(hashed.select("doc_id", "print", F.size("w").cast("bigint").alias("n_words"), grams.alias("grams")), "benchmark-scan"))
        scanned = passes[-1].select("doc_id", "print", F.explode("grams").alias("x")).select("doc_id", "print", "x.*")
        same = (F.col("hash") == F.col("_hash")) & (F.col("words") == F.col("gram"))
        table = F.broadcast(table.select(F.col("hash").alias("_hash"), "gram", "window"))
        found.append(scanned.join(table, same).select("doc_id", "print", "span", "window"))
    ordered = lambda c: F.sort_array(F.collect_set(c))
    grouped = reduce(DataFrame.unionByName, found).groupBy("doc_id", "print").agg(ordered("span").alias("spans"), ordered("window").alias("windows"))
    return passes[0].drop("grams"), kept(grouped, "benchmark-hits")


def items_of(found: DataFrame, held: DataFrame) -> DataFrame:
    """The documents with hits, with the items of their windows; those with the same windows share one look-up."""
    sets = found.select("windows").distinct()
    named = sets.withColumn("window", F.explode("windows")).join(held, "window").groupBy("windows").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.join(named, "windows", "left")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Every document row with n_words, n_hit and the items whose windows occur in it."""
    windows, held = benchmark_windows(benchmark, size)
    rows, found = hits(docs.select("doc_id", "text"), windows, block, size)
    hit = items_of(found, held).select(F.col("doc_id").alias("_doc_id"), F.col("print").alias("_print"), covered(F.col("spans"), "len").alias("n_hit"), "items")
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("print") == F.col("_print")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Documents without the benchmark: those with hits dropped, or with ``remove="spans"`` only the words that were hit.

    The text between kept words stays as it is; the characters after a removed word go with it. Only documents
    that may have hits are moved to be looked up, the others stay where they are.
    """
    _, found = hits(docs.select("doc_id", "text"), benchmark_windows(benchmark, size)[0], block, size)
    its_id, its_print, its_spans, maybe = (free(docs, name) for name in ("hit_doc_id", "hit_print", "hit_spans", "hit_maybe"))
    mine = F.col("doc_id").eqNullSafe(F.col(its_id)) & (fingerprint(F.col("text")) == F.col(its_print))
    renamed = found.select(F.col("doc_id").alias(its_id), F.col("print").alias(its_print), F.col("spans").alias(its_spans))
    marked = sieved(docs, F.xxhash64("doc_id", fingerprint(F.col("text"))), found.select(F.xxhash64("doc_id", "print")), maybe)
    unhit, asked = (marked.where(some).select(*docs.columns) for some in (~F.col(maybe), F.col(maybe)))
    if remove == "documents":
        return unhit.unionByName(asked.join(renamed, mine, "left_anti"))
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    # Case does not change what is a word, so the words of the text itself stand at the same places.
    cased = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    own, gaps = matches(F.col("text"), cased), F.split(whole(F.col("text")), cased, -1)
    hit = lambda i: F.exists(its_spans, lambda s: (s["start"] <= i) & (i < s["start"] + s["len"]))
    parts = bound(gaps, lambda g: F.transform(own, lambda w, i: F.when(hit(i), F.lit("")).otherwise(F.concat(w, F.get(g, i + 1)))))
    rebuilt = F.concat(F.get(gaps, F.lit(0)), F.array_join(parts, ""))
    joined = asked.join(renamed, mine, "left")
    return unhit.unionByName(joined.withColumn("text", F.when(F.col(its_spans).isNotNull(), rebuilt).otherwise(F.col("text"))).select(*docs.columns))

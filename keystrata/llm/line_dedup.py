"""Line duplicates within one word edit, by a deletion-neighbourhood join. DataFrame functions only.

Lines are word sequences (white space between words doesn't count). Every line with all words, and with each
one word deleted, gives a hashed key; lines within one inserted, deleted or replaced word meet under an
equal key, and the edit distance is then verified on the words. The keys of a line come from two running
XORs over its words, so a line of n words costs n keys and no more.

Only lines that can have a partner emit their variants: of two lines one edit apart, the first halves or the
second halves are equal, so a line none of whose halves occurs in another line has none. That loses nothing.

A line is dropped if it is equal to an earlier one, or within one edit of an earlier distinct line and both
have at least ``least_words`` words in the longer one (one edit in five words is a similarity of 0.8). Earlier
means by document id (null last), then content hash, then line number. Under one key every line is
compared with the earliest lines that could be within one edit of it, never with all.

Defined results: a null text counts as empty; a document keeps its blank lines; a text of one empty line
stays one. Rows that repeat id and text are one document and stay alike. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.text import text_or_empty
from keystrata.sources.shared import fresh_folder

LEAST_WORDS = 5
SALTS = 32
HOT = 256
#: A filter of hashes has 2^18 words of 64 bits: a fixed size, whatever it is filled from.
FILTER_SHIFT = 46


def _filter_of(hashes: DataFrame) -> DataFrame:
    """The hashes of a one-column table as a bitmap: (word, bits), at most 2^18 rows."""
    h = hashes.columns[0]
    bit = F.expr(f"shiftleft(1L, CAST({h} & 63 AS INT))")
    return hashes.groupBy(F.shiftrightunsigned(h, FILTER_SHIFT).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def _maybe_in(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose hash may be in the bitmap; none that is gets lost. The bitmap is small by construction, so it is broadcast."""
    found = rows.join(F.broadcast(bitmap), F.shiftrightunsigned(column, FILTER_SHIFT) == F.col("__word"))
    return found.filter(F.getbit("__bits", F.col(column).bitwiseAND(63)) == 1).drop("__word", "__bits")


def _place() -> Column:
    """The order of lines as one number: document id (null last), then content, then line."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr("CAST(9223372036854775808 AS DECIMAL(20, 0))"))
    inner = F.pmod("content", F.lit(1 << 31)) * F.lit(1 << 31) + F.col("line_no")
    return (doc * F.lit("4611686018427387904").cast("decimal(19,0)") + inner.cast("decimal(19,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: its document, its words joined by single spaces, a 64-bit hash."""
    odd = F.lit(False)
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains("text", F.lit(x))
    spaced = F.when(odd, F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), F.split(spaced, "\n").alias("lines"))
    lines = rows.select("doc_id", "content", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.withColumn("h1", F.xxhash64("line"))


def _second_hash() -> Column:
    """Another 64 bits, for the lines that need them."""
    return F.xxhash64(F.lit(1), "line")


def _halves() -> list[Column]:
    """Keys of the halves that a partner of n or n + 1 words shares (the first two), and a partner of n - 1 words (the others)."""

    def at(size: str) -> list[Column]:
        h = f"CAST({size} AS INT) DIV 2"
        return [F.expr(f"xxhash64(1, {size}, substring_index(line, ' ', CAST({h} AS INT)))"), F.expr(f"xxhash64(2, {size}, substring_index(line, ' ', -CAST({size} - {h} AS INT)))")]

    return [*at("n"), *at("(n - 1)")]


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(h1, h2, key, p): all variants of each line; p is the deleted word's position, -1 for the line with all words."""
    words = lines.select("h1", "h2", "n", F.posexplode("words").alias("p", "word"))
    words = words.select("h1", "h2", "n", "p", F.xxhash64("p", "word").alias("here"), F.xxhash64(F.col("p") - 1, "word").alias("moved"))
    line = W.partitionBy("h1", "h2")
    so_far = line.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = words.select("*", F.bit_xor("here").over(so_far).alias("head"), F.bit_xor("moved").over(so_far).alias("moved_head"), F.bit_xor("moved").over(line).alias("moved_all"))
    # The number of words that remain goes into the key: only variants of one length are equal.
    gone = F.struct(F.xxhash64(F.col("n") - 1, F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_head"))).alias("key"), F.col("p").alias("p"))
    whole = F.struct(F.xxhash64("n", "head").alias("key"), F.lit(-1).alias("p"))
    both = F.when(F.col("p") == F.col("n") - 1, F.array(gone, whole)).otherwise(F.array(gone))
    return summed.select("h1", "h2", F.explode(both).alias("v")).select("h1", "h2", "v.key", "v.p")


def _within_one(longer: Column, shorter: Column, p: Column, same_size: Column) -> Column:
    """The word edit distance is at most one: a replaced word, or the longer line without word p is the shorter."""
    replaced = F.size(F.filter(F.zip_with(longer, shorter, lambda x, y: ~x.eqNullSafe(y)), lambda z: z)) <= 1
    deleted = F.concat(F.slice(longer, F.lit(1), F.greatest(p, F.lit(0))), F.slice(longer, F.greatest(p, F.lit(0)) + 2, F.size(longer))) == shorter
    return F.when(same_size, replaced).otherwise(deleted)


def duplicate_lines(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Distinct lines that lose occurrences: h1, h2, place of the first one, n_lines, near (no occurrence stays).

    ``docs`` has doc_id and text (not null).
    """
    folder = fresh_folder(spark, "lines")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    counted = _lines(docs).withColumn("n", F.expr("length(line) - length(replace(line, ' ', '')) + 1"))
    flat = counted.select("h1", _second_hash().alias("h2"), _place().alias("place"), "n", *(h.alias(f"half_{k}") for k, h in enumerate(_halves())))
    distinct = flat.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("n"), *(F.max(f"half_{k}").alias(f"half_{k}") for k in range(4)))
    distinct = kept(distinct, "distinct")

    # Only lines one of whose halves another line has can have a partner; the filter admits some others too.
    wide = distinct.filter(F.col("n") >= least_words - 1).select("h1", "h2", "place", "n", F.explode(F.array(*(F.col(f"half_{k}") for k in range(4)))).alias("half"))
    often = wide.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    hopeful = _maybe_in(wide, "half", _filter_of(often)).select("h1", "h2", "place", "n").distinct()
    hopeful = kept(hopeful, "candidates")
    texts = _maybe_in(_lines(docs), "h1", _filter_of(hopeful.select("h1"))).select("h1", _second_hash().alias("h2"), _place().alias("place"), F.split("line", " ").alias("words"))
    hopeful = kept(texts.join(hopeful, ["h1", "h2", "place"]).dropDuplicates(["h1", "h2"]), "hopeful")

    everything = kept(_neighbourhood(hopeful), "variants")
    meeting = everything.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    variants = _maybe_in(everything, "key", _filter_of(meeting)).join(hopeful.select("h1", "h2", "place"), ["h1", "h2"])
    variants = kept(variants, "meeting")
    line = F.struct("place", "h1", "h2").alias("line")
    # The earliest line per key and position (replaced words), per key over all positions, and the whole line that is the key.
    heads = kept(variants.select("key", "p", line).groupBy("key", "p").agg(F.min("line").alias("head"), F.count(F.lit(1)).alias("c")), "heads")
    replaced = heads.filter("p >= 0 AND c > 1").select("key", "p", "head")
    whole = heads.filter("p = -1").select("key", "head")
    longer_ones = heads.filter("p >= 0").groupBy("key").agg(F.min(F.struct("head", "p")).alias("x"))
    shorter = longer_ones.join(whole.select("key"), "key").select("key", F.col("x.head").alias("head"), F.col("x.p").alias("gone"))
    by_replacing = variants.join(replaced, ["key", "p"]).select("h1", "h2", "place", "head", F.lit(-1).alias("gone"))
    by_deleting = variants.filter("p >= 0").join(whole, "key").select("h1", "h2", "place", "head", F.col("p").alias("gone"))
    by_inserting = variants.filter("p = -1").join(shorter, "key").select("h1", "h2", "place", "head", "gone")
    pairs = by_replacing.unionByName(by_deleting).unionByName(by_inserting).filter("head.place < place")
    pairs = pairs.select("h1", "h2", F.col("head.h1").alias("r1"), F.col("head.h2").alias("r2"), "gone").dropDuplicates(["h1", "h2", "r1", "r2", "gone"])
    own = hopeful.select("h1", "h2", F.col("words").alias("a"))
    other = hopeful.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("words").alias("b"))
    checked = pairs.join(own, ["h1", "h2"]).join(other, ["r1", "r2"])
    longer = F.size("a") >= F.size("b")
    close = _within_one(F.when(longer, F.col("a")).otherwise(F.col("b")), F.when(longer, F.col("b")).otherwise(F.col("a")), F.col("gone"), F.size("a") == F.size("b"))
    near = checked.filter((F.greatest(F.size("a"), F.size("b")) >= least_words) & close).select("h1", "h2").distinct()
    marks = distinct.select("h1", "h2", "place", "n_lines").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return marks.filter("near OR n_lines > 1")


def dedup_lines(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_kept and the text without its duplicate lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    folder = fresh_folder(spark, "marks")
    duplicate_lines(spark, rows, least_words).write.parquet(f"{folder}/marks")
    marks = spark.read.parquet(f"{folder}/marks").select("h1", "h2", F.col("place").alias("first"), "near", (F.col("n_lines") > HOT).alias("hot"))
    # Lines with many occurrences are met under salted keys.
    salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))))
    seen = _maybe_in(_lines(rows), "h1", _filter_of(marks.select("h1"))).select(_place().alias("place"), "h1", _second_hash().alias("h2"), "doc_id", "content", "line_no")
    seen.write.parquet(f"{folder}/seen")  # few of all lines, and read twice
    seen = spark.read.parquet(f"{folder}/seen")
    hot = seen.withColumn("salt", F.pmod(F.xxhash64("content", "doc_id"), F.lit(SALTS)).cast("int")).join(salted.filter("hot"), ["h1", "h2", "salt"])
    cold = seen.withColumn("salt", F.lit(0)).join(salted.filter("NOT hot"), ["h1", "h2", "salt"])
    gone = hot.unionByName(cold).filter(F.col("near") | (F.col("place") != F.col("first")))
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "content").agg(F.collect_set("line_no").alias("gone"))
    own = rows.withColumn("content", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    split = F.split("text", "\n")
    joined = own.join(gone, ["id", "content"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stays = F.filter(split, lambda _, k: ~F.array_contains(F.col("gone"), k))
    return joined.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.size(stays).cast("long").alias("n_kept"), F.array_join(stays, "\n").alias("text"))

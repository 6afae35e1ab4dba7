"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents;
no target exceeds ``repeats`` times its source, and what that frees is shared by weight among the others.
Schedule: the mix is ``slots`` slots, as many as there are words if those are fewer. Slot i has the golden-ratio
point i * 2654435769 mod 2^32, which falls into one source's stretch of the cumulative targets; slots are ranked
per source. A source that no point meets, having less than a slot's share, gets one slot at the end. Blocks: the documents
of a source, shuffled by a hash of their id, form a stream that begins again at its end; its slots share the
target's words out evenly, block after block, so the blocks of a source are equal to a word, those of all sources
nearly so, and every source meets its target to a word, whatever its size. A document's taken words are the
overlaps of its stretches of the stream with the blocks of the slots.

All counts are integers and the order is total, so reruns agree. Running sums go by (source, hash prefix) and
then over prefixes, so a source with most of the rows is no single task. The number of slots is a parameter,
not a function of the input: more words make longer blocks. Sources are numbered and share the words in one task, a row per
source, which fits some millions of them.

Defined results: a null text has size 0; documents without words are taken 0 times; a null source is a source
of its own; a null id is shuffled as the text "null"; rows that repeat are mixed one by one. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.text import WORD, free_names, text_or_empty
from keystrata.sources.shared import fresh_folder

GOLDEN = 2654435769
SPAN = 1 << 32
SALTS = 16


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":mix")))


def targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """Per source: number (in order), source_size, weight, target, and its stretch from..until of 2^32 points."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.select("source", "source_size", (F.row_number().over(order) - 1).cast("long").alias("number"))
    per = per.withColumn("weight", F.col("number") % 3 + 1).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("ratio", F.lit(float(repeats)) * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("ratio", "number")
    capped = F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - capped).cast("double") / others)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.least(F.lit(float(repeats)) * F.col("source_size"), level * F.col("weight")))
    points = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total") * F.lit(float(SPAN)))).otherwise(0).cast("long")
    until = F.sum(points).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.round("target").cast("long").alias("wanted")
    return per.withColumn("until", until).select("source", "number", "source_size", "target", wanted, "total", (F.col("until") - points).alias("from"), "until")


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """(number, rank, slot, first, past): the slots, and which words of their source's repeated stream they take. At most ``slots`` rows and one a source."""
    cells = 4096
    wide = SPAN // cells
    stretches = plan.filter("until > from").select("number", "total", "from", "until", F.explode(F.sequence(F.floor(F.col("from") / wide), F.floor((F.col("until") - 1) / wide))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % SPAN).alias("point")).withColumn("cell", F.floor(F.col("point") / wide))
    placed = points.join(stretches, "cell").filter("point >= from AND point < until AND slot < total").select("number", "slot")
    missed = plan.filter("wanted > 0").select("number").join(placed, "number", "left_anti").select("number", (F.col("number") + slots).alias("slot"))
    ranked = placed.unionByName(missed).withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("slot")) - 1)
    shared = ranked.join(ranked.groupBy("number").agg(F.count(F.lit(1)).alias("n")), "number").join(plan.select("number", "wanted"), "number")
    each, over = F.floor(F.col("wanted") / F.col("n")), F.col("wanted") % F.col("n")
    first = F.col("rank") * F.col("each") + F.least("rank", "over")
    return shared.withColumns({"each": each, "over": over}).select("number", "rank", "slot", "n", first.alias("first"), (first + F.col("each") + (F.col("rank") < F.col("over")).cast("long")).alias("past"))


def _rank(word: Column) -> Column:
    """Of the slot that takes a word of the repeated stream: the first ``over`` slots take ``each`` + 1 words, the others ``each``."""
    longer = F.col("over") * (F.col("each") + 1)
    return F.when(word < longer, F.floor(word / (F.col("each") + 1))).otherwise(F.col("over") + F.floor((word - longer) / F.greatest(F.lit(1), F.col("each"))))


def _streams(spark: SparkSession, docs: DataFrame, slots: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """Every input row with its stretch of its source's stream and its source's plan; and where the mix takes which of its words."""
    if not 0 < slots <= 1 << 30:
        raise ValueError("slots must lie between 1 and 2^30")
    folder = fresh_folder(spark, "mix")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")).write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    targets(sizes, repeats).write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    schedule(spark, plan, slots).write.parquet(f"{folder}/schedule")
    taken = spark.read.parquet(f"{folder}/schedule")
    counts = taken.filter("rank = 0").select("number", "n")
    # A source with most of the rows meets its plan under salted keys.
    salted = plan.join(counts, "number", "left").select(F.col("source").alias("plan_source"), "number", "source_size", "target", "wanted", F.coalesce("n", F.lit(1)).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("plan_salt"))
    keyed = sizes.withColumn("key", shuffle_key(F.col("doc_id"))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    rows = keyed.join(salted, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("salt") == F.col("plan_salt"))).drop("plan_source", "plan_salt", "salt")
    rows = rows.withColumn("prefix", F.substring("key", 1, 3))
    inner = Window.partitionBy("number", "prefix").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    heads = rows.groupBy("number", "prefix").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("number").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    rows = rows.join(heads.select("number", "prefix", before.alias("before")), ["number", "prefix"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "key", "prefix")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/streams")
    rows = spark.read.parquet(f"{folder}/streams")
    rounds = F.sequence(F.lit(0), F.floor((F.col("wanted") - 1 - F.col("start")) / F.col("source_size")))
    again = rows.filter("size > 0 AND start < wanted").withColumns({"each": F.floor(F.col("wanted") / F.col("n")), "over": F.col("wanted") % F.col("n"), "round": F.explode(rounds)})
    again = again.withColumn("begin", F.col("start") + F.col("round") * F.col("source_size"))
    again = again.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("wanted")))
    touched = again.select("row", "doc_id", "number", "begin", "end", F.explode(F.sequence(_rank(F.col("begin")), _rank(F.col("end") - 1))).alias("rank"))
    pieces = touched.join(taken.select("number", "rank", "slot", "first", "past"), ["number", "rank"])
    return rows, pieces.select("row", "doc_id", "slot", (F.greatest("begin", "first") - F.col("begin")).alias("from_word"), (F.least("end", "past") - F.greatest("begin", "first")).alias("words"))


def mix_sources(spark: SparkSession, docs: DataFrame, slots: int = 1 << 18, repeats: int = 3) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source."""
    rows, pieces = _streams(spark, docs, slots, repeats)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix_order(spark: SparkSession, docs: DataFrame, slots: int = 1 << 18, repeats: int = 3) -> DataFrame:
    """The mix itself, a row per piece: slot, doc_id, from_word and words. Read by slot, sources alternate by their targets all along."""
    return _streams(spark, docs, slots, repeats)[1].drop("row")


def apply_mix(spark: SparkSession, docs: DataFrame, slots: int = 1 << 18, repeats: int = 3) -> DataFrame:
    """The rows, with all their columns, as often as the mix takes them whole (a half counts as whole)."""
    names = docs.columns
    own_id, own_source, own_size, taken, words, times, copy = free_names(names, "mix_id", "mix_source", "mix_size", "mix_taken", "mix_words", "mix_times", "mix_copy")
    mixed = mix_sources(spark, docs, slots, repeats).filter("taken > 0")
    copies = mixed.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size)).agg(F.max("taken").alias(taken))
    sized = docs.withColumn(words, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.col(words) == F.col(own_size))
    joined = sized.join(copies, same).withColumn(times, F.floor(F.col(taken) / F.col(own_size) + 0.5).cast("int")).filter(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)

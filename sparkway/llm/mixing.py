"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets share the tokens of all sources by weight; no target exceeds ``most_epochs`` times its source, and what is over
goes to the others by weight.  A source's stream is its documents in shuffled order, anew for each epoch, cut into blocks
of ``block_words`` words that run over document ends.  The mix is a row of slots, one for each block to be taken:

* slots lie side by side on [0, N), every source holding as many as its target needs (the cumulative weights);
* van der Corput's sequence visits the cells of [0, 2^m), 2^m >= N, in bit-reversed order of time; cells from N on are
  nobody's.  So each source gets exactly its slots, evenly spread over time;
* slots are ranked per source by time, and the slot of rank r takes block r of the source's stream.

Running sums (ranks, stream positions, cumulative weights) are made in two levels, totals of small ranges
first, so no source is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import dense_ids
from .common import checkpointed, documents
from .skew import copied, with_facts

#: Rows of one range of a running sum.
RANGE_ROWS = 65_536
NO_WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, group: list[str], within: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group that come before: ranges (``within``, in order) first, then inside a range."""
    rows = rows.withColumn("_value", value)
    totals = rows.groupBy(*group, within).agg(F.sum("_value").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy(within).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*[F.col(c).alias(f"_{c}") for c in (*group, within)], before.cast("long").alias("_start"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*group, within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(c) == F.col(f"_{c}") for c in (*group, within)]
    summed = rows.withColumn("_inside", inside).join(starts, same)
    return summed.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).select(*[c for c in rows.columns if c != "_value"], name)


def shared(sources: DataFrame, most_epochs: int) -> DataFrame:
    """``sources`` (weight, source_size) with target: the share of all sizes by weight, at most ``most_epochs`` times the source.

    target = min(most_epochs * size, level * weight); each round sets the level that shares what the full sources leave, and
    the level only rises, until no further source is full.
    """
    most = F.col("source_size") * most_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = most <= F.col("weight") * level
        row = sources.agg(F.count_if(is_full).alias("n"), F.sum(F.when(is_full, most)).alias("held"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        if row["n"] == full or not row["open"]:
            return sources.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level if row["open"] else float("inf"))))
        full, level = row["n"], (total - (row["held"] or 0)) / row["open"]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, block_words: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(rows, schedule) of a mix of all documents.

    rows: row_id, doc_id, size, source, source_size, target, one for each row of ``docs``.  schedule: slot (time, with gaps), source, rank,
    row_id, epoch, from_word, n_words: what every slot takes of which document.  Slots of a source take ``floor(target)``
    words in all, so no document is taken more than ``most_epochs`` times.

    size: words ``[^\\x20\\x09-\\x0D]+`` (null text: none).  Sources go by code point, null last, and take the weights in turn.
    Documents without words have no schedule rows.  Shuffling follows from a row's content, not from its place; equal rows are
    numbered, and which of them is cut short is undetermined but as many are.  An empty table gives two
    empty ones; further columns are not read.  row_id is made of hash, size and number among equal rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(NO_WORD)).cast("long")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit("mix"), F.col(id_col).cast("long"), text).alias("mark"))
    equal = checkpointed(read.groupBy("doc_id", "size", "source", "mark").agg(F.count(F.lit(1)).alias("copies")))

    sizes = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_groups"))
    known = dense_ids(equal.where("source IS NOT NULL").select("source"), "source").select(F.col("source").alias("_source"), F.col("id").alias("source_id"))
    # null comes last: one past the ids of the others
    last = F.lit(known.count()).cast("long")
    sources = sizes.join(known, F.col("source") == F.col("_source"), "left").withColumn("source_id", F.coalesce("source_id", last)).drop("_source")
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    sources = shared(checkpointed(sources.withColumn("weight", turn)), most_epochs)
    sources = sources.withColumns({"whole": F.floor("target").cast("long"), "slots": F.ceil(F.floor("target") / block_words).cast("long")})
    # cumulative weights: the first cell of every source
    sources = sources.withColumns({"_one": F.lit(0), "_range": F.expr(f"source_id div {RANGE_ROWS}")})
    sources = checkpointed(running(sources, ["_one"], "_range", ["source_id"], F.col("slots"), "first_cell").select("source", "n_groups", "source_id", "source_size", "target", "whole", "slots", "first_cell"))

    cells = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (cells - 1).bit_length())
    celled = copied(sources.where("slots > 0"), "slots", "cell").withColumn("cell", F.col("first_cell") + F.col("cell"))
    slot = F.conv(F.reverse(F.lpad(F.bin("cell"), bits, "0")), 2, 10).cast("long")
    timed = celled.select("source_id", slot.alias("slot")).withColumn("span", F.expr(f"slot div {RANGE_ROWS}"))
    slots = running(timed, ["source_id"], "span", ["slot"], F.lit(1), "rank").drop("span")

    rows = with_facts(equal, sources, "source", "n_groups")
    epochs = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("whole") / F.col("source_size")) - 1)
    read_again = rows.where("size > 0 AND whole > 0").withColumn("epoch", F.explode(epochs)).withColumn("place", F.xxhash64("epoch", "mark", "doc_id", "size"))
    # ranges of the shuffled order: as many as hold RANGE_ROWS rows each if hashes are even
    ranges = max(1, -(-equal.count() // RANGE_ROWS))
    ranged = read_again.withColumn("span", F.floor((F.col("place").cast("double") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    placed = running(ranged, ["source_id", "epoch"], "span", ["place", "mark", "doc_id", "size"], F.col("size") * F.col("copies"), "offset")
    copies = copied(placed, "copies", "copy")
    copies = copies.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("copy") * F.col("size"))
    copies = copies.withColumn("stop", F.least(F.col("start") + F.col("size"), "whole")).where("start < stop")
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(stop - 1) div {block_words}"))))
    begin, end = F.greatest("start", F.col("rank") * block_words), F.least("stop", (F.col("rank") + 1) * block_words)
    pieces = pieces.select("source_id", "source", "rank", "mark", "doc_id", "size", "copy", "epoch", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"))
    row_id = F.struct("mark", "doc_id", "size", "copy")
    schedule = pieces.join(slots, ["source_id", "rank"]).select("slot", "source", "rank", row_id.alias("row_id"), "epoch", "from_word", "n_words")
    return copied(rows, "copies", "copy").select(row_id.alias("row_id"), "doc_id", "size", "source", "source_size", "target"), schedule


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each: sources weigh 1, 2, 3 in turn and are read three times at most."""
    rows, schedule = mixed(documents(spark, sf_dir))
    taken = schedule.groupBy("row_id", F.col("source").alias("_source")).agg(F.sum("n_words").alias("taken"))
    same = (F.col("rows.row_id") == F.col("taken.row_id")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = rows.alias("rows").join(taken.alias("taken"), same, "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

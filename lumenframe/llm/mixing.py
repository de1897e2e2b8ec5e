"""A mix of sources at target weights, as a schedule of equal-token blocks; DataFrame and SQL functions only.

* Each source's documents stand in a shuffled stream, once for each epoch, and the stream is cut into blocks of equal tokens.
* The mix is a row of slots. Slot i's point is the fractional part of i times the golden ratio, as a fraction of Fibonacci numbers:
  i F(k-1) mod F(k), over F(k), for F(k) slots. Points are exact, each occurs once, and any run of slots holds every source about in
  proportion. The point falls into the cumulative weights of the sources, and so names the slot's source.
* A source's slots, ranked in their order, take its blocks.

As the points are all numbers below F(k), the map is turned round: a source's range of points is written down in pieces, and a point's slot is
its product with the inverse of F(k-1). No table of sources is looked up by range, so none is broadcast.

Running sums and ranks are made in two levels: inside parts, and over the sums of parts. There are about as many parts as rows in one, the root
of all rows, so a source may hold any share of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace, integer_id

#: Tokens of a block, unless that makes more blocks than MOST_BLOCKS.
BLOCK = 4096
#: The largest schedule, a Fibonacci number: products of two numbers below it are exact in 64 bits.
MOST_BLOCKS = 1_836_311_903
#: How often a source is read at most: its target stops at so many times its size.
EPOCHS = 2
#: Points written from one row.
PIECE = 4096
#: Hexadecimal digits of a document's place in a shuffled stream, 60 bits.
DIGITS = 15


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def words(text: Column) -> Column:
    """The number of runs of characters that are no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text") -> DataFrame:
    """(row, doc, source, size) of each document; ``row`` tells rows of one id apart. size: words of the text, unless given."""
    size = words(docs[text_col].cast("string")) if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(integer_id(docs, id_col).alias("doc"), docs[source_col].cast("string").alias("source"), size.alias("size"))
    return Workspace(docs.sparkSession, "mix").save(rows.withColumn("row", F.monotonically_increasing_id()))


def _before(rows: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows before, of the same group, in the order of ``part`` and then ``order``."""
    sums = rows.groupBy(*within, "part").agg(F.sum(value).alias("sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(*within, "part", F.coalesce(F.sum("sum").over(earlier(Window.partitionBy(*within).orderBy("part"))), F.lit(0)).alias("parts_before"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*within, "part").orderBy(*order))), F.lit(0))
    return rows.withColumn("inside", inside).join(parts, [*within, "part"]).withColumn("before", F.col("parts_before") + F.col("inside")).drop("inside", "parts_before")


def sources(units: DataFrame) -> DataFrame:
    """(part, source, source_size, number): sources numbered from 0 in code-point order, null last."""
    work = Workspace(units.sparkSession, "sources")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.asc_nulls_last("source"))
    at = F.monotonically_increasing_id()
    rows = work.save(sizes.select("source", "source_size", at.alias("i"), F.shiftright(at, 33).alias("part"), F.lit(1).alias("one"), F.lit(0).alias("all")))
    return work.save(_before(rows, "one", ["i"], ["all"]).select("part", "source", "source_size", F.col("before").alias("number")))


def cycled(number: Column, weights: Sequence[float]) -> Column:
    """The weights in turn, for sources numbered from 0."""
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights) + 1).cast("int"))


def targets(rows: DataFrame, share: float, epochs: int = EPOCHS) -> DataFrame:
    """``rows`` (source_size, weight) with ``target``: ``share`` of all sizes by weight. A target stops at ``epochs`` times its source's size,
    and what is left over goes to the others by weight, until none is above.

    What is held back rises with the level, tokens for a weight of 1, so a round needs one sum over sources, and rounds end when no more sources
    stop. Null and negative weights count as 0."""
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    most = F.col("source_size") * epochs
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = F.lit(0.0), -1
    while True:
        stops = most < level * weight
        n, held, rest = rows.agg(F.count(F.when(stops, 1)), F.coalesce(F.sum(F.when(stops, most)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, weight)), F.lit(0.0))).first()
        left = max(total - held, 0.0)
        if n == stopped or not rest:
            open_target = F.lit(left) * weight / F.lit(rest) if rest else F.lit(0.0)
            return rows.withColumn("target", F.when(stops, most.cast("double")).otherwise(open_target))
        level, stopped = F.lit(left / rest), n


def _fibonacci(least: int) -> tuple[int, int]:
    """The first Fibonacci number of at least ``least`` and 2, and the one before it."""
    before, now = 1, 2
    while now < least:
        before, now = now, before + now
    return now, before


def schedule(planned: DataFrame) -> DataFrame:
    """(number, block, slot) of (part, number, blocks): every block of every source at its slot.

    Slots are below the first Fibonacci number that is enough; those that are left over, at the end, are nobody's."""
    spark, work = planned.sparkSession, Workspace(planned.sparkSession, "schedule")
    rows = work.save(_before(planned.select("part", "number", "blocks", F.lit(0).alias("all")), "blocks", ["number"], ["all"]))
    blocks = rows.agg(F.sum("blocks")).first()[0] or 0
    if blocks > MOST_BLOCKS:
        raise ValueError(f"{blocks} blocks are over {MOST_BLOCKS}: take larger ones")
    slots, step = _fibonacci(blocks)
    at = lambda c: _div(c * slots, max(blocks, 1))
    ranges = rows.where("blocks > 0").select("number", "blocks", at(F.col("before")).alias("low"), at(F.col("before") + F.col("blocks")).alias("high"))
    pieces = ranges.select("*", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(PIECE))).alias("start"))
    pieces = pieces.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots // (PIECE * 256)), "number", "start")
    points = pieces.select("number", "blocks", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + PIECE, F.col("high")) - 1)).alias("point"))
    placed = points.select("number", "blocks", F.pmod(F.col("point") * pow(step, -1, slots), F.lit(slots)).alias("slot"), F.lit(1).alias("one"))
    placed = work.save(placed.withColumn("part", _div(F.col("slot"), max(1, math.isqrt(slots)))))
    ranked = _before(placed, "one", ["slot"], ["number"])
    return ranked.where("before < blocks").select("number", F.col("before").alias("block"), "slot")


def _place(epoch: Column, seed: int) -> Column:
    """Where a document stands in the stream of an epoch: 60 bits that any SQL engine computes."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc").cast("string"), F.lit("")))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(DIGITS)), 16, 10).cast("long")


def mix(units: DataFrame, planned: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(slot, at, row, doc, source, epoch, start, length): the mix of ``sized`` documents to ``planned`` sources (part, source, source_size,
    number, target), piece by piece. A piece is ``length`` tokens of a document from its token ``start`` on, at place ``at`` of a slot.

    A source gives the whole tokens of its target, in blocks of ``block`` - more if there would be over ``MOST_BLOCKS`` - the last of which may be
    shorter. No document is read more than ``ceil(target / size of the source)`` times. The same documents make the same mix in any number of
    tasks; rows that are equal in id, source and size are interchangeable. Documents without tokens give no rows."""
    work = Workspace(units.sparkSession, "mix")
    take = F.floor("target").cast("long")
    n, tokens = units.count(), planned.agg(F.sum(take)).first()[0] or 0
    block = max(block, -(-2 * tokens // MOST_BLOCKS))
    planned = work.save(planned.select("part", "source", "source_size", "number", take.alias("take"), _div(take + block - 1, block).alias("blocks")))
    taken = planned.where("take > 0")
    rows = units.where("size > 0").join(taken.select(F.col("source").alias("of"), "number", "source_size", "take"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), _div(F.col("take") - 1, F.col("source_size")).cast("int"))))
    rows = rows.withColumn("place", _place(F.col("epoch"), seed))
    parts = max(1, math.isqrt(n))
    rows = rows.withColumn("part", _div(F.col("place"), -(-(16**DIGITS) // parts)))
    first = F.col("before") + F.col("epoch") * F.col("source_size")
    spans = _before(rows, "size", ["place", "doc", "row"], ["number", "epoch"]).select("*", first.alias("first"), F.least(first + F.col("size"), F.col("take")).alias("end")).where("first < end")
    own = F.explode(F.sequence(_div(F.col("first"), block), _div(F.col("end") - 1, block)))
    low = F.greatest("first", F.col("block") * block)
    pieces = spans.withColumn("block", own).select(
        "number", "block", "row", "doc", "source", "epoch", (low - F.col("block") * block).alias("at"), (low - F.col("first")).alias("start"), (F.least("end", (F.col("block") + 1) * block) - low).alias("length")
    )
    return pieces.join(schedule(planned), ["number", "block"]).select("slot", "at", "row", "doc", "source", "epoch", "start", "length")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, block: int = BLOCK, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, planned, mix) of a table of documents: ``sized`` rows, sources with targets, and the mix. Sources in code-point order, null
    last, weigh ``weights`` in turn, and share ``share`` times all tokens.

    A null source is a source; null and empty texts have no tokens and are never taken; repeated ids are documents of their own; an empty table
    gives empty tables; other columns are not read, whatever their names."""
    units = sized(docs, id_col, source_col, text_col=text_col)
    listed = sources(units)
    planned = targets(listed.withColumn("weight", cycled(F.col("number"), weights)), share)
    return units, planned, mix(units, planned, block, seed)


def per_document(units: DataFrame, planned: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc, source, size, source_size, target, taken), a row for each document: what the mix takes of it, repeats counted."""
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    plan = planned.select(F.col("source").alias("of"), "source_size", "target")
    rows = units.join(taken, "row", "left").join(plan, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

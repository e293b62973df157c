"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import unit_hash, word_count
from claimforge.llm.presence import whole_rows
from claimforge.operators.storage import materialize

#: Sources in order weigh 5, 2, 1, repeating; none is taken more than 3 times over.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Cells of a source grow in number and in size with the root of the table, so neither the list of cells nor a cell is
#: ever large: of 10 billion documents, 25,000 cells for each stratum of a source.
ROOT_SHARE = 4


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, source_docs, target): shares by weight, capped, the excess reshared.

    Resharing by weight until no source is above its cap ends where every source not capped has
    the same target per weight. Sources ordered by cap per weight are capped up to the first for
    which that level, reckoned without those before it, stays within its cap. One row per source
    goes to one task here, after a partial sum.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w.cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("rn"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(after).cast("double")
    levelled = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # The first source that isn't capped sets the level of all that follow it.
    chosen = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(chosen.isNull(), F.col("cap").cast("double")).otherwise(chosen * F.col("w"))
    return levelled.select("source", "source_size", "source_docs", target.alias("target"))


def stratum(size: Column) -> Column:
    """Documents of like size: the number of digits and the first one."""
    digits = size.cast("string")
    return F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, with_source: bool = False) -> DataFrame:
    """How often each document is taken: (doc_id, size, source_size, target, copies, taken).

    Every document of a source is expected ``target / source_size`` times. The documents of a
    source stand in one order (strata of size, salted cells, size, id); the running sum of
    expected copies, moved by one offset of the source, gives a copy for every integer that it
    crosses. As documents of like size are neighbours, the words taken stay near the target.

    The running sum is made in cells of some thousand documents: counts per cell are summed
    within a source, then documents are ranked inside their cell, so a hot source is never in
    one task. Reruns agree, as order and offset come from md5 of ids, source and seed.

    Null or empty text has size 0 and is sampled like any other. A null source is a source of its
    own and sorts last. Null ids, ties and repeated rows: rows that tie in the whole order are the same
    to the sum, so whichever gets a copy the counts are the same. An empty table gives no rows. Further columns are
    ignored.
    """
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sized")
    salts = max(1, math.ceil(math.sqrt(sized.count()) / ROOT_SHARE))
    salt = F.floor(unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))) * salts).cast("int")
    placed = sized.withColumns({"k": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), "stratum": stratum(F.col("size")), "salt": salt})
    targets = source_targets(sized, weights, max_epochs)
    # Rows: cells, of which a source has at most strata times salts.
    cells = placed.groupBy("k", "stratum", "salt").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    ahead = Window.partitionBy("k").orderBy("stratum", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    rates = targets.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("k"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)).alias("rate"),
        unit_hash(F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("\x00"))).alias("offset"),
    )
    cells = materialize(cells.join(rates, "k").select("k", "stratum", "salt", "ahead", "source_size", "target", "rate", "offset"), "mix-cells")
    inside = Window.partitionBy("k", "stratum", "salt").orderBy("size", "doc_id")
    rank = F.col("ahead") + F.row_number().over(inside)
    ranked = placed.join(cells.hint("merge"), ["k", "stratum", "salt"]).withColumn("rank", rank)
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(crossed, F.ceil("rate")).cast("long")
    extra = ["source"] if with_source else []
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *extra)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it.

    Rows that repeat an id share out that id's copies of like size and source: each is taken as often as its own
    place in the order says. Columns of any name come back as they were. Null texts, ids and sources are mixed like
    others; an empty table gives no rows. The texts are shuffled once, by id, whatever the table's size.
    """
    taken = mix(docs, id_col, source_col, text_col, with_source=True, **how).select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "copies")
    per_row = materialize(taken.groupBy("i", "s", "z").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-copies")
    keyed = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), whole_rows(docs).alias("row"))
    same = keyed["id"].eqNullSafe(per_row["i"]) & keyed["source"].eqNullSafe(per_row["s"]) & (keyed["size"] == per_row["z"])
    joined = keyed.join(per_row.where("copies > 0").hint("merge"), same)
    # Alike rows take turns: the first ones get one copy more where the sum isn't a multiple.
    sortable = [F.col("row")[f.name] for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    place = Window.partitionBy("id", "source", "size").orderBy(*sortable)
    single = joined.where("rows = 1").select("row", F.col("copies").alias("n"))
    several = joined.where("rows > 1").withColumn("rn", F.row_number().over(place))
    several = several.select("row", (F.floor(F.col("copies") / F.col("rows")) + (F.col("rn") <= F.col("copies") % F.col("rows")).cast("long")).cast("long").alias("n"))
    both = single.unionByName(several).where("n > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")

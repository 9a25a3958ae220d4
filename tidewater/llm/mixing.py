"""Mixing sources to target weights by a low-discrepancy schedule, DataFrame functions only.

Slot i of the schedule is the golden-ratio point i * phi mod 1, mapped through the sources' cumulative targets: the
sources alternate evenly at every length of the mix. A slot takes the next block of its source, blocks being equal
runs of words of the source's documents in hashed order, read again from the start when they are used up. What the
points leave a source short of its target, some blocks at most, it is granted in slots behind the schedule. Ranks of
slots and places of documents are sums over groups of groups, carried on level by level, so no source is one task.
Sums of groups, what sources lack and what is taken are small tables that are written, so that no plan holds another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.base import materialize, read

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; weights that repeat over the sources; uses of a document at most.
BLOCK_WORDS, WEIGHTS, MOST_USES = 64, (1, 2, 3), 3
#: Cells of [0, 1) by which points find their source; documents or slots of a group within which a running sum is kept.
CELLS, GROUP_ROWS = 4096, 4096
#: 2 ** 48 / golden ratio, odd: a slot's point is this times its number, modulo 2 ** 48, in exact integers.
PHI = int(2**47 * (5**0.5 - 1)) | 1


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_USES) -> DataFrame:
    """(source, source_size, target, low, high): the share of each source, and its range of [0, 1).

    Sharing the excess of capped sources again by weight until none is above its cap ends at one level: every
    source gets its weight times the level, or its cap if that is less. With the sources sorted by cap per unit of
    weight, the level is where the capped ones and the rest add up to the whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        # the level holds at the first source whose cap it doesn't pass; all before are at their caps
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("at")))).over(everything)["at"])
        .withColumn("target", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")))
    )
    so_far, whole = Window.orderBy(F.col("source").isNull(), "source"), F.nullif("total", F.lit(0.0))
    return per.select("source", "source_size", "target", (F.coalesce(F.sum("target").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / whole).alias("low"), (F.sum("target").over(so_far) / whole).alias("high"))


def running(df: DataFrame, keys: list[str], group: Column, order: list, value: str, out: str, levels: int = 2) -> DataFrame:
    """df with `out`, the sum of `value` over the rows of the same keys before this one, by group, then by order.

    Groups are small and many: their sums are added up first, group by group of GROUP_ROWS groups and so on for as many
    levels; then each group is summed by itself. No task holds more than a group, but for the last level's. The sums of
    the groups are written, as each level reads them twice.
    """
    rows = df.withColumn("_group", group)
    sums = rows.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum")).withColumnRenamed("_group", "_g")
    if levels > 1:
        sums = running(materialize(sums, "sums"), keys, F.floor(F.col("_g") / GROUP_ROWS), ["_g"], "_sum", "_before", levels - 1)
    else:
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_g").alias("_go"), F.col("_before").alias("_off"))
    within = Window.partitionBy(*keys, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = rows["_group"] == offsets["_go"]
    for k in keys:
        same = same & rows[k].eqNullSafe(offsets[f"_{k}"])
    return rows.join(offsets, same).withColumn(out, F.col("_off") + F.col("_within")).select(*df.columns, out)


def point(slot: Column) -> Column:
    """slot * PHI / 2 ** 48 modulo 1, in exact integers for slots up to 2 ** 48, by halves of 24 bits."""
    half = (1 << 24) - 1
    a, b = F.shiftright(slot, 24), slot.bitwiseAND(F.lit(half))
    high = (a * F.lit(PHI & half) + b * F.lit(PHI >> 24)).bitwiseAND(F.lit(half))
    return (high * F.lit(1 << 24) + b * F.lit(PHI & half)).bitwiseAND(F.lit((1 << 48) - 1)) / float(1 << 48)


def schedule(targets: DataFrame, n_slots: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, slot, rank): the source of each slot, and which of its source's slots it is.

    A source whose share is below a few points can get too few: what it lacks of its target's blocks follows in slots
    from n_slots on.
    """
    cells = targets.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    slots = targets.sparkSession.range(n_slots).withColumn("x", point(F.col("id"))).withColumn("cell", F.floor(F.col("x") * CELLS))
    dealt = slots.join(cells.select("source", "cell", "low", "high"), "cell").where("x >= low and x < high").select("source", F.col("id").alias("slot"), F.lit(1).cast("long").alias("one"))
    ranked = running(dealt, ["source"], F.floor(F.col("slot") / GROUP_ROWS), ["slot"], "one", "rank").select("source", "slot", "rank")
    have = dealt.groupBy("source").agg(F.count("*").alias("have")).withColumnRenamed("source", "_s")
    wanted = F.ceil(F.round("target") / block_words)
    short = targets.join(have, targets["source"].eqNullSafe(have["_s"]), "left").select("source", F.coalesce("have", F.lit(0)).alias("have"), (wanted - F.coalesce("have", F.lit(0))).alias("lack")).where("lack > 0")
    granted = running(materialize(short, "short"), [], F.pmod(F.xxhash64("source"), F.lit(GROUP_ROWS)), ["source"], "lack", "from").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)))
    return ranked.unionByName(granted.select("source", (F.lit(n_slots) + F.col("from") + F.col("k")).alias("slot"), (F.col("have") + F.col("k")).alias("rank")))


def _uses(sizes: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """sizes: (row, doc_id, source, size, place) -> what the mix takes of each row (row, taken, first_slot, n_slots), and the targets."""
    total, n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = materialize(source_targets(sizes), "targets")
    slots = schedule(targets, -(-total // block_words), block_words)
    groups = max(1, -(-n // GROUP_ROWS))
    placed = running(sizes.where("size > 0"), ["source"], F.pmod("place", F.lit(groups)), ["place", "doc_id", "row"], "size", "at")
    t = targets.select("source", F.col("source_size").alias("length"), F.round("target").cast("long").alias("wanted"))
    uses = placed.join(t, placed["source"].eqNullSafe(t["source"])).drop(t["source"])
    # where the document stands in its source read over and over, cut at the target
    uses = uses.withColumn("from", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_USES - 1)), lambda e: F.col("at") + e * F.col("length")))).where("from < wanted")
    uses = uses.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("wanted")))
    uses = uses.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))))
    words = F.least(F.col("to"), (F.col("block") + 1) * block_words) - F.greatest(F.col("from"), F.col("block") * block_words)
    blocks = slots.select(F.col("source").alias("slot_source"), "slot", "rank")
    took = uses.join(blocks, (F.col("block") == F.col("rank")) & F.col("source").eqNullSafe(F.col("slot_source"))).groupBy("row").agg(F.sum(words).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    return materialize(took, "took"), targets


def _sizes(docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(source_col), F.lit("")), F.lit("mix"))
    return docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), place.alias("place"), *(c.alias("mark") for c in more))


def _said(rows: DataFrame, took: DataFrame, targets: DataFrame, *columns: str) -> DataFrame:
    """rows with what is taken of each, and with the size and target of its source."""
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    out = rows.join(took, "row", "left").join(t, rows["source"].eqNullSafe(t["_source"]))
    return out.select(*columns, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target (of the source), taken, first_slot, n_slots.

    taken counts the words that the mix takes, repeats counted; first_slot is the first slot of the schedule that holds
    words of the document (null if none does), n_slots how often a slot does. The schedule has as many words as the
    corpus; a source's slots beyond its target are void, and no document is used more than three times. A null or empty
    text has size 0, a null source is a source of its own that comes last, a null doc_id keeps its row. Rows that repeat
    are documents of their own, in the order they are read. Without any words nothing is taken and targets are 0; an
    empty table gives no rows. A long text is many blocks. Other columns are not looked at, whatever their names.
    """
    sizes = materialize(_sizes(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), "sizes")
    took, targets = _uses(sizes, block_words)
    return _said(sizes, took, targets, "doc_id", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus: the columns of docs with size, source_size, target, taken, first_slot and n_slots of mix.

    One row per row of docs, read n_slots times from first_slot on; rows of which nothing is taken stay, with taken 0. A
    column of docs that has one of the six names is replaced. Nulls, repeats, long and empty texts count as in mix.

    docs is read twice, and its rows are numbered each time by their place in the scan, so it has to be files; a row
    whose text is another the second time fails the query.
    """
    mark = F.xxhash64(F.col(id_col).cast("string"), text_col)
    row = F.monotonically_increasing_id()
    sizes = materialize(_sizes(docs, row, id_col, text_col, source_col, mark), "sizes")
    took, targets = _uses(sizes.drop("mark"), block_words)
    said = _said(sizes, took, targets, F.col("row").alias("_row"), F.col("mark").alias("_mark"))
    new = [c for c in said.columns if not c.startswith("_")]
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), row.alias("row"), mark.alias("mark")).join(said, F.col("row") == F.col("_row"), "left")
    size = F.when(F.col("mark") == F.col("_mark"), F.col("size")).otherwise(F.raise_error(F.lit("rows are numbered otherwise when read again; write them to files first")).cast("long"))
    return rows.withColumn("size", size).select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in new), *new)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")

"""Saved positions: making them, and finding their places again in a revised work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import utf16_length, utf16_slice
from vellum.sources.scratch import kept

CONTEXT, LEAST = 24, 6
#: Characters of the runs by which a context is looked up.
LONG_RUN, SHORT_RUN = 8, 3
#: Different contexts of a work up to which its texts are searched for each; beyond, contexts are looked up by runs.
FEW = 64


def make_positions(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions from wanted (position_id, work_id, block_id, offset): context on both sides and the share of the work.

    blocks are block_offsets' rows. Offsets outside their block, and unknown blocks, give no position."""
    # a wanted block is found without texts; then these move once, to its number
    found = wanted.join(blocks.drop("text"), ["work_id", "block_id"]).where("offset >= 0 AND offset <= size")
    j = found.join(blocks.select("work_id", "block_no", "text"), ["work_id", "block_no"])
    start = F.greatest(F.col("offset") - CONTEXT, F.lit(0))
    share = F.when(F.col("total") == 0, 0.0).otherwise((F.col("at") + F.col("offset")) / F.col("total"))
    return j.select("position_id", "work_id", "block_id", "offset", utf16_slice(F.col("text"), start, F.col("offset") - start).alias("before"), utf16_slice(F.col("text"), F.col("offset"), F.lit(CONTEXT)).alias("after"), share.alias("percent"))


def _sound(saved: DataFrame) -> DataFrame:
    b, a = utf16_length(F.col("before")), utf16_length(F.col("after"))
    return saved.where(F.col("block_id").isNotNull() & F.coalesce((F.col("offset") >= b) & (b <= CONTEXT) & (a <= CONTEXT), F.lit(False)))


def restore_exact(saved: DataFrame, blocks: DataFrame) -> DataFrame:
    """(position_id, how, block_id, offset) where the block of that ID still has the context around the offset.

    Where other blocks have its text and kind of ID too, the nearest by share is taken, as ``context``."""
    family = F.regexp_extract("block_id", "^(p-[0-9a-f]+)", 1)
    s = _sound(saved).select("position_id", "work_id", "block_id", family.alias("family"), "offset", "before", "after", F.coalesce("percent", F.lit(0.0)).alias("percent"))
    held = blocks.select("work_id", family.alias("family"), F.col("block_id").alias("twin"), F.col("at").alias("twin_at"), "block_no", "size", "total")
    b, a = utf16_length(F.col("before")), utf16_length(F.col("after"))
    there = (F.col("offset") <= F.col("size")) & (utf16_slice(F.col("text"), F.col("offset") - b, b) == F.col("before")) & (utf16_slice(F.col("text"), F.col("offset"), a) == F.col("after"))
    far = F.abs((F.col("twin_at") + F.col("offset")) / F.col("total") - F.col("percent"))
    nearest = F.min(F.struct(far.alias("far"), F.col("block_no").alias("twin_no"), "twin")).alias("t")
    # the block and all that may be its twins have its kind of ID; their texts move once, to the numbers of these
    kin = s.where("family <> ''").join(held, ["work_id", "family"]).join(blocks.select("work_id", "block_no", "text"), ["work_id", "block_no"])
    alike = kin.groupBy(*s.columns, "text").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("twin") == F.col("block_id")) & there).alias("own"), nearest).where("own").select("position_id", "offset", "n", "t")
    if not s.where("family = ''").isEmpty():  # IDs of another make tell nothing of the text, so it is the key
        known = blocks.select("work_id", "block_id", "size", "text")
        same = s.where("family = ''").join(known, ["work_id", "block_id"]).where(there).drop("size", "block_id")
        twins = held.drop("size").join(blocks.select("work_id", "block_no", "text"), ["work_id", "block_no"]).where("family = ''")
        alike = alike.unionByName(same.join(twins, ["work_id", "family", "text"]).groupBy("position_id", "offset").agg(F.count(F.lit(1)).alias("n"), nearest))
    near = alike.groupBy("position_id", "offset").agg(F.sum("n").alias("n"), F.min("t").alias("t"))
    return near.select("position_id", F.when(F.col("n") == 1, "exact").otherwise("context").alias("how"), F.col("t.twin").alias("block_id"), "offset")


def _grams(text: Column, q: int) -> Column:
    """Hashes of the different runs of ``q`` characters of a text, none for a shorter text."""
    of = lambda chars: F.when(F.size(chars) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - q + 1), lambda i: F.xxhash64(F.slice(chars, i, q)))))
    # a lambda's variable holds the characters, so that they are split once a text
    return F.coalesce(F.transform(F.array(F.split(text, "")), of)[0], F.array().cast("array<bigint>"))


def _places(needles: DataFrame, texts: DataFrame, q: int) -> DataFrame:
    """(work_id, needle, text_id) of the texts that may hold a needle: those with the rarest of its runs of ``q`` characters.

    Runs are looked up by work and hash. A needle with a run that no text of its work has is left out."""
    asked = needles.select("work_id", "needle", F.explode(_grams(F.col("needle"), q)).alias("gram"))
    held = texts.join(needles.select("work_id").distinct(), "work_id", "left_semi").select("work_id", "text_id", F.explode(_grams(F.col("text"), q)).alias("gram"))
    held = kept(held.join(asked.select("work_id", "gram").distinct(), ["work_id", "gram"], "left_semi"))
    often = held.groupBy("work_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(often, ["work_id", "gram"], "left").groupBy("work_id", "needle").agg(F.min(F.struct("n", "gram")).alias("rarest"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    probes = counted.where("all").select("work_id", "needle", F.col("rarest.gram").alias("gram"))
    return probes.join(held, ["work_id", "gram"]).select("work_id", "needle", "text_id")


def _hits(texts: DataFrame, near: DataFrame) -> DataFrame:
    """(work_id, needle, places, block_id, at): how often a needle is in the texts that near pairs it with, by the columns that
    both have; place and ID are right where there is one."""
    on = [c for c in near.columns if c in texts.columns]
    # a text that lacks the needle goes no further than the join
    found = texts.select(*on, "text", "times", "block_id").alias("t").join(near.alias("n"), [F.col(f"t.{c}") == F.col(f"n.{c}") for c in on] + [F.expr("contains(t.text, n.needle)")])
    found = found.select("n.work_id", "n.needle", "t.text", "t.times", "t.block_id").withColumn("p", F.expr("locate(needle, text)"))
    twice = F.expr("locate(needle, text, p + 1)") > 0
    return found.groupBy("work_id", "needle").agg(F.sum(F.when(twice, 2).otherwise(1) * F.col("times")).alias("places"), F.min("block_id").alias("block_id"), F.min(utf16_length(F.expr("substring(text, 1, p - 1)"))).alias("at"))


def restore_context(saved: DataFrame, blocks: DataFrame, few: int = FEW) -> DataFrame:
    """The same where the context, of at least six units, occurs at exactly one place of the work.

    Equal contexts of a work are looked for once. A work's texts are searched as they are for each of up to ``FEW`` contexts,
    which costs less than the runs of its characters. Where there are more, equal texts are looked at once, and a context
    is looked up by its rarest run of eight characters, or of three if it is shorter (six units are three characters at
    least); what is found is verified. So no position meets all blocks of a work that has many, and a context or text that
    is there many times counts once.
    """
    s = _sound(saved).select("position_id", "work_id", "before", F.concat("before", "after").alias("needle"))
    s = s.where(utf16_length(F.col("needle")) >= LEAST)
    different = s.select("work_id", "needle").distinct()
    needles = kept(different.join(different.groupBy("work_id").agg((F.count(F.lit(1)) > few).alias("many")), "work_id"))
    places = _hits(blocks.where("text <> ''").withColumn("times", F.lit(1)), needles.where("NOT many").select("work_id", "needle"))
    if not needles.where("many").isEmpty():
        needles = needles.where("many").select("work_id", "needle")
        crowded = blocks.where("text <> ''").join(needles.select("work_id").distinct(), "work_id", "left_semi")
        same = crowded.groupBy("work_id", "text").agg(F.count(F.lit(1)).alias("times"), F.min("block_id").alias("block_id"))
        texts = kept(same.withColumn("text_id", F.monotonically_increasing_id()))
        long = F.char_length("needle") >= LONG_RUN
        near = _places(needles.where(long), texts, LONG_RUN).unionAll(_places(needles.where(~long), texts, SHORT_RUN))
        places = places.unionByName(_hits(texts, near))
    one = s.join(places.where("places = 1"), ["work_id", "needle"])
    return one.select("position_id", F.lit("context").alias("how"), "block_id", (F.col("at") + utf16_length(F.col("before"))).alias("offset"))


def restore_percent(saved: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same by the share of the work alone; the end is the last block's. Works without text give no place.

    Positions are sorted in among their work's blocks, so each block is read once however many positions there are."""
    last = blocks.groupBy("work_id").agg(F.max_by(F.struct("block_id", "at"), "block_no").alias("end"), F.max("total").alias("total"))
    share = F.when(F.isnan("percent") | F.col("percent").isNull() | (F.abs("percent") == float("inf")), 0.0).otherwise(F.col("percent"))
    target = F.least(F.col("total"), F.greatest(F.lit(0), F.floor(share * F.col("total") + 0.5))).cast("long")
    s = saved.select("position_id", "work_id", "percent").join(last, "work_id").where("total > 0").select("position_id", "work_id", "end", "total", target.alias("place"))
    held = blocks.where("size > 0").select("work_id", F.col("at").alias("place"), F.lit(0).alias("kind"), F.struct("block_id", "at").alias("block"))
    asked = s.select("work_id", "place", F.lit(1).alias("kind"), "position_id", "end", "total")
    before = Window.partitionBy("work_id").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = held.unionByName(asked, allowMissingColumns=True).withColumn("inside", F.last("block", ignorenulls=True).over(before)).where("kind = 1")
    found = F.when(F.col("place") == F.col("total"), F.col("end")).otherwise(F.col("inside"))
    return rows.select("position_id", F.lit("percent").alias("how"), found["block_id"].alias("block_id"), (F.col("place") - found["at"]).alias("offset"))


def restore_positions(saved: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each saved position's place: exact, else by context, else by share; none where the work has no text.

    Each way sees only what those before it left."""
    exact = kept(restore_exact(saved, blocks))
    left = saved.join(exact.select("position_id"), "position_id", "left_anti")
    context = kept(restore_context(left, blocks))
    share = restore_percent(left.join(context.select("position_id"), "position_id", "left_anti"), blocks)
    return exact.unionByName(context).unionByName(share).select("position_id", "how", "block_id", "offset")

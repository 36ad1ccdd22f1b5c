"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every document starts with the same fractional number of copies as its source: target words over source
words. The whole part is sure. The fractions are rounded in pairs: two documents exchange copies such
that their words in sum stay the same, up or down by chance, until one of them is integral; the other one
meets the next document. The chances keep each document's expected copies. A block of documents ends with one
fraction at most, which goes up a reduction tree of blocks; the last one of a source is rounded by itself, so
a source misses its target by the words of one document at most.

Chance is a hash of the seed, the two documents and the level, so reruns agree. Blocks are small groups of a hashed
document id, so a source with a third of all rows is many blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import WORD, stored, whole_row

FAN_IN = 48
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, size -> one row per source: source, source_size, target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words. A target stops at
    max_repeats times its source; the excess goes to the others by weight. That has a closed form: a source stops
    if its cap over its weight is below the common level, and the level is what is left over the weights that are left. The table has one row
    per source, so one window over it may be global."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("_w", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double")).withColumn("_cap", (max_repeats * F.col("source_size")).cast("double"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    leveled = weighed.withColumn("_level", level)
    # the first source that does not stop sets the level of all from there on
    free = leveled.withColumn("_free", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(everything))
    target = F.when(F.col("_cap") / F.col("_w") < F.col("_free.r"), F.col("_cap")).otherwise(F.least(F.col("_free.l") * F.col("_w"), F.col("_cap")))
    return free.select("source", "source_size", F.coalesce(target, F.col("_cap")).alias("target"))


def _chance(*of: Column) -> Column:
    """Uniform in [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def _pivot(units: Column, seed: int, level: int) -> Column:
    """Rounds an array of (id, size, copies, frac) by pairs. Gives (open: the one that is left with a fraction or null,
    done: the others with whole copies)."""
    tiny = 1e-9
    kind = "struct<id:struct<doc_id:bigint,size:bigint,nth:bigint>,size:bigint,copies:bigint,frac:double>"

    def settled(u: Column, frac: Column) -> Column:
        return F.struct(u["id"].alias("id"), u["size"].alias("size"), (u["copies"] + F.round(frac).cast("long")).alias("copies"), F.lit(0.0).alias("frac"))

    def still(u: Column, frac: Column) -> Column:
        return F.struct(u["id"].alias("id"), u["size"].alias("size"), u["copies"].alias("copies"), frac.alias("frac"))

    def whole(f: Column) -> Column:
        return (f < tiny) | (f > 1 - tiny)

    def meet(state: Column, b: Column) -> Column:
        a = state["open"]
        sa, sb = a["size"].cast("double"), b["size"].cast("double")
        # up: words from b to a, down: from a to b, each until one of the two is integral
        up = F.least((1 - a["frac"]) * sa, b["frac"] * sb)
        down = F.least(a["frac"] * sa, (1 - b["frac"]) * sb)
        goes_up = _chance(F.lit(seed), F.lit(level), a["id"], b["id"]) * (up + down) < down
        fa = a["frac"] + F.when(goes_up, up).otherwise(-down) / sa
        fb = b["frac"] - F.when(goes_up, up).otherwise(-down) / sb
        a_left = ~whole(fa)
        b_left = ~whole(fb)
        left = F.when(a_left, still(a, fa)).when(b_left, still(b, fb)).otherwise(F.lit(None).cast(kind))
        out = F.when(a_left, F.array(settled(b, fb))).when(b_left, F.array(settled(a, fa))).otherwise(F.array(settled(a, fa), settled(b, fb)))
        met = F.struct(left.alias("open"), F.concat(state["done"], out).alias("done"))
        alone = F.struct(b.cast(kind).alias("open"), state["done"].alias("done"))
        certain = F.struct(a.alias("open"), F.concat(state["done"], F.array(settled(b, b["frac"]))).alias("done"))
        return F.when(whole(b["frac"]) | (b["size"] == 0), certain).when(a.isNull(), alone).otherwise(met)

    zero = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(units, zero, meet)


def mix_units(units: DataFrame, seed: int = 42, max_repeats: int = MAX_REPEATS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size -> one row per row: doc_id, size, nth, source, source_size, target, copies. size: words, not null.

    nth tells rows apart that agree in doc_id, source and size. copies is between 0 and max_repeats. Documents
    without words and sources without words take no copies. Null ids and sources are values like others. An empty
    table gives no rows."""
    units = stored(units.select("doc_id", "source", F.col("size").cast("long").alias("size")), "sizes")
    same = units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m"))
    rows = same.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m")
    targets = stored(source_targets(units, max_repeats), "targets")
    most = units.count()
    share = F.least(F.col("_t.target") / F.col("_t.source_size"), F.lit(float(max_repeats)))
    rate = F.when((F.col("size") > 0) & (F.col("_t.source_size") > 0), share).otherwise(F.lit(0.0))
    base = F.floor(rate + 1e-12).cast("long")
    blocks = max(1, -(-most // fan_in))
    level0 = rows.alias("r").join(targets.withColumnRenamed("source", "_source").alias("_t"), F.col("r.source").eqNullSafe(F.col("_t._source"))).select(
        "source", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "nth"), F.lit(blocks)).alias("block"),
        F.struct(F.struct("doc_id", "size", "nth").alias("id"), F.col("size").alias("size"), base.alias("copies"), F.greatest(rate - base, F.lit(0.0)).alias("frac")).alias("unit"))
    done, level, open_ = [], 0, level0
    while True:
        last = blocks <= 1
        state = open_.groupBy("source", "source_size", "target", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
        state = stored(state.select("source", "source_size", "target", "block", _pivot(F.col("units"), seed, level).alias("s")), "mix")
        done.append(state.select("source", "source_size", "target", F.inline("s.done")))
        left = state.where("s.open is not null").select("source", "source_size", "target", (F.col("block") / fan_in).cast("long").alias("block"), F.col("s.open").alias("unit"))
        if last:
            u = F.col("unit")
            # with its chance, so that its expected copies stay
            got = u["copies"] + (_chance(F.lit(seed), F.lit(-1), u["id"]) < u["frac"]).cast("long")
            done.append(left.select("source", "source_size", "target", u["id"].alias("id"), u["size"].alias("size"), got.alias("copies"), F.lit(0.0).alias("frac")))
            break
        blocks, level, open_ = -(-blocks // fan_in), level + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id.doc_id", "id.size", "id.nth", "source", "source_size", "target", "copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, seed: int = 42, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is taken; doc_id, source and text decide.

    Rows that agree in doc_id, source and size share their copies, first by text."""
    sized = docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("_size"), whole_row(docs).alias("_row"))
    copies = mix_units(sized.select("doc_id", "source", F.col("_size").alias("size")), seed, max_repeats)
    summed = copies.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.sum("copies").alias("_c"), F.count("*").alias("_m"))
    both = sized.join(summed, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    alone = both.where("_m = 1").withColumn("_n", F.lit(0))
    shared = both.where("_m > 1").withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy("text")) - 1)
    taken = alone.unionByName(shared).withColumn("_take", F.floor(F.col("_c") / F.col("_m")) + (F.col("_n") < F.col("_c") % F.col("_m")).cast("long"))
    return taken.where("_take > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take").cast("long")))).select("_row.*")

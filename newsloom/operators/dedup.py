"""De-duplication: exact by key, and greedy by headline similarity within a time band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import title_tokens
from ..lineage import cut

#: How alike headlines must be, and how close in time.
THRESHOLD, BAND_S = 0.45, 7200


def first_of_each(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def _headlines(df: DataFrame, id_col: str, title: Column, at: Column, band_s: int, keep_marks: bool, *more: Column) -> DataFrame:
    """(id, at, words, slot, cls, *more): rows with the same words in the same slot of time have one class."""
    t = df.select(F.col(id_col).alias("id"), at.cast("long").alias("at"), F.array_sort(title_tokens(F.coalesce(title, F.lit("")), keep_marks)).alias("words"), *more).where("at IS NOT NULL AND size(words) > 0")
    return t.withColumn("slot", F.floor(F.col("at") / band_s)).withColumn("cls", F.xxhash64("words", "slot"))


def _alike(t: DataFrame, threshold: float) -> DataFrame:
    """(c, d, similarity), c < d: different classes of the same slot or neighbouring ones whose words are alike.

    Two such headlines share one of their rarest words, so that is what they are joined on; words of
    all headlines never make pairs, and a headline of many rows is one class.
    """
    one = cut(t.select("cls", "slot", "words").dropDuplicates(["cls"]), "classes")
    each = one.select("cls", "slot", F.size("words").alias("size"), F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    n = F.row_number().over(Window.partitionBy("cls").orderBy("df", "word"))
    prefix = each.join(often, "word").withColumn("n", n).where(F.col("n") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    a = prefix.select(F.col("cls").alias("c"), "word", "slot")
    b = prefix.select(F.col("cls").alias("d"), "word", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    pairs = a.join(b, ["word", "slot"]).where(F.col("c") < F.col("d")).select("c", "d").distinct()
    wc, wd = one.select(F.col("cls").alias("c"), F.col("words").alias("wc")), one.select(F.col("cls").alias("d"), F.col("words").alias("wd"))
    both = F.size(F.array_intersect("wc", "wd"))
    out = pairs.join(wc, "c").join(wd, "d").select("c", "d", (both / (F.size("wc") + F.size("wd") - both)).alias("similarity"))
    return out.where(F.col("similarity") >= threshold)


def title_pairs(df: DataFrame, id_col: str, title: Column, at: Column, threshold: float = THRESHOLD, band_s: int = BAND_S, keep_marks: bool = False) -> DataFrame:
    """(a, b, similarity) of rows with headlines at least so alike and times (seconds) at most so far apart; a < b.

    Headlines are compared by classes; the pairs of rows that are asked for are made last.
    ``greedy_alike`` needs no pairs.
    """
    t = cut(_headlines(df, id_col, title, at, band_s, keep_marks), "headlines")
    links = _alike(t, threshold)
    same = t.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("c"), F.col("cls").alias("d"), F.lit(1.0).alias("similarity"))
    x = t.select(F.col("cls").alias("c"), F.col("id").alias("x"), F.col("at").alias("at_x"))
    y = t.select(F.col("cls").alias("d"), F.col("id").alias("y"), F.col("at").alias("at_y"))
    met = links.unionByName(same).join(x, "c").join(y, "d").where((F.abs(F.col("at_x") - F.col("at_y")) <= band_s) & ((F.col("c") != F.col("d")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def greedy_alike(df: DataFrame, id_col: str, title: Column, at: Column, *order: Column, threshold: float = THRESHOLD, band_s: int = BAND_S, keep_marks: bool = False, max_rounds: int = 1000) -> DataFrame:
    """(id, owner): each row in order is kept (owner is itself) unless its headline is alike that of a kept row before it and near in time; then the first of those owns it.

    As ``greedy`` over the pairs of ``title_pairs``, but without pairs: rows look at the classes of
    headlines that are alike theirs. Rows of one class all match, so a class keeps one row at most.
    Every round gives up all rows that a kept row before them matches, and keeps each row that no
    undecided row comes before in any class it looks at.
    """
    keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(id_col).alias("id")).alias("key")
    t = cut(_headlines(df, id_col, title, at, band_s, keep_marks, keys), "headlines")
    links = _alike(t, threshold)
    looks = links.select("c", "d").unionByName(links.select(F.col("d").alias("c"), F.col("c").alias("d"))).select(F.col("c").alias("cls"), F.col("d").alias("g"))
    own = t.select("id", "at", "key", F.col("cls").alias("g"), F.lit(True).alias("own"))
    table = own.unionByName(t.select("id", "at", "key", "cls").join(looks, "cls").select("id", "at", "key", "g", F.lit(False).alias("own")))
    several = table.groupBy("g").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("g")
    base = open_ = cut(table.join(several, "g", "left_semi"), "looks")
    taken: DataFrame | None = None
    given_up: list[DataFrame] = []
    for _ in range(max_rounds):
        if taken is not None:
            lost = cut(_matched(open_, taken, band_s).select("id").distinct(), "lost")
            given_up.append(lost)
            open_ = open_.join(lost, "id", "left_anti")
        first = open_.where("own").groupBy("g").agg(F.min("key").alias("first"))
        ready = open_.join(first, "g", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("first") >= F.col("key"), F.lit(True))).alias("kept"))
        state = cut(open_.join(ready, "id"), "state")
        won = state.where("kept AND own").select("g", "id", "at", "key")
        taken = won if taken is None else taken.unionByName(won)
        open_ = state.where("NOT kept").drop("kept")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    out = df.select(F.col(id_col).alias("id"))
    if not given_up:
        return out.select("id", F.col("id").alias("owner"))
    lost = given_up[0]
    for x in given_up[1:]:
        lost = lost.unionByName(x)
    # owners are looked for last: the first kept row may have been kept after the one that decided
    owners = _matched(base.join(lost, "id", "left_semi"), taken, band_s).groupBy("id").agg(F.min_by("owner", "key_k").alias("owner"))
    return out.join(owners, "id", "left").select("id", F.coalesce("owner", "id").alias("owner"))


def _matched(looks: DataFrame, taken: DataFrame, band_s: int) -> DataFrame:
    """(id, owner, key_k): rows with the kept rows before them that they match."""
    k = taken.select("g", F.col("at").alias("at_k"), F.col("key").alias("key_k"), F.col("id").alias("owner"))
    return looks.join(k, "g").where((F.col("key_k") < F.col("key")) & (F.abs(F.col("at_k") - F.col("at")) <= band_s)).select("id", "owner", "key_k")


def greedy(df: DataFrame, id_col: str, pairs: DataFrame, *order: Column, max_rounds: int = 1000) -> DataFrame:
    """(id, owner): each row in order is kept (owner is itself) unless it pairs with a kept row before it; then the first of those owns it.

    Decided in rounds over the rows that have pairs at all: a row all of whose earlier partners are
    given up is kept, a row with a kept earlier partner is given up. Every round decides the first
    undecided row at least; what it decides is final.
    """
    rows = df.select(F.col(id_col).alias("id"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(id_col).alias("id")).alias("key"))
    touched = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ranked = rows.join(touched, "id", "left_semi")
    x, y = ranked.select(F.col("id").alias("a"), F.col("key").alias("ka")), ranked.select(F.col("id").alias("b"), F.col("key").alias("kb"))
    both = pairs.join(x, "a").join(y, "b")
    first = F.col("ka") < F.col("kb")
    links = cut(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), F.when(first, F.col("ka")).otherwise(F.col("kb")).alias("key")), "links")
    open_ = cut(touched.withColumn("kept", F.lit(None).cast("boolean")), "state")
    done = None
    for _ in range(max_rounds):
        early = links.join(open_.select(F.col("id").alias("late")), "late", "left_semi").join((open_ if done is None else open_.unionByName(done)).select(F.col("id").alias("early"), F.col("kept").alias("was")), "early")
        seen = early.groupBy(F.col("late").alias("id")).agg(F.bool_or(F.coalesce("was", F.lit(False))).alias("lost"), F.bool_or(F.col("was").isNull()).alias("wait"))
        state = open_.select("id").join(seen, "id", "left").select("id", F.when(F.col("lost"), False).when(F.coalesce("wait", F.lit(False)), None).otherwise(True).alias("kept"))
        state = cut(state, "state")
        now = state.where("kept IS NOT NULL")
        done = now if done is None else done.unionByName(now)
        open_ = state.where("kept IS NULL")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    kept = done.where("kept").select(F.col("id").alias("early"))
    owners = links.join(kept, "early", "left_semi").groupBy(F.col("late").alias("id")).agg(F.min_by("early", "key").alias("owner"))
    lost = done.where("NOT kept").select("id").join(owners, "id")
    return rows.select("id").join(lost, "id", "left").select("id", F.coalesce("owner", "id").alias("owner"))


def coverage(df: DataFrame, owners: DataFrame, id_col: str = "id") -> DataFrame:
    """The kept rows with coverage_count, alternate_source_ids and image_url of all the rows they own.

    ``df`` has id, source_id, image_url and ord (its place in the order). Alternates are the other
    outlets in order, null if there are none; the picture is the first there is, the row's own first.
    """
    t = df.join(owners.withColumnRenamed("id", id_col), id_col)
    has = F.coalesce("image_url", F.lit("")) != ""
    own = F.col(id_col) == F.col("owner")
    agg = t.groupBy("owner").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"])).alias("outlets"),
        F.max(F.when(own, F.col("source_id"))).alias("source_id"),
        F.min_by(F.when(has, F.col("image_url")), F.when(has, F.struct((~own).alias("other"), F.col("ord")))).alias("image_url"),
    )
    others = F.filter("outlets", lambda s: s != F.col("source_id"))
    return agg.select(F.col("owner").alias(id_col), "source_id", F.size("outlets").alias("coverage_count"), F.when(F.size(others) > 0, others).alias("alternate_source_ids"), "image_url")

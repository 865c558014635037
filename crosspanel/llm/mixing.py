"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the same copy rate as its source: the whole part is certain, the fraction is a probability. Within a block
the documents fight in turn: the one carried along and the next exchange mass, measured in words, until the chance of one
is 0 or 1; the other is carried on. The last of a block is its residual; residuals go up a reduction tree, block by block,
until one document per source is left. So a source's words differ from its target by less than one document, and
every document's expected number of copies is its rate.

Everything is a DataFrame or SQL function; draws are hashes of ids and seed, so reruns agree. Rows with the same id, source and
size are first counted: of m such rows the whole part of m times the fraction is certain and one of them carries the rest.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take no part and get the whole part of the rate; rows with a null id are told apart by source and size only; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, materialize, settle, uniform

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents per block of the reduction tree.
BLOCK = 64
#: Most sources whose table may be sent to every task; beyond it the join is salted.
SMALL_SOURCES = 10_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target. A target stops at `most` times its source's size; the excess is shared anew by weight.

    The end of that sharing has a closed form: in the order of size over weight, the first sources are full and the others
    share what is left by weight. The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", F.when(level * F.col("weight") < F.col("limit"), level))
    level = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return by.withColumn("target", F.coalesce(F.least(level * F.col("weight"), F.col("limit")), F.col("limit"))).select("source", "source_size", "n_docs", "target")


def _join_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows with the columns of their source; a source may hold a third of the rows."""
    renamed = sources.withColumnRenamed("source", "of_source")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if n_sources <= SMALL_SOURCES:
        return rows.join(F.broadcast(renamed), same).drop("of_source")
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    renamed = renamed.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(renamed, same & (F.col("salt") == F.col("of_salt"))).drop("of_source", "salt", "of_salt")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _fight(a: Column, b: Column, seed: int) -> Column:
    """struct(a, b) with the chances after the exchange: the sum of chance times size is kept, and one chance is 0 or 1."""

    def exchanged(t: Column) -> Column:
        a, b = t["a"], t["b"]
        up = F.least((1 - a["f"]) * a["size"], b["f"] * b["size"])
        down = F.least(a["f"] * a["size"], (1 - b["f"]) * b["size"])
        return _let(F.struct(a.alias("a"), b.alias("b"), up.alias("up"), down.alias("down"), uniform(a["h"], b["h"], a["doc_id"], b["doc_id"], seed=seed).alias("u")), moved)

    def moved(t: Column) -> Column:
        a, b, up, down = t["a"], t["b"], t["up"], t["down"]
        won = t["u"] * (up + down) < down
        full = F.when(won, up).otherwise(down)
        fa = F.when(won, F.when(full >= (1 - a["f"]) * a["size"], 1.0).otherwise(a["f"] + full / a["size"])).otherwise(F.when(full >= a["f"] * a["size"], 0.0).otherwise(a["f"] - full / a["size"]))
        fb = F.when(won, F.when(full >= b["f"] * b["size"], 0.0).otherwise(b["f"] - full / b["size"])).otherwise(F.when(full >= (1 - b["f"]) * b["size"], 1.0).otherwise(b["f"] + full / b["size"]))
        return F.struct(a.withField("f", fa).alias("a"), b.withField("f", fb).alias("b"))

    return _let(F.struct(a.alias("a"), b.alias("b")), exchanged)


def _settled(x: Column) -> Column:
    return (x["f"] <= 0) | (x["f"] >= 1)


def _reduce_block(block: Column, seed: int) -> Column:
    """The documents of a block after all fights: at most one chance is neither 0 nor 1."""

    def step(state: Column, x: Column) -> Column:
        carried = state["carried"]

        def settle(t: Column) -> Column:
            keep, other = F.when(_settled(t["b"]), t["a"]).otherwise(t["b"]), F.when(_settled(t["b"]), t["b"]).otherwise(t["a"])
            return F.struct(keep.alias("carried"), F.array_append(state["done"], other).alias("done"))

        pair = F.when(_settled(carried) | _settled(x), F.struct(carried.alias("a"), x.alias("b"))).otherwise(_fight(carried, x, seed))
        return _let(pair, settle)

    start = F.struct(block[0].alias("carried"), F.filter(block, lambda _: F.lit(False)).alias("done"))
    return F.aggregate(F.slice(block, F.lit(2), F.size(block)), start, step, lambda s: F.array_append(s["done"], s["carried"]))


def _decided(sizes: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, m, whole, more of every kind of row (id, source and size): its m rows get `whole` copies each, `more` of them one more.

    Per level of the tree one exchange of small rows.
    """
    sources = materialize(source_targets(sizes, weights, most), "sources")
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = _join_sources(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), sources, n_sources)
    # of m equal rows, `sure` get one copy more than `whole`, and one has the chance f of one more
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("mass", F.col("m") * (rate - F.floor(rate)))
    rows = rows.withColumn("sure", F.when(F.col("size") > 0, F.floor("mass")).otherwise(0)).withColumn("f", F.when(F.col("size") > 0, F.col("mass") - F.floor("mass")).otherwise(0.0))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "source")).drop("mass")
    fields = ["h", "doc_id", "size", "f", "m", "whole", "sure", "source_size", "target"]
    decided, n_left, level = rows.where(F.col("f") == 0), largest or 0, 0
    left = materialize(rows.where(F.col("f") > 0).select("source", *fields, F.col("n_docs").alias("n_left")), "mix")
    while True:
        block = F.pmod(F.xxhash64(F.lit(seed + level), "h", "doc_id"), F.ceil(F.col("n_left") / BLOCK))
        blocks = left.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("docs"), F.max(F.ceil(F.col("n_left") / BLOCK)).alias("n_left"))
        done = blocks.select("source", "n_left", F.explode(_reduce_block(F.col("docs"), seed + level)).alias("x")).select("source", "n_left", "x.*")
        left = materialize(done, "mix")
        settled, n_left, level = (F.col("f") <= 0) | (F.col("f") >= 1), math.ceil(n_left / BLOCK), level + 1
        if n_left <= 1:  # one residual per source: its chance is drawn
            last = F.when(settled, F.col("f")).otherwise((uniform("h", "doc_id", seed=seed + level) < F.col("f")).cast("double"))
            decided = decided.unionByName(left.withColumn("f", last), allowMissingColumns=True)
            break
        decided = decided.unionByName(left.where(settled), allowMissingColumns=True)
        left = left.where(~settled)
    return decided.select("doc_id", "source", "size", "source_size", "target", "m", "whole", (F.col("sure") + F.col("f").cast("bigint")).alias("more"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies (of every row of docs). The texts are read once, for their sizes, and never moved."""
    sizes = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")
    copies = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("m")), lambda i: F.col("whole") + F.when(i <= F.col("more"), 1).otherwise(0))
    return _decided(sizes, weights, most, seed).select("doc_id", "source", "size", "source_size", "target", F.explode(copies).alias("n_copies"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all where that is 0). Columns stay as they are.

    Rows with the same id, source and size are interchangeable to the mix; among them copies go by the hash of the text, then of all other columns.
    Texts move once, by one key that the join and the count of equal rows share; words are counted once.
    """
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sizes = materialize(row, "sizes")
    kind = ("doc_id", "source", "size")
    texts = sizes.groupBy(*kind, "text_hash").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*kind).orderBy("text_hash").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))  # equal ids, sources and sizes: a row per different text
    decided = _decided(sizes, weights, most, seed).select(*[F.col(c).alias(f"of_{c}") for c in kind], "whole", "more")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    taken = texts.join(decided, same).where((F.col("whole") > 0) | (F.col("more") > F.col("before")))
    keys = lambda text: (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull(), text)
    own = [fresh(docs, f"mix_key{i}") for i in range(5)]
    of = [fresh(docs, f"mix_of{i}") for i in range(5)]
    whole, more, at = (fresh(docs, x) for x in ("mix_whole", "mix_more", "mix_at"))
    taken = taken.select(*[k.alias(n) for k, n in zip(keys(F.col("text_hash")), of, strict=True)], F.col("whole").alias(whole), (F.col("more") - F.col("before")).alias(more))
    rows = docs.withColumns(dict(zip(own, keys(F.xxhash64("text")), strict=True))).join(taken, [F.col(a) == F.col(b) for a, b in zip(own, of, strict=True)])
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(*own).orderBy(settle(docs, ("text",)))))
    n = F.col(whole) + F.when(F.col(at) <= F.col(more), 1).otherwise(0)
    return rows.where(n > 0).withColumn(at, F.explode(F.sequence(F.lit(1).cast("bigint"), n))).select(*docs.columns)

"""Embedding near-dedup through a pivot-permutation index.

Every vector is described by its nearest reference points in order. Two vectors that share two of them meet in the inverted list of that
pair of pivots, so lists of pairs retrieve exactly the vectors with a shared-pivot count of two or more, and are far shorter than lists of single
pivots. Vectors of different lengths never meet: every length has pivots and lists of its own, and a length with LIST vectors or fewer is a single list.

Lists hold unit vectors as 16-bit components. Their rounding error is bounded, so all pairs but those within about 1e-4 of the threshold are decided in
the list; the cosine of the others is computed in double precision from the vectors themselves. A pair counts only in the first list that both
are in. What leaves a list is a number of links per vector and edges that span the linked groups, so a group of near copies gives rows in
proportion to its size. Lists of over LIST vectors are cut into blocks and compared block by block.

The number of pivots grows with the square root of the number of vectors, so that lists keep their length, up to MOST_PIVOTS, and more pivots
are looked at per vector where there are more (`n_nearest`), as fewer of them are shared then.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of any size, however large or small, are
scaled before they are compared; equal vectors are compared once and counted; repeated ids count as vectors of their own; a null
vec_id is never the smallest; empty tables give empty results; only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready_python, small
from .graph import connected_components

LEAST_PIVOTS, MOST_PIVOTS = 256, 8192
#: Vectors of a list that are compared in one piece; of a list beyond it, two blocks at a time.
LIST = 2048
#: Mean length that lists should have.
MEAN_LIST = 100
#: Rows of the table of long lists that may be sent to every task.
SMALL_TABLE = 100_000
FOUND = "kind tinyint, a bigint, b bigint"
#: Kinds of FOUND: vector a has b links, a and b are in one group, a and b link, a and b have to be looked at.
COUNT, EDGE, PAIR, DOUBT = range(4)


def n_nearest(n_pivots: int) -> int:
    """Pivots to describe a vector by. At cosine 0.9 two random directions of 64 components then share two of them with a chance of 0.95 or more."""
    return 7 if n_pivots <= 512 else 8 if n_pivots <= 2048 else 9


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, id) and (classes: id, vec, n, least_id): equal valid vectors are one class; id is null where a vector is not valid."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    valid = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(valid, x).alias("vec")).withColumn("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    found = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    return rows.select("vec_id", "id"), materialize(found, "classes")


def choose_pivots(found: DataFrame, n_pivots: int | None = None, seed: int = 3) -> dict[int, np.ndarray]:
    """Per length with more than LIST vectors a bounded sample: the unit vectors with the smallest hashes, LEAST_PIVOTS to MOST_PIVOTS of them."""
    out = {}
    sizes = found.groupBy(F.size("vec").alias("d")).count().where(F.col("count") > LIST).collect()  # a row per common length
    for d, n in sizes:
        wanted = n_pivots or LEAST_PIVOTS
        while n_pivots is None and wanted < MOST_PIVOTS and math.comb(n_nearest(wanted), 2) * n > MEAN_LIST * wanted * wanted / 2:
            wanted = min(MOST_PIVOTS, wanted + wanted // 8)
        rows = found.where(F.size("vec") == d).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(wanted).select("vec").collect()
        out[d] = _unit(np.array([r[0] for r in rows], np.float64))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(found: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, n, d (length), code (16-bit components of the unit vector), scale, near (the nearest pivots in order; none where the length has none)."""
    ready_python(found.sparkSession)
    shared = found.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                for at in range(0, len(rows), 1000):
                    part = batch.take(pa.array(rows[at : at + 1000]))
                    x = _unit(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d))
                    near: list = [[]] * part.num_rows
                    if (points := shared.value.get(d)) is not None:
                        near = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, : n_nearest(len(points))].tolist()
                    scale = np.abs(x).max(axis=1) / 32767
                    code = np.rint(x / scale[:, None]).astype("<i2")
                    cols = [part.column(0), part.column(1), pa.array([d] * part.num_rows, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float64()), pa.array(near, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "n", "d", "code", "scale", "near"])

    return found.select("id", "n", "vec").mapInArrow(run, "id bigint, n bigint, d int, code binary, scale double, near array<int>")


def _first_shared(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """The number of the first list that two vectors share, from their nearest pivots in ascending order."""
    common = (near_a[:, :, None] == near_b[:, None, :]).any(axis=2)
    first = np.argmax(common, axis=1)
    common[np.arange(len(near_a)), first] = False
    rows = np.arange(len(near_a))
    return near_a[rows, first].astype(np.int64) * MOST_PIVOTS + near_a[rows, np.argmax(common, axis=1)]


def _groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n is linked to over any number of pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _compare(key: tuple[int, ...], rows: dict[str, np.ndarray], threshold: float, listed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of FOUND of one list, or of blocks i and j of it, over the pairs that no earlier list has."""
    d, pair, i, j = key
    ids, n = rows["id"], len(rows["id"])
    x = (np.frombuffer(b"".join(rows["code"]), "<i2").reshape(n, d) * rows["scale"][:, None]).astype(np.float32)
    slack = np.sqrt(d) * rows["scale"] / 2  # most that rounding can move a vector
    error = slack[:, None] * 2.1
    a_side = np.flatnonzero(rows["block"] == i)
    b_side = a_side if i == j else np.flatnonzero(rows["block"] == j)
    near = np.sort(np.stack(rows["near"]), axis=1) if pair >= 0 else None
    sure_a, sure_b, doubt_a, doubt_b = [], [], [], []
    for at in range(0, len(a_side), 256):
        a_rows = a_side[at : at + 256]
        sim = x[a_rows] @ x[b_side].T
        wide = error[a_rows] + error[b_side].T + (d + 8) * 1.2e-7
        a, b = np.nonzero(sim >= threshold - wide)
        sure = sim[a, b] >= threshold + wide[a, b]
        a, b = a_rows[a], b_side[b]
        own = a < b if i == j else np.ones(len(a), bool)
        if near is not None and len(a):
            own &= _first_shared(near[a], near[b]) == pair
        sure_a.append(a[own & sure])
        sure_b.append(b[own & sure])
        doubt_a.append(a[own & ~sure])
        doubt_b.append(b[own & ~sure])
    none = np.zeros(0, np.int64)
    a, b, u, v = (np.concatenate([*part, none]) for part in (sure_a, sure_b, doubt_a, doubt_b))
    out = [(DOUBT, ids[u], ids[v])]
    if listed:
        out.append((PAIR, ids[a], ids[b]))
    elif len(a):
        many = rows["n"].astype(np.float64)
        links = (np.bincount(a, many[b], n) + np.bincount(b, many[a], n)).astype(np.int64)
        label = _groups(a, b, n)
        linked, led = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        out += [(COUNT, ids[linked], links[linked]), (EDGE, ids[led], ids[label[led]])]
    return np.concatenate([np.full(len(p), k, np.int8) for k, p, _ in out]), np.concatenate([p for _, p, _ in out]), np.concatenate([q for *_, q in out])


def compared(described: DataFrame, threshold: float, listed: bool) -> DataFrame:
    """The rows of FOUND that all lists give: with `listed` every pair, else counts and edges."""
    spark, at = described.sparkSession, F.array_sort("near")
    pairs = F.flatten(F.transform(at, lambda x: F.transform(F.filter(at, lambda y: y > x), lambda y: x.cast("bigint") * MOST_PIVOTS + y)))
    posted = described.withColumn("pair", F.explode(F.when(F.size("near") > 0, pairs).otherwise(F.array(F.lit(-1).cast("bigint")))))
    long = posted.groupBy("d", "pair").count().where(F.col("count") > LIST).select("d", "pair", F.ceil(F.col("count") / LIST).cast("int").alias("n_blocks"))
    posted = posted.join(small(materialize(long, "long"), SMALL_TABLE), ["d", "pair"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    keys = ["d", "pair", "i", "j"]
    dealt = posted.withColumn("o", F.explode(others)).select("d", "pair", "o.i", "o.j", "block", "id", "n", "code", "scale", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            key = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            col = {c: rows.column(c).to_numpy() for c in ("block", "id", "n", "code", "scale", "near")}
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    kind, a, b = _compare(tuple(key[lo].tolist()), {c: v[lo:hi] for c, v in col.items()}, threshold, listed)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            last = [rows.column(c)[-1].as_py() for c in keys]
            key = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
            cut = int(np.argmax((key == last).all(axis=1)))  # the last list may go on in the next batch
            yield from whole(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, FOUND)


def _unit_column(vec: Column) -> Column:
    largest = F.array_max(F.transform(vec, F.abs))
    return F.transform(vec, lambda v: v / largest)


def _settled(found: DataFrame, doubtful: DataFrame, threshold: float) -> DataFrame:
    """a, b, n_a, n_b of the doubtful pairs whose cosine, in double precision, is at least the threshold."""
    side = lambda c: found.select(F.col("id").alias(c), _unit_column(F.col("vec")).alias(f"vec_{c}"), F.col("n").alias(f"n_{c}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("vec_a", "vec_b") / (F.sqrt(dot("vec_a", "vec_a")) * F.sqrt(dot("vec_b", "vec_b")))
    return doubtful.join(side("a"), "a").join(side("b"), "b").where(cosine >= threshold).select("a", "b", "n_a", "n_b")


def _searched(vectors: DataFrame, threshold: float, listed: bool, n_pivots: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    members, found = classes(vectors)
    rows = materialize(compared(describe(found, choose_pivots(found, n_pivots)), threshold, listed), "compared")
    return members, found, rows, materialize(_settled(found, rows.where(F.col("kind") == DOUBT).select("a", "b"), threshold), "settled")


def cosine_links(vectors: DataFrame, threshold: float = 0.9, n_pivots: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, pairs a, b of class ids with a cosine of at least the threshold, each once).

    All pairs are listed: the square of the size of a group of near copies. near_vectors needs no such list.
    """
    members, found, rows, settled = _searched(vectors, threshold, True, n_pivots)
    return members, found, rows.where(F.col("kind") == PAIR).select("a", "b").unionByName(settled.select("a", "b"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, n_pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    members, found, rows, settled = _searched(vectors, threshold, False, n_pivots)
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("n_b").alias("others")), F.struct(F.col("b").alias("id"), F.col("n_a").alias("others"))))
    counts = rows.where(F.col("kind") == COUNT).select(F.col("a").alias("id"), F.col("b").alias("others")).unionByName(settled.select(ends.alias("e")).select("e.*"))
    others = counts.groupBy("id").agg(F.sum("others").alias("others"))
    labels = connected_components(rows.where(F.col("kind") == EDGE).select("a", "b").unionByName(settled.select("a", "b")))
    per = found.select("id", "n", "least_id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = per.groupBy("label").agg(F.min("least_id").alias("component_id"))
    per = per.join(least, "label").join(others, "id", "left").select("id", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = members.join(per, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

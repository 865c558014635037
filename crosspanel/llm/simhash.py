"""SimHash near-dedup by the generalised pigeonhole principle.

64-bit fingerprints over word 3-shingles link at `most` = 2 or fewer differing bits. For parts of the bits with thresholds that add up to
most - parts + 1, two fingerprints that link are within its threshold on at least one part (a threshold of -1 leaves a part out).
The plan is made from all distinct fingerprints: correlated bits share a part, the candidates of a part at threshold 0 are counted
exactly, those at 1 and 2 are estimated from how often its bits agree, and dynamic programming allots the thresholds for 2, 3 and 4 parts.

Probing joins exact values with all values within the threshold and checks the bits in the join itself, so only links leave it. A
value shared by more than BUCKET fingerprints isn't joined: its members are expanded to their 65 values within one bit, and
two fingerprints link at two bits exactly if they meet in one of those. Such a meeting has at most 65 members, all of them linked, so
a star loses nothing and the work is linear in the size of a group of near copies.

`similar` groups texts by the Jaccard similarity of their shingle sets instead: wide fingerprints find the candidates by the same principle,
and every candidate is verified on the whole sets.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other (to `similar`: with each other); copies share a
fingerprint and are one vertex; a null doc_id is never the smallest (component_id is null only if a whole component has null
ids); empty tables give empty results; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, materialize, ready_python, settle, slices, small
from .graph import connected_components

BITS = 64
#: Most fingerprints that may share a value of a part and still be joined pair by pair.
BUCKET = 64


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42, unsigned)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), 42)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[a : a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long), written to the shared folder."""
    ready_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            fps = np.array([fingerprint(t, width) for t in batch.column(2).cast(pa.binary()).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return materialize(rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint"), "fingerprints")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set: 64 x 64 sums of the partitions' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), "<i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(raw)
        if n:
            cells = [*both.astype(np.int64).ravel().tolist(), n]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.int64())], ["cell", "n"])

    cells = dict(fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect())
    return cells.pop(BITS * BITS, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; a part starts with the freest bit and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    cor = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for i in range(parts):
        room = len(free) // (parts - i)
        part = [max(free, key=lambda b: (cor[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < room:
            part.append(max(free, key=lambda b: (cor[b, part].mean(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming: one threshold per part, adding up to `total`, at the least sum of costs."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in cost.items():
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def plan(fps: DataFrame, most: int = 2) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe. Counts are over all distinct fingerprints; what comes to the driver has a fixed size."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) * (1 - p), 1e-9)
    odds = (1 - agree) / agree
    choices = {m: correlated_parts(n, both, m) for m in (2, 3, 4)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _masked(F.col("fp"), bits).alias("key")) for m, parts in choices.items() for i, bits in enumerate(parts)]
    same = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k").count().groupBy("k.m", "k.i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    pairs = {(r["m"], r["i"]): r["pairs"] for r in same.collect()}
    found = []
    for m, parts in choices.items():
        costs = []
        for i, bits in enumerate(parts):
            exact, one = pairs.get((m, i), 0.0), odds[bits].sum()
            two = sum(a * b for a, b in combinations(odds[bits], 2))
            w = len(bits)
            costs.append({-1: 0.0, 0: exact + n, 1: exact * (1 + one) + n * (2 + w), 2: exact * (1 + one + two) + n * (2 + w + w * (w - 1) / 2)})
        found.append((*allot(costs, most - m + 1), m))
    _, thresholds, m = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(choices[m], thresholds, strict=True) if t >= 0]


def _masked(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))).cast("bigint"))


def _flips(bits: list[int], threshold: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for t in range(threshold + 1) for c in combinations(bits, t)]


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose components are those of all links."""
    parts = plan(fps, most)
    data, probe = [], []
    for i, (bits, t) in enumerate(parts):
        data.append(F.struct(F.lit(i).alias("part"), _masked(F.col("fp"), bits).alias("key")))
        probe += [F.struct(F.lit(i).alias("part"), _masked(F.col("fp"), bits).bitwiseXOR(F.lit(x).cast("bigint")).alias("key")) for x in _flips(bits, t)]
    spread = lambda keys: fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", "fp")
    left, right = spread(data), spread(probe)
    members = left.withColumn("d", F.lit(1)).unionByName(right.withColumn("d", F.lit(0))) if len(probe) > len(data) else left.withColumn("d", F.lit(1))
    counted = members.groupBy("part", "key").agg(F.sum("d").alias("n_data"), F.sum(1 - F.col("d")).alias("n_probe"))
    hot = materialize(counted.where((F.col("n_data") > BUCKET) | (F.col("n_probe") > BUCKET)).select("part", "key"), "hot")
    distance = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    x, y = (side.join(hot, ["part", "key"], "left_anti").alias(name) for side, name in ((left, "x"), (right, "y")))
    near = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (distance <= most))
    near = near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    dense = members.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
    return near.unionByName(_meetings(dense, most))


def _meetings(dense: DataFrame, most: int) -> DataFrame:
    """Star edges of fingerprints that meet at a value within half of `most` bits of each; of an odd distance, the larger half holds for one side only."""
    low, high = most // 2, most - most // 2
    at = lambda r: [F.struct(F.lit(r <= low).alias("close"), F.col("fp").bitwiseXOR(F.lit(_signed(sum(1 << b for b in c))).cast("bigint")).alias("key")) for c in combinations(range(BITS), r)]
    met = dense.select("fp", F.explode(F.array(*[k for r in range(high + 1) for k in at(r)])).alias("k")).groupBy("k.key").agg(F.collect_set("fp").alias("fps"), F.min(F.when(F.col("k.close"), F.col("fp"))).alias("a"))
    return met.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _grouped_rows(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """rows with group (a label that its members share) and component_id. reps: fp, least_id and, where it has links, label."""
    reps = reps.withColumn("group", F.coalesce("label", "fp") if "label" in reps.columns else F.col("fp"))
    least = reps.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", "fp").join(reps.join(least, "group").select("fp", "group", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """doc_id, text_hash, fp, group, component_id (smallest doc_id reachable by links, itself included) for every row."""
    rows = fingerprints(docs, width)
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "reps")
    return _grouped_rows(rows, reps.join(connected_components(links(reps.select("fp"), most)).withColumnRenamed("id", "fp"), "fp", "left"))


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of docs per group: the one with the smallest doc_id, of equal ids that with the smallest text hash, of equal texts by all other columns.

    `found` is what near_duplicates (the default) or similar says of docs. In a group whose ids are all null, the row with the smallest text hash
    stays. Columns stay as they are. Texts are joined against the rows to drop or to choose from only, and move only where those are very many.
    """
    found = materialize(near_duplicates(docs) if found is None else found, "groups")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    keys = found.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("m")).join(first, "group")
    kept = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    names = {c: fresh(docs, c) for c in ("dealt_id", "dealt_none", "text_hash", "dealt_hash", "choose", "row_at", "of_id", "of_none")}
    id_, none, own, hash_, choose, at, of_id, of_none = names.values()
    acted = keys.where(~kept | (F.col("m") > 1)).select(F.coalesce("doc_id", F.lit(0)).alias(of_id), F.col("doc_id").isNull().alias(of_none), F.col("text_hash").alias(hash_), kept.alias(choose))
    acted = materialize(acted, "acted")
    several = small(acted, SMALL_TABLE)
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), none: F.col("doc_id").isNull(), own: F.xxhash64("text")})
    rows = rows.join(several, (F.col(id_) == F.col(of_id)) & (F.col(none) == F.col(of_none)) & (F.col(own) == F.col(hash_)), "left")
    order = Window.partitionBy(id_, none, own).orderBy(settle(docs, ("text",)))
    if several is acted:  # the join has moved the texts already
        out = rows.withColumn(at, F.row_number().over(order)).where(F.col(choose).isNull() | (F.col(choose) & (F.col(at) == 1)))
        return out.select(*docs.columns)
    chosen = rows.where(F.col(choose)).withColumn(at, F.row_number().over(order)).where(F.col(at) == 1)
    return rows.where(F.col(choose).isNull()).select(*docs.columns).unionByName(chosen.select(*docs.columns))


# ---- Groups by the similarity of shingle sets -------------------------------------------------------------------------------------------

WIDE = 512
WORDS = WIDE // 64
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: What a row of the index costs, in pairs looked at.
ROW_COST = 200
#: Fingerprints that the plan's estimates are made from.
SAMPLE = 1000
#: Members of a bucket compared at once.
BLOCK = 2048
#: Rows of a bucket that one task takes; of a bucket beyond it, two blocks at a time.
BUCKET_ROWS = 16_384
#: Rows of a table that may be sent to every task.
SMALL_TABLE = 1_000_000
#: Shingles up to which a set also meets others by the rarest of its shingles, and those up to which chances are counted exactly.
SHORT, EXACT = 64, 256
#: Sets from which on a shingle counts as frequent.
FREQUENT = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of a whole text's shingles of `width` words, ascending; a text of fewer words is one shingle, one of none has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = _mixed(rolled ^ h[i : len(h) - width + 1 + i])
    return np.unique(rolled)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WIDE bits over distinct shingle hashes as WORDS integers: a bit is 1 if it is set in over half of the hashes of its word."""
    ones = np.zeros(WIDE, np.int64)
    for a in range(0, len(found), 1 << 14):
        h = found[a : a + (1 << 14)]
        block = np.stack([h, *(_mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, WORDS))], axis=1)
        ones += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


FPS = [f"f{k}" for k in range(WORDS)]
_FPS = ", ".join(f"{f} bigint" for f in FPS)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def sketches(docs: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, text_hash, id (a hash of the set of shingles), n (its size), the wide fingerprint and few (the shingles, of sets that a set of SHORT shingles can be similar to) of every row, written to the shared folder."""
    ready_python(docs.sparkSession)
    names = ["doc_id", "text_hash", "id", "n", *FPS, "few"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = [shingles(t, width) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "<u8").view("<i8")
            fps = np.array([wide_fingerprint(s) for s in sets], "<u8").view("<i8").reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(WORDS)), _lists([s if len(s) <= SHORT / least else s[:0] for s in sets])], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return materialize(rows.mapInArrow(run, f"doc_id bigint, text_hash bigint, id bigint, n bigint, {_FPS}, few array<bigint>"), "sketches")


def prefixes(few: DataFrame, least: float) -> DataFrame:
    """id and prefix, the rarest shingles of every set in `few` (id, n, few): of two sets with a similarity of `least` or more, those of both have one in common.

    That holds for any order of all shingles. In this one those of fewer than FREQUENT sets come first, then the others by their count (the most frequent ones that fit SMALL_TABLE rows are told apart), so
    that only sets made of frequent shingles nearly throughout meet in a frequent one.
    """
    each = few.select("id", "n", F.explode("few").alias("shingle"))
    counts = materialize(each.groupBy("shingle").count().where(F.col("count") >= FREQUENT), "frequent")
    bound = FREQUENT
    while counts.where(F.col("count") >= bound).count() > SMALL_TABLE:
        bound *= 2
    ranked = each.join(F.broadcast(counts.where(F.col("count") >= bound)), "shingle", "left").groupBy("id", "n")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle"))).alias("ranked"))
    length = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    return materialize(ranked.select("id", F.slice(F.col("ranked.shingle"), F.lit(1), length.cast("int")).alias("prefix")), "prefixes")


def differences(least: float) -> np.ndarray:
    """The chance of a bit to differ between two sets at the given Jaccard similarity, by the size of the larger one up to EXACT: of all sizes of the smaller one the worst.

    Of large sets it is the angle between them over pi. A bit of a small one is a majority of few hashes, ties are 0, and sizes that are odd and even differ more, so it
    is counted: over the heads among the hashes in common, the chances of a majority on either side.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, EXACT + 1)))])
    out = np.zeros(EXACT + 1)
    for b in range(1, EXACT + 1):
        for a in range(math.ceil(least * b - 1e-9), b + 1):
            common = math.ceil(least * (a + b) / (1 + least) - 1e-9)
            if common > a:
                continue
            flips = lambda n: np.exp(logs[n] - logs[: n + 1] - logs[n::-1] - n * math.log(2))
            one = []
            for n in (a, b):
                at_least = np.append(np.cumsum(flips(n - common)[::-1])[::-1], 0.0)
                one.append(at_least[np.clip(n // 2 + 1 - np.arange(common + 1), 0, n - common + 1)])
            u, v = one
            out[b] = max(out[b], float((flips(common) * (u * (1 - v) + v * (1 - u))).sum()))
    return out


def distance_limits(chances: np.ndarray) -> np.ndarray:
    """Differing bits that a pair may have to be verified, by the size of the larger set up to EXACT: 2.5 deviations over what is expected at the threshold."""
    return (WIDE * chances + 2.5 * np.sqrt(WIDE * chances * (1 - chances))).astype(int)


def grouped(cor: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; a part starts with the bit most correlated with the free ones and takes those most correlated with it."""
    free, out = np.ones(len(cor), bool), []
    for i in range(parts):
        room = int(free.sum()) // (parts - i)
        part = [int(np.argmax(np.where(free, cor[:, free].sum(axis=1), -np.inf)))]
        free[part[0]] = False
        while len(part) < room:
            part.append(int(np.argmax(np.where(free, cor[:, part].sum(axis=1), -np.inf))))
            free[part[-1]] = False
        out.append(sorted(part))
    return out


def groupings(bits: np.ndarray, width: int, most: int) -> list[list[int]]:
    """Parts of about `width` bits: all bits are dealt out `most` times, correlated ones together, those that were together before apart."""
    cor = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((WIDE, WIDE))
    out = []
    for _ in range(most):
        parts = grouped(cor, max(1, WIDE // width))
        for part in parts:
            cor[np.ix_(part, part)] -= 1
        out += parts
    return out


def wide_plan(fps: np.ndarray, n: int, p: float, recall: float) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe: the least work at which two sets whose bits differ with a chance of p meet with a chance of `recall`.

    A part of w bits with threshold t brings a pair together with the chance that at most t of its bits differ; parts multiply the chances to miss. The pairs
    that a part makes in the whole corpus are estimated from the sample. Widths are tried in turn, thresholds allotted by dynamic programming.
    """
    steps, need = 200, -math.log(1 - recall)
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").reshape(-1, WIDE)
    u, v = np.triu_indices(len(bits), 1)
    best = (math.inf, [])
    first = max(8, max(n, 1).bit_length() - 8)
    for width in range(first, first + 12, 2):
        parts, costs, gains = groupings(bits, width, 2), [], []
        for part in parts:
            w = len(part)
            key = bits[:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64))
            apart = np.bitwise_count(key[u] ^ key[v]) if len(u) else np.zeros(1, np.uint8)
            # a sample can't see what is rarer than one of its pairs: bits of their own chance stand in there
            share = [max(float((apart <= t).mean()), (1 + t * w) / 2**w) for t in (0, 1)]
            costs.append([share[t] * n * n / 2 + ROW_COST * n * (1 + t * w) for t in (0, 1)])
            chance = [(1 - p) ** w, (1 - p) ** w + w * p * (1 - p) ** (w - 1)]
            gains.append([-math.log(1 - c) for c in chance])
        cost, chosen = allot_gain(costs, gains, need, steps)
        if cost < best[0]:
            best = (cost, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def allot_gain(costs: list[list[float]], gains: list[list[float]], need: float, steps: int = 200) -> tuple[float, list[int]]:
    """Dynamic programming: a threshold per part (-1: none) so that the gains add up to `need` at the least sum of costs."""
    best = np.full(steps + 1, math.inf)
    best[0] = 0.0
    came = []
    for cost, gain in zip(costs, gains, strict=True):
        step, own = best.copy(), np.full(steps + 1, -1)
        for t, (c, g) in enumerate(zip(cost, gain, strict=True)):
            up = min(steps, int(g / need * steps))
            at = np.minimum(np.arange(steps + 1) + up, steps)
            for s in np.flatnonzero(np.isfinite(best)):
                if best[s] + c < step[at[s]]:
                    step[at[s]], own[at[s]] = best[s] + c, t * (steps + 1) + s
        came.append(own)
        best = step
    chosen, s = [], steps
    for own in reversed(came):
        t, before = (-1, s) if own[s] < 0 else divmod(int(own[s]), steps + 1)
        chosen.append(t)
        s = before
    return float(best[steps]), chosen[::-1]


def _indexed(reps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, probe, id, label, n, room and fingerprint: a row per part, one per flipped bit where a part's threshold is 1, and one per shingle of a prefix, as a part of its own behind the others."""
    names = ["part", "key", "probe", "id", "label", "n", "room", *FPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                fps = np.stack([batch.column(k + 4).to_numpy() for k in range(WORDS)], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
                for i, (part, t) in enumerate(parts):
                    own = bits[:, part].astype(np.int64) @ (np.int64(1) << np.arange(len(part), dtype=np.int64))
                    for probe, flip in [(0, 0)] + [(1, 1 << b) for b in range(len(part))] * t:
                        n = batch.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(own ^ flip), pa.array(np.full(n, probe, np.int8)), *batch.columns], names)

    rows = reps.select("id", "label", F.col("n").cast("int").alias("n"), F.col("room").cast("int").alias("room"), *FPS, "prefix")
    met = rows.select(F.lit(len(parts)).alias("part"), F.explode("prefix").alias("key"), F.lit(0).cast("tinyint").alias("probe"), *rows.columns[:-1])
    return rows.drop("prefix").mapInArrow(run, f"part int, key bigint, probe tinyint, id bigint, label bigint, n int, room int, {_FPS}").unionByName(met)


def _sides(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is compared in a bucket, or in blocks i and j of it: members with members, flipped values with members."""
    data, i, j = rows["probe"] == 0, rows["i"][0], rows["j"][0]
    at = lambda kind, block: np.flatnonzero(kind & (rows["block"] == block))
    yield at(data, i), at(data, j)
    yield at(~data, i), at(data, j)
    if i != j:
        yield at(~data, j), at(data, i)


def _first_part(apart: np.ndarray, masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The first part that brings each pair together, their number if none does. apart: the differing bits of a pair, WORDS integers; masks and most: bits and threshold of every part."""
    if not len(most):
        return np.zeros(len(apart), int)
    meet = sum(np.bitwise_count(apart[:, k, None] & masks[None, :, k]).astype(np.int16) for k in range(WORDS)) <= most[None, :]
    return np.where(meet.any(axis=1), np.argmax(meet, axis=1), len(most))


def _near_pairs(rows: dict[str, np.ndarray], least: float, most: np.ndarray, limit: int, masks: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a bucket with different labels, sizes and room that allow a similarity of `least` and at most as many differing bits as `most` has for the larger size, that no earlier part brings together; where
    there are very many, of the `limit` nearest of each member. Whether any was left out. (A member's nearest of all is also the nearest in the first part that they share, so it is always there.)"""
    found_a, found_b, cut = [], [], False
    for side, other in _sides(rows):
        for at in range(0, len(side), BLOCK // 4):
            a_rows = side[at : at + BLOCK // 4]
            for to in range(0, len(other), BLOCK):
                b_rows = other[to : to + BLOCK]
                apart = np.zeros((len(a_rows), len(b_rows)), np.uint16)
                for k in range(WORDS):
                    apart += np.bitwise_count(rows["fps"][a_rows, k][:, None] ^ rows["fps"][b_rows, k][None, :])
                n_a, n_b = rows["n"][a_rows][:, None], rows["n"][b_rows][None, :]
                room = np.minimum(rows["room"][a_rows][:, None], rows["room"][b_rows][None, :])
                apart[(rows["label"][a_rows][:, None] == rows["label"][b_rows][None, :]) | ((1 + least) * room < least * (n_a + n_b) - 1e-9)] = WIDE + 1
                near = apart <= np.minimum(most[np.minimum(np.maximum(n_a, n_b), EXACT)], WIDE)
                if near.sum() > 8 * limit * len(a_rows):
                    cut, k = True, min(limit, len(b_rows))
                    nearest = np.argpartition(apart, k - 1, axis=1)[:, :k]
                    some = np.zeros_like(near)
                    np.put_along_axis(some, nearest, True, axis=1)
                    near &= some
                a, b = np.nonzero(near)
                a, b = a_rows[a], b_rows[b]
                own = _first_part(rows["fps"][a] ^ rows["fps"][b], masks, thresholds) == rows["part"][0]
                found_a.append(rows["id"][a[own]])
                found_b.append(rows["id"][b[own]])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([*found_a, none]), np.concatenate([*found_b, none])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], cut


def _candidates(reps: DataFrame, parts: list[tuple[list[int], int]], least: float, most: np.ndarray, limit: int) -> DataFrame:
    """a, b: pairs with different labels that meet in a part or a prefix and can have a similarity of `least`; a row of nulls for every bucket that left some out."""
    keys = ["part", "key", "i", "j"]
    masks = np.array([[sum(1 << b % 64 for b in part if b // 64 == k) for k in range(WORDS)] for part, _ in parts], np.uint64).reshape(-1, WORDS)
    thresholds = np.array([t for _, t in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            col = {c: rows.column(c).to_numpy() for c in (*keys, "block", "probe", "id", "label", "n", "room")} | {"fps": np.stack([rows.column(f).to_numpy().view(np.uint64) for f in FPS], axis=1)}
            ends = np.flatnonzero(np.any([col[c][1:] != col[c][:-1] for c in keys], axis=0)) + 1
            cuts = [0, *ends.tolist(), rows.num_rows]
            found_a, found_b = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1 and (col["label"][lo:hi] != col["label"][lo]).any():
                    a, b, cut = _near_pairs({c: v[lo:hi] for c, v in col.items()}, least, most, limit, masks, thresholds)
                    found_a += [*a.tolist(), *[None] * cut]
                    found_b += [*b.tolist(), *[None] * cut]
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            last = [rows.column(c).to_numpy() for c in keys]
            cut = int(np.argmax(np.all([c == c[-1] for c in last], axis=0)))  # the last bucket may go on in the next batch
            yield from whole(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = _indexed(reps, parts)
    long = index.groupBy("part", "key").count().where(F.col("count") > BUCKET_ROWS)
    long = small(materialize(long.select("part", "key", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("n_blocks")), "long"), SMALL_TABLE)
    block = F.pmod(F.xxhash64("id", "probe"), F.col("n_blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = index.join(long, ["part", "key"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("block", block).withColumn("o", F.explode(both))
    dealt = dealt.select("part", "key", "o.i", "o.j", "block", "probe", "id", "label", "n", "room", *FPS)
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, shingles of the wanted sets (id, text_hash): the texts that have them are read again, one each."""
    ready_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingles(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64("text").alias("text_hash"), "text")
    same = (F.col("text_hash") == F.col("of_text")) & F.col("own_id").eqNullSafe(F.col("of_doc"))
    found = rows.join(small(wanted.select("id", F.col("text_hash").alias("of_text"), F.col("doc_id").alias("of_doc")), SMALL_TABLE), same).select("id", "text")
    return materialize(found.mapInArrow(run, "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "sets")


def _with_room(active: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The active sets, their room made exact: the shingles that another active set has as well, so the most that two sets can have in common. Those that can't be similar to any other for want of it are left out."""
    own = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id"))
    own = own.where("m = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    roomy = active.join(own, "id", "left").withColumn("room", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return materialize(roomy.where(F.col("room") >= F.lit(least) * F.col("n") - 1e-9), "roomy")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, linked: whether the Jaccard similarity of the two sets is at least `least`."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    linked = both >= F.lit(least) * (F.size("s_a") + F.size("s_b") - both) - 1e-9
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", linked.alias("linked"))


def similar(docs: DataFrame, width: int = 5, least: float = 0.8, recall: float = 0.99, seed: int = 13) -> DataFrame:
    """doc_id, text_hash, fp (a hash of the set of shingles), group, component_id (smallest doc_id reachable by links, itself included) for every row.

    Two texts link if the Jaccard similarity of their sets of `width`-word shingles is `least` or more. Candidates come from fingerprints of
    WIDE bits by the generalised pigeonhole: parts of correlated bits, thresholds by dynamic programming on estimated candidates, such that two sets just at
    `least` meet with a chance of `recall` (more similar ones nearly always); what meets within the distance that such sets
    keep is verified on the whole sets. A set of at most SHORT shingles also meets whatever shares one of its rarest shingles, as any set of that similarity does, so that only the
    distance can lose it; the distance allowed follows from the exact chances of sets of that size. Of a bucket with very many pairs, as a group of near copies makes them, first the nearest of each member
    are verified; whoever is in one group by then need not be compared again, and the search goes on between groups until no pair is left out. From then on shingles that
    only one of the sets still in question has are counted against it, so that pages of one template that are not similar leave their bucket once, not as all their pairs.
    """
    rows = sketches(docs, width, least)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    same = ["n", *FPS, "few"]  # equal in all rows of an id
    reps = rows.groupBy("id").agg(one, *[F.first(f).alias(f) for f in same]).select("id", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), *same)
    once = materialize(reps, "once")
    met = prefixes(once.where(F.size("few") > 0).select("id", "n", "few"), least)
    reps = materialize(once.drop("few").join(met, "id", "left").withColumn("room", F.col("n")), "reps")
    for table in (once, met):
        forget(table)
    n = reps.count()
    sample = np.array(reps.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select(*FPS).collect(), np.int64).reshape(-1, WORDS)
    chances = differences(least)
    parts, most = wide_plan(sample, n, float(chances[SHORT + 1 :].max()), recall), distance_limits(chances)
    now, left, links, limit, sets, checked = reps, None, None, 1, None, None
    while n > 1:
        at = now if "label" in now.columns else now.withColumn("label", F.col("id"))
        met = materialize(_candidates(at, parts, least, most, limit).distinct(), "met")
        cut = met.where(F.col("a").isNull()).count() > 0
        pairs = met.where(F.col("a").isNotNull())
        if sets is None:
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            active = materialize(reps.join(wanted, "id"), "active")
            sets = _sets(docs, active, width)
        pairs = pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti")
        done = materialize(_verified(pairs, sets, least), "verified")
        found = done.where("linked").count()
        forget(met)
        checked = done.select("a", "b") if checked is None else checked.unionByName(done.select("a", "b"))
        links = done.where("linked").select("a", "b") if links is None else links.unionByName(done.where("linked").select("a", "b"))
        labels = connected_components(links)
        if now is not reps:
            forget(now)
        if not cut:
            break
        limit = limit if 2 * found > done.count() else 64 * limit
        if now is reps:
            left = _with_room(active, sets, least)
        now = materialize(left.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "now")
    if links is not None:
        for table in (sets, active, *([] if left is None else [left])):
            forget(table)
        reps = reps.join(labels, "id", "left")
    return _grouped_rows(rows.withColumnRenamed("id", "fp"), reps.withColumnRenamed("id", "fp").withColumnRenamed("doc_id", "least_id"))


def keep_dissimilar(docs: DataFrame, width: int = 5, least: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row of docs per group of similar texts, as keep_one chooses it."""
    return keep_one(docs, similar(docs, width, least, recall))

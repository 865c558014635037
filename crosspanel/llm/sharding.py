"""Sharding by histogram sort: shards of nearly equal bytes in the order of a key, found by counting and made by one exchange.

The key of a row is three numbers of 60 bits: a hash of the text, one of the id, one of all other columns. So equal texts lie together, and a group
of copies is cut only where a shard's bytes ask for it. For every splitter, candidate boundaries divide the interval that holds it, the exact bytes and
rows below each are counted over all partitions, and the interval shrinks to the bin that holds the target, until a boundary is within the tolerance or
no boundary lies nearer. A round is one aggregate over narrow rows in which only bins that hold an open target take part; what reaches
the driver is at most 2^PROBE_BITS counts. Then rows know their shard from the splitters alone and move once.

Everything is a DataFrame or SQL function. Slots need no task of a shard's size: a shard is dealt out in pieces of about `piece_bytes`, whose first
slots follow from the counts.

Defined cases: a null text has no bytes and ties with the empty one in the first number only if all else is equal; null ids hash as the empty id;
rows that are equal in every column can't be told apart and stay in one shard; empty tables give empty results; where there are fewer rows than shards, some
shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, settle

#: Bits of each of the key's numbers.
BITS = 60
#: Bits of all candidate boundaries of a round together, and of one interval.
PROBE_BITS, MOST_BITS = 17, 12
#: Most pieces of all shards together.
MOST_PIECES = 4096
PIECE_BYTES = 256 << 20
WORDS = ("k1", "k2", "k3")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _hashed(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def keys(docs: DataFrame) -> list[Column]:
    """The three numbers of a row's key."""
    return [_hashed(F.col("text")), _hashed(F.col("doc_id").cast("string")), F.shiftrightunsigned(settle(docs, ("text", "doc_id")), 64 - BITS)]


@dataclass(frozen=True)
class Splitter:
    """The first key that is not below, and the bytes and rows below it."""

    key: tuple[int, int, int]
    bytes: int
    rows: int


@dataclass
class _Open:
    """Targets that lie in one interval: the numbers before `word` in full, `done` bits of number `word`."""

    word: int
    done: int
    prefix: tuple[int, ...]
    below: tuple[int, int]
    targets: list[int]


def _edge(word: int, prefix: tuple[int, ...], value: int, shift: int) -> tuple[int, int, int]:
    return (*prefix[:word], value << shift, *[0] * (2 - word))


def _count(rows: DataFrame, word: int, done: int, step: int, prefixes: list[tuple[int, ...]]) -> dict[tuple[int, ...], list[tuple]]:
    """Per prefix the bins of its next `step` bits in order: value, bytes, rows, and the least and largest of each number."""
    shift = BITS - done - step
    at = F.shiftright(F.col(WORDS[word]), shift)
    head = [F.col(w) for w in WORDS[:word]]
    if word == 0:
        rows = rows.where(F.shiftright(at, step).isin([p[0] for p in prefixes])) if done else rows
    else:
        own = F.struct(*[h.alias(w) for h, w in zip(head, WORDS, strict=False)], F.shiftright(at, step).alias("p"))
        rows = rows.where(F.array_contains(F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(n) for x, n in zip(p, [*WORDS[:word], "p"], strict=True)]) for p in prefixes]), own))
    names = [f"h{i}" for i in range(word)]
    least = [f(w).alias(f"{n}_{w}") for w in WORDS for f, n in ((F.min, "lo"), (F.max, "hi"))]
    found = rows.groupBy(*[h.alias(n) for h, n in zip(head, names, strict=True)], at.alias("at")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *least).collect()
    out: dict[tuple[int, ...], list[tuple]] = {}
    for r in sorted(found, key=lambda r: r["at"]):
        prefix = (*[r[n] for n in names], r["at"] >> step)
        out.setdefault(prefix, []).append((r["at"], r["bytes"], r["rows"], [(r[f"lo_{w}"], r[f"hi_{w}"]) for w in WORDS]))
    return out


def splitters(sizes: DataFrame, n_parts: int, tolerances: list[float]) -> list[Splitter]:
    """n_parts - 1 boundaries with nearly equal bytes between them. sizes: k1, k2, k3, size. tolerances: for each boundary, in bytes.

    A boundary is the first found within its tolerance, else the nearest of all (of two equally near the lower).
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found: dict[int, Splitter] = {}
    open_: list[_Open] = [_Open(0, 0, (0,), (0, 0), list(range(1, n_parts)))]
    if not total:
        return [Splitter((0, 0, 0), 0, 0)] * (n_parts - 1)
    while open_:
        following: list[_Open] = []
        for word, done in sorted({(o.word, o.done) for o in open_}):
            now = {o.prefix: o for o in open_ if (o.word, o.done) == (word, done)}
            step = max(1, min(MOST_BITS, BITS - done, PROBE_BITS - (len(now) - 1).bit_length()))
            shift = BITS - done - step
            counted = _count(sizes, word, done, step, list(now))
            for prefix, o in now.items():
                bins = counted[prefix]
                ends, rows, at = [], [], list(o.below)
                for _, size, m, _ in bins:
                    at = [at[0] + size, at[1] + m]
                    ends.append(at[0])
                    rows.append(at[1])
                inner: dict[int, list[int]] = {}
                for j in o.targets:
                    i = min(bisect_right(ends, total * j // n_parts), len(bins) - 1)
                    value, size, m, span = bins[i]
                    low, high = ends[i] - size, ends[i]
                    near = min((abs(low * n_parts - total * j), 0), (abs(high * n_parts - total * j), 1))
                    if near[0] > tolerances[j - 1] * n_parts and any(a != b for a, b in span):
                        inner.setdefault(i, []).append(j)
                    elif near[1] == 0:
                        found[j] = Splitter(_edge(word, prefix, value, shift), low, rows[i] - m)
                    else:
                        found[j] = Splitter(_edge(word, prefix, value + 1, shift), high, rows[i])
                for i, targets in inner.items():
                    value, size, m, span = bins[i]
                    below = (ends[i] - size, rows[i] - m)
                    if span[word][0] != span[word][1]:
                        following.append(_Open(word, done + step, (*prefix[:word], value), below, targets))
                    else:  # the whole number is shared: go on in the next that differs
                        to = next(w for w in range(word + 1, 3) if span[w][0] != span[w][1])
                        following.append(_Open(to, 0, (*[span[w][0] for w in range(to)], 0), below, targets))
        open_ = following
    return [found[j] for j in range(1, n_parts)]


def _numbers(values: list[int], kind: str = "bigint") -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _part(key: list[str], bounds: list[Splitter]) -> Column:
    """The number of boundaries that are not above a row's key. Only those with the key's first bits are compared."""
    if not bounds:
        return F.lit(0)
    shift = BITS - MOST_BITS
    heads = [b.key[0] >> shift for b in bounds]
    first = _numbers([bisect_left(heads, b) for b in range((1 << MOST_BITS) + 1)], "int")
    all_ = F.transform(F.arrays_zip(*[_numbers([b.key[i] for b in bounds]) for i in range(3)]), lambda s: F.struct(*[s[str(i)].alias(w) for i, w in enumerate(WORDS)]))
    b = F.shiftright(F.col(key[0]), shift).cast("int")
    lo, hi = F.get(first, b), F.get(first, b + 1)
    own = F.struct(*[F.col(k).alias(w) for k, w in zip(key, WORDS, strict=True)])
    return lo + F.size(F.filter(F.slice(all_, lo + 1, hi - lo), lambda s: s <= own))


def shard(docs: DataFrame, n_shards: int, tolerance: float = 0.0, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs with size, shard and slot (gapless from 0 within a shard, in the order of the key). tolerance: in shares of a shard's bytes.

    docs may have columns of these names: the new ones then get underscores in front.
    """
    size, shard_, slot = (fresh(docs, n) for n in ("size", "shard", "slot"))
    key = [fresh(docs, f"shard_{w}") for w in WORDS]
    part = fresh(docs, "shard_part")
    rows = docs.withColumns({**dict(zip(key, keys(docs), strict=True)), size: n_bytes(F.col("text"))})
    sizes = materialize(rows.select(*[F.col(k).alias(w) for k, w in zip(key, WORDS, strict=True)], F.col(size).alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = max(1, min(-(-total // (piece_bytes * n_shards)), MOST_PIECES // n_shards))
    n_parts = n_shards * pieces
    within = [total * (tolerance if j % pieces == 0 else max(tolerance, 0.1)) / (n_shards if j % pieces == 0 else n_parts) for j in range(1, n_parts)]
    bounds = splitters(sizes, n_parts, within)
    below = [0, *[b.rows for b in bounds]]
    base = _numbers([below[i] - below[i - i % pieces] for i in range(n_parts)])
    rows = rows.withColumn(part, _part(key, bounds)).repartitionById(n_parts, part)  # a task a piece; the window needs no other exchange
    order = Window.partitionBy(part).orderBy(*key)
    rows = rows.withColumns({slot: F.row_number().over(order).cast("bigint") - 1 + F.get(base, F.col(part)), shard_: F.floor(F.col(part) / pieces).cast("int")})
    return rows.select(*docs.columns, size, shard_, slot)


def write_shards(docs: DataFrame, path: str, n_shards: int, tolerance: float = 0.0) -> None:
    """Write the rows of docs, a folder per shard, in the order of their slots."""
    rows = shard(docs, n_shards, tolerance)
    shard_, slot = rows.columns[-2:]
    rows.sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)

"""Conversation prefix trie from padded matrices of turn ids.

A turn's id is a hash of 127 bits over role and text; a conversation is the sequence of its ids. Sequences are dealt out by range, in
lexicographic order with the conv_id last, so every node's members stand together, and many equal conversations are spread over shards. A shard
fills padded matrices, DEPTHS turns wide, and sorts them (numpy lexsort); a cell starts a node where its column or one before it differs from the row above
(change masks, OR-accumulated along the row), and reduceat aggregates every depth at once. Conversations longer than a matrix go on in the next one, which
holds only them.

Nodes on the path of a shard's first or last sequence may go on in the next shard: they stay open. An open path is one row with its nodes' sums so far, and up to
GROUP neighbouring shards are combined by the same code until one group is left. So what is recombined is two rows a shard.

A task holds the ids of its shard, about CELLS turns (24 bytes each); only a single conversation's ids have to fit as a whole.

Defined cases: a null role or text is empty; turns are ordered by turn, null first, equal turns by role, then by the hash of their text; rows without a conv_id belong
to no conversation and are left out; a conversation can have no turns (it ends at the root); repeated rows are turns of their own; an empty table has no
nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready_python, small, small_batches

#: Turns of all conversations of a shard, about; columns of a matrix; shards that are combined at once.
CELLS, DEPTHS, GROUP = 1 << 18, 32, 1024
#: Bytes of a piece of a list of conv_ids.
PIECE = 1 << 16
#: Open nodes whose keys may be sent to every task.
SMALL_TABLE = 200_000
PAD, MOST = np.int64(-1), np.iinfo(np.int64).max


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns: an array of turn, role, a, b (the id) and chars per conversation, in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    a = F.xxhash64(role, text).bitwiseAND(F.lit((1 << 63) - 1))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), a.alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("bigint").alias("chars"))
    return turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def with_shared_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """sequences of which the first `heads` turns (at most `most`) are those of conversation `base`, both in terms of conv_id."""
    own = materialize(sequences(turns), "sequences").withColumn("_base", base)
    first = own.where(F.col("conv_id") == F.col("_base")).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, most).alias("_head"))
    first = small(materialize(first, "heads"), SMALL_TABLE // most)
    joined = own.join(first, F.col("_base") == F.col("_of"), "left").withColumn("_h", heads.cast("int"))
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


@dataclass
class Rows:
    """Sequences and what each adds to the nodes on its path (cells: one per depth from 0 on)."""

    lens: np.ndarray
    ids: np.ndarray
    seq: np.ndarray
    cells: dict[str, np.ndarray]


SUMS = ("n", "kids", "leaves", "saved")
NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, k1 bigint, k2 bigint, p1 bigint, p2 bigint"
OPEN = "shard bigint, seq bigint, ids array<bigint>, conv array<bigint>, chars array<bigint>, " + ", ".join(f"{s} array<bigint>" for s in SUMS)
SCHEMA = f"kind tinyint, {NODE}, {OPEN}, piece string"
FIELDS = [tuple(c.split()) for c in SCHEMA.split(", ")]
_TYPES = {"tinyint": pa.int8(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in FIELDS])


def _chained(key: bytes, turn: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(key + turn.tobytes())


def _two(key: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(key, "<i8").tolist())


def levels(rows: Rows) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """Per depth the nodes in lexicographic order: sums, conv (the least), chars, parent (a node of the depth above), lead (a row below it); and the last node of each row."""
    lens, n_rows = rows.lens, len(rows.lens)
    turn_at, cell_at = np.cumsum(lens) - lens, np.cumsum(lens + 1) - lens - 1
    node, rank, alive = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.flatnonzero(lens >= 0)
    out: list[dict[str, np.ndarray]] = []

    def add(cells: np.ndarray, starts: np.ndarray, lead: np.ndarray, parent: np.ndarray) -> None:
        at = {s: np.add.reduceat(rows.cells[s][cells], starts) for s in SUMS}
        out.append(at | {"conv": np.minimum.reduceat(rows.cells["conv"][cells], starts), "chars": rows.cells["chars"][cell_at[lead] + len(out)], "parent": parent, "lead": lead})

    zero = np.zeros(1, np.int64)
    add(cell_at, zero, zero, zero)
    first = 0
    alive = alive[lens > 0]
    while len(alive):
        width = int(min(DEPTHS, lens[alive].max() - first))
        have = np.minimum(lens[alive] - first, width)
        matrix = np.full((len(alive), width, 2), PAD)
        inside = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        matrix[np.repeat(np.arange(len(alive)), have), inside] = rows.ids[np.repeat(turn_at[alive] + first, have) + inside]
        order = np.lexsort([rows.seq[alive], *matrix.reshape(len(alive), -1).T[::-1], rank[alive]])
        alive, matrix, have = alive[order], matrix[order], have[order]
        changed = np.ones((len(alive), width), bool)
        changed[1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
        changed[1:, 0] |= rank[alive[1:]] != rank[alive[:-1]]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        for j in range(width):
            at = np.flatnonzero(have > j)
            some, start = alive[at], changed[at, j]
            starts = np.flatnonzero(start)
            lead = some[starts]
            add(cell_at[some] + first + j + 1, starts, lead, node[lead])
            node[some] = np.cumsum(start) - 1
        rank[alive] = np.cumsum(changed[:, -1])
        first += width
        alive = alive[lens[alive] > first]
    return out, node


def _paths(at: list[dict[str, np.ndarray]], lens: np.ndarray, node: np.ndarray) -> tuple[int, int]:
    """How deep the path of the first and that of the last sequence go: always the first or last node of a depth."""
    ends = [np.bincount(node[lens == d], minlength=len(lv["n"])) for d, lv in enumerate(at)]
    low = next(d for d in range(len(at)) if ends[d][0] or d + 1 == len(at))
    high = next(d for d in range(len(at)) if d + 1 == len(at) or at[d + 1]["parent"][-1] != len(at[d]["n"]) - 1)
    return low, high


def fold(rows: Rows, shard: int, last: bool, first: bool = True) -> pa.Table:
    """Rows of SCHEMA. kind 0: finished nodes; 1: the open paths; 2: pieces of the lists of conv_ids that end at open nodes.

    last: nothing stays open. first: the rows are conversations; else they are open paths, and finished nodes name their key, as others ask for it.
    """
    at, node = levels(rows)
    low, high = (-1, -1) if last else _paths(at, rows.lens, node)
    turn_at = np.cumsum(rows.lens) - rows.lens
    open_ = []
    for d, lv in enumerate(at):
        flags = np.zeros(len(lv["n"]), bool)
        if d <= low:
            flags[0] = True
        if d <= high:
            flags[-1] = True
        open_.append(flags)
    root = xxhash.xxh3_128_digest(b"")
    keys: list[dict[int, bytes]] = [{0: root}]
    for d in range(1, len(at)):
        lead, parent = at[d]["lead"], at[d]["parent"]
        wanted = np.flatnonzero(open_[d]) if first else np.arange(len(lead))
        keys.append({int(i): _chained(keys[d - 1][int(parent[i])], rows.ids[turn_at[lead[i]] + d - 1]) for i in wanted})
    digests, pieces = _ends(rows, node, at, open_, keys) if first else ({}, [])
    out: dict[str, list] = {n: [] for n, _ in FIELDS}
    nothing = hashlib.sha256(b"").hexdigest()
    for d in range(len(at) - 1, -1, -1):
        lv = at[d]
        done = np.flatnonzero(~open_[d])
        if not len(done):
            continue
        leaves = np.where(lv["kids"] == 0, 1, lv["leaves"])
        saved = lv["saved"] + (lv["n"] - 1) * lv["chars"]
        up, held = lv["parent"][done], np.zeros(len(done), bool)
        if d:
            np.add.at(at[d - 1]["kids"], up, 1)
            np.add.at(at[d - 1]["leaves"], up, leaves[done])
            np.add.at(at[d - 1]["saved"], up, saved[done])
            held = open_[d - 1][up]
        own = [_two(keys[d][i]) for i in done.tolist()] if not first else [(None, None)] * len(done)
        above = [_two(keys[d - 1][p]) if h else (None, None) for p, h in zip(up.tolist(), held.tolist(), strict=True)]
        known = [None if h or not d else c for h, c in zip(held.tolist(), (at[d - 1]["conv"][up] if d else up).tolist(), strict=True)]
        for name, values in (
            ("kind", [0] * len(done)), ("depth", [d] * len(done)), ("conv_id", lv["conv"][done].tolist()), ("parent_conv_id", known), ("n_convs", lv["n"][done].tolist()), ("n_children", lv["kids"][done].tolist()),
            ("n_leaves", leaves[done].tolist()), ("saved_tokens", saved[done].tolist()), ("ends_sha256", [digests.get((d, i), nothing) if first else None for i in done.tolist()]),
            ("k1", [k[0] for k in own]), ("k2", [k[1] for k in own]), ("p1", [k[0] for k in above]), ("p2", [k[1] for k in above]),
        ):
            out[name] += values
    tables = [_table(out)]
    if not last:
        tables.append(_table(_open_rows(rows, at, turn_at, low, high, shard)))
    for k, path, text in pieces:
        tables.append(_table({"kind": [2], "k1": [k[0]], "k2": [k[1]], "shard": [shard], "seq": [path], "piece": [text]}))
    return pa.concat_tables(tables)


def _table(found: dict[str, list]) -> pa.Table:
    n = max(map(len, found.values()))
    return pa.table([pa.array(found[f.name] if found.get(f.name) else [None] * n, f.type) for f in _ARROW], schema=_ARROW)


def _ends(rows: Rows, node: np.ndarray, at: list[dict], open_: list[np.ndarray], keys: list[dict[int, bytes]]) -> tuple[dict, list]:
    """SHA-256 of the conv_ids that end at a finished node; for open ones their lists in pieces."""
    order = np.lexsort([rows.seq, node, rows.lens])
    depth, own, ids = rows.lens[order], node[order], rows.seq[order]
    cuts = [0, *(np.flatnonzero((np.diff(depth) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(order)]
    digests, pieces = {}, []
    for a, b in zip(cuts, cuts[1:], strict=False):
        d, i, text = int(depth[a]), int(own[a]), ",".join(map(str, ids[a:b].tolist()))
        if open_[d][i]:
            pieces += [(_two(keys[d][i]), k, text[k : k + PIECE]) for k in range(0, len(text), PIECE)]
        else:
            digests[d, i] = hashlib.sha256(text.encode()).hexdigest()
    return digests, pieces


def _open_rows(rows: Rows, at: list[dict], turn_at: np.ndarray, low: int, high: int, shard: int) -> dict[str, list]:
    """The open paths: the first sequence's, and the last one's, where a node on both counts for the first only."""
    out: dict[str, list] = {"kind": [], "shard": [], "seq": []} | {c: [] for c in ("ids", "conv", "chars", *SUMS)}
    for which, (deep, i) in enumerate(((low, 0), (high, -1))):
        own = [not which or d > low or len(lv["n"]) > 1 for d, lv in enumerate(at[: deep + 1])]
        if not any(own):
            continue
        lead = int(at[deep]["lead"][i])
        out["kind"].append(1)
        out["shard"].append(shard)
        out["seq"].append(2 * shard + which)
        out["ids"].append(rows.ids[turn_at[lead] : turn_at[lead] + deep].ravel().tolist())
        out["conv"].append([int(lv["conv"][i]) if o else MOST for lv, o in zip(at, own, strict=False)])
        out["chars"].append([int(lv["chars"][i]) for lv in at[: deep + 1]])
        for s in SUMS:
            out[s].append([int(lv[s][i]) if o else 0 for lv, o in zip(at, own, strict=False)])
    return out


def _first_rows(table: pa.Table) -> Rows:
    """conv_id, ids, chars as rows: each conversation counts once at every depth."""
    table = table.combine_chunks()
    ids, chars = (table.column(c).combine_chunks() for c in ("ids", "chars"))
    lens = np.diff(chars.offsets.to_numpy()).astype(np.int64)
    conv = table.column("conv_id").to_numpy()
    cells = int((lens + 1).sum())
    of = np.ones(cells, bool)
    of[np.cumsum(lens + 1) - lens - 1] = False  # the roots
    all_chars = np.zeros(cells, np.int64)
    all_chars[of] = chars.flatten().to_numpy()
    zero = np.zeros(cells, np.int64)
    return Rows(lens, ids.flatten().to_numpy().reshape(-1, 2), conv, {"n": zero + 1, "conv": np.repeat(conv, lens + 1), "chars": all_chars, "kids": zero, "leaves": zero, "saved": zero})


def _open_as_rows(table: pa.Table) -> Rows:
    table = table.combine_chunks()
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
    lens = np.diff(table.column("chars").combine_chunks().offsets.to_numpy()).astype(np.int64) - 1
    return Rows(lens, flat("ids").reshape(-1, 2), table.column("seq").to_numpy(), {c: flat(c) for c in ("conv", "chars", *SUMS)})


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from fold(_first_rows(pa.Table.from_batches(held)), TaskContext.get().partitionId(), last=False).to_batches(max_chunksize=10_000)


def _combined(open_: DataFrame, group: int, last: bool) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = _open_as_rows(table)
        return fold(rows, int(table.column("shard")[0].as_py()), last, first=False)

    names = [n for n, _ in FIELDS]
    dealt = open_.withColumn("shard", F.floor(F.col("shard") / group))
    return materialize(dealt.select(*names).groupBy("shard").applyInArrow(run, SCHEMA), "trie")


def _digests(pieces: DataFrame) -> DataFrame:
    """k1, k2, sha of the lists in pieces, which stream through a task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, shard = None, None, None
        for batch in batches:
            for k1, k2, s, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k1, k2) != key:
                    if key:
                        yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "sha": [digest.hexdigest()]})
                    key, digest, shard = (k1, k2), hashlib.sha256(), s
                if s != shard:
                    digest.update(b",")
                    shard = s
                digest.update(piece.encode())
        if key:
            yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "sha": [digest.hexdigest()]})

    ordered = pieces.select("k1", "k2", "shard", "piece", "seq").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard", "seq")
    with small_batches(pieces.sparkSession):
        return materialize(ordered.mapInArrow(run, "k1 bigint, k2 bigint, sha string"), "digests")


def prefix_trie(conversations: DataFrame, cells: int = CELLS, group: int = GROUP) -> DataFrame:
    """A row per node: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id (each once, not null) and turns, as `sequences` gives them.
    """
    spark = conversations.sparkSession
    ready_python(spark)
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = materialize(conversations.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "conversations")
    total = rows.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cells))
    found = materialize(rows.repartitionByRange(n, "ids", "conv_id").select("conv_id", "ids", "chars").mapInArrow(_by_shard, SCHEMA), "trie")
    tables, shards, last = [found], n, False
    while not last:
        shards, last = -(-shards // group), shards <= group
        tables.append(_combined(tables[-1].where("kind = 1"), group, last))
    nodes = tables[0].where("kind = 0")
    later = tables[1].where("kind = 0")
    for t in tables[2:]:
        later = later.unionByName(t.where("kind = 0"))
    ends = _digests(found.where("kind = 2"))
    later = materialize(later.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha"), "nodes")
    parents = small(later.select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), F.col("conv_id").alias("of_conv")), SMALL_TABLE)
    every = nodes.unionByName(later).join(parents, (F.col("p1") == F.col("of1")) & (F.col("p2") == F.col("of2")), "left")
    return every.select("conv_id", "depth", F.coalesce("parent_conv_id", "of_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

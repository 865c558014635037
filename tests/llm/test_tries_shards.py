"""op11 to op13 against plain versions: the registered queries on given tables, the operators on odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import importance, sharding, trie
from crosspanel.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_trie(sequences):
    """sequences: conv_id -> tuple of (role, text)."""
    members, kids, out = defaultdict(list), defaultdict(list), []
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def visit(k):
        leaves, saved = 0, (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for x in kids[k]:
            a, b = visit(x)
            leaves, saved = leaves + a, saved + b
        ends = sorted(c for c in members[k] if len(sequences[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves or 1, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves or 1, saved

    if members:
        visit(())
    return sorted(out, key=str)


def plain_sequences(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: tuple(v[1:] for v in sorted(vs)) for c, vs in by.items()}


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_op11_equals_brute_force(spark):
    own = plain_sequences(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall())
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    assert as_rows(QUERIES["op11_prefix_trie"](spark, SMALL)) == plain_trie({c: own.get(c - c % 100, ())[: heads[c]] + s[heads[c] :] for c, s in own.items()})


@pytest.mark.parametrize(("cells", "group", "depth"), [(1 << 18, 1024, 9), (40, 3, 9), (60, 2, 80)])
def test_trie_over_many_shards_and_long_conversations(spark, cells, group, depth):
    """Many equal conversations, shared heads, some longer than two matrices, shards of few rows combined over several levels."""
    rng = random.Random(5)
    rows = []
    for c in range(160):
        if c % 3 == 0:
            rows += [(c, i, "user", "same") for i in range(depth // 2)]  # a third are equal
        else:
            rows += [(c, i, rng.choice(["user", "assistant"]), "x" * rng.choice([1, 1, 2]) if i < 4 or c % 7 else "tail") for i in range(rng.randrange(1, depth))]
    want = plain_trie(plain_sequences(rows))
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, TURNS)), cells, group)
    assert as_rows(got) == want


def test_trie_on_odd_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (2, None, "user", "a"), (2, 0, "", ""), (2, 0, "", ""), (None, 0, "user", "a"), (-5, 3, "user", ""), (9, 0, "user", "a" * 100_000), (9, 0, "user", "a" * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("clash"), "ids": F.lit(1), "turns": F.lit(2)})
    want = plain_trie(plain_sequences(rows))
    assert as_rows(trie.prefix_trie(trie.sequences(df))) == want
    assert trie.prefix_trie(trie.sequences(df.limit(0))).collect() == []


def test_trie_with_turnless_conversations(spark):
    """Conversations whose own turns are all replaced, and whose base does not exist, end at the root."""
    rows = [(c, t, "user", f"t{t}") for c in (201, 202, 300, 301) for t in range(2)]
    df = spark.createDataFrame(rows, TURNS)
    conv = F.col("conv_id")
    got = trie.with_shared_heads(df, conv - conv % 100, F.when(conv % 100 == 0, 0).otherwise(5), 5)
    own = plain_sequences(rows)
    assert as_rows(trie.prefix_trie(got)) == plain_trie({c: s if c % 100 == 0 else own.get(c - c % 100, ())[:5] + s[5:] for c, s in own.items()})


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_importance(docs, target, width=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = plain_words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(w) - n + 1))

    own, s, t = [features(x) for _, x in docs], Counter(), Counter()
    for f in own:
        s.update(f)
    for x in target:
        t.update(features(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_all := s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    assert t_all
    rows = []
    for (d, x), f in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items())
        rows.append([d, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_op12_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    target = [x for (x,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    assert as_rows(QUERIES["op12_importance_resampling"](spark, SMALL)) == plain_importance(docs, target)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_importance_on_odd_rows_and_across_lines(spark, width):
    rng = random.Random(3)
    names = ["Öl", "ab", "AB9", "c", "日本", "x"]
    text = lambda n: "".join(rng.choice(names) + rng.choice([" ", "\n", "\n\n", ", ", "\r\n", "-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 90))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "!!"), (None, "ab c"), (7, "ab c " * 30), (7, "ab c " * 30), (64, "c\n" * 40), (65, "c\n" * 40), (66, "ab " * 20_000)]
    target = [text(40), None, "日本 x\nc"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"rid": F.lit("clash"), "line": F.lit(1), "score": F.lit(2)})
    got = importance.importance(df, spark.createDataFrame([(x,) for x in target], "text string"), width, 500, 20, 30).select("doc_id", "n_features", "weight", "score", "rank")
    assert as_rows(got) == plain_importance(docs, target, width, 500, 20, 30)
    assert importance.importance(df.limit(0), df.select("text"), width).collect() == []
    flat = importance.importance(df, df.select("text").limit(0), width, 500)
    assert flat.count() == len(docs)


def test_resample_returns_whole_rows(spark):
    docs = [(i, f"w{i % 5} " * 25, i) for i in range(50)] + [(3, "w3 " * 25, 99)] * 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string, rank int")
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = importance.resample(df, target, percent=50)
    assert got.columns == df.columns and got.count() == 26
    drawn = Counter(r[0] for r in importance.importance(df, target, percent=50).where("rank IS NOT NULL").select("doc_id").collect())
    assert Counter(r[0] for r in got.collect()) == drawn and {tuple(r) for r in got.collect()} <= set(docs)


def plain_shards(docs, n):
    key = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    rows = sorted((key(x or ""), key(str(d)), d, len((x or "").encode()) + 1) for d, x in docs)
    total, at, slots, out = sum(r[3] for r in rows), 0, Counter(), {}
    for _, _, d, size in rows:
        shard = n * (2 * at + size) // (2 * total)  # by the middle of the row: splitters are the boundaries nearest to the targets
        out[d] = (size, shard, slots[shard])
        slots[shard] += 1
        at += size
    return out


def test_op13_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in QUERIES["op13_histogram_shards"](spark, SMALL).collect()}
    assert got == plain_shards(docs, 16)


@pytest.mark.parametrize(("n", "piece"), [(1, 1 << 28), (4, 1 << 28), (4, 500), (300, 1 << 28)])
def test_shards_with_a_hot_text(spark, n, piece):
    """A third of all rows share a text, one text is very long, some are empty or null; pieces don't change the result."""
    rng = random.Random(1)
    docs = [(i, "the same text" if i % 3 == 0 else None if i % 31 == 0 else "é" * rng.randrange(40)) for i in range(400)] + [(1000, "y" * 3000), (-1, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"size": F.lit("clash"), "slot": F.lit(0)})
    got = sharding.shard(df, n, piece_bytes=piece)
    assert got.columns == ["doc_id", "text", "size", "slot", "_size", "shard", "_slot"]
    assert {r["doc_id"]: (r["_size"], r["shard"], r["_slot"]) for r in got.collect()} == plain_shards(docs, n)


def test_shards_within_tolerance_and_odd_rows(spark):
    docs = [(i, f"{i} " * (i % 50)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sums = [r[0] for r in sharding.shard(df, 8, tolerance=0.02).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 8 and max(abs(s * 8 / sum(sums) - 1) for s in sums) < 0.05
    odd = spark.createDataFrame([(None, None), (None, None), (None, "a"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == 5
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(odd.limit(0), 3).collect() == []


def test_written_shards_keep_rows(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    assert back.select("shard").distinct().count() == 4


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling", "op13_histogram_shards"])
def test_sql_of_the_queries(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    found = con.execute("SELECT " + ", ".join(df.columns) + f" FROM ({ORACLE_SQL[name]})").fetchall()
    assert as_rows(df) == sorted(found, key=str)

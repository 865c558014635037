import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from crosspanel.llm import mixing, secrets
from crosspanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_base(text):
    found = []
    for kind, pattern, flags, length in (("assign", secrets.ASSIGN, re.I | re.A, lambda m: len(m[2]) >= 6), ("access", secrets.ACCESS, 0, lambda m: len(m[0]) >= 20), ("hex", secrets.HEX, 0, lambda m: len(m[0]) >= 24)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if length(m)]
    return [x for _, _, x in sorted(found)]


def test_op3_base_equals_brute_force(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op3_secret_scans"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == docs.keys()
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(n - 1)) + "7"
    rows = [(i, f"word {key(40)} end", 0) for i in range(60)] + [(100 + i, f"see page{i}page{i}page{i}pagepagePagepage1 section_{i}_section_section_1 12345678901234567890123", 0) for i in range(60)] + [(500, None, 0), (501, "", 0)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    assert sum(bool(found[i]) for i in range(60)) >= 50
    assert sum(bool(found[100 + i]) for i in range(60)) <= 3
    assert found[500] == found[501] == []


def test_rare_kinds_and_pieces_of_a_run_are_found(spark):
    """One secret per encoding and length class, one in a URL path and one after a name; ordinary paths and names are left alone."""
    rng, rows = random.Random(5), []
    key = lambda e, n: "".join(rng.choice(secrets.ALPHABETS[e]) for _ in range(n))
    for e in ("hex", "HEX", "base32", "base36", "base62", "base64", "base64url"):
        for n in (20, 24, 32, 48, 64, 128):
            while secrets.infer_encoding(k := key(e, n)) != e or secrets.randomness(k, e) < 0.1:
                pass
            rows.append(f"see {k} end")
    while secrets.randomness(k := key("base62", 40), "base62") < 0.1 or secrets.infer_encoding(k) != "base62":
        pass
    rows += [f"https://host.example/static/assets/files/{k}/index.html", f"backup_of_the_main_service_{k}"]
    ordinary = ["/usr/local/lib/python3.13/site-packages/numpy/core", "some-article-title-about-things-2021", "page1page1page1pagepagePagepage1 section_section_section_1"]
    df = spark.createDataFrame(list(enumerate(rows + ordinary)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    for i in range(42):
        assert [(s["start"], s["end"]) for s in found[i]] == [(4, len(rows[i]) - 4)]
    for i in (42, 43):
        assert any(rows[i][s["start"] : s["end"]].endswith(k) or k in rows[i][s["start"] : s["end"]] for s in found[i])
    assert not any(found[i] for i in range(44, 47))
    marked = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert all("<secret>" in marked[i] for i in range(44)) and not any(k in t for t in marked.values())


def test_keys_of_letters_only_are_found_and_long_words_are_not(spark):
    rng, n = random.Random(8), 200
    key = lambda chars: "".join(rng.choice(chars) for _ in range(32))
    kinds = (secrets.ALPHABETS["letters"], secrets.ALPHABETS["lower"], secrets.ALPHABETS["upper"])
    rows = [f"word {key(chars)} end" for chars in kinds for _ in range(n)] + [f"https://host.example/a/{key(kinds[0])}/b" for _ in range(n)] + [f"https://host.example/keys/{key(secrets.ALPHABETS['base62'])}/b" for _ in range(n)]
    words = "Rechtsschutzversicherungsgesellschaften Arbeiterunfallversicherungsgesetz Lebensversicherungsgesellschaften Kraftfahrzeughaftpflichtversicherung antidisestablishmentarianism".split()
    prose = [f"{w} steht in /usr/share/{w.lower()}/{w}_{w} und {w.upper()}" for w in words]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(rows + prose)), "doc_id long, text string")).collect()}
    for k in range(5):
        assert sum(bool(found[i]) for i in range(k * n, (k + 1) * n)) >= 0.9 * n
    # words in both cases never pass; some of one case do, within the share that false discoveries may have
    wrong = [prose[i - 5 * n][s["start"] : s["end"]] for i in range(5 * n, len(found)) for s in found[i]]
    assert len(wrong) <= 0.05 * sum(map(len, found.values())) and all(w in (w.lower(), w.upper()) for w in wrong)


def test_sparse_classes_take_pooled_thresholds():
    uniform, low = np.full(secrets.CELLS, 40), np.eye(1, secrets.CELLS, dtype=int)[0]
    got = secrets.chosen({"hex:1": uniform + 2000 * low, "hex:2": low, "base32:1": low, "base62:5": low, "base64:4": 3000 * low})
    assert got["hex:1"] == got["hex:2"] == got["base32:1"] > 0 and got["base62:5"] > 0 and "base64:4" not in got
    assert secrets.chosen({"hex:1": low}) == {"hex:1": secrets.PRIOR}


def test_redact(spark):
    rows = [(1, "a password: hunter2hunter2 z", 0), (2, None, 1), (None, "x 0123456789abcdef0123456789abcdef", 2), (3, "clean", 3), (3, "clean", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(map(tuple, secrets.redact(df).collect()), key=str)
    assert got == sorted([(1, "a <secret> z", 0), (2, None, 1), (None, "x <secret>", 2), (3, "clean", 3), (3, "clean", 3)], key=str)
    assert secrets.redact(df.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = total - sum(full.values())
        share = sum(w[s] for s in names if s not in full)
        t = {s: rest * w[s] / share for s in names if s not in full} if share else {}
        over = {s: most * sizes[s] for s in t if t[s] > most * sizes[s]}
        if not over:
            return t | full
        full |= over


def test_op4_targets_totals_and_reruns(spark):
    a, b = (sorted(map(tuple, QUERIES["op4_source_mixing"](spark, SF).collect())) for _ in range(2))
    assert a == b
    docs = {d: (s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()}
    assert [r[0] for r in a] == sorted(docs)
    by = defaultdict(int)
    for s, n in docs.values():
        by[s] += n
    want, taken = brute_targets(by), defaultdict(int)
    for d, size, source_size, target, got in a:
        s, n = docs[d]
        assert (size, source_size) == (n, by[s]) and abs(target - want[s]) < 1e-6 * (1 + target) and got <= 3 * size and (size == 0 or got % size == 0)
        taken[s] += got
    largest = max(n for _, n in docs.values())
    assert all(abs(taken[s] - want[s]) <= largest + 1 for s in by)


def test_mix_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, None, "x"), (2, "", "x"), (3, "c " * 5000, "y")] + [(9, "d e f", "hot")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r["source"] == "hot"]
    assert abs(sum(r["n_copies"] * 3 for r in hot) - hot[0]["target"]) <= 3
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["n_copies"] for r in got)


def test_inclusion_rates_over_seeds(spark):
    """Every document is taken as often as its source's rate says, on average over seeds, whatever its size."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "ab"[i % 2]) for i in range(120)]
    df, n = spark.createDataFrame(rows, "doc_id long, text string, source string"), 40
    taken, rate = defaultdict(int), {}
    for seed in range(n):
        for r in mixing.mix(df, seed=seed).collect():
            taken[r["doc_id"]] += r["n_copies"]
            rate[r["doc_id"]] = r["target"] / r["source_size"]
    for d, p in rate.items():
        f = p % 1
        assert abs(taken[d] / n - p) <= 4.5 * (f * (1 - f) / n) ** 0.5 + 1e-9
    for s in "ab":
        own = [d for d, _, x in rows if x == s]
        assert abs(np.mean([taken[d] / n - rate[d] for d in own])) < 0.02


def test_copies_of_equal_rows_are_settled_by_all_columns(spark):
    rows = [(1, "one two three", "a", x) for x in range(5)] + [(1, "four five six", "a", x) for x in range(5)] + [(i, f"x{i} y z w", "b", 0) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    once = [sorted(map(str, mixing.apply_mix(df.orderBy(F.rand(i)).repartition(3)).collect())) for i in range(2)]
    assert once[0] == once[1]
    words = sum(r["n_copies"] * r["size"] for r in mixing.mix(df).collect())
    assert words == sum(len(r["text"].split()) for r in mixing.apply_mix(df).collect())

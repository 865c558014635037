from collections import defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from crosspanel.llm import pieces
from crosspanel.llm.common import materialize
from crosspanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert name == "piece_encoding" or docs.columns == columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    sets = lambda text: set(zip(*(text.lower().split()[i:] for i in range(5)), strict=False))
    kept = {r["doc_id"] for r in QUERIES["op10_line_rules"](spark, SF).collect() if r["kept"]}
    assert rows(seen["quality_rules"][1]).keys() == kept
    before, after = map(rows, seen["near_dedup"])
    assert after.keys() <= before.keys() and len(set(after.values())) == len(after)
    known = {d: sets(t) for d, t in before.items() if len(t.split()) > 5}
    near = {(a, b) for a in known for b in known if a < b and 5 * len(known[a] & known[b]) >= 4 * len(known[a] | known[b])}
    assert not any(a in after and b in after for a, b in near)
    assert all(d in after or any(d in pair for pair in near) for d in known)
    before, after = map(rows, seen["secret_scans"])
    assert after.keys() == before.keys() and all("<secret>" in after[d] for d in after if after[d] != before[d])
    before, after = rows(seen["source_mixing"][0]), defaultdict(int)
    for r in seen["source_mixing"][1].collect():
        assert r["text"] == before[r["doc_id"]]
        after[r["doc_id"]] += 1
    assert max(after.values()) <= 3
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    got = defaultdict(int)
    for r in docs.collect():
        assert m.decode(np.array(r["ids"], "<u4")) == before[r["doc_id"]]
        got[r["doc_id"]] += 1
    assert got == after
    assert corpus_pipeline.run(spark, SF).count() == sum(after.values())


def test_stages_on_odd_tables(spark):
    """Nulls everywhere, empty and long texts, repeats, a near copy (14 of 15 five-word shingles), clashing column names; and no rows at all."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    schema = "doc_id long, text string, lang string, source string, n_chars long, content string, text_hash string, fp int, row_at int, row_size int, mix_at int, size int, spans string, kept string"
    extra = ("c", "h", 1, 2, 3, 4, 5, "s", "k")
    rows = [
        (1, words, "en", "a", 9, *extra),
        (1, words, "en", "a", 9, *extra),
        (2, f"{words[::-1]} secret: hunter2hunter2", None, None, None, *extra),
        (5, f"{words} end", "en", "a", 9, *extra),
        (None, "other " + words[::-2], "en", "a", 9, *([None] * 9)),
        (None, None, None, None, None, *extra),
        (3, "", "en", "b", 0, *extra),
        (4, " ".join(f"w{i}" for i in range(40_000)), "en", "b", 1, *extra),
    ]
    docs = spark.createDataFrame(rows, schema)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name == "secret_scans":
            got = {r["doc_id"]: r for r in docs.collect()}
            assert got[2]["text"].endswith("<secret>") and got[2]["n_chars"] is None or got[2]["n_chars"] == len(got[2]["text"])
            assert got[1]["kept"] == "k" and got[1]["size"] == 5
        assert name == "piece_encoding" or docs.columns == [f.split()[0] for f in schema.split(", ")]
    assert sizes[:3] == [6, 4, 4]
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), name)
        assert empty.count() == 0

import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from crosspanel.llm import chat, tokens
from crosspanel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_op1_equals_sql(spark):
    got = sorted(map(tuple, QUERIES["op1_chat_formatting"](spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op1_chat_formatting']})").fetchall())


def test_round_trip_of_hostile_texts(spark):
    texts = ["", None, "&lt;| &amp; <|im_end|>\n<|im_start|>assistant\nx", "</s>[INST]<<SYS>>&#91;INST]", "é😀<|\n", "a" * 100_000]
    rows = [(1, i, "assistant" if i % 2 else "u<|\nser", t) for i, t in enumerate(texts)] + [(None, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    read = {r["conv_id"]: r for r in chat.read_formatted(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("assistant" if i % 2 else "u<|\nser", t or "") for i, t in enumerate(texts)]
    assert read[1]["loss_text"] == "".join(t or "" for t in texts[1::2])
    assert read[1]["formatted"].count("<|im_end|>") == len(texts)
    assert [tuple(t) for t in read[None]["turns"]] == [("", "")]
    assert len(read[2]["turns"]) == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [(1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3), part("odd", text="t")]), (1, 1, "assistant", None)]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")).first()
    assert "see &lt;|image|><|image|><|audio|><|document|>t" in r["formatted"]
    assert [tuple(a) for a in r["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 768)]
    assert r["n_media_tokens"] == 810


TEXTS = [None, "", " ", "It's we'll 'sa ''s", "Ünïcode ÉÉ Straße ǅ İx ΣΑΣ", "a<|endoftext|>b <|EndOfText|>", "é ́x  y z", "J̌ ﬁ ½ ² 12345 ٣", "日本語 text 😀😀", "x" * 5000, "\x1cab\x85c", "don't,re. \"q\"'s"]


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), tokens.encoder(path)
    got = enc.encode([None if t is None else t.encode() for t in TEXTS])
    assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_op2_equals_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    want, start = [], 0
    for d, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_files"](spark, SF).collect())) == want


def test_token_files_edges(spark):
    rows = [(5, "b", 1), (None, "n", 2), (5, "b", 3), (3, None, 4)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokens.tokenize_to_files(spark.createDataFrame(rows, "doc_id long, text string, start int"), path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 5, 5]
    assert [r["start"] for r in got] == [0, 2, 3, 5]
    assert tokens.tokenize_to_files(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_files_read_by_ranges_and_in_small_pieces(spark, monkeypatch):
    """Another file system than a local one is read range by range; long documents come alone."""
    import contextlib

    import pyarrow.fs as pafs

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"word {i} " * (i * 40)) for i in range(12)]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/ranges"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder, path)
    whole = tokens.read_tokens(spark, folder, with_ids=True).collect()
    assert [sum(len(r["ids"]) for r in whole), {r["doc_id"] for r in whole}] == [sum(r["n_tokens"] for r in whole), set(range(12))]
    part = next(p for p in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if p.path.endswith(".tok")).path
    with contextlib.ExitStack() as files:
        near, far = tokens._ranges(pafs.LocalFileSystem(), part, "<u2", files), tokens._ranges(pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), part, "<u2", files)
        assert near(3, 9).tolist() == far(3, 9).tolist() and far(0, 0).tolist() == []


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    from crosspanel.llm.common import slices

    texts = ["a" * 100, None, "b" * 5000, "", "c" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["id", "text"])
    got = list(slices(iter([batch, batch.slice(0, 0)]), 1, rows=3, size=1000))
    assert [b.num_rows for b in got] == [2, 1, 2] and [t for b in got for t in b.column(1).to_pylist()] == texts

"""Token-ID / binary output: flat files of unsigned integers with 64-bit document offsets.

A range partitioning by id makes the order global, every task streams its documents into files of its own, and
the bases of the partitions are prefix sums over one small row per partition. Layout of a folder, part by part:

    part-00000.tok   token ids, little-endian, uint16 (vocabularies below 65,536) or uint32, nothing else
    part-00000.off   document offsets in tokens within the part, little-endian int64, one more than documents
    part-00000.ids   document ids, little-endian int64 (0 where null)
    part-00000.nul   one byte per document, 1 where the id is null
    manifest         Parquet: part, n_docs, n_tokens, doc_base, token_base, dtype

A task writes under a name of its own and renames at its end, so retried and speculative tasks leave whole files.
The folder has to be one that pyarrow can open (a local or mounted path, HDFS, S3); local files are memory-mapped.

Defined cases: a null text counts as empty and still gets its end id; null ids come first; repeated ids all stay,
ordered by a hash of their text; empty tables give an empty manifest.
"""

from __future__ import annotations

import contextlib
import functools
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready_python, scratch_path, share_file, shared_file, slices, small_batches

MANIFEST = "part int, n_docs bigint, n_tokens bigint"
#: Most words that a Python worker remembers.
CACHE_WORDS = 800_000
#: Tokens that are read back at once (one document at least).
READ_TOKENS = 1 << 21


class WordEncoder:
    """encode() of a tokenizers file, text by text the same ids, with a memory of pre-tokens.

    A text of printable characters below U+0180 (so in normal form as it is) and without a special token is cut into pre-tokens here; the unseen ones go
    through the tokenizer in one call, and as every pre-token ends with a word-end token, the ids part again. No pre-token
    holds white space, so any other text is cut at ASCII white space first, and its chunks that aren't of this kind go through the tokenizer by themselves.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        latin = [c for c in map(chr, range(0xA1, 0x180)) if c != "\xad"]
        letters = "".join(c for c in latin if c.isalpha())
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.pretokens = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9{numbers}]|[^\\sa-z0-9{letters}{numbers}]+").findall
        self.plain = re.compile(f"[ \\t-\\r!-~{''.join(latin).replace('İ', '')}]*").fullmatch  # İ becomes two characters in lower case
        self.known: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _cut(self, text: bytes | None) -> list[str]:
        """The pre-tokens in lower case; a chunk that has to be encoded by itself stands behind a NUL."""
        if not text:
            return []
        s = text.decode()
        if self.plain(s) and "<|" not in s:
            return self.pretokens(s.lower())
        out: list[str] = []
        for chunk in text.split():
            s = chunk.decode()
            out += self.pretokens(s.lower()) if self.plain(s) and "<|" not in s else ["\0" + s]
        return out

    def _learn(self, unseen: set[str]) -> None:
        known = self.known
        alone = {p for p in unseen if p[0] == "\0"}
        known.update((p, self._alone(p[1:])) for p in alone)
        if new := list(unseen - alone):
            lines = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(new) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
                known.update(zip(new, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
            else:
                known.update((p, self._alone(p)) for p in new)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as the bytes of `dtype`."""
        cut = [self._cut(t) for t in texts]
        seen = set(chain.from_iterable(cut))
        if len(self.known) + len(seen) > CACHE_WORDS:
            self.known.clear()
        if unseen := seen.difference(self.known):
            self._learn(unseen)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


@contextlib.contextmanager
def _whole_file(fs: pafs.FileSystem, path: str) -> Iterator[pa.NativeFile]:
    """Write under another name, then rename over whatever an earlier attempt left."""
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own) as out:
            yield out
    except BaseException:
        fs.delete_file(own)
        raise
    try:
        fs.move(own, path)
    except OSError:
        fs.delete_file(path)
        fs.move(own, path)


def _ranges(fs: pafs.FileSystem, path: str, dtype: str, files: contextlib.ExitStack) -> Callable[[int, int], np.ndarray]:
    """A function (first, end) that gives the numbers of a file: a local file is memory-mapped, of others only the range is read."""
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        return lambda a, b: whole[a:b]
    held, width = files.enter_context(fs.open_input_file(path)), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(held.read_at((b - a) * width, a * width), dtype)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode `text` of every row and write it in ascending doc_id order. Other columns are ignored."""
    spark = docs.sparkSession
    ready_python(spark)
    name = share_file(spark, tokenizer_path)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, n_docs, n_tokens = encoder(shared_file(name)), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        batches = slices(batches, 1)
        first = next(batches, None)
        if first is None:
            return
        fs, root = _filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        with contextlib.ExitStack() as files:
            tok, off, ids, nul = (files.enter_context(_whole_file(fs, f"{root}/part-{part:05d}.{x}")) for x in ("tok", "off", "ids", "nul"))
            off.write(np.zeros(1, "<i8").tobytes())
            for batch in chain([first], batches):
                coded = [x + end for x in enc.encode(batch.column(1).cast(pa.binary()).to_pylist())]
                ends = n_tokens + np.cumsum([len(x) for x in coded], dtype="<i8") // enc.dtype.itemsize if coded else np.zeros(0, "<i8")
                tok.write(b"".join(coded))
                off.write(ends.astype("<i8").tobytes())
                ids.write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                nul.write(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                n_docs += batch.num_rows
                n_tokens = int(ends[-1]) if len(ends) else n_tokens
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["part", "n_docs", "n_tokens"])

    key = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    with small_batches(spark):
        ordered.mapInArrow(write_part, MANIFEST).write.parquet(f"{out_dir}/parts")
    dtype = encoder(tokenizer_path).dtype.str
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    parts = spark.read.schema(MANIFEST).parquet(f"{out_dir}/parts")
    parts.withColumns({"doc_base": base("n_docs"), "token_base": base("n_tokens"), "dtype": F.lit(dtype)}).write.parquet(f"{out_dir}/manifest")


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32), and on request the ids."""
    ready_python(spark)

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(out_dir)
        for batch in batches:
            for row in batch.to_pylist():
                with contextlib.ExitStack() as files:
                    tok, off, ids, nul = (_ranges(fs, f"{root}/part-{row['part']:05d}.{x}", t, files) for x, t in (("tok", row["dtype"]), ("off", "<i8"), ("ids", "<i8"), ("nul", "u1")))
                    a = 0
                    while a < row["n_docs"]:
                        at = off(a, min(a + 2000, row["n_docs"]) + 1)
                        at = at[: max(2, int(np.searchsorted(at, at[0] + READ_TOKENS, "right")))]  # one document at least
                        b, flat = a + len(at) - 1, tok(int(at[0]), int(at[-1]))
                        cut = at - at[0]
                        cols = [
                            pa.array(ids(a, b), pa.int64(), mask=nul(a, b) == 1),
                            pa.array(at[:-1] + row["token_base"], pa.int64()),
                            pa.array(np.diff(at), pa.int64()),
                            pa.array([zlib.crc32(flat[x:y].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:], strict=False)], pa.int64()),
                        ]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cut.astype("i4")), pa.array(flat.astype("i4"))))
                        yield pa.RecordBatch.from_arrays(cols, names)
                        a = b

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    manifest = spark.read.parquet(f"{out_dir}/manifest")
    return manifest.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read_part, schema)


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write to a new folder in the shared folder and read the files back."""
    out_dir = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, out_dir, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, out_dir)

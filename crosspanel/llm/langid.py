"""Language ID by language-bitmask n-gram filters.

Per language, the character n-grams (orders ORDERS, over lower-cased letters, anything else a space) with a share of at least
`least_share` of the language's n-grams of that order go into a Bloom filter. The filters of all languages are bit-sliced: a
slot holds one bit per language, so that AND over an n-gram's slots returns all languages that contain it. Per text and language, the
contained n-grams are counted bit by bit, corrected by the filter's false-positive rate, and the most decide.

Training reads whole texts of about `per_lang` documents per language (a bounded sample, by a hash of the id); the filters' size is bounded by
1 / least_share n-grams per order. Prediction reads every whole text, in pieces of bounded size.

Defined cases: a null or letterless text is `und` with score 0; ties go to the first language in code-point order; without
any learned language everything is `und`; repeated rows are each predicted; only doc_id, text and (in training) lang are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, ready_python, slices, uniform

ORDERS = (2, 3, 4)
HASHES = 3
#: Code points handled at once.
PIECE = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


@functools.cache
def letters() -> np.ndarray:
    """Code point to lower-cased code point for letters, 32 for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, start of each piece, its text's number, where n-grams may start up to) with about PIECE codes at a time; long texts come in overlapping pieces."""
    table, lap = letters(), max(ORDERS) - 1
    buffer, owner, limit, size = [], [], [], 0
    for k, text in enumerate(texts):
        codes = table[np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = codes[np.flatnonzero(np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes  # runs of spaces become one
        codes = np.r_[np.uint32(32), codes, np.uint32(32)]
        for a in range(0, len(codes), PIECE):
            piece = codes[a : a + PIECE + lap]
            buffer.append(piece)
            owner.append(k)
            limit.append(min(PIECE, len(piece)))
            size += len(piece)
            if size >= PIECE:
                yield _packed(buffer, owner, limit)
                buffer, owner, limit, size = [], [], [], 0
    if buffer:
        yield _packed(buffer, owner, limit)


def _packed(buffer: list[np.ndarray], owner: list[int], limit: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(b) for b in buffer])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    return np.concatenate(buffer), starts, np.array(owner), np.stack([lengths, np.array(limit)])


def _ngrams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hash at every position, whether an n-gram starts there)."""
    lengths, limit = ends
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # codes from here to the piece's end
    own = np.arange(len(codes)) - np.repeat(starts, lengths) < np.repeat(limit, lengths)
    wide = codes.astype(np.uint64)
    for n in ORDERS:
        h, letter = np.full(len(codes), n, np.uint64), np.zeros(len(codes), bool)
        for i in range(min(n, len(codes))):
            h[: len(codes) - i] = (h[: len(codes) - i] ^ wide[i:]) * _MIX
            letter[: len(codes) - i] |= codes[i:] != 32
        yield n, h ^ (h >> np.uint64(29)), own & letter & (left >= n)


def sample(docs: DataFrame, per_lang: int = 1500, seed: int = 5) -> DataFrame:
    """doc_id, text, lang of about per_lang documents of each language that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().collect()  # one row per language
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))]) if counts else F.create_map().cast("map<string,double>")
    return rows.where(uniform("doc_id", seed=seed) < F.try_element_at(rate, F.col("lang")))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """lang, n, h, count: every partition counts its texts, then the counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 0):
            langs, texts = batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist()
            for lang in set(langs):
                for codes, starts, _, ends in _pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for n, h, valid in _ngrams(codes, starts, ends):
                        keys, counts = np.unique(h[valid], return_counts=True)
                        if (lang, n) in held:
                            k0, c0 = held[lang, n]
                            keys, at = np.unique(np.r_[k0, keys], return_inverse=True)
                            counts = np.bincount(at, np.r_[c0, counts]).astype(np.int64)
                        held[lang, n] = keys, counts
        for (lang, n), (keys, counts) in held.items():
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array([n] * len(k), pa.int32()), pa.array(k.view(np.int64)), pa.array(counts[a : a + 50_000], pa.int64())], ["lang", "n", "h", "count"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, n int, h bigint, count bigint")
    return counted.groupBy("lang", "n", "h").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class LanguageFilter:
    """slots[i] holds, per language, one bit; rates are the languages' false-positive rates."""

    langs: list[str]
    slots: np.ndarray
    rates: np.ndarray

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Per n-gram the bitmask (in words of 64 languages) of all languages that contain it."""
        shift = np.uint64(64 - int(self.slots.shape[0]).bit_length() + 1)
        out = None
        for odd in _ODD[:HASHES]:
            got = self.slots[(h * odd) >> shift]
            out = got if out is None else out & got
        return out


def train(docs: DataFrame, per_lang: int = 1500, least_share: float = 3e-4) -> LanguageFilter:
    ready_python(docs.sparkSession)
    counts = materialize(ngram_counts(sample(docs, per_lang)), "ngrams")
    total = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    kept = counts.join(F.broadcast(total), ["lang", "n"]).where(F.col("count") >= F.lit(least_share) * F.col("total"))  # total: a row per language and order
    grams = kept.groupBy("lang").agg(F.collect_list("h").alias("h")).collect()  # bounded by 1 / least_share n-grams per order
    grams = sorted((r["lang"], np.array(r["h"], np.int64).view(np.uint64)) for r in grams) if grams else []
    size = 1 << max(10, (16 * max((len(h) for _, h in grams), default=1)).bit_length())
    word = np.uint8 if len(grams) <= 8 else np.uint64
    bits = 8 * np.dtype(word).itemsize
    slots = np.zeros((size, max(1, -(-len(grams) // bits))), word)
    shift = np.uint64(64 - size.bit_length() + 1)
    for i, (_, h) in enumerate(grams):
        for odd in _ODD[:HASHES]:
            slots[(h * odd) >> shift, i // bits] |= word(1 << (i % bits))
    fill = [float(((slots[:, i // bits] >> word(i % bits)) & word(1)).mean()) for i in range(len(grams))]
    return LanguageFilter([x for x, _ in grams], slots, np.array(fill) ** HASHES)


def _decide(model: LanguageFilter, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    n_langs = len(model.langs)
    hits, total = np.zeros((len(texts), n_langs)), np.zeros(len(texts))
    bits = 8 * model.slots.dtype.itemsize
    one = model.slots.dtype.type(1)
    for codes, starts, owner, ends in _pieces(texts):
        for _, h, valid in _ngrams(codes, starts, ends):
            mask = model.containing(h)
            mask[~valid] = 0
            np.add.at(total, owner, np.add.reduceat(valid.astype(np.int64), starts))
            for i in range(n_langs):
                found = (mask[:, i // bits] >> model.slots.dtype.type(i % bits)) & one
                np.add.at(hits[:, i], owner, np.add.reduceat(found.astype(np.int32), starts))
    if not n_langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    true = np.maximum(0.0, (hits - total[:, None] * model.rates) / (1 - np.minimum(model.rates, 0.999)))
    best, seen = np.argmax(true, axis=1), total > 0
    score = np.divide(true.max(axis=1), true.sum(axis=1), out=np.zeros(len(texts)), where=true.sum(axis=1) > 0)
    return [model.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], np.where(seen, np.clip(score, 0.0, 1.0), 0.0)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score, written to the shared folder. The filters are broadcast; their size is bounded (see train)."""
    ready_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            langs, scores = _decide(shared.value, [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double"), "langs")

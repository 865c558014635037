"""SentencePiece encoding and decoding: a Viterbi driven by an Aho-Corasick automaton over the pieces.

The automaton runs over the text once; at every position its output links give all pieces that end there, each relaxes
the best score of the position. Scores are the model file's own, so the segmentation is the one with the highest sum of
scores. (The public model at hand was trained for merges; those are another rule and give other pieces. Here the file's pieces and scores are used as a
unigram model.) A character that no piece covers alone may become its bytes, at the penalty that unigram models use.

No piece of such models goes from a character on to a space mark, or from a letter to a character that is none or back, so a text's best
segmentation is that of its stretches between such places, and a worker remembers stretches: those met last, in two halves, of which the older one goes when the newer
one is full, so frequent stretches stay. They keep their spaces until they are segmented, so most take a byte a character. Both are read off the model's pieces; where a model has pieces across such places,
stretches are longer, up to whole texts.

Decoding joins pieces and bytes and gives back the text exactly; the space mark itself, where a text has it, is encoded by its bytes.

Defined cases: a null text counts as empty and has no pieces; null ids stay null; repeated rows are each encoded; very long texts are encoded whole; empty tables
give empty results; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialize, ready_python, share_file, shared_file, slices

MARK = "▁"
#: Stands for the space mark where the text itself has it. No text and no piece can hold a lone surrogate, so it is encoded by bytes.
LITERAL = "\ud800"
UNKNOWN_PENALTY = 10.0
#: Stretches that a worker remembers at most, and bytes of text that it encodes at a time.
CACHE_WORDS, SLICE_BYTES = 150_000, 1 << 18


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        usable = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = {i: sp.get_score(i) for i in usable.values()}
        self.prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        self.stretches = self._stretches(usable)
        self.penalty = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, i in usable.items():
            self.automaton.add_word(p, (len(p), i, scores[i]))
        self.automaton.make_automaton()
        self.alone = {p for p in usable if len(p) == 1}
        raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw = raw
        self.known = _Known(self)
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _stretches(pieces: dict[str, int]):
        """Cuts a text, its spaces still spaces, where no piece can lie across; None where pieces go across words."""
        pieces = [p.replace(MARK, " ") for p in pieces]
        if any(re.search("[^ ] |.\n|\n.", p, re.DOTALL) for p in pieces):
            return None
        odd = "".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))  # like a raised 2
        letter, other = f"[^\\W\\d_{odd}]", f"(?![ \n])[\\W\\d_{odd}]"
        if any(re.search(f"{letter}{other}|{other}{letter}", p) for p in pieces):
            return re.compile(" *[^ \n]+| +|\n").findall
        return re.compile(f" *{letter}+| *(?:{other})+| +|\n").findall

    def segment(self, s: str) -> list[int]:
        """Single-pass Viterbi: ids of the best pieces of s, unknown characters as bytes."""
        n = len(s)
        best, back = [-1e300] * n + [0.0], [None] * n  # by the last character of what is covered; nothing is covered at -1
        if self.alone.issuperset(s):
            for end, found in self.automaton.iter(s):
                reached = best[end - found[0]] + found[2]
                if reached > best[end]:
                    best[end], back[end] = reached, found
        else:
            self._with_unknown(s, best, back)
        out, end = [], n - 1
        while end >= 0:
            length, piece, _ = back[end]
            if piece >= 0:
                out.append(piece)
            else:
                raw = s[end].replace(LITERAL, MARK).encode("utf-8", "surrogatepass")
                out.extend(reversed([self.bytes[b] for b in raw]) if self.bytes else [self.unknown])
            end -= length
        out.reverse()
        return out

    def _with_unknown(self, s: str, best: list[float], back: list[tuple | None]) -> None:
        """The search where characters of s are no pieces alone: each may be covered by its bytes."""
        alone, byte = self.alone, (1, -1, self.penalty)
        unknown = [i for i, c in enumerate(s) if c not in alone]
        at = 0  # of the unknown characters that are behind
        for end, found in chain(self.automaton.iter(s), [(len(s), None)]):
            while at < len(unknown) and unknown[at] <= end:
                i = unknown[at]
                if best[i - 1] + byte[2] > best[i]:
                    best[i], back[i] = best[i - 1] + byte[2], byte
                at += 1
            if found is not None:
                reached = best[end - found[0]] + found[2]
                if reached > best[end]:
                    best[end], back[end] = reached, found

    def words(self, text: str) -> list[str]:
        """Stretches of the text, each segmented by itself; a space stands for the space mark."""
        if not text:
            return []
        s = " " + text if self.prefix else text
        return self.stretches(s) if self.stretches else [s]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.words(t))) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text[:1] == " " else text


class _Known(dict):
    """Ids of the stretches met last; a stretch that is missing is looked for among the older ones, else segmented."""

    def __init__(self, of: PieceModel) -> None:
        self.of = of

    def __missing__(self, w: str) -> bytes:
        of = self.of
        if len(self) >= CACHE_WORDS // 2:
            of.older = dict(self)
            self.clear()
        ids = of.older.get(w)
        if ids is None:
            ids = array("i", of.segment(w.replace(MARK, LITERAL).replace(" ", MARK))).tobytes()
        self[w] = ids
        return ids


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every row, written to the shared folder."""
    ready_python(docs.sparkSession)
    name = share_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared_file(name))
        for batch in slices(batches, 1, size=SLICE_BYTES):
            coded = m.encode([t or "" for t in batch.column(1).to_pylist()])
            at = np.cumsum([0, *map(len, coded)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>"), "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the texts that the ids stand for."""
    ready_python(encoded.sparkSession)
    name = share_file(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared_file(name))
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, whole.num_rows, BATCH_ROWS)):
            ids = batch.column(1)
            flat, at = ids.flatten().to_numpy(), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in ids)])
            texts = [m.decode(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")

"""Secret scans: fixed patterns, plus a battery of randomness tests with length-aware false-discovery control.

Candidates are maximal runs of 20 or more characters of an encoding alphabet, the parts of 20 or more between their / and +, and the
atoms of 20 or more between / + - and _; a part is listed only where its run isn't, an atom only where its part isn't. For each, an encoding is inferred (hex,
base32, base62, base64, base64url) and three tests of uniform randomness are made over its alphabet: chi-squared
uniformity (the number of coinciding pairs, whose mean and variance are exact at any length), the runs test about
the middle of the alphabet, and the lag-1 serial correlation. Fisher's method combines the three.

Random strings have uniform p-values, ordinary strings have small ones, the smaller the longer they are. So for every encoding
and length class the corpus itself tells, by Storey's estimate above p = 1/2, how many candidates are random, and the lowest
threshold is taken at which the share of ordinary strings among those above it is at most `fdr`. The histogram that
this needs has a fixed number of cells, whatever the corpus. The estimate needs many candidates: a class of fewer than SPARSE takes the threshold
of its encoding, its length class or of all candidates, the first of these with as many; where there is none it is PRIOR, which
random strings miss about once in twenty times. A class of SPARSE or more without a threshold lists nothing.

Spans are in code points, end exclusive. A random span that overlaps a fixed-pattern span is not listed again.
Defined cases: a null text counts as empty and has no spans; repeated rows are each scanned; rows keep their other columns out of the way
(only doc_id and text are read); empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, ready_python, slices, small

# The patterns of the three kinds and the lengths they need.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile("[0-9a-f]{%d,}" % MIN_HEX)  # a run is taken whole, so a failing match can hide nothing
_words = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_RANDOM = 20
_run = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RANDOM)
_part, _atom = re.compile("[A-Za-z0-9_-]{%d,}" % MIN_RANDOM), re.compile("[A-Za-z0-9]{%d,}" % MIN_RANDOM)
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of one case need more characters: a long word of a language is too like a short random one.
MIN_LETTERS = 28
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "upper": _UPPER,
    "lower": _LOWER,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_ranks = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
SPAN = "struct<start:bigint,kind:int,end:bigint>"
CELLS = 50
#: Candidates that a threshold of its own needs, and the threshold where even all candidates are too few.
SPARSE, PRIOR = 1_000, 0.05


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    lower = raw.lower()
    if any(w in lower for w in _words):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return sorted(found + [(m.start(), 2, m.end()) for m in _hex.finditer(text)])


def infer_encoding(s: str) -> str | None:
    """The smallest alphabet that holds s; None where s has digits only, is words joined by - and _, or is of one case and short."""
    chars = set(s)
    if not chars & set(_DIGITS):
        if not chars <= _ranks["letters"].keys() or len(s) < MIN_LETTERS and not (chars & set(_UPPER) and chars & set(_LOWER)):
            return None
        return next(name for name in ("upper", "lower", "letters") if chars <= _ranks[name].keys())
    if not chars - set(_DIGITS + "+/-_"):
        return None
    return next((name for name, ranks in _ranks.items() if chars <= ranks.keys()), None)


def randomness(s: str, encoding: str) -> float:
    """Combined p-value of the battery: near uniform on [0, 1] for random strings, near 0 for others."""
    ranks = _ranks[encoding]
    x, n, k = [ranks[c] for c in s], len(s), len(ranks)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    pairs, mean = sum(c * (c - 1) for c in counts.values()) / 2, n * (n - 1) / (2 * k)
    chi = 0.5 * math.erfc((pairs - mean - 0.5) / math.sqrt(2 * mean * (1 - 1 / k)))
    high = [v >= k / 2 for v in x]
    n1 = sum(high)
    n0 = n - n1
    if n1 and n0:
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = math.erfc(abs(1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    serial = math.erfc(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / var + 1 / n) * math.sqrt(n / 2)) if var else 0.0
    fisher = -sum(math.log(max(p, 1e-300)) for p in (chi, runs, serial))  # half of the statistic, 6 degrees of freedom
    return min(1.0, math.exp(-fisher) * (1 + fisher + fisher * fisher / 2))


def length_class(n: int) -> int:
    """20-23, 24-31, 32-47, 48-63, 64-127, 128 and more."""
    return sum(n >= x for x in (24, 32, 48, 64, 128))


_ONE = "start:bigint,end:bigint,class:string,p:double"
SCANNED = f"base array<{SPAN}>, candidates array<struct<{_ONE},parts:array<struct<{_ONE},atoms:array<struct<{_ONE}>>>>>>"
_one = [("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("p", pa.float64())]
_TYPES = (
    pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])),
    pa.list_(pa.struct([*_one, ("parts", pa.list_(pa.struct([*_one, ("atoms", pa.list_(pa.struct(_one)))])))])),
)


def _candidate(s: str, start: int, end: int, base: list[tuple[int, int, int]]) -> dict:
    """The candidate s, without a class where it has no encoding or overlaps a fixed pattern."""
    name = None if any(a < end and start < b for a, _, b in base) else infer_encoding(s)
    return {"start": start, "end": end, "class": name and f"{name}:{length_class(len(s))}", "p": randomness(s, name) if name else None}


def _scan(text: bytes | None) -> tuple[list[dict], list[dict]]:
    raw = text or b""
    text = raw.decode()
    base, candidates = base_spans(text, raw), []
    for m in _run.finditer(text):
        s, at, parts = m[0].rstrip("="), m.start(), []
        ends = lambda i: m.end() if i == len(s) else at + i  # noqa: B023, E731
        for part in _part.finditer(s):
            atoms = [_candidate(x[0], at + part.start() + x.start(), ends(part.start() + x.end()), base) for x in _atom.finditer(part[0]) if x[0] != part[0]]
            atoms = [x for x in atoms if x["class"]]
            found = _candidate(part[0], at + part.start(), ends(part.end()), base) if part[0] != s else {"start": None, "end": None, "class": None, "p": None}
            if found["class"] or atoms:
                parts.append(found | {"atoms": atoms})
        run = _candidate(s, at, m.end(), base)
        if run["class"] or parts:
            candidates.append(run | {"parts": parts})
    return [{"start": a, "kind": k, "end": b} for a, k, b in base], candidates


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, candidates for every row, written to the shared folder; the texts are read once and not moved."""
    ready_python(docs.sparkSession)
    schema = f"doc_id bigint, text_hash bigint, {SCANNED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [_scan(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_hash", "base", "candidates"])

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema), "secrets")


def _plain(c: Column) -> Column:
    return F.struct(*[c[name].alias(name) for name in ("start", "end", "class", "p")])


def _least(counts: np.ndarray, fdr: float) -> float | None:
    """The lowest p from which on at most `fdr` of the candidates are ordinary; twice those above p = 1/2 are taken as random ones (Storey).

    What lies below the first cell's end is never listed: a few plain words would else pass among very many keys.
    """
    above = counts[::-1].cumsum()[::-1]
    random = 2.0 * counts[CELLS // 2 :].sum() * (1.0 - np.arange(CELLS) / CELLS)
    fit = np.flatnonzero((counts > 0) & (above - random <= fdr * above) & (np.arange(CELLS) > 0))
    return float(fit[0]) / CELLS if len(fit) else None


def chosen(cells: dict[str, np.ndarray], fdr: float = 0.05) -> dict[str, float]:
    """The threshold of every class that has one, from its histogram or, where that is sparse, from a pooled one."""
    found = {}
    for name, counts in cells.items():
        if counts.sum() >= SPARSE:
            if (least := _least(counts, fdr)) is not None:
                found[name] = least
            continue
        encoding, length = name.split(":")
        pools = (sum(c for k, c in cells.items() if same(k)) for same in (lambda k: k.split(":")[0] == encoding, lambda k: k.split(":")[1] == length, lambda k: True))  # noqa: B023
        found[name] = next((x for pool in pools if pool.sum() >= SPARSE and (x := _least(pool, fdr)) is not None), PRIOR)
    return found


def thresholds(scanned: DataFrame, fdr: float = 0.05) -> dict[str, float]:
    """The least p to list of every encoding and length class; at most 42 classes of CELLS cells come to the driver."""
    cell = F.least(F.floor(F.col("c.p") * CELLS), F.lit(CELLS - 1)).cast("int")
    every = F.transform("candidates", lambda c: F.concat(F.array(_plain(c)), F.flatten(F.transform(c["parts"], lambda q: F.concat(F.array(_plain(q)), q["atoms"])))))
    rows = scanned.select(F.explode(F.flatten(every)).alias("c")).where("c.class IS NOT NULL").groupBy(F.col("c.class").alias("class"), cell.alias("cell")).count().collect()
    cells: dict[str, np.ndarray] = {}
    for name, i, n in rows:
        cells.setdefault(name, np.zeros(CELLS, np.int64))[i] = n
    return chosen(cells, fdr)


def find_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, text_hash, base (fixed patterns) and spans (those and the random ones), sorted by start, then kind."""
    scanned = scan(docs)
    least = F.create_map(F.lit(""), F.lit(2.0), *[F.lit(x) for pair in thresholds(scanned, fdr).items() for x in pair])
    listed = lambda c: F.coalesce(c["p"] >= F.try_element_at(least, c["class"]), F.lit(False))
    inner = lambda q: F.when(listed(q), F.array(_plain(q))).otherwise(F.filter(q["atoms"], listed))
    outer = lambda c: F.when(listed(c), F.array(_plain(c))).otherwise(F.flatten(F.transform(c["parts"], inner)))
    random = F.transform(F.flatten(F.transform("candidates", outer)), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "text_hash", "base", F.sort_array(F.concat("base", random)).alias("spans"))


#: Rows and spans of the table of hits that may be sent to every task.
SMALL_TABLE = 500_000


def redact(docs: DataFrame, fdr: float = 0.05, mark: str = "<secret>") -> DataFrame:
    """docs with every secret span replaced by `mark`; overlapping spans become one mark. All rows and columns stay, n_chars follows the text.

    The join is by id and hash of the text, so that texts are dealt out evenly whatever the ids; texts without a span stay as they are, and all
    stay in place unless very many have one.
    """
    spans = find_secrets(docs, fdr).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    key, have = fresh(docs, "text_hash"), fresh(docs, "secret_spans")
    spans = materialize(spans, "hits")
    hit = spans.select(F.col("doc_id").alias(fresh(docs, "hit_id")), F.col("text_hash").alias(fresh(docs, "hit_hash")), F.col("spans").alias(have))
    joined = docs.withColumn(key, F.xxhash64("text")).join(small(hit, SMALL_TABLE, 1 + F.size(have)), F.col("doc_id").eqNullSafe(F.col(hit.columns[0])) & (F.col(key) == F.col(hit.columns[1])), "left")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = lambda text, a, b: F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda text: lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], cut(text, s["at"], x["start"]), F.lit(mark))).alias("out"))
    done = lambda text: lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.length(text)))
    text = F.when(F.col(have).isNull(), F.col("text")).otherwise(F.aggregate(F.col(have), state, step(F.col("text")), done(F.col("text"))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(have).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

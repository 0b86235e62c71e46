"""Quality rules with cross-document line frequency.

Base rules look at one text; the method looks across documents: lines are normalised (white space at the ends off, A-Z lowered) and
hashed to 128 bits, the distinct documents that hold a line are counted per host, lines held by more than the limit
are removed from all but the host's smallest doc_id that holds them, and a document that keeps less than ``DEPLETED`` of its bytes is
rejected. The limit is ``SHARE`` of the host's documents, ``LEAST`` at least.

Defined results: a null text has no words (it fails the base rules); a null host is a host of its own; every row counts as
a document, also when doc_ids repeat; a null doc_id comes after all others; an empty table gives an empty result; other columns play no
part, whatever their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices, texts, written
from .wordscan import mixed, powers, word_hashes

LEAST, SHARE, DEPLETED = 20, 0.01, 0.3
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_COUNTS = np.zeros((256, 2), np.int64)  # code points in words, symbols
_COUNTS[:, 0] = [b not in SPACE and b & 0xC0 != 0x80 for b in range(256)]
_COUNTS[list(b"#*$%&|<>"), 1] = 1
_HALF = np.dtype(">i8")


def repeated_words(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of so many words which its text holds twice or more."""
    n = len(words) - window + 1
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts), np.int64)
    if n <= 0:
        return out
    base = powers(window)
    code = words[:n] * base[0]
    for k in range(1, window):
        code = code + words[k : n + k] * base[k]
    code = mixed(code) + text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # windows of different texts differ
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    order = at[np.argsort(code[at], kind="stable")]
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    return np.bincount(text, weights=np.cumsum(change)[:-1] > 0, minlength=len(counts)).astype(np.int64)


def _lines(text: bytes) -> tuple[int, int, dict[bytes, int]]:
    """(lines with a word that equal an earlier one, bytes of normalised lines, bytes by key)"""
    duplicates, total = 0, 0
    seen: set[bytes] = set()
    sizes: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        bare = line.strip(SPACE).lower()
        if bare:
            duplicates += line in seen
            seen.add(line)
            key = xxhash.xxh3_128_digest(bare)
            sizes[key] = sizes.get(key, 0) + len(bare)
            total += len(bare)
    return duplicates, total, sizes


_STATS = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_bytes long, lines array<struct<hi:long,lo:long,size:long>>"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId() << 36, 0
    for batch in slices(batches, 4000, "text"):
        raw = texts(batch.column(2))
        n = len(raw)
        words, counts = word_hashes(raw)
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])[:-1]
        sums = [np.add.reduceat(_COUNTS[:, k][buf], starts) for k in range(2)] if n else [np.zeros(0, np.int64)] * 2
        lines = [_lines(x) for x in raw]
        halves = np.frombuffer(b"".join(k for _, _, s in lines for k in s), _HALF).reshape(-1, 2).astype(np.int64)
        size = np.array([v for _, _, s in lines for v in s.values()], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(s) for _, _, s in lines])]).astype(np.int32)
        nested = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(size)], ["hi", "lo", "size"]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part + serial + np.arange(n)), batch.column(0), batch.column(1), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]),
                pa.array([d for d, _, _ in lines], pa.int64()), pa.array(repeated_words(words, counts)), pa.array([t for _, t, _ in lines], pa.int64()), nested,
            ],
            [c.split()[0] for c in _STATS.split(", ")],
        )
        serial += n


def judged(docs: DataFrame, root: str, host: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, removed_bytes, line_bytes and kept for every row."""
    stats = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").mapInArrow(_stats, _STATS), f"{root}/stats")
    lines = stats.select("row", "doc_id", "host", F.explode("lines").alias("line")).select("row", "doc_id", "host", "line.hi", "line.lo", "line.size")
    hosts = stats.groupBy("host").agg(F.greatest(F.lit(float(LEAST)), F.count(F.lit(1)) * F.lit(SHARE)).alias("most")).select(F.col("host").alias("host_"), "most")
    often = lines.groupBy("host", "hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where(F.col("n") > LEAST)
    often = often.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n") > F.col("most")).select(F.col("host").alias("host_"), F.col("hi").alias("hi_"), F.col("lo").alias("lo_"), "least")
    removed = lines.join(often, (F.col("hi") == F.col("hi_")) & (F.col("lo") == F.col("lo_")) & F.col("host").eqNullSafe(F.col("host_"))).where(~F.col("doc_id").eqNullSafe(F.col("least")))
    removed = removed.groupBy("row").agg(F.sum("size").alias("gone"))
    gone = F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    depleted = (F.col("line_bytes") - gone) < F.lit(DEPLETED) * F.col("line_bytes")
    return stats.drop("lines").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("removed_bytes"), "line_bytes", (~failed & ~depleted).alias("kept"),
    )

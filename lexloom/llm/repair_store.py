"""Token ids of whole documents in Re-Pair compressed shards.

Layout of a shard file: ``RPZ1``, then independent blocks, then a footer (JSON: for each block offset, length, documents,
tokens), its length as little-endian 4 bytes, and ``RPZ1`` again. A block holds the document ids, their token counts, the grammar's
rules (two symbols each), the expansion length of each rule, and the compressed sequence. Symbols below ``vocab`` are
token ids; symbol ``vocab + k`` stands for rule ``k``. The expansion lengths give the token position of every symbol, so that
a range of a block is decoded without the rest of it (:func:`read_range`).

Documents are dealt into shards by ranges of doc_id and lie in ascending order in them; a block closes
after ``BLOCK_TOKENS`` tokens and has a grammar of its own, so memory doesn't follow the size of a shard (only a single longer document makes a longer block)
and a document is read without the rest of its shard (:func:`read_document`).

Defined results: a null text is encoded as an empty one (its end id alone); null doc_ids come first; rows with the same doc_id follow each
other in the order of their texts; an empty table gives no shard and an empty result; other columns play no part, whatever their names. Words
already encoded are found again by 64-bit hashes.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, filesystem, slices, texts, written
from .merging import MergeTable, UnitStore, lockstep
from .wordscan import pieces, run_hashes

MAGIC = b"RPZ1"
BLOCK_TOKENS = 1 << 20
#: A pair becomes a rule if it occurs this often in the block.
MIN_COUNT = 12


def compress(seq: np.ndarray, vocab: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: pairs that occur often become rules and their occurrences nonterminals, until no pair occurs ``min_count`` times.
    Returns (sequence, rules).

    A round takes all frequent pairs at once. Where occurrences overlap, that of the more frequent pair is replaced, the
    left one among equals; what is left comes up again in the next round, counted anew."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    top = vocab
    # places whose pair can still become frequent: all at first, then those next to a new symbol and occurrences that a better pair took the place of
    open_ = np.arange(max(0, len(seq) - 1))
    while len(open_):
        code = (seq[open_].astype(np.uint64) << np.uint64(32)) | seq[open_ + 1]
        pair, count = _counted(code)
        often = count >= min_count
        if not often.any():
            break
        pair, count = pair[often], count[often]
        rank = np.empty(len(pair), np.int64)
        rank[np.lexsort((pair, -count))] = np.arange(len(pair))
        slots = np.full(1 << 20, -1, np.int32)
        slots[_slot(pair)] = np.arange(len(pair))
        place = slots[_slot(code)]
        maybe = np.flatnonzero(place >= 0)
        place = place[maybe]
        other = np.flatnonzero(pair[place] != code[maybe])  # few: their slot is another pair's
        place[other] = np.minimum(np.searchsorted(pair, code[maybe[other]]), len(pair) - 1)
        hit = pair[place] == code[maybe]
        every, own = open_[maybe[hit]], rank[place[hit]]
        near = np.diff(every) == 1  # the next occurrence overlaps
        lose = np.zeros(len(every), bool)
        lose[:-1] |= near & (own[:-1] > own[1:])
        lose[1:] |= near & (own[1:] > own[:-1])
        same = np.concatenate([[False], near & (own[1:] == own[:-1])])  # runs of one symbol: every other pair
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(every))))
        lose |= ((np.arange(len(every)) - begin) & 1) == 1
        taken = np.flatnonzero(~lose)
        clash = np.flatnonzero(np.diff(every[taken]) == 1) + 1  # left over where runs meet better pairs
        taken = np.delete(taken, clash)
        made = np.bincount(own[taken], minlength=len(pair))
        if made.max() < 2:
            break
        good = np.flatnonzero(made >= min(min_count, int(made.max())))
        name = np.full(len(pair), -1, np.int64)
        name[good] = top + np.arange(len(good))
        taken = taken[name[own[taken]] >= 0]
        at = every[taken]
        of = np.empty(len(pair), np.uint64)
        of[rank] = pair
        rules.append(np.stack([of[good] >> np.uint64(32), of[good] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.copy()
        seq[at] = name[own[taken]]
        moved = np.cumsum(stay) - 1
        left = np.delete(every, taken)
        left = left[stay[left] & stay[left + 1]]
        seq = seq[stay]
        again = np.zeros(len(seq) + 1, bool)  # one more for the place before the first
        again[moved[at]] = again[moved[at] - 1] = again[moved[left]] = True
        open_ = np.flatnonzero(again[: len(seq) - 1])
        top += len(good)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an array, in order, and how often each occurs."""
    held = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[first], np.diff(np.append(first, len(held)))


def expansion_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Tokens behind each rule; a rule only names earlier symbols."""
    length = np.ones(vocab + len(rules), np.int64)
    done = 0
    while done < len(rules):  # rules of one round don't name each other, so whole rounds are summed at once
        most = rules[done:].max(axis=1)
        stop = done + (int(np.argmax(most >= vocab + done)) if (most >= vocab + done).any() else len(rules) - done)
        length[vocab + done : vocab + stop] = length[rules[done:stop, 0]] + length[rules[done:stop, 1]]
        done = stop
    return length[vocab:]


def expand(seq: np.ndarray, rules: np.ndarray, vocab: int) -> np.ndarray:
    """The tokens behind a sequence of symbols: those of each rule are put together once, from the rules before it."""
    size = np.concatenate([np.ones(vocab, np.int64), expansion_lengths(rules, vocab)])
    first = np.cumsum(size) - size
    flat = np.arange(int(first[-1] + size[-1]) if len(size) else 0, dtype=np.uint32)  # a token is its own expansion
    done = vocab
    while done < len(size):  # as many rules as don't name each other
        most = rules[done - vocab :].max(axis=1)
        late = most >= done
        stop = done + int(np.argmax(late)) if late.any() else len(size)
        flat[first[done] : first[stop] if stop < len(size) else None] = _gathered(rules[done - vocab : stop - vocab].ravel(), first, size, flat)
        done = stop
    return _gathered(seq, first, size, flat)


def _gathered(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    n = size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(first[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pack_block(ids: list[int | None], counts: np.ndarray, tokens: np.ndarray, vocab: int) -> bytes:
    seq, rules = compress(tokens, vocab)
    kind = np.dtype("<u2") if vocab + len(rules) <= 1 << 16 else np.dtype("<u4")
    parts = [
        np.array([i is None for i in ids], np.uint8), np.array([0 if i is None else i for i in ids], "<i8"), counts.astype("<u4"),
        rules.astype(kind).ravel(), expansion_lengths(rules, vocab).astype("<u4"), seq.astype(kind),
    ]
    head = np.array([len(ids), len(tokens), len(rules), len(seq), kind.itemsize, vocab], "<u4")
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Block:
    def __init__(self, blob: bytes):
        n, self.tokens, rules, symbols, size, self.vocab = np.frombuffer(blob, "<u4", 6).tolist()
        at = 24
        kind = f"<u{size}"

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        null, ids = take("u1", n), take("<i8", n)
        self.ids = [None if z else int(i) for z, i in zip(null, ids, strict=True)]
        self.counts = take("<u4", n).astype(np.int64)
        self.rules = take(kind, 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.seq = take(kind, symbols)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.vocab)


def read_range(block: Block, start: int, count: int) -> np.ndarray:
    """``count`` tokens from position ``start`` of a block, expanding only the symbols that cover them."""
    inner = block.seq >= block.vocab
    width = np.ones(len(block.seq), np.int64)
    width[inner] = block.lengths[block.seq[inner].astype(np.int64) - block.vocab]
    ends = np.cumsum(width)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + count, "left")) + 1
    out = expand(block.seq[a:b], block.rules, block.vocab)
    skip = start - (int(ends[a - 1]) if a else 0)
    return out[skip : skip + count]


def read_document(block: Block, doc_id: int | None) -> list[np.ndarray]:
    """The tokens of each document of a block with this id, expanding nothing else."""
    starts = np.cumsum(block.counts) - block.counts
    return [read_range(block, int(starts[i]), int(block.counts[i])) for i, own in enumerate(block.ids) if own == doc_id]


class WordEncoder:
    """Encodes pre-tokens once each. A pre-token never contains white space; within a word of Latin letters, digits and marks it
    is a run of letters, one digit or a run of marks, and its normal form is its lower case. Such pre-tokens are merged
    here; a word that holds anything else (an apostrophe, other scripts, controls, the special tokens' bar) goes to the library whole.

    Encoding every text by the library takes more than the whole budget (README), so of each batch one text, the
    shortest of at least ``COMPARED`` bytes or else the longest, is encoded by the library as well, and ids that differ raise an error."""

    COMPARED = 200

    SPACE, LETTER, DIGIT, MARK, OTHER = range(5)

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.store = UnitStore()
        self.tokenizer = Tokenizer.from_buffer(blob)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        model = json.loads(blob)["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = MergeTable({(ids[a], ids[b]): (i, ids[a + b]) for i, (a, b) in reversed(list(enumerate(merges))) if a in ids and b in ids})
        letter = _byte_letters()
        end = model["end_of_word_suffix"]
        self.inner = np.array([ids.get(letter[b], -1) for b in range(256)], np.int32)
        self.last = np.array([ids.get(letter[b] + end, -1) for b in range(256)], np.int32)
        self.kind = np.full(256, self.OTHER, np.uint8)
        for b in range(33, 127):
            c = chr(b)
            self.kind[b] = self.LETTER if c.isalpha() else self.DIGIT if c.isdigit() else self.OTHER if c in "'|" else self.MARK
        self.kind[list(SPACE)] = self.SPACE

    def _units(self, raw: np.ndarray):
        kind = self.kind[raw]
        lead = raw == 0xC3  # U+00C0 to U+00FF
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        if lead.any():
            second = np.concatenate([[False], lead[:-1]]) & (raw >= 0x80) & (raw != 0x97) & (raw != 0xB7)
            kind[lead] = self.LETTER
            kind[second] = self.LETTER
            low[second & (raw <= 0x9E)] += 32
        at = np.flatnonzero(kind)
        kind = kind[at]
        word = np.ones(len(at), bool)
        word[1:] = np.diff(at) > 1
        begin = np.flatnonzero(word)
        odd = np.repeat(np.maximum.reduceat(kind, begin) == self.OTHER, np.diff(np.append(begin, len(at)))) if len(at) else word
        change = np.ones(len(at), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        start = np.flatnonzero(word | (change & ~odd))
        return at, np.where(odd, raw[at], low[at]), odd, start, np.diff(np.append(start, len(at)))

    def _piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each unit, place of each unit in the piece)"""
        at, data, odd, start, length = self._units(np.frombuffer(raw, np.uint8))
        key = run_hashes(data, start, length)
        key ^= odd[start].astype(np.uint64) if len(start) else key

        def learn(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            alone = odd[start[units]] | (length[units] > 48)
            plain, rest = units[~alone], units[alone]
            size = length[plain]
            ends = np.cumsum(size)
            flat = data[np.repeat(start[plain] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            symbols = self.inner[flat]
            symbols[ends - 1] = self.last[flat[ends - 1]]
            ids, count = lockstep(symbols, size, self.table)
            words = [data[start[u] : start[u] + length[u]].tobytes().decode("utf-8", "replace") for u in rest]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.zeros(len(units), np.int64)
            sizes[~alone], sizes[alone] = count, [len(x) for x in made]
            out = np.empty(int(sizes.sum()), np.int32)
            own = np.repeat(alone, sizes)
            out[~own], out[own] = ids, [i for x in made for i in x]
            return out, sizes

        ids, count = self.store.gather(key, learn)
        return ids, count, at[start]

    def _compare(self, batch: list[bytes], tokens: np.ndarray, per_text: np.ndarray) -> None:
        if batch:
            i = min(range(len(batch)), key=lambda k: (len(batch[k]) < self.COMPARED, len(batch[k]) if len(batch[k]) >= self.COMPARED else -len(batch[k])))
            end = int(per_text[: i + 1].sum())
            if tokens[end - per_text[i] : end].tolist() != self.tokenizer.encode(batch[i].decode("utf-8", "replace"), add_special_tokens=False).ids:
                raise ValueError("ids differ from the tokenizers library's")

    def encode(self, batch: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts one after the other, each followed by the end id; tokens of each text)"""
        parts, per_text = [], np.zeros(len(batch), np.int64)
        for group, owner in pieces(batch):
            ids, count, place = self._piece(b"\n".join(group))
            text = np.array(owner)[np.searchsorted(np.cumsum([len(x) + 1 for x in group]), place, "right")] if len(place) else np.zeros(0, np.int64)
            per_text += np.bincount(text, weights=count, minlength=len(batch)).astype(np.int64)
            parts.append(ids)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self._compare(batch, tokens, per_text)
        out = np.full(len(tokens) + len(batch), end_id, np.uint32)
        out[np.arange(len(tokens)) + np.repeat(np.arange(len(batch)), per_text)] = tokens
        return out, per_text + 1


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if it is printable in Latin-1, else the next
    free one from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_encoders: dict[int, WordEncoder] = {}  # lives as long as the Python worker


def _encoder(blob: bytes) -> WordEncoder:
    key = zlib.crc32(blob)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(blob)
    return _encoders[key]


MANIFEST = "part long, block long, file string, offset long, length long, docs long, tokens long"


def write_shards(docs: DataFrame, root: str, tokenizer: bytes, end_id: int) -> DataFrame:
    """Encodes documents (doc_id, text) and writes one shard file a task below ``root``; returns the written manifest.

    A file's name is new for each attempt and only the manifest names files, so a lost or repeated task leaves at most a file that
    nobody reads."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    folder = f"{root}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(shipped.value)
        file, out, rows = None, None, []
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def close() -> None:
            nonlocal ids, held, counts, size
            blob = pack_block(ids, np.concatenate(counts), np.concatenate(held), encoder.vocab)
            rows.append({"part": part, "block": len(rows), "file": file, "offset": out.tell(), "length": len(blob), "docs": len(ids), "tokens": size})
            out.write(blob)
            ids, held, counts, size = [], [], [], 0

        for batch in slices(batches, 1000, "text", 1 << 20):
            if file is None:
                file = f"{folder}/{part:06d}-{uuid.uuid4().hex}.rpz"
                fs, path = filesystem(file)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
                out.write(MAGIC)
            tokens, per_text = encoder.encode(texts(batch.column(1)), end_id)
            ids += batch.column(0).to_pylist()
            held.append(tokens)
            counts.append(per_text)
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                close()
        if file is not None:
            if ids:
                close()
            foot = json.dumps([{k: r[k] for k in ("offset", "length", "docs", "tokens")} for r in rows]).encode()
            out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in ("part", "block", "file", "offset", "length", "docs", "tokens")]))

    return written(ordered.mapInArrow(write, MANIFEST), f"{root}/manifest")


def open_shard(uri: str) -> tuple[io.IOBase, list[dict]]:
    """A shard file and its footer, for random access."""
    fs, path = filesystem(uri)
    f = fs.open_input_file(path)
    end = f.size()
    f.seek(end - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError(f"{uri} isn't a shard")
    size = int.from_bytes(tail[:4], "little")
    f.seek(end - 8 - size)
    return f, json.loads(f.read(size))


def read_block(row) -> bytes:
    """The bytes of the block that a manifest's row names."""
    fs, path = filesystem(row["file"])
    with fs.open_input_file(path) as f:
        f.seek(row["offset"])
        return f.read(row["length"])


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest.

    Only a number for each shard goes to the driver: the count of tokens before it."""
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    bases = spark.sparkContext.broadcast(base)
    earlier = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    tasks = manifest.select("part", "block", "file", "offset", "length", earlier).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(read_block(row))
                tokens = block.all().astype("<u4")
                ends = np.cumsum(block.counts)
                starts = ends - block.counts
                raw = memoryview(tokens).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(starts + (bases.value[row["part"]] + row["before"])), pa.array(block.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

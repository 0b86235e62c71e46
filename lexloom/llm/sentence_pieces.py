"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, with a score-ordered agenda of symbol pairs.

A text gets a space in front and its spaces become U+2581. The symbols at first are single characters; the pair whose joined
piece has the best score (the leftmost among equals) is merged until no joined pair is a piece. No piece of such a vocabulary
holds U+2581 behind another character or a character outside the vocabulary's own, so the agenda of a text falls apart at those
places, and a worker merges each distinct part once. A character that is no piece is written as its UTF-8 bytes' pieces.

Each Arrow batch is checked against the sentencepiece library: ids that differ raise an error. Decoding is the library's.

Defined results: a null text is encoded as an empty one (begin and end ids alone), an empty table gives an empty result;
texts are encoded whole, rows are independent of each other; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .merging import MergeTable, UnitStore, agenda, lockstep
from .wordscan import mixed, run_hashes

SPACE_MARK = "▁"
#: Parts longer than this (in characters) are merged with a heap each, shorter ones together.
TOGETHER = 48


class Mismatch(ValueError):
    """The agenda's ids differ from the library's."""


class PieceEncoder:
    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only merge-type vocabularies with identity normalisation and a dummy prefix")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (0, 1)}
        score = {p.piece: p.score for p in model.pieces}
        letters = {c for p in normal for c in p}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in normal):
            raise ValueError("a piece holds a space behind another character")
        ids = dict(normal)
        for c in sorted(letters):
            ids.setdefault(c, len(model.pieces) + len(ids))  # a character that only occurs within pieces
        order = {s: r for r, s in enumerate(sorted({-score[p] for p in normal}))}
        merges = {}
        for piece in normal:
            for cut in range(1, len(piece)):
                if piece[:cut] in ids and piece[cut:] in ids:
                    merges[ids[piece[:cut]], ids[piece[cut:]]] = (order[-score[piece]], normal[piece])
        self.table = MergeTable(merges)
        self.pieces = len(model.pieces)
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = [byte.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.library.unk_id()
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.symbol = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.symbol[ord(c)] = ids[c]
        self.text_of = {i: p for p, i in ids.items()}
        self.store = UnitStore()

    def _spelled(self, char: str) -> list[int]:
        made = [self.byte[b] for b in char.encode()]
        return [self.unknown] if None in made else made

    def part(self, text: str) -> list[int]:
        """Ids of one part with a heap."""
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].tolist()
        fresh = self.pieces + len(self.text_of) + 1
        at = [s if s >= 0 else fresh + i for i, s in enumerate(symbols)]  # unknown characters merge with nothing
        ids: list[int] = []
        for s in agenda(at, self.table):
            ids += [s] if s < self.pieces else self._spelled(text[s - fresh] if s >= fresh else self.text_of[s])
        return ids

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, with begin and end ids; ids of each text)"""
        marked = [(SPACE_MARK + x.decode("utf-8", "replace").replace(" ", SPACE_MARK)) if x else "" for x in batch]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(m) for m in marked], np.int64)
        symbol = self.symbol[points]
        space, known = points == ord(SPACE_MARK), symbol >= 0
        start = np.zeros(len(points), bool)
        start[np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]] = True
        start[1:] |= (space[1:] & ~space[:-1]) | ~known[1:] | ~known[:-1]
        start = np.flatnonzero(start)
        length = np.diff(np.append(start, len(points)))
        octets = points.astype(np.uint32)
        key = run_hashes((octets & 255).astype(np.uint8), start, length) ^ mixed(run_hashes(((octets >> 8) & 255).astype(np.uint8), start, length) + run_hashes((octets >> 16).astype(np.uint8), start, length) * np.uint64(3))

        def learn(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            alone = (length[units] > TOGETHER) | ~known[start[units]]
            plain = units[~alone]
            size = length[plain]
            ends = np.cumsum(size)
            flat = symbol[np.repeat(start[plain] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            ids, count = lockstep(flat, size, self.table)
            redo = {}
            if (ids >= self.pieces).any():  # a character that is no piece stayed alone
                for row in np.unique(np.repeat(np.arange(len(plain)), count)[ids >= self.pieces]):
                    redo[int(plain[row])] = None
            own = [self.part(points[start[u] : start[u] + length[u]].tobytes().decode("utf-32-le")) if a or int(u) in redo else None for u, a in zip(units, alone, strict=True)] if alone.any() or redo else None
            if own is None:
                return ids, count
            first = np.concatenate([[0], np.cumsum(count)])
            row = np.cumsum(~alone) - 1
            lists = [o if o is not None else ids[first[r] : first[r + 1]].tolist() for o, r in zip(own, row, strict=True)]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

        ids, count = self.store.gather(key, learn)
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, start, "right")
        per_text = np.bincount(text, weights=count, minlength=len(batch)).astype(np.int64)
        out = np.empty(len(ids) + 2 * len(batch), np.int32)
        full = per_text + 2
        last = np.cumsum(full)
        out[last - full] = self.bos
        out[last - 1] = self.eos
        out[np.arange(len(ids)) + 2 * np.repeat(np.arange(len(batch)), per_text) + 1] = ids
        return out, full


_made: dict[int, PieceEncoder] = {}  # lives as long as the Python worker


def encoder(blob: bytes) -> PieceEncoder:
    key = zlib.crc32(blob)
    if key not in _made:
        _made.clear()
        _made[key] = PieceEncoder(blob)
    return _made[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with_ids adds ids (array of int) and decoded."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped.value)
        for batch in slices(batches, 500, "text", 1 << 20):
            raw = texts(batch.column(1))
            ids, count = own.encode(raw)
            ends = np.cumsum(count)
            lists = [ids[b - n : b].tolist() for b, n in zip(ends.tolist(), count.tolist(), strict=True)]
            if lists != own.library.encode([x.decode("utf-8", "replace") for x in raw], add_bos=True, add_eos=True, num_threads=1):
                raise Mismatch("ids differ from the sentencepiece library's")
            decoded = own.library.decode(lists, num_threads=1)
            packed = ids.astype("<u4")
            columns = [
                batch.column(0),
                pa.array(count),
                pa.array([hashlib.sha256(packed[b - n : b]).hexdigest() for b, n in zip(ends.tolist(), count.tolist(), strict=True)]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))

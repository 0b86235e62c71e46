"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

An index is a folder of tables that are only ever added to, and a manifest that names them, newest last:

* ``postings`` (doc_id, mark, hi, lo): for each document row its distinct line keys, the exact references; mark is a hash of the text;
* ``gone`` (doc_id): documents taken out of all postings before it;
* ``refs`` (hi, lo, refs, least, most, nulls): the new values of the keys that a change touched: the number of references, the smallest and
  largest document that holds the key, and references without a doc_id; the newest value counts, a key with 0 references is no more;
* ``filters`` (shard, n, room, table): the cuckoo filters that a change touched, one for each shard of the key space.

Inserting documents probes the filters of their keys' shards, shard by shard and at any size: keys that a filter doesn't know are new, only the others meet the
exact table; the new keys are then put into the same filters. Deleting documents recounts exactly the keys that they held, and takes
the fingerprints of vanished keys out of the filters. So an insertion followed by the deletion of the same documents
gives back the same state. A filter only ever spares work; the exact table decides. The manifest is written last, so that a change
that was broken off leaves the index as it was; :meth:`LineIndex.open` finds it again from any session.

Defined results: a null or empty text is one empty line; rows with the same doc_id are one document, and so are all rows without one, which come after all
others; a row that an earlier insertion brought is passed over; an empty table gives an empty result; a document's own
columns stay as they are, results have the prefix ``_lx_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACE, newest, slices, texts, written

#: Distinct keys that a filter shard is laid out for (a task holds one shard's filter and keys: about 30 MB); with twice as many on average the key space is cut anew.
KEYS_PER_SHARD = 1 << 18


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key, partial-key hashing; numpy throughout."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / 4 / 0.8 + 1))))
        return cls(np.zeros((buckets, 4), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = lo.astype(np.uint64)
        mark = (lo >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (lo & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, lo: np.ndarray, kicks: int = 600) -> bool:
        """Adds keys; False if the table is too full for them (the caller builds a larger one)."""
        mark, at, other = self._places(lo)
        rng = np.random.default_rng(len(lo))
        for turn in range(kicks):
            if not len(mark):
                return True
            if turn == 0:
                at = np.where((self.table[at] == 0).any(axis=1), at, other)
            _, lead = np.unique(at, return_index=True)  # one key a bucket and turn
            rest = np.ones(len(at), bool)
            rest[lead] = False
            rows, marks = at[lead], mark[lead]
            free = self.table[rows] == 0
            has = free.any(axis=1)
            slot = np.where(has, free.argmax(axis=1), rng.integers(0, 4, len(rows)))
            old = self.table[rows, slot]
            self.table[rows, slot] = marks
            out, out_at = old[~has], rows[~has]
            mark = np.concatenate([mark[rest], out])
            at = np.concatenate([at[rest], out_at ^ self._step(out)])
        return not len(mark)

    def contains(self, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(lo)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def delete(self, lo: np.ndarray) -> None:
        """Takes one fingerprint out for each of the distinct keys, which must have been inserted."""
        mark, a, b = self._places(lo)
        for _ in range(len(mark) + 1):
            if not len(mark):
                return
            at = np.where((self.table[a] == mark[:, None]).any(axis=1), a, b)
            _, lead = np.unique(at, return_index=True)
            hit = self.table[at[lead]] == mark[lead][:, None]
            found = hit.any(axis=1)
            self.table[at[lead][found], hit.argmax(axis=1)[found]] = 0
            rest = np.ones(len(mark), bool)
            rest[lead] = False
            mark, a, b = mark[rest], a[rest], b[rest]


def build_filter(lo: np.ndarray, room: int = 0) -> CuckooFilter:
    """A filter of these keys with room for as many as named."""
    keys = max(len(lo), room)
    while True:
        made = CuckooFilter.sized(keys)
        if made.insert(lo):
            return made
        keys = max(2 * keys, 64)


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each \\n-separated line its 16-byte key, or None where the normalised line is too short to count."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        line = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
        short = len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars)
        keys.append(None if short else xxhash.xxh3_128_digest(line))
    return keys


_HALF = np.dtype(">i8")


def _references(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "text"):
            rows, keys = [], []
            for i, text in enumerate(texts(batch.column(2))):
                own = set(line_keys(text, min_chars))
                own.discard(None)
                rows += [i] * len(own)
                keys += own
            halves = np.frombuffer(b"".join(keys), _HALF).reshape(-1, 2).astype(np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "mark", "hi", "lo"])

    return run


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text").mapInArrow(_references(min_chars), _SCHEMAS["postings"])


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))


def _is_shared():
    """More than one document holds the key: two different ids, or an id and a null id."""
    return F.coalesce((F.col("least") != F.col("most")) | (F.col("nulls") > 0), F.lit(False)) & F.col("least").isNotNull()


_SCHEMAS = {
    "postings": "doc_id long, mark long, hi long, lo long",
    "gone": "doc_id long",
    "refs": "hi long, lo long, refs long, least long, most long, nulls long, fresh boolean, dead boolean",
    "filters": "shard long, n long, room long, table binary",
}
_VALUES = ["refs", "least", "most", "nulls"]


class LineIndex:
    def __init__(self, spark: SparkSession, root: str, min_chars: int = 10):
        """A new index in a folder; nothing is written before the first change."""
        self.spark, self.root, self.min_chars, self.version, self.bits = spark, root, min_chars, 0, 0
        self.parts: list[tuple[int, str]] = []  # (version, kind), oldest first

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineIndex:
        """The index of a folder as its last finished change left it."""
        found = newest(spark, root, "manifest-")
        if found is None:
            raise FileNotFoundError(f"{root} holds no index")
        made = cls(spark, root)
        rows = spark.read.parquet(found).collect()
        made.version, made.min_chars, made.bits = rows[0]["version"], rows[0]["min_chars"], rows[0]["bits"]
        made.parts = sorted((r["part"], r["kind"]) for r in rows)
        return made

    # -- tables ----------------------------------------------------------------------------------------------
    def _path(self, version: int, kind: str) -> str:
        return f"{self.root}/{version:06d}-{kind}"

    def _put(self, kind: str, rows: DataFrame) -> DataFrame:
        self.parts.append((self.version, kind))
        return written(rows, self._path(self.version, kind))

    def _read(self, kind: str) -> list[tuple[int, DataFrame]]:
        return [(v, self.spark.read.schema(_SCHEMAS[kind]).parquet(self._path(v, kind))) for v, k in self.parts if k == kind]

    def _finish(self) -> LineIndex:
        rows = [(self.version, self.min_chars, self.bits, v, k) for v, k in self.parts]
        self.spark.createDataFrame(rows, "version int, min_chars int, bits int, part int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest-{self.version:06d}")
        return self

    @property
    def postings(self) -> DataFrame:
        """(doc_id, mark, hi, lo) of all documents that are in the index."""
        now = self.spark.createDataFrame([], _SCHEMAS["postings"])
        gone = dict(self._read("gone"))
        for v, part in sorted([*self._read("postings"), *gone.items()], key=lambda x: x[0]):
            now = now.join(part.withColumnRenamed("doc_id", "out"), F.col("doc_id").eqNullSafe(F.col("out")), "left_anti") if v in gone else now.unionByName(part)
        return now

    @property
    def refs(self) -> DataFrame:
        """(hi, lo, refs, least, most, nulls) of all keys."""
        parts = self._read("refs")
        if len(parts) < 2:
            return (parts[0][1] if parts else self.spark.createDataFrame([], _SCHEMAS["refs"])).where("refs > 0").select("hi", "lo", *_VALUES)
        every = None
        for v, part in parts:
            part = part.select("hi", "lo", F.struct(F.lit(v).alias("version"), *_VALUES).alias("value"))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("hi", "lo").agg(F.max("value").alias("value")).where("value.refs > 0").select("hi", "lo", *[F.col(f"value.{c}") for c in _VALUES])

    @property
    def filters(self) -> DataFrame:
        """(shard, n, room, table): each shard's newest filter."""
        parts = self._read("filters")
        if not parts:
            return self.spark.createDataFrame([], _SCHEMAS["filters"])
        every = None
        for v, part in parts:
            part = part.withColumn("version", F.lit(v))
            every = part if every is None else every.unionByName(part)
        last = every.groupBy("shard").agg(F.max("version").alias("version"))
        return every.join(last, ["shard", "version"]).drop("version")

    # -- filters ---------------------------------------------------------------------------------------------
    def _shard(self):
        return F.shiftrightunsigned("hi", 64 - self.bits) if self.bits else F.lit(0).cast("long")

    def probed(self, keys: DataFrame) -> DataFrame:
        """The rows of distinct (hi, lo) that the filters may hold."""
        schema = StructType(list(keys.schema.fields))
        names = keys.columns

        def probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows:
                return rows.select(names).slice(0, 0)
            made = CuckooFilter.load(filters["table"][0].as_py())
            return rows.select(names).filter(pa.array(made.contains(rows["lo"].to_numpy())))

        return keys.withColumn("_lx_shard", self._shard()).groupBy("_lx_shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, schema)

    def _changed(self, keys: DataFrame, remove: bool) -> DataFrame:
        """The filters of the shards of (hi, lo) with these keys put in or taken out; a filter without room is built anew from the exact table."""

        def change(rows: pa.Table, filters: pa.Table) -> pa.Table:
            lo = rows["lo"].to_numpy()
            n = filters["n"][0].as_py() if filters.num_rows else 0
            if not len(lo):
                return filters.slice(0, 0)
            shard = rows["_lx_shard"][0].as_py()
            if remove:
                made, room = CuckooFilter.load(filters["table"][0].as_py()), filters["room"][0].as_py()
                made.delete(lo)
                return pa.table({"shard": [shard], "n": [n - len(lo)], "room": [room], "table": pa.array([made.dump()], pa.binary())})
            room = filters["room"][0].as_py() if filters.num_rows else max(2 * len(lo), 1024)
            blob = None
            if not filters.num_rows:
                blob = build_filter(lo, room).dump()
            elif n + len(lo) <= room:
                made = CuckooFilter.load(filters["table"][0].as_py())
                blob = made.dump() if made.insert(lo) else None
            return pa.table({"shard": [shard], "n": [n + len(lo)], "room": [room], "table": pa.array([blob], pa.binary())})

        keyed = keys.select(self._shard().alias("_lx_shard"), "lo")
        made = written(keyed.groupBy("_lx_shard").cogroup(self.filters.groupBy("shard")).applyInArrow(change, _SCHEMAS["filters"]), f"{self.root}/{self.version:06d}-tried")
        full = made.where(F.col("table").isNull()).select("shard")
        return made.where(F.col("table").isNotNull()).unionByName(self._built(self.refs.withColumn("shard", self._shard()).join(full, "shard", "left_semi")))

    def _built(self, keys: DataFrame) -> DataFrame:
        """Filters of all the keys of (shard, lo), with room for as many again."""

        def build(key: tuple, group: pa.Table) -> pa.Table:
            lo = group["lo"].to_numpy()
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": [len(lo)], "room": [2 * len(lo)], "table": pa.array([build_filter(lo, 2 * len(lo)).dump()], pa.binary())})

        return keys.select("shard", "lo").groupBy("shard").applyInArrow(build, _SCHEMAS["filters"])

    # -- changes ---------------------------------------------------------------------------------------------
    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents: (doc_id, text)."""
        new, old, first = references(docs, self.min_chars), self.postings, not self.version
        known, filters = self.refs, len(self._read("filters"))
        self.version += 1
        if not first:
            there = old.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()
            new = new.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_anti")
        counts = counted(self._put("postings", new)).select("hi", "lo", *_VALUES, F.lit(False).alias("was"))
        if first:
            merged = counts
        else:
            counts = written(counts, f"{self.root}/{self.version:06d}-counts")
            maybe = self.probed(counts.select("hi", "lo"))  # only these meet the exact table
            merged = known.join(maybe, ["hi", "lo"], "left_semi").withColumn("was", F.lit(True)).unionByName(counts)
            merged = merged.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("nulls").alias("nulls"), F.max("was").alias("was"))
        part = self._put("refs", merged.select("hi", "lo", *_VALUES, (~F.col("was")).alias("fresh"), F.lit(False).alias("dead")))
        keys = (part if first else self.refs).count()
        bits = max(0, int(np.ceil(np.log2(max(1, keys / KEYS_PER_SHARD)))))
        if not filters or bits > self.bits + 1:  # many more keys than shards are laid out for
            self.bits = bits
            self.parts = [p for p in self.parts if p[1] != "filters"]
            self._put("filters", self._built(self.refs.select(self._shard().alias("shard"), "lo")))
        else:
            changed = self._changed(part.where("fresh"), remove=False)
            self._put("filters", changed)
        return self._finish()

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (a table with doc_id) out again; keys and counts are then as if they had never come."""
        before, known = self.postings, self.refs
        self.version += 1
        gone = self._put("gone", doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "out")
        match = F.col("doc_id").eqNullSafe(F.col("out"))
        touched = before.join(gone, match, "left_semi").select("hi", "lo").distinct().join(known.select("hi", "lo"), ["hi", "lo"], "left_semi")
        again = counted(before.join(gone, match, "left_anti").join(touched, ["hi", "lo"], "left_semi"))
        now = touched.join(again, ["hi", "lo"], "left").withColumns({"dead": F.col("refs").isNull(), "refs": F.coalesce("refs", F.lit(0).cast("long")), "nulls": F.coalesce("nulls", F.lit(0).cast("long")), "fresh": F.lit(False)})
        part = self._put("refs", now.select("hi", "lo", *_VALUES, "fresh", "dead"))
        self._put("filters", self._changed(part.where("dead"), remove=True))
        return self._finish()

    # -- decisions -------------------------------------------------------------------------------------------
    def drops(self) -> DataFrame:
        """(doc_id, mark, lost): for each text the keys whose lines it loses: shared keys of which its document isn't the smallest holder."""
        shared = self.refs.where(_is_shared()).select("hi", "lo", "least")
        lost = self.postings.join(shared, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("least")))
        return lost.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The rows of indexed documents with _lx_text, _lx_lines, _lx_dropped and _lx_sha256 behind their own columns."""
        drops = self.drops().select(F.col("doc_id").alias("_lx_doc"), F.col("mark").alias("_lx_mark"), F.col("lost").alias("_lx_lost"))
        match = docs["doc_id"].cast("long").eqNullSafe(F.col("_lx_doc")) & (_mark() == F.col("_lx_mark"))
        joined = docs.join(drops, match, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_lx_lost")
        min_chars, at = self.min_chars, docs.columns.index("text")
        made = ["_lx_text", "_lx_lines", "_lx_dropped", "_lx_sha256"]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1000, "text"):
                kept_, lines_, dropped, digest = [], [], [], []
                for text, gone in zip(texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    lines, kept, n = text.split(b"\n"), text, 0
                    if gone:
                        dead = {g["hi"].to_bytes(8, "big", signed=True) + g["lo"].to_bytes(8, "big", signed=True) for g in gone}
                        stay = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in dead]
                        n, kept = len(lines) - len(stay), b"\n".join(stay)
                    kept_.append(kept.decode("utf-8", "replace"))
                    lines_.append(len(lines))
                    dropped.append(n)
                    digest.append(hashlib.sha256(kept).hexdigest())
                own = batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, pa.array(kept_, pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], [*batch.schema.names[:-1], *made])

        kinds = [StringType(), LongType(), LongType(), StringType()]
        return joined.mapInArrow(cut, StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(made, kinds, strict=True)]]))


def indexed(spark: SparkSession, docs: DataFrame, root: str, min_chars: int = 10, batches: int = 2) -> LineIndex:
    """An index of a whole table, inserted in batches (by a hash of doc_id) as an incremental run would."""
    index = LineIndex(spark, root, min_chars)
    for k in range(batches):
        index.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index

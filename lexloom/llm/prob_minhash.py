"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

A document is a weighted set of shingles of ``SHINGLE`` words (weight 1 + ln of its count). Each shingle is a Poisson process with
its weight as rate: arrivals come at exponentially distributed times, each falls into a random slot, and a slot keeps the shingle that came
first. Two signatures agree in a slot with the probability Jaccard similarity of the weighted sets. A shingle's process is
cut off once its time is behind the latest first arrival of its document. Signatures are cut into bands; documents that share a band are
candidates, and a candidate pair counts if the Jaccard similarity of the sets of distinct shingles (64-bit hashes) is ``SIMILARITY`` or more.

Equal word sequences are one text (a node) from the start, however many copies there are. No list of all pairs of a bucket is made:

1. Every node of a bucket is compared with one hub, the node with the most company. Linked ones are one component.
2. A bucket whose nodes are all in one component is done. In the others, a link can only run between two components, so only shingles held by
   two components or more can be part of its overlap. A node x with fewer than SIMILARITY |x| of these has no link left and goes; copies edited each in
   its own way go here, however many they are. That is done twice, as nodes that go make other shingles useless.
3. What stays is a set join with prefixes: each node puts its useful shingles in the order of rarity (then hash), and two nodes can reach the overlap
   that their sizes ask for only if they share one of the first of them, at places that leave both enough shingles behind it. A pair has to
   lie in different components and to pass the bound at a shared shingle; at its first shared one a link always does. These
   pairs are verified, and components that they link are joined.

Steps 2 and 3 lose no link between candidates; links between nodes that share no band may be found on the way.

Defined results: every row gets the smallest doc_id of its class; a text without a word is a class of its own; a text of fewer words than a
shingle is a single shingle; rows with the same doc_id are judged by their texts; a null doc_id is never the smallest unless it is alone; an
empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, texts, written
from .wordscan import mixed, powers, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5


def shingles(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the distinct shingles of each text, ordered by text and hash."""
    base = powers(width)
    text = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(words) - width + 1)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code + words[k : n + k] * base[k]
    at = np.flatnonzero(text[:n] == text[width - 1 : n + width - 1])
    code, of = mixed(code[at]), text[at]
    start = np.concatenate([[0], np.cumsum(counts)])
    small = np.flatnonzero((counts > 0) & (counts < width))
    if len(small):
        own = np.array([(words[start[i] : start[i] + counts[i]] * base[: counts[i]]).sum() + counts[i] for i in small.tolist()], np.uint64)
        code, of = np.concatenate([code, mixed(own)]), np.concatenate([of, small])
    _, first, count = np.unique(code + mixed(of + 1), return_index=True, return_counts=True)  # equal hashes of different texts are told apart
    order = np.lexsort((code[first], of[first]))
    return code[first][order], of[first][order], count[order]


def signatures(code: np.ndarray, text: np.ndarray, weight: np.ndarray, texts_: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """For each text the shingle that comes first in each slot."""
    time_of = np.full(texts_ * slots, np.inf)
    value = np.zeros(texts_ * slots, np.uint64)
    row, clock = np.arange(len(code)), np.zeros(len(code))
    turn = 0
    while len(row):
        turn += 1
        draw = mixed(code[row] + np.uint64(turn * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight[row]
        slot = text[row] * slots + (mixed(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(time_of, slot, clock)
        won = time_of[slot] == clock
        value[slot[won]] = code[row[won]]
        latest = time_of.reshape(texts_, slots).max(axis=1)
        live = clock < latest[text[row]]
        row, clock = row[live], clock[live]
    return value.reshape(texts_, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        key = mixed(key + parts[:, :, k])
    return mixed(key + np.arange(bands, dtype=np.uint64))  # the band counts


def nodes_of(words: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 16-byte key of each text's word sequence; None for texts without a word."""
    ends = np.cumsum(counts).tolist()
    return [xxhash.xxh3_128_digest(words[e - n : e]) if n else None for e, n in zip(ends, counts.tolist(), strict=True)]


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "text", 2 << 20):
            words, counts = word_hashes(texts(batch.column(2)))
            code, text, count = shingles(words, counts)
            key = band_keys(signatures(code, text, 1 + np.log(count), len(counts), bands * rows), bands, rows)
            key[counts == 0] = 0
            offsets = np.arange(0, (len(counts) + 1) * bands, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes_of(words, counts), pa.binary()), pa.array(np.bincount(text, minlength=len(counts))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.ravel().view(np.int64)))],
                ["doc_id", "mark", "node", "n", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, is_hub, hubs, shingles) of (nid, is_hub, hubs, text): the sorted distinct shingles of each text."""
    for batch in slices(batches, 2000, "text", 2 << 20):
        words, counts = word_hashes(texts(batch.column(3)))
        code, text, _ = shingles(words, counts)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(code.view(np.int64)))], ["nid", "is_hub", "hubs", "shingles"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two arrays that are sorted as unsigned numbers."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _linked(similarity: float):
    """(a, b) of (a, b, x, y) for the pairs whose sets x and y are similar enough; pairs with the same a stand together, mostly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, x, y = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            xs, ys = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y))
            x_at, y_at = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (x, y))
            keep = np.zeros(batch.num_rows, bool)
            last, held = None, xs[:0]
            for i in range(batch.num_rows):
                if first[i] != last:
                    last, held = first[i], xs[x_at[i] : x_at[i + 1]]
                other = ys[y_at[i] : y_at[i + 1]]
                common = overlap(held, other)
                keep[i] = common >= similarity * (len(held) + len(other) - common) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def components(edges: DataFrame, root: str) -> DataFrame:
    """(node, label) of all nodes of (a, b), with the smallest node of the component as label: the least label of the neighbours and pointer jumping, in turns."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), f"{root}/links")
    now = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{root}/labels0")
    turn = 0
    while True:  # ends: labels only fall, and a turn without a change is the last
        turn += 1
        seen = both.join(now.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = now.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = low.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was")
        new = written(new, f"{root}/labels{turn}")
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        remove(edges.sparkSession, f"{root}/labels{turn - 1}")
        now = new.select("node", "label")
        if not changed:
            return now


def _open(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket")
    return members.join(several, "bucket", "left_semi")


def _useful(live: DataFrame) -> DataFrame:
    """(nid, shingle, holders) for each node's shingles that more than one component holds."""
    each = live.select("nid", "label", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("holders")).where(F.col("lo") != F.col("hi"))
    return each.select("nid", "shingle").join(shared.select("shingle", "holders"), "shingle")


def _further(members: DataFrame, sets: DataFrame, root: str, similarity: float) -> DataFrame:
    """(a, b) of components that a link joins, from the open (bucket, nid, label) and (nid, shingles): steps 2 and 3."""
    live = written(sets.join(members.select("nid", "label").distinct(), "nid").select("nid", "label", F.size("shingles").alias("n"), "shingles"), f"{root}/live0")
    count = _useful(live).groupBy("nid").agg(F.count(F.lit(1)).alias("useful"))
    least = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9))
    able = live.select("nid", "n").join(count, "nid").where(F.col("useful") >= least).select("nid")
    members = _open(members.join(able, "nid", "left_semi"))
    live = written(live.join(members.select("nid").distinct(), "nid", "left_semi"), f"{root}/live1")
    remove(live.sparkSession, f"{root}/live0")

    ordered = _useful(live).groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("order"))
    ordered = ordered.join(live.select("nid", "label", "n"), "nid").withColumn("useful", F.size("order")).where(F.col("useful") >= least)
    prefix = ordered.select("nid", "label", "n", "useful", F.posexplode(F.slice("order", F.lit(1), (F.col("useful") - least + 1).cast("int"))).alias("place", "entry"))
    # room: the most that two nodes can share if this is their first common shingle
    prefix = written(prefix.select("nid", "label", "n", (F.col("useful") - F.col("place")).alias("room"), F.col("entry.shingle").alias("shingle")), f"{root}/prefixes")
    share = F.lit(similarity / (1 + similarity))
    reach = prefix.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least_n"), F.max("room").alias("most")).where(F.col("lo") != F.col("hi")).drop("lo", "hi")
    asked = share * (F.col("n") + F.col("least_n")) - F.lit(1e-6)
    tight = prefix.join(reach, "shingle").where((F.col("room") >= asked) & (F.col("most") >= asked)).select(F.col("shingle").alias("bucket"), "nid", "label", "n", "room")
    tight = written(_open(tight), f"{root}/tight")
    other = tight.select("bucket", F.col("nid").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_n"), F.col("room").alias("b_room"))
    fit = (F.col("nid") < F.col("b")) & (F.col("label") != F.col("b_label")) & (F.least("room", "b_room") >= share * (F.col("n") + F.col("b_n")) - F.lit(1e-6)) & (F.least("n", "b_n") >= F.lit(similarity) * F.greatest("n", "b_n") - F.lit(1e-6))
    pairs = written(tight.join(other, "bucket").where(fit).select(F.col("nid").alias("a"), "b").distinct(), f"{root}/pairs")
    whole = pairs.join(live.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), "a").join(live.select(F.col("nid").alias("b"), F.col("shingles").alias("y")), "b")
    links = whole.select("a", "b", "x", "y").mapInArrow(_linked(similarity), "a long, b long")
    label = live.select("nid", "label")
    named = links.join(label.select(F.col("nid").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("nid").alias("b"), F.col("label").alias("lb")), "b")
    return named.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


_KEY = ["none", "id", "mark"]  # a document's row: whether it has no doc_id, the doc_id, a hash of the text


def _keyed(docs: DataFrame, prefix: str = "") -> DataFrame:
    number = F.col("doc_id").cast("long")
    return docs.withColumns({f"{prefix}none": number.isNull(), f"{prefix}id": F.coalesce(number, F.lit(0).cast("long")), f"{prefix}mark": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def _placed(docs: DataFrame, root: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The sketches (doc_id, node, n) of all rows of (doc_id, text), and the nodes (node, group_, copies, least: the key of the first row that holds it)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"), "text")
    sketches = written(marked.mapInArrow(_sketch(bands, rows), "doc_id long, mark long, node binary, n long, bands array<long>"), f"{root}/sketches")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "mark")
    nodes = sketches.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), f"{root}/nodes")
    entries = nodes.select("nid", F.xxhash64("node").alias("tie"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = written(entries.join(shared, "bucket"), f"{root}/members")

    company = members.groupBy("nid").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "nid").groupBy("bucket").agg(F.max(F.struct("company", "tie", "nid"))["nid"].alias("hub"))
    star = written(members.join(hubs, "bucket").select("hub", "nid").distinct(), f"{root}/star")  # a hub is its own spoke as well
    spokes = star.groupBy("nid").agg(F.collect_list(F.when(F.col("hub") != F.col("nid"), F.col("hub"))).alias("hubs"), F.max(F.col("hub") == F.col("nid")).alias("is_hub"))  # at most one hub a band
    needed = nodes.select("nid", "least.*").join(spokes, "nid")
    whole = _keyed(docs).groupBy(*_KEY).agg(F.first("text").alias("text"))  # repeated rows once
    sets = written(whole.join(needed, _KEY).select("nid", "is_hub", "hubs", "text").mapInArrow(_sets, "nid long, is_hub boolean, hubs array<long>, shingles array<long>"), f"{root}/sets")
    centres = sets.where("is_hub").select(F.col("nid").alias("a"), F.col("shingles").alias("x"))
    pairs = sets.select(F.explode("hubs").alias("a"), F.col("nid").alias("b"), F.col("shingles").alias("y")).join(centres, "a")
    fit = F.least(F.size("x"), F.size("y")) >= F.lit(similarity) * F.greatest(F.size("x"), F.size("y")) - F.lit(1e-6)
    edges = pairs.where(fit).select("a", "b", "x", "y").mapInArrow(_linked(similarity), "a long, b long")
    labels = written(components(edges, f"{root}/components").withColumnRenamed("node", "nid"), f"{root}/labels")

    state = members.select("bucket", "nid").join(labels, "nid", "left").select("bucket", "nid", F.coalesce("label", "nid").alias("label"))
    still = written(_open(state), f"{root}/open")
    joined = components(_further(still, sets.select("nid", "shingles"), f"{root}/further", similarity), f"{root}/joined")
    group = F.coalesce("label", "nid")
    placed = nodes.select("nid", "node", "least", "copies").join(labels, "nid", "left").withColumn("own", group).drop("label")
    placed = placed.join(joined.withColumnRenamed("node", "own"), "own", "left").select("node", "least", "copies", F.coalesce("label", "own").alias("group_"))
    return sketches.select("doc_id", "node", "n"), placed


def classified(docs: DataFrame, root: str, **options) -> DataFrame:
    """doc_id, class_id, class_size and n_shingles for every row of (doc_id, text)."""
    sketches, nodes = _placed(docs, root, **options)
    first = F.min(F.when(~F.col("least.none"), F.col("least.id")))
    classes = nodes.groupBy("group_").agg(first.alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.select("node", "group_").join(classes, "group_").select("node", "class_id", "class_size")
    own = F.col("node").isNull()
    return sketches.join(named, "node", "left").select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.col("n").alias("n_shingles"))


def kept(docs: DataFrame, root: str, **options) -> DataFrame:
    """One row of each class: the first by doc_id (null last), then hashes of text and row. Every text without a word is kept.

    Rows meet their classes by doc_id and text, so that rows without a doc_id, and rows with the same one, are told apart by their texts."""
    key = [f"_lx_{c}" for c in _KEY]
    _, nodes = _placed(docs, root, **options)
    least = nodes.groupBy("group_").agg(F.min("least").alias("least")).select(*[F.col(f"least.{c}").alias(k) for c, k in zip(_KEY, key, strict=True)])
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = _keyed(docs.where(worded), "_lx_").join(least, key).groupBy(*key).agg(F.min_by(own, F.xxhash64(own)).alias("row"))
    return one.select("row.*").unionByName(docs.where(~worded))

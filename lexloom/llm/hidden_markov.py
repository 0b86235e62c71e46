"""A hidden Markov language model over words, trained by Baum-Welch on all training documents.

Emissions are factored so that the model stays bounded while the vocabulary grows: a word belongs to a class (each of the
``OWN`` most frequent tokens is its own class, all others fall into ``SUFFIXES`` classes by a hash of their last three bytes), a
state emits a class, and a class emits a word by its smoothed share (c + 0.1) / (C + 0.1 (V + 1)), C and V being the
counts and the number of distinct training tokens of the class; an unknown word takes the share with c = 0. The word factor doesn't depend on
the state, so log P(text) = forward recursion over classes + sum of log shares, exactly.

Passes: (1) token counts of all training documents, summed by 64-bit token hash; (2) class sequences of all documents
written as 16-bit numbers, with the counts of the ``HOT`` most frequent tokens looked up on the way and the rest left as hashes;
the rest meets the count table in one join; (3) for each Baum-Welch round an expectation step over all training sequences,
whose expected counts are summed per class across tasks (the model's size, not the data's, reaches the driver); (4) the scaled
forward recursion over all documents. Long documents are run in segments that are tied together exactly: the products of a
segment's transition matrices give the state distributions at its two ends.

The states start as the unigram shares of all training documents, each with its own fixed noise; all rounds run over all of these documents.
So scores depend neither on ids nor on how rows are dealt to tasks (but for the last digits of sums).

Defined results: a null text is empty (one end token); a null doc_id counts as empty text where it is hashed; without training
documents every token is unknown, N and V are 0; rows are scored one by one, so repeated rows get equal scores; other columns play no
part, whatever their names. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written
from .wordscan import HashIndex, Words, mixed, pieces

STATES, ROUNDS = 8, 5
OWN, SUFFIXES = 8192, 8192
#: Most frequent tokens whose counts are shipped with the tasks (about 2 MB); others are looked up by a join.
HOT = 1 << 17
SEGMENT = 2048
#: Bytes of class sequences (two a token) that are run together.
CLASS_BYTES = 800_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"end of text"))
ALPHA = 0.1


def _suffix(words: Words) -> np.ndarray:
    """The suffix class of each word."""
    last = words.start + words.length - 1
    code = np.zeros(len(last), np.uint64)
    for back in range(3):
        inside = words.length > back
        code = (code << np.uint64(8)) | np.where(inside, words.data[np.maximum(last - back, 0)], 0).astype(np.uint64)
    return (mixed(code) % np.uint64(SUFFIXES)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 20_000, "text", 4 << 20):
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        own = [x for x, t in zip(texts(batch.column(1)), train, strict=True) if t]
        parts = []
        for group, owner in pieces(own):
            words = Words(group, owner, lower=True)
            parts.append((words.hash, _suffix(words)))
        key = np.concatenate([p[0] for p in parts] + [np.array([END])])
        suffix = np.concatenate([p[1] for p in parts] + [np.array([-1])])
        key, first, count = np.unique(key, return_index=True, return_counts=True)
        count[key == END] = len(own)
        live = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(key[live].view(np.int64)), pa.array(suffix[first][live]), pa.array(count[live])], ["token", "suffix", "c"])


@dataclass
class Vocabulary:
    """What tasks need to know of the counts: bounded by HOT and the number of classes."""

    token: np.ndarray  # of the hot tokens, most frequent first
    count: np.ndarray
    total: float  # N
    distinct: float  # V
    class_total: np.ndarray  # of the suffix classes, without tokens of their own class
    class_distinct: np.ndarray

    def log_class(self) -> np.ndarray:
        return np.log10(self.class_total + ALPHA * (self.class_distinct + 1))


def _sequences(vocabulary: Vocabulary):
    """Rows of _SEQUENCES for (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary
        index = HashIndex(len(v.token))
        index.add(v.token, np.arange(len(v.token)))
        log_count = np.log10(v.count + ALPHA)
        log_class = v.log_class()
        part = TaskContext.get().partitionId() << 36
        serial = 0
        for batch in slices(batches, 2000, "text", 2 << 20):
            raw = texts(batch.column(2))
            n = len(raw)
            cls, owner, rare, rare_owner = [], [], [], []
            sums = np.zeros((3, n))  # known hot tokens, their base logs, logs of shares (of rare words only the class's part)
            end = int(index.find(np.array([END]))[0])
            for group, of in pieces(raw):
                words = Words(group, of, lower=True)
                at = index.find(words.hash)
                hot = at >= 0
                own = hot & (at < OWN)
                suffix = _suffix(words)
                cls.append(np.where(own, at, OWN + suffix))
                owner.append(words.text)
                value = np.where(hot, log_count[at], 0) if len(log_count) else np.zeros(len(at))
                for row, x in enumerate((hot, value, np.where(own, 0, value - log_class[suffix]))):
                    sums[row] += np.bincount(words.text, weights=x, minlength=n)
                rare.append(words.hash[~hot])
                rare_owner.append(words.text[~hot])
            text = np.concatenate([*owner, np.arange(n)])
            every = np.concatenate([*cls, np.full(n, end if end >= 0 else 0)])
            order = np.argsort(text, kind="stable")
            every, text = every[order].astype("<u2"), text[order]
            ends = np.cumsum(np.bincount(text, minlength=n))
            if end >= 0:
                sums[0] += 1
                sums[1] += log_count[end]
            else:
                sums[1] += np.log10(ALPHA)
            rares = np.concatenate(rare) if rare else np.zeros(0, np.uint64)
            per = np.bincount(np.concatenate(rare_owner), minlength=n) if rare else np.zeros(n, np.int64)
            blob = every.tobytes()
            starts = ends - np.bincount(text, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + serial + np.arange(n)), batch.column(0), batch.column(1), pa.array(ends - starts),
                    pa.array([blob[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(rares.view(np.int64))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "classes", "hot_known", "hot_base", "hot_share", "rare"],
            )
            serial += n

    return run


_SEQUENCES = "row long, doc_id long, held_out boolean, n_tokens long, classes binary, hot_known long, hot_base double, hot_share double, rare array<long>"


@dataclass
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # classes x S

    def single(self) -> Model:
        """In single precision, for expectations (scaled, so that it does)."""
        return Model(self.start.astype(np.float32), self.move.astype(np.float32), self.emit.astype(np.float32))


class _Lattice:
    """Segments of class sequences laid out time by time: step t holds the segments that have a t-th token, longest first."""

    def __init__(self, segments: list[np.ndarray]):
        length = np.array([len(s) for s in segments], np.int64)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        steps = int(self.length[0]) if len(segments) else 0
        self.width = np.searchsorted(-self.length, -np.arange(1, steps + 1), "right")  # segments with more than t tokens
        self.first = np.concatenate([[0], np.cumsum(self.width)])
        flat = np.concatenate([segments[i] for i in self.order])
        begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        step = np.repeat(np.arange(steps), self.width)
        row = np.arange(self.first[-1]) - self.first[step]
        self.cls = flat[begin[row] + step]
        self.last = self.first[self.length - 1] + np.arange(len(segments))  # place of each segment's last token

    def forward(self, prior: np.ndarray, model: Model, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales at each place."""
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        state = prior
        for t, n in enumerate(self.width.tolist()):
            a, b = self.first[t], self.first[t + 1]
            state = (state[:n] @ model.move if t else state[:n]) * emit[a:b]
            s = state.sum(axis=1)
            state = state / s[:, None]
            alpha[a:b], scale[a:b] = state, s
        return alpha, scale

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        row = np.arange(len(scale)) - np.repeat(self.first[:-1], self.width)
        return np.bincount(row, weights=np.log(scale.astype(np.float64)), minlength=len(self.length))

    def backward(self, final: np.ndarray, model: Model, emit: np.ndarray, scale: np.ndarray) -> np.ndarray:
        beta = np.empty_like(emit)
        state = np.empty((0, emit.shape[1]), emit.dtype)
        back = model.move.T.copy()
        for t in range(len(self.width) - 1, -1, -1):
            a, b = self.first[t], self.first[t + 1]
            n = len(state)
            beta[a + n : b] = final[n : b - a]
            if n:
                c = self.first[t + 1]
                beta[a : a + n] = (state * emit[c : c + n] / scale[c : c + n, None]) @ back
            state = beta[a:b]
        return beta


def _boundaries(docs: list[np.ndarray], model: Model):
    """Cuts documents into segments. Returns (segments, document of each, prior of each, the state distribution before each (zeros
    for first ones), final beta of each); priors and betas of long documents come from the products of their segments' matrices."""
    segments, doc, prior, before, final = [], [], [], [], []
    long: list[tuple[int, list[np.ndarray]]] = []
    states = len(model.start)
    for i, d in enumerate(docs):
        if len(d) <= SEGMENT:
            segments.append(d)
            doc.append(i)
            prior.append(model.start)
            before.append(np.zeros(states))
            final.append(np.ones(states))
        else:
            long.append((i, [d[k : k + SEGMENT] for k in range(0, len(d), SEGMENT)]))
    if long:
        # one row for each first segment, and one for each state before each later one
        firsts = [own[0] for _, own in long]
        later = [s for _, own in long for s in own[1:]]
        lattice = _Lattice(firsts + [s for s in later for _ in range(states)])
        ahead_of = np.concatenate([np.tile(model.start, (len(firsts), 1)), np.tile(model.move, (len(later), 1))])
        alpha, scale = lattice.forward(ahead_of[lattice.order], model, model.emit[lattice.cls])
        end, log = np.empty_like(ahead_of), np.empty(len(ahead_of))
        end[lattice.order] = alpha[lattice.last]
        log[lattice.order] = lattice.log_likelihood(scale)
        entered, end, log = end[: len(firsts)], end[len(firsts) :], log[len(firsts) :].reshape(-1, states)
        product = end.reshape(-1, states, states) * np.exp(log - log.max(axis=1, keepdims=True))[:, :, None]
        at = 0
        for (i, own), v in zip(long, entered, strict=True):
            mine = product[at : at + len(own) - 1]
            at += len(own) - 1
            ahead = [np.zeros(states), v]
            for m in mine[:-1]:
                v = v @ m
                v = v / v.sum()
                ahead.append(v)
            behind = [np.ones(states)]
            for m in mine[::-1]:
                u = m @ behind[-1]
                behind.append(u / u.max())
            for k, s in enumerate(own):
                segments.append(s)
                doc.append(i)
                before.append(ahead[k])
                prior.append(model.start if not k else ahead[k] @ model.move)
                final.append(behind[len(own) - 1 - k])
    kind = model.move.dtype
    return segments, np.array(doc, np.int64), np.array(prior, kind), np.array(before, kind), np.array(final, kind)


def log_likelihoods(docs: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural logarithm of each class sequence's probability: the scaled forward recursion."""
    segments, doc, prior, _, _ = _boundaries(docs, model)
    lattice = _Lattice(segments)
    _, scale = lattice.forward(prior[lattice.order], model, model.emit[lattice.cls])
    return np.bincount(doc[lattice.order], weights=lattice.log_likelihood(scale), minlength=len(docs))


def expectations(docs: list[np.ndarray], model: Model, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of start states, moves and emissions, and the log-likelihood."""
    segments, _, prior, before, final = _boundaries(docs, model)
    lattice = _Lattice(segments)
    order = lattice.order
    emit = model.emit[lattice.cls]
    alpha, scale = lattice.forward(prior[order], model, emit)
    final, before = final[order], before[order]
    final = final / (alpha[lattice.last] * final).sum(axis=1, keepdims=True)
    beta = lattice.backward(final, model, emit, scale)
    gamma = alpha * beta
    right = beta * emit / scale[:, None]
    width = lattice.width
    onward = np.arange(width[0], len(alpha))
    left = onward - np.repeat(width[:-1], width[1:])  # the same segment one step before
    move = alpha[left].T @ right[onward] + before.T @ right[: width[0]]
    begins = before.sum(axis=1) == 0
    counts = np.stack([np.bincount(lattice.cls, weights=gamma[:, s], minlength=classes) for s in range(gamma.shape[1])], axis=1)
    return gamma[: width[0]][begins].sum(axis=0), move * model.move, counts, float(np.log(scale.astype(np.float64)).sum())


def reestimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
    """The maximisation step; emissions are smoothed towards the classes' overall shares."""
    emit = emit + 2.0 * unigram[:, None]
    move = move + 0.1
    start = start + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def started(classes: int, unigram: np.ndarray, states: int) -> Model:
    """A first model: noisy states that tend to stay."""
    rng = np.random.default_rng(7)
    emit = unigram[:, None] * rng.uniform(0.3, 1.7, (classes, states))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def scored(docs: DataFrame, root: str, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for (doc_id, text, held_out)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out"), "text")
    counted = docs.select((~F.col("held_out")).alias("train"), "text").mapInArrow(_counts, "token long, suffix long, c long")
    counts = written(counted.groupBy("token").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c")), f"{root}/counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the count from which on tokens are hot, by a histogram of a few hundred rows; the end token is hot always, and leads
    step = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > HOT:
            break
        least = r["step"]
    is_end = F.col("token") == F.lit(int(END.view(np.int64)))
    hot = counts.where(is_end | (step >= least) if least is not None else is_end).select("token", "suffix", "c").toPandas()
    hot = hot.assign(lead=(hot["suffix"] >= 0).astype(int)).sort_values(["lead", "c", "token"], ascending=[True, False, True])
    token, count = hot["token"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.float64)
    by_class = np.zeros((2, SUFFIXES))
    for r in counts.where(F.col("suffix") >= 0).groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        by_class[:, r["suffix"]] = r["c"], r["v"]
    own = hot.iloc[:OWN]
    own = own[own["suffix"] >= 0]
    np.subtract.at(by_class[0], own["suffix"].to_numpy(), own["c"].to_numpy())
    np.subtract.at(by_class[1], own["suffix"].to_numpy(), 1)
    vocabulary = Vocabulary(token, count, float(total["n"] or 0), float(total["v"]), by_class[0], by_class[1])
    classes = OWN + SUFFIXES
    weight = np.zeros(classes)
    weight[: min(OWN, len(count))] = count[:OWN]
    weight[OWN:] = by_class[0]
    unigram = (weight + 0.5) / (weight + 0.5).sum()

    del hot, own
    sequences = written(docs.mapInArrow(_sequences(vocabulary), _SEQUENCES), f"{root}/sequences")
    training = sequences.where(~F.col("held_out")).select("classes")
    model = started(classes, unigram, states)
    columns = [f"s{i}" for i in range(states)]
    for _ in range(rounds if total["n"] else 0):
        shipped = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in slices(batches, 2000, "classes", CLASS_BYTES):
                own = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]
                start, move, emit, _ = expectations(own, shipped.value.single(), classes)
                new = np.concatenate([emit, start[None, :], move])
                sums = new if sums is None else sums + new
            if sums is not None:
                at = np.flatnonzero(sums.sum(axis=1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[at, s]) for s in range(states)]], ["at", *columns])

        gathered = training.mapInArrow(expect, "at long, " + ", ".join(f"{c} double" for c in columns))
        rows = gathered.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        sums = np.zeros((classes + 1 + states, states))
        sums[rows["at"].to_numpy()] = rows[columns].to_numpy()
        model = reestimated(sums[classes], sums[classes + 1 :], sums[:classes], unigram)
        shipped.unpersist()
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "classes", CLASS_BYTES):
            own = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(batch.schema.get_field_index("classes")).to_pylist()]
            made = log_likelihoods(own, final.value) / np.log(10)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "classes"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(made)], [batch.schema.names[i] for i in keep] + ["path"])

    rare = sequences.select("row", F.explode("rare").alias("token")).join(counts.select("token", "c"), "token", "left")
    known = rare.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("logs"))
    paths = sequences.select("row", "doc_id", "held_out", "n_tokens", "classes", "hot_known", "hot_base", "hot_share").mapInArrow(likelihood, "row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot_share double, path double")
    norm = float(np.log10(vocabulary.total + ALPHA * (vocabulary.distinct + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return paths.join(known, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("hot_base") + logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("path") + F.col("hot_share") + logs).alias("score"),
    )

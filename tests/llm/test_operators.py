"""Each operator against a plain version on small tables that hold nulls, empty and long texts, repeated rows and ties."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import hidden_markov, language_id, line_dedup, merging, mixing, multi_index, prob_minhash, quality_rules, repair_store, sentence_pieces, warc_bundles, wordscan
from lexloom.llm.common import tokenizer_file, work_dir

WS = re.compile(rb"[^\x20\x09-\x0D]+")
SHARED = "this line is held by several documents of the table"
ROWS = [
    (1, f"first own line\n{SHARED}\nshort", "en", "a", 10), (2, f"{SHARED}  \nsecond own line is here", "en", "a", 10), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, "\n\n", "en", "b", 2), (6, f"\t{SHARED.upper()}\nshort", "en", "b", 5), (7, "word " * 6000, "en", "a", 30000), (7, "word " * 6000, "en", "a", 30000),
    (8, "é" * 9 + "\n" + "é" * 10 + "\nшесть", "de", None, 3), (9, "é" * 10, "de", "c", 3), (None, f"no id\n{SHARED}", "en", "a", 1), (10, "12 34 ..,", None, "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keys(text):
    return [(x if len(x.decode()) >= 10 else None) for x in (line.strip(b" \t\n\x0b\x0c\r").lower() for line in (text or "").encode().split(b"\n"))]


def test_line_dedup(spark, docs, empty):
    index = line_dedup.indexed(spark, docs, work_dir(spark, "t"))
    got = index.apply(docs.withColumns({"hi": F.lit("clash"), "n_dropped": F.lit("own"), "mark": F.lit(1)})).collect()
    assert {(r.hi, r.n_dropped, r.mark) for r in got} == {("clash", "own", 1)}
    least = {}
    holders = collections.defaultdict(set)
    for i, text, *_ in ROWS:
        for k in keys(text):
            holders[k].add(i)
    for k, ids in holders.items():
        least[k] = min([i for i in ids if i is not None], default=None)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if k is None or len(holders[k]) < 2 or i == least[k]]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r._lx_lines, r._lx_dropped, r._lx_sha256) for r in got) == want
    assert line_dedup.indexed(spark, empty, work_dir(spark, "t")).apply(empty).count() == 0


def test_line_dedup_is_reversible(spark, docs):
    first, second = docs.where("doc_id <= 4"), docs.where("doc_id > 4 or doc_id is null")
    root = work_dir(spark, "t")
    index = line_dedup.LineIndex(spark, root).insert(first)
    state = sorted(map(tuple, index.refs.collect()), key=str)
    before = sorted(r._lx_sha256 for r in index.apply(first).collect())
    index.insert(second)
    assert len(index.refs.collect()) > len(state)
    grown = sorted(map(tuple, index.refs.collect()), key=str)
    index.insert(second)  # brought already
    assert sorted(map(tuple, index.refs.collect()), key=str) == grown
    again = line_dedup.LineIndex.open(spark, root)  # as another session finds it
    again.delete(second.select("doc_id"))
    assert sorted(map(tuple, again.refs.collect()), key=str) == state
    assert sorted(r._lx_sha256 for r in again.apply(first).collect()) == before
    live = again.filters.collect()
    made = line_dedup.CuckooFilter.load(bytes(live[0].table))
    assert len(live) == 1 and (made.table != 0).sum() == len(state) == live[0].n and made.contains(np.array([r[1] for r in state])).all()
    assert sorted(map(tuple, again.insert(second).refs.collect()), key=str) == grown


def test_filters_without_room_are_built_anew(spark):
    one = spark.range(200).select("id", F.concat(F.lit("a line of its own, number "), "id").alias("text")).withColumnRenamed("id", "doc_id")
    index = line_dedup.LineIndex(spark, work_dir(spark, "t")).insert(one.where("doc_id < 20")).insert(one)
    live = index.filters.collect()
    assert sum(r.n for r in live) == 200 == index.refs.count() and len(index._read("filters")) == 2


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    lo = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    made = line_dedup.build_filter(lo)
    assert made.contains(lo).all() and made.contains(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)).mean() < 0.002
    made.delete(lo[:10_000])
    assert made.contains(lo[10_000:]).all() and (made.table != 0).sum() == 10_000


def test_repair_round_trip():
    rng = np.random.default_rng(2)
    tokens = np.concatenate([np.tile(rng.integers(0, 500, 40), 300), rng.integers(0, 500, 5000), np.full(999, 7)])
    block = repair_store.Block(repair_store.pack_block([5, None], np.array([1000, len(tokens) - 1000]), tokens, 500))
    assert (block.all() == tokens).all() and len(block.seq) < len(tokens) / 2 and block.ids == [5, None]
    assert (repair_store.expansion_lengths(block.rules, 500) == block.lengths).all()
    for a, n in ((0, 1), (17, 900), (len(tokens) - 5, 5)):
        assert (repair_store.read_range(block, a, n) == tokens[a : a + n]).all()


def test_repair_store(spark, docs, empty):
    from tokenizers import Tokenizer

    blob = tokenizer_file("word_bpe_49k.json")
    manifest = repair_store.write_shards(docs, work_dir(spark, "t"), blob, 1)
    got = [tuple(r) for r in repair_store.read_shards(spark, manifest).collect()]
    plain, want, at = Tokenizer.from_buffer(blob), [], 0
    for i, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    f, foot = repair_store.open_shard(manifest.first().file)
    assert sum(b["docs"] for b in foot) >= 1
    f.close()
    block = repair_store.Block(repair_store.read_block(manifest.first()))
    some = block.ids[-1]
    assert [zlib.crc32(x.astype("<u4").tobytes()) for x in repair_store.read_document(block, some)] == [crc for i, _, _, crc in want if i == some]
    assert repair_store.read_shards(spark, repair_store.write_shards(empty, work_dir(spark, "t"), blob, 1)).count() == 0


TRICKY = ["", " ", "a  b   c ", "\n\n a\n b", "İI ΑΣ ΣΑΣ. 漢字 𝒳 😀", "x" * 500 + " " + "ab" * 300, "▁▁", "é   　 <s> <0x41>", "don't IT'S <|startoftext|> a\x1cb ①②\x85y", " ́x"]


def test_encoders_equal_their_libraries():
    from tokenizers import Tokenizer

    pieces, words = sentence_pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model")), repair_store.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    plain = Tokenizer.from_buffer(tokenizer_file("word_bpe_49k.json"))
    raw = [x.encode() for x in TRICKY]
    ids, n = pieces.encode(raw)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == pieces.library.encode(TRICKY, add_bos=True, add_eos=True)
    ids, n = words.encode(raw, 1)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == [[*plain.encode(x, add_special_tokens=False).ids, 1] for x in TRICKY]


def test_agenda_and_lockstep_agree():
    rng = np.random.default_rng(3)
    merges = {(int(a), int(b)): (int(r), 10 + int(r)) for r, (a, b) in enumerate(rng.integers(0, 30, (60, 2)))}
    made = merging.MergeTable(merges)
    lengths = rng.integers(1, 30, 200)
    flat = rng.integers(0, 10, lengths.sum())
    out, counts = merging.lockstep(flat, lengths, made)
    ends, begin = np.cumsum(counts), 0
    for n, e, c in zip(lengths, ends, counts, strict=True):
        assert out[e - c : e].tolist() == merging.agenda(flat[begin : begin + n].tolist(), made)
        begin += n


def test_sentence_pieces(spark, docs, empty):
    model = tokenizer_file("piece_bpe_32k.model")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.encoded(docs, model).collect()}
    lib = sentence_pieces.encoder(model).library
    want = set()
    for i, text, *_ in ROWS:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == want
    assert sentence_pieces.encoded(empty, model).count() == 0


def test_multi_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [None] + [1.0] * 7), (1003, [float("nan")] + [1.0] * 7), (1004, [1.0] * 3), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = collections.defaultdict(list)
    for r in multi_index.neighbours(df, F.col("id") % 20 == 0, work_dir(spark, "t"), k=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 400, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-9 for _, v, c in mine)
        hit += len(set(order) & {v for _, v, _ in mine})
    assert hit >= 0.9 * 100 and set(got) == set(range(0, 400, 20))
    assert multi_index.neighbours(df.limit(0), F.col("id") % 20 == 0, work_dir(spark, "t")).count() == 0


def test_warc(spark):
    rows = [(3, "http://a", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", "<p>same</p>"), (2, "u", "<p>same</p>"), (4, "u\n", None), (5, "u", ""), (None, "u", "<p>same</p>"), (6, "u", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_bundles.write_bundles(pages, work_dir(spark, "t"))
    got = sorted((tuple(r) for r in warc_bundles.read_bundles(spark, index).collect()), key=str)
    least = {"<p>same</p>": 1, "": 4, rows[-1][2]: 6}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = least[html or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    one = index.where("page_id = 6").first()
    table = warc_bundles.seek_table(one.file)
    frame = warc_bundles.read_frame(one.file, *table[one.frame][:2])
    assert next(warc_bundles.records(frame[one.offset : one.offset + one.length]))[1] == rows[-1][2].encode()


def test_language_id(spark, docs, empty):
    en, de = "the house and the garden of them ", "das Haus und der Garten von ihnen "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "12 34", "en"), (102, en * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.fitted(df.where("doc_id < 40"))
    got = {r.doc_id: (r._lx_lang, r._lx_score) for r in language_id.predicted(df.withColumn("score", F.lit("own")), network).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0.5 < got[i][1] <= 1 for i in range(60))
    assert got[100] == ("und", 0.0) and got[101] == ("und", 0.0) and got[102][0] == "en"
    assert language_id.fitted(empty) is None and language_id.predicted(docs, None).where("_lx_lang = 'und'").count() == len(ROWS)


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["x", "y", None, "z"][i % 4 if i % 3 else 0]) for i in range(400)] + [(900, None, "x"), (901, "a b", "only"), (902, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mix = mixing.Mix(df, work_dir(spark, "t"))
    got = mix.applied(df).collect()
    assert len(got) == len(rows) and all(0 <= r._lx_copies <= 3 for r in got)
    again = mixing.Mix(df.repartition(5), work_dir(spark, "t")).applied(df).collect()
    assert sorted((r.doc_id, r._lx_copies, tuple(r._lx_shards)) for r in got) == sorted((r.doc_id, r._lx_copies, tuple(r._lx_shards)) for r in again)
    size = collections.Counter()
    for _, text, s in rows:
        size[s] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    found = {(None if r._lx_nul else r._lx_src): r.target for r in mix.sources.collect()}
    assert all(abs(found[s] - target[s]) < 1e-6 for s in order)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.size * r._lx_copies
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in order)
    rows_out = mixing.mixed_rows(df, mix)
    assert rows_out.count() == sum(r._lx_copies for r in got)
    assert mixing.Mix(df.limit(0), work_dir(spark, "t")).applied(df.limit(0)).count() == 0


def test_splitting_tree_is_exact(spark):
    units = spark.createDataFrame([("a", False, 100), ("b", False, 37), ("", True, 3)], "_lx_src string, _lx_nul boolean, k long")
    got = mixing.split_tree(units, 6, 5).collect()
    per = collections.Counter()
    by = collections.Counter()
    for r in got:
        per[r._lx_src, r._lx_nul] += r.quota
        by[r.shard] += r.quota
        assert r.quota >= 0
    assert per == {("a", False): 100, ("b", False): 37, ("", True): 3} and max(by.values()) - min(by.values()) <= 1 and len(by) == 6


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_prob_minhash(spark, empty):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for k in rng.integers(0, 120, i // 3):
            words[k] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(50, " ".join(base)), (51, " ".join(base).replace(" ", "\n")), (60, None), (61, ""), (62, "two words"), (63, "two  words"), (64, "other words"), (None, "lonely text of six words here"), (70, "x " * 3000), (70, "x " * 3000)]
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(30)]
    got = collections.Counter((r.doc_id, r.class_id) for r in prob_minhash.classified(spark.createDataFrame(rows, "doc_id long, text string"), work_dir(spark, "t")).collect())
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    assert got == collections.Counter((d, least.get(top(i))) for i, (d, _) in enumerate(rows))
    assert prob_minhash.classified(empty, work_dir(spark, "t")).count() == 0


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    code = wordscan.mixed(np.concatenate([a, b]))
    text = np.repeat([0, 1], 1000)
    s = prob_minhash.signatures(code, text, np.ones(2000), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.04


def test_hidden_markov_likelihood_is_exact():
    rng = np.random.default_rng(7)
    model = hidden_markov.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T.copy())
    docs = [rng.integers(0, 9, n) for n in (1, 2, 50, 5000, 2048, 2049)]
    want = []
    for d in docs:
        v, total = model.start * model.emit[d[0]], 0.0
        for c in d[1:]:
            total += math.log(v.sum())
            v = (v / v.sum()) @ model.move * model.emit[c]
        want.append(total + math.log(v.sum()))
    assert np.allclose(hidden_markov.log_likelihoods(docs, model), want, rtol=1e-10)
    start, move, emit, log = hidden_markov.expectations(docs, model, 9)
    assert np.isclose(start.sum(), len(docs)) and np.isclose(emit.sum(), sum(map(len, docs))) and np.isclose(move.sum(), sum(len(d) - 1 for d in docs))
    grown = hidden_markov.reestimated(start, move, emit, np.full(9, 1e-9))
    assert hidden_markov.log_likelihoods(docs, grown).sum() > sum(want)


def test_hidden_markov_scores(spark, docs, empty):
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    got = hidden_markov.scored(docs.withColumn("held_out", fold), work_dir(spark, "t")).collect()
    count = collections.Counter()
    for i, text, *_ in ROWS:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            count.update([*WS.findall((text or "").encode().lower()), "end"])
    total, distinct = sum(count.values()), len(count)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        tokens = [*WS.findall((text or "").encode().lower()), "end"]
        want[i, len(tokens), sum(t in count for t in tokens), total, round(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens), 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want and all(r.score < 0 for r in got)
    assert hidden_markov.scored(empty.withColumn("held_out", F.lit(False)), work_dir(spark, "t")).count() == 0


def test_quality_rules(spark, docs, empty):
    extra = [(1000 + i, f"boilerplate line of the host number one\nown {i}", "en", "h", 1) for i in range(40)]
    rows = ROWS + extra + [(2000, "one two three four five six seven eight nine " * 5, "en", "h", 1), (2001, "a # b\na # b\n x\n x" + " q" * 30, "en", "h", 1)]
    got = quality_rules.judged(spark.createDataFrame(rows, SCHEMA), work_dir(spark, "t")).collect()
    want = []
    for i, text, *_ in rows:
        w = WS.findall((text or "").encode())
        windows = collections.defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        repeated = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WS.search(line.encode()):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    removed = {r.doc_id: r.removed_bytes for r in got}
    assert removed[1000] == 0 and all(removed[1000 + i] == len("boilerplate line of the host number one") for i in range(1, 40))
    assert quality_rules.judged(empty, work_dir(spark, "t")).count() == 0


def test_pipeline_stages(spark, docs, empty):
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, "")
        if name != "sentence_pieces":
            assert out.columns == docs.columns
        held = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < held.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_pipeline_keeps_one_of_a_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text + (f" tail{i}" if i else ""), "en", "s", 1) for i in range(6)] + [(9, "another clean text of some words", "en", "s", 1), (10, None, None, None, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10]

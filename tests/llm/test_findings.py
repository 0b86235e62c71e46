"""Cases in which an operator once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import mixing
from lexloom.llm.common import work_dir


def test_mixing_passes_over_long_documents(spark):
    """Six sources of 2,000 documents and one of a third of the source's words; each comes within 1% of its target."""
    one = F.when(F.col("id") % 2001 == 0, 400_000).otherwise(300 + F.pmod(F.xxhash64("id"), F.lit(200)))
    rows = spark.range(6 * 2001).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2001)).alias("source"), one.cast("long").alias("size"))
    for seed in (17, 18):
        mix = mixing.Mix(rows, work_dir(spark, "t"), seed=seed)
        taken = mixing.keyed(mix.applied(rows)).groupBy("_lx_src").agg(F.sum(F.col("size") * F.col("_lx_copies")).alias("taken"))
        for r in taken.join(mix.sources, "_lx_src").collect():
            assert 0.99 * r.target <= r.taken <= r.target + 1, (seed, r)


def test_near_duplicates_keep_a_row_of_each_class(spark):
    """Rows without a doc_id, or with the same one, are classes by their texts; copies of them still go."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefgh"}
    rows = [(None, text["a"], "en", "s", 1), (None, text["a"] + " tail", "en", "s", 2), (None, text["b"], "en", "s", 3), (None, text["c"], "de", "s", 4), (7, text["d"], "en", "s", 5), (7, text["e"], "en", "s", 6)]
    rows += [(None, text["d"] + " tail", "en", "s", 7), (3, text["f"], "en", "s", 8), (2, text["f"].replace(" ", "  "), "en", "s", 9), (None, "", "en", "s", 10), (None, None, "en", "s", 11), (8, " ", "en", "s", 12), (8, None, "en", "s", 13)]
    rows += [(None, text["g"], lang, "s", 14) for lang in ("en", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, frame.repartition(n), "").collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    got = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert len(got) == 11 and {3, 4, 5, 6, 9, 10, 11, 12, 13, 14} < {r.n_chars for r in got} and {r.n_chars for r in got} & {1, 2} and not {r.n_chars for r in got} & {7, 8}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(a, b, letters):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(letters))


def test_words_that_sums_of_powers_mix_up(spark):
    """Pairs of words, and of texts, whose sums of powers modulo 2^64 are equal."""
    from tokenizers import Tokenizer

    from lexloom.llm import hidden_markov, prob_minhash, quality_rules, repair_store, sentence_pieces, wordscan
    from lexloom.llm.common import tokenizer_file

    pairs = [(thue_morse("a", "b", n), thue_morse("b", "a", n)) for n in (1024, 4096)]
    words = [w for pair in pairs for w in pair]
    raw = [w.encode() for w in words]
    assert len(set(wordscan.word_hashes(raw)[0].tolist())) == 4
    blob = tokenizer_file("word_bpe_49k.json")
    ids, n = repair_store.WordEncoder(blob).encode(raw, 1)
    ends = np.cumsum(n)
    plain = Tokenizer.from_buffer(blob)
    assert [ids[e - k : e - 1].tolist() for e, k in zip(ends, n, strict=True)] == [plain.encode(w, add_special_tokens=False).ids for w in words]
    encoder = sentence_pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
    ids, n = encoder.encode(raw)
    assert [ids[e - k : e].tolist() for e, k in zip(np.cumsum(n), n, strict=True)] == encoder.library.encode(words, add_bos=True, add_eos=True)
    texts = [*words, *(thue_morse("one ", "two ", 2048), thue_morse("two ", "one ", 2048))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert len(set(prob_minhash.nodes_of(*wordscan.word_hashes([t.encode() for t in texts])))) == 6
    scored = hidden_markov.scored(docs.withColumn("held_out", F.lit(False)), work_dir(spark, "t")).collect()
    assert all(r.n_known == r.n_tokens for r in scored)
    twice = quality_rules.judged(spark.createDataFrame([(1, " ".join([words[0], *"bcdefgh", words[1], *"bcdefgh"]), "en", "s", 1)], SCHEMA), work_dir(spark, "t")).first()
    assert twice.n_repeat_words == 0


def clashing(frame):
    names = ["score", "lang_pred", "n_dropped", "kept_text", "n_lines", "kept_sha256", "passes", "single", "shards", "copy", "s_doc", "block_", "copies", "src_", "nul_", "node", "mark", "hi", "lo", "size", "label", "row", "id", "none"]
    return frame.withColumns({c: F.lit(f"own {c}") for c in names}), names


def test_stages_leave_clashing_columns_alone(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} number{i}\nshared line of all documents", "en" if i % 2 else "de", "ab"[i % 2], 1) for i in range(12)] + [(None, "text without an id\nshared line of all documents", "en", None, 1), (3, None, None, None, None)]
    held, names = clashing(spark.createDataFrame(rows, SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, "")
        if name == "sentence_pieces":
            assert out.count() == held.count()
            break
        got = out.collect()
        assert out.columns == held.columns and got and all(r[c] == f"own {c}" for r in got for c in names), name
        held = spark.createDataFrame(got, out.schema)


def test_line_dedup_takes_lines_of_rows_without_an_id(spark):
    """A long line that only rows without an id hold, and one that such a row shares."""
    from lexloom.llm import line_dedup

    rows = [(None, "a long line of the rows without an id\na long line that a document shares"), (None, "a long line of the rows without an id"), (4, "a long line that a document shares"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r._lx_text, r._lx_dropped) for r in line_dedup.indexed(spark, docs, work_dir(spark, "t")).apply(docs).collect())
    assert got == [("4", rows[2][1], 0), ("None", "", 0), ("None", rows[1][1], 0), ("None", rows[1][1], 1)]


def test_record_ids_are_unique(spark):
    from lexloom.llm import warc_bundles

    rows = [(1, "u", "<p>x</p>")] * 3 + [(2, "v", "<p>y</p>"), (2, "w", "<p>y</p>"), (3, "v", "<p>x</p>"), (None, "n", "<p>z</p>"), (None, "n", "<p>z</p>"), (5, "e", None), (6, "e", None)]
    for least in (0, 1 << 20):
        index = warc_bundles.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), work_dir(spark, "t"), least=least)
        ids = [r.record_id for r in index.collect()]
        assert len(ids) == len(rows) == len(set(ids))


def test_scores_do_not_follow_the_partitions(spark):
    from lexloom.llm import hidden_markov

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 30)), i % 5 == 0) for i in range(60)] + [(100, " ".join(f"w{k}" for k in rng.integers(0, 60, 5000)), False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    runs = [{r.doc_id: r.score for r in hidden_markov.scored(frame.repartition(n), work_dir(spark, "t")).collect()} for n in (1, 7)]
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-6 * abs(runs[0][i]) for i in runs[0])
    long = spark.createDataFrame([(i, " ".join(f"w{k % 7 + i}" for k in range(3000)), i > 2) for i in range(4)], "doc_id long, text string, held_out boolean")
    trained = hidden_markov.scored(long, work_dir(spark, "t")).where("doc_id = 0").first().score
    assert trained > hidden_markov.scored(long, work_dir(spark, "t"), rounds=0).where("doc_id = 0").first().score - 1e-9


def test_families_of_edited_copies(spark):
    """Classes of heavily edited copies, cut texts and copies of copies equal those of all pairs."""
    from lexloom.llm import prob_minhash

    rng = np.random.default_rng(8)
    rows = []
    for family in range(4):
        base = [f"b{family}_{i}" for i in rng.integers(0, 400, 100)]
        for k in range(60):
            words = list(base)
            for at in rng.integers(0, 100, rng.integers(0, 10)):
                words[at] = f"e{rng.integers(0, 12)}"
            cut = rng.integers(0, 25) if k % 3 == 0 else 0
            rows.append((len(rows), " ".join(words[cut:])))
    got = {r.doc_id: r.class_id for r in prob_minhash.classified(spark.createDataFrame(rows, "doc_id long, text string"), work_dir(spark, "t")).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label)) and len(set(label)) > 10


def test_walk_meets_the_neighbours_of_many_vectors(spark):
    """20,000 vectors around 300 centres: a walk of 2,000 candidates, against all inner products."""
    from lexloom.llm import multi_index

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 20_000)] + 0.4 * rng.normal(size=(20_000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").withColumn("cell", F.lit("own"))
    got = {}
    for r in multi_index.neighbours(frame, F.col("id") % 100 == 0, work_dir(spark, "t"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide, hit = x.astype(np.float64), 0
    for q, rows in got.items():
        score = wide @ wide[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & {v for _, v, _ in rows})
        assert [r for r, *_ in sorted(rows)] == list(range(1, 21)) and all((wide[q] * wide[v]).sum() == s for _, v, s in rows)
    assert len(got) == 200 and hit >= 0.9 * 4000


def test_network_equals_a_plain_convolution():
    from lexloom.llm import language_id

    rng = np.random.default_rng(4)
    tables = [rng.normal(size=(w, 256, language_id.FILTERS)) for w in language_id.WIDTHS]
    features = language_id.FILTERS * len(tables)
    network = language_id.Network(["a", "b", "c"], tables, rng.normal(size=features), rng.normal(size=(features, 3)), rng.normal(size=3))
    windows = np.concatenate([language_id.windows_of(bytes(rng.integers(0, 256, n).astype(np.uint8))) for n in (0, 1, 256, 700)])
    want = []
    for w in windows:
        one_hot = np.eye(256)[w]
        hidden = [max((one_hot[i : i + len(t)] * t[:, :, f]).sum() for i in range(language_id.WINDOW - len(t) + 1)) for t in tables for f in range(language_id.FILTERS)]
        out = np.exp(np.maximum(np.array(hidden) + network.shift, 0) @ network.out + network.bias)
        want.append(out / out.sum())
    assert np.allclose(language_id.probabilities(windows, network, network.pairs()), want)


SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    from lexloom.llm import queries

    told = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows = queries.op6_language_id(spark, SF).where("held_out and lang_pred <> 'und'").join(told, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_latent_states_beat_the_base_on_held_out_documents(spark):
    from lexloom.llm import queries

    r = queries.op9_hidden_markov(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.2


def test_labels_of_all_languages_are_learned(spark):
    from lexloom.llm import language_id

    rows = [(i, f"{chr(0x3B1 + i % 80)} text of a language with letters", f"l{i % 80:02d}") for i in range(160)]
    assert len(language_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=160).labels) == 80


def test_splits_follow_the_hypergeometric_distribution(spark):
    """120 trees of two sources with 6 and 10 units, two shards of 8: the mean and the variance of a shard's units."""
    units = spark.createDataFrame([("a", False, 6), ("b", False, 10)], "_lx_src string, _lx_nul boolean, k long")
    drawn = []
    for start in range(0, 120, 40):
        trees = [mixing.split_tree(units, 2, seed).where("_lx_src = 'a' and shard = 0") for seed in range(start, start + 40)]
        whole = trees[0]
        for t in trees[1:]:
            whole = whole.unionAll(t)
        drawn += [r.quota for r in whole.collect()]
    assert len(drawn) == 120 and abs(np.mean(drawn) - 3) < 0.3 and abs(np.var(drawn) - 1.0) < 0.4

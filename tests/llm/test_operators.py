"""Operators on small tables: brute force, round trips and the defined odd cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from areastats.llm import chat, jaccard, language_model, licences, mixing, neighbours, packing, quality, rules, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "  \n ", "one", "one two three", "x " * 3000, "one", "A b c d e f", "a B c d e f"]


def test_template_errors_and_folding():
    for bad in ("{% for m in others %}{% endfor %}", "{{ a.__class__ }}", "{% if x %}", "{{ x | nothing }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}"))
    assert tree == (chat.Emit(chat.Const("abcd")),)


@pytest.mark.parametrize("text", ["<|im_end|>", "<||x|>", "<", "|", "a\\n\n<|", ""])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unline(chat.unescape(chat.escape(chat.line(text)))) == text
    assert "<|im" not in chat.escape(text)


def test_chat_round_trip_with_nulls_and_ties(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<"), (1, 1, "assistant", "<"), (1, 2, "assistant", "|a"), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 4 and got[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_rules_against_brute_force(spark):
    texts = [*ODD, "a b c a b c\nd\nd\n \n", "p q r s p q r t p q r"]
    got = {r.doc_id: r for r in rules.quality_rules(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x for x in (t or "").replace("\n", " ").split(" ") if x]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
    assert rules.quality_rules(documents(spark, ["a"]).limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost():
    made = [rules.Rule("a", "true", 1.0, 0.5), rules.Rule("b", "true", 0.1, 0.2), rules.Rule("c", "true", 1.0, 0.0)]
    assert [r.name for r in rules.order(made)] == ["b", "a", "c"]


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d", "l", "small", 10.0, 1.0), ("d", "l", "large", 1000.0, 1.0), ("d", "l", "none", 5.0, 0.0)]
    nodes = spark.createDataFrame(rows, "d string, l string, _mix_k0 string, _mix_cap double, _mix_w double")
    got = {r._mix_k0: r._mix_budget for r in mixing.share_out(nodes, ["d", "l"], F.lit(100.0)).collect()}
    assert got == {"small": 10.0, "large": 90.0, "none": 0.0}


def test_mixing_odd_rows(spark):
    out = mixing.mix_sources(documents(spark, ODD), mixing.LEVELS)
    assert out.count() == len(ODD) and out.agg(F.min("_mix_copies")).first()[0] >= 0
    assert mixing.mix_sources(documents(spark, ODD).limit(0), mixing.LEVELS).count() == 0


def test_mixing_unlisted_and_missing_values(spark):
    made = [("src1", "en"), ("src5", "en"), ("wiki", "de"), ("crawl20230101123456", "fr"), (None, "en"), ("src2", None), ("src3", "pt"), ("", "en"), (None, None)]
    rows = [(100 * k + i, "word " * 10, lang, source, 50) for k, (source, lang) in enumerate(made) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs, mixing.LEVELS).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        taken[r.source, r.lang] += r._mix_copies
    assert set(taken) == set(made) and min(taken.values()) > 0
    domain = {r.source: r._mix_domain for r in out}
    assert domain["src1"] == domain["src5"] == "1" and domain["crawl20230101123456"] == "0"
    assert domain["wiki"] == str(zlib.crc32(b"wiki") % 4) and domain[""] == "0"
    mixed = Counter((r.source, r.lang) for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert mixed == taken


def links_of(vectors, cosine):
    out = {}
    for i, (_, v, a) in enumerate(vectors):
        for j, (_, w, b) in enumerate(vectors):
            if i != j and a is not None and a == b and v and w and len(v) == len(w) and np.isfinite(v).all() and np.isfinite(w).all():
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                if norm and np.dot(v, w) / norm >= cosine:
                    out.setdefault(i, set()).add(j)
    return out


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((20, 24))
    made = [(i, (centre[i % 20] + rng.standard_normal(24) * 0.2).tolist(), i % 2) for i in range(300)]
    made += [(300, made[0][1], 0), (301, None, 1), (302, [0.0] * 24, 1), (303, [math.nan] * 24, 1), (304, made[1][1], None), (305, [1.0], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    exact = [(i, None if v is None else np.asarray(v, np.float32).astype(float).tolist(), c) for i, v, c in made]
    want = links_of(exact, 0.93)
    got = {r.vec_id: r for r in neighbours.link_vectors(df).collect()}
    assert all(got[i].n_links == len(want.get(i, ())) for i in range(len(made)))
    assert all(got[j].component_id == got[i].component_id for i, js in want.items() for j in js)
    assert got[302].kept and neighbours.link_vectors(df.limit(0)).count() == 0


def test_vectors_in_many_chunks(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((30, 20))
    # Labels over several chunks and chunks of several labels, two sizes of vectors, copies in every batch, repeated keys.
    made = [(i, (centre[i % 30] + rng.standard_normal(20) * 0.25)[: 20 - 4 * (i % 7 == 0)].tolist(), i % 9 if i % 2 else 77) for i in range(400)]
    made += [(1000 + i, made[5][1], made[5][2]) for i in range(40)] + [(7, made[9][1], made[9][2])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(4)
    for cosine in (0.93, 0.99):
        want = links_of(made, cosine)
        links = sorted((made[i][0], len(want.get(i, ()))) for i in range(len(made)))
        out = neighbours.link_vectors(df, cosine, chunk=16).collect()
        assert sorted((r.vec_id, r.n_links) for r in out) == links
        component = {r.vec_id: r.component_id for r in out if r.vec_id != 7}
        assert all(component[made[i][0]] == component[made[j][0]] for i, js in want.items() for j in js if 7 not in (made[i][0], made[j][0]))


def shuffled(spark):
    """Bytes of the files that shuffles have left so far."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_vectors_are_moved_once(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").localCheckpoint()
    before = shuffled(spark)
    out = neighbours.link_vectors(df)
    assert shuffled(spark) - before < 3 * x.size * 4
    rows = out.collect()
    assert len(rows) == 4000 and all(r.n_links == 0 for r in rows)


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(10)]
    texts = list(ODD)
    for b in base:
        for _ in range(8):
            w = b.split()
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                w[at] = "edited"
            texts.append(" ".join(w))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r for r in jaccard.jaccard_classes(documents(spark, texts)).collect()}
    assert {i: got[i].component_id for i in got} == {i: root(i) for i in range(len(texts))}
    assert {i: got[i].n_shingles for i in got} == {i: len(s) for i, s in enumerate(sets)}
    assert jaccard.jaccard_classes(documents(spark, texts).limit(0)).count() == 0


def kept_by_brute_force(rows):
    """Rows (doc_id, text, ...) as one of each class: all pairs, smallest id first and NULL last; rows equal in all columns are one."""
    rows = list(dict.fromkeys(rows))
    sets = [set(jaccard.shingles(r[1]).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    classes = {}
    for r, g in zip(rows, group):
        classes.setdefault(g, []).append(r)
    return [[r for r in c if r[0] == min((x[0] for x in c if x[0] is not None), default=None)] for c in classes.values()]


def rows_without_and_with_repeated_ids(texts):
    near = [" ".join([*t.split()[:-1], "changed"]) for t in texts]
    made = [(0, texts[0]), (1, near[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, near[3])]
    made += [(2, texts[4]), (None, texts[4]), (2, near[4]), (3, texts[5]), (3, texts[5]), (4, texts[5])]
    return [(i, t, "en", f"src{k % 3}", len(t)) for k, (i, t) in enumerate(made)] + [(3, texts[5], "en", "src1", len(texts[5]))] * 2


def test_one_of_each_against_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(6)]
    made = rows_without_and_with_repeated_ids(texts)
    made += [(None, None, "en", "src0", 0), (5, "", "en", None, 0), (5, " ", None, "src0", 0), (6, None, "en", "src0", 0), (None, None, "en", "src0", 0)]
    got = [[tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] for docs in
           (spark.createDataFrame(made, DOCS).repartition(3), spark.createDataFrame(made[::-1], DOCS).repartition(5))]
    assert sorted(got[0], key=str) == sorted(got[1], key=str)
    want = kept_by_brute_force(made)
    assert len(got[0]) == len(want) and all(sum(r in c for r in got[0]) == 1 for c in want)


def test_pipeline_against_brute_force(spark, small_data, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{small_data}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{small_data}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(given, DOCS)
    regular = corpus_pipeline.keep_regular(spark, corpus_pipeline.keep_good(spark, docs, small_data), small_data)
    texts = [r.text for r in regular.orderBy("doc_id").collect()][:6]
    assert len(texts) == 6
    odd = [(i if i is None else 10**6 + i, *rest) for i, *rest in rows_without_and_with_repeated_ids([f"{t} extra" for t in texts])]
    docs = spark.createDataFrame(given + odd, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    regular = corpus_pipeline.keep_regular(spark, corpus_pipeline.keep_good(spark, docs, str(tmp_path)), str(tmp_path))
    want = kept_by_brute_force([tuple(r) for r in regular.collect()])
    one = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, regular, str(tmp_path)).collect()]
    assert len(one) == len(want) and all(sum(r in c for r in one) == 1 for c in want)
    mixed = mixing.mix_sources(spark.createDataFrame(one, DOCS), mixing.LEVELS).collect()
    copies = Counter()
    for r in mixed:
        ids = [*packing.encode_all(packing.encoder(None), r.text), packing.END]
        for piece, (start, length) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            copies[r.doc_id, piece, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += r._mix_copies
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == +copies


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((10, 12), (900, 1100), (3000, 2500), (5000, 700)):
        both = np.unique(rng.integers(0, 2**63, min(n, m) // 2, dtype=np.uint64))
        a, b = (np.union1d(both, rng.integers(0, 2**63, k - len(both), dtype=np.uint64)) for k in (n, m))
        x, y = jaccard.signature(a), jaccard.signature(b)
        assert len(x) * 64 >= len(a)
        least = min(len(x), len(y))
        differ = np.bitwise_count(jaccard.fold(x[None], least) ^ jaccard.fold(y[None], least)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_jaccard_of_long_and_short_texts(spark):
    # Long near copies, long texts that share one passage only, and a region of many unrelated texts.
    rng = np.random.default_rng(6)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    long, passage = words(4000), words(60)
    texts = [" ".join(long), " ".join([*long[:3900], *words(100)]), " ".join([*long[:2000], *words(2000)])]
    texts += [" ".join([*passage, *words(n)]) for n in (5, 8, 100, 1500, 3000, 3000)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}


def test_packing_ids_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(documents(spark, ODD)).toPandas()
    for i, t in enumerate(ODD):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 1024
    assert packing.pack(documents(spark, ODD).limit(0)).count() == 0


def test_packing_ids_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end}", f"a{end}b", f"  {end}\n\n {end}  x", f"<|{end}|>", "<|endoftext|", "<|EndOfText|>", f"é{end}é 12{end}34 " * 400]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(None)
    want = [exact.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packing.pack(documents(spark, texts)).toPandas()
    for i, plain in enumerate(want):
        assert packing.encode_all(enc, texts[i]) == plain
        ids = np.array([*plain, packing.END], "<u4")
        own = rows[rows.doc_id == i]
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_sweep_places_every_rank_once():
    counts = {700: 3, 400: 5, 300: 7, 24: 100, 1: 13}
    fill = Counter()
    for length, first, end, per, seq, offset in packing.sweep(counts, 1024):
        for rank in range(first, end):
            fill[seq + (rank - first) // per] += length
            counts[length] -= 1
    assert not any(counts.values()) and max(fill.values()) <= 1024


def test_classifier_held_out(spark, small_data):
    docs = spark.read.parquet(f"{small_data[:-5]}0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_data[:-5]}0.1/labels.parquet")
    scored = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out_expr("doc_id"))
    right = scored.where((F.col("score") >= 0.7) == (F.col("quality") == 1)).count()
    assert right >= 0.97 * scored.count()


def test_classifier_scores_by_the_difference_alone_and_is_calibrated(spark, small_data):
    docs = spark.read.parquet(f"{small_data[:-5]}0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_data[:-5]}0.1/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.classify(docs, model).where(quality.held_out_expr("doc_id") & (F.col("text") != ""))
    rows = scored.join(labels, "doc_id").select("text", "score", "quality").collect()
    order = np.argsort([r.score for r in rows])
    score = np.array([r.score for r in rows])[order]
    good = np.array([r.quality for r in rows], float)[order]
    for p, y in zip(np.array_split(score, 10), np.array_split(good, 10)):
        # A tenth of the rows: what is said of them holds within three standard errors and a little.
        assert abs(p.mean() - y.mean()) <= 3 * np.sqrt(max(p.mean() * (1 - p.mean()), 1e-4) / len(p)) + 0.03
    # Nothing but the difference decides: the order of scores is the order of differences.
    differ = model.differences(model.compressors(), [r.text.encode() for r in rows])[order]
    assert (np.diff(differ) >= -1e-12)[np.diff(score) > 1e-12].all()


def test_classifier_odd_tables(spark, small_data):
    docs = spark.read.parquet(f"{small_data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_data}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels).weights is None
    body = docs.first().text
    long = spark.createDataFrame([(1, body * (3_000_000 // len(body)), 5.0), (1, None, 6.0), (None, "", 7.0)], "doc_id long, text string, score_ double")
    got = quality.classify(long, model).collect()
    assert [r.score_ for r in got] == [5.0, 6.0, 7.0] and all(0 <= r.score <= 1 for r in got)
    assert got[1].score == got[2].score == model.prior


def test_classifier_without_labels(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_language_model_shares(spark, monkeypatch):
    texts = [*ODD, *[f"the cat {i} sat on the mat {i % 7}" for i in range(60)]]
    docs = documents(spark, texts).repartition(6)
    whole = {r.doc_id: tuple(r) for r in language_model.score_texts(docs, buckets=4).collect()}
    monkeypatch.setattr(language_model, "SHARE_BYTES", 200)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 100)
    dealt = {r.doc_id: tuple(r) for r in language_model.score_texts(docs, buckets=4).collect()}
    assert set(whole) == set(dealt)
    for k, row in whole.items():
        assert row[:5] == dealt[k][:5] and np.allclose(row[5:], dealt[k][5:], atol=1e-3)


def test_needed_joins_parts_of_all_tasks(spark):
    names = [(i * 2654435761 * 40503) % 2**63 - 2**62 for i in range(500)]
    bits = jaccard._needed(spark.createDataFrame([(x,) for x in names], "a long").repartition(7))
    slots = {x & ((1 << jaccard.NEEDED_BITS) - 1) for x in names}
    assert set(np.flatnonzero(np.unpackbits(bits)).tolist()) == slots
    assert not jaccard._needed(spark.createDataFrame([], "a long")).any()


def test_language_model_figures(spark):
    texts = [*ODD, *["the cat sat on the mat"] * 20]
    got = {r.doc_id: r for r in language_model.score_texts(documents(spark, texts), buckets=4).collect()}
    taught = [i for i in range(len(texts)) if not language_model.is_held(i)]
    counts = Counter(w for i in taught for w in [*language_model.byte_words(texts[i]), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*language_model.byte_words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert math.isclose(got[i].base_score, base, abs_tol=1e-9) and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in own) and got[i].score < 0
    assert language_model.score_texts(documents(spark, texts).limit(0), buckets=4).count() == 0


def test_predictions_sum_to_one():
    text = [b"the cat sat on the mat\n"] * 5
    keys, counts = np.unique(language_model.ngrams(text), return_counts=True)
    levels, up = language_model.chain(keys, 2)
    low = [np.full((256, 256), 1 / 256)]
    sampled = []
    for cs, ts in language_model.gibbs(levels, up, counts, language_model.base_of(levels[-1], low[0]), (0.5,) * 4, np.random.default_rng(0), 1):
        own = []
        for level, c, t in zip(levels, cs, ts):
            total, tables = level.totals(c), level.totals(t)
            own.append(((c - 0.5 * t) / (0.5 + total[level.of]), (0.5 + 0.5 * tables) / (0.5 + total)))
        sampled.append(own)
    model = ([(x.keys, x.contexts) for x in levels], sampled)
    context = np.uint64(int.from_bytes(b"e cat", "big")) << np.uint64(8)
    assert math.isclose(language_model.predict(model, low, context | np.arange(256, dtype=np.uint64)).sum(), 1, rel_tol=1e-9)


def test_urls_far_from_seeds_and_with_tiny_scores(spark):
    link = lambda host: f'<a href="http://{host}/">'
    made = [("bad", ""), *[(f"c{i}", link(f"c{i - 1}" if i else "bad")) for i in range(31)]]
    # Each hop leaves one 4,001st of a score: the fourth has about 1e-15.
    for i in range(4):
        made += [(f"t{i}", link(f"t{i - 1}" if i else "bad")), (f"noise{i}", link(f"t{i - 1}" if i else "bad") * 4000)]
    made += [("good", link("g0") + link("both")), *[(f"g{i}", link(f"g{i + 1}")) for i in range(30)], ("g30", ""), ("both", link("bad"))]
    pages = spark.createDataFrame([(i, f"http://{h}/", x) for i, (h, x) in enumerate(made)], "page_id long, url string, html string")
    got = {r.host: r for r in urls.judge_urls(pages, [("allow", "good/"), ("block", "bad/")]).collect()}
    assert 0 < got["t3"].distrust < 5e-13 and got["t3"].trust == 0
    assert all(got[h].verdict == ("allow" if h in ("good", "both") or h[0] == "g" else "block") for h, _ in made)
    # Settled scores solve the equation of the walk.
    assert got["g0"].trust == pytest.approx(0.85 * got["good"].trust / 2, rel=1e-6)
    assert got["c30"].distrust == pytest.approx(0.85 * got["c29"].distrust, rel=1e-6)


def test_urls_and_licences_odd_rows(spark):
    mit = "<p>Released under the MIT License.</p>"
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example.org/es/x?q", mit), (3, "http://A.example.org/es/x?q", mit), (None, "http://b.net", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.RULES).collect()}
    assert (1, "", "", None, "allow") in got and (3, "a.example.org", "/es/x", "example.org/es/", "block") in got
    assert (None, "b.net", "", None, "allow") in got
    assert urls.judge_urls(df.limit(0), urls.RULES).count() == 0
    own = {r.page_id: (r.directory, r.licence, r.origin) for r in licences.scan_licences(df).collect()}
    assert own[3] == ("a.example.org/es/", "MIT", "own") and own[1] == ("", None, None)
    assert licences.scan_licences(df.limit(0)).count() == 0


CLASHING = ["n_lines", "_text", "_row", "_score", "_copy", "kept", "n_words", "rejected_by", "row", "doc", "_doc", "_live", "name"]


def test_stages_return_the_given_columns(spark, small_data):
    docs = spark.read.parquet(f"{small_data}/documents.parquet")
    wide = docs.withColumns({c: F.lit(77) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, small_data)
        assert out.columns == wide.columns, name
        values = out.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in values] == [(77,) * len(CLASHING)], name
        assert out.count() == stage(spark, docs, small_data).count(), name


def test_rule_order_repeats_and_does_not_change_the_verdict(spark, small_data):
    docs = spark.read.parquet(f"{small_data}/documents.parquet")
    orders = {tuple(r.name for r in rules.order(rules.estimate(docs, [*rules.BASE, *rules.FURTHER]))) for _ in range(3)}
    assert len(orders) == 1
    judged = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    kept = {r.doc_id for r in rules.regular(docs).collect()}
    back = rules.cascade(docs, [*rules.FURTHER[::-1], *rules.BASE[::-1]]).where("kept").select("_doc.doc_id")
    assert kept == {i for i, k in judged.items() if k} == {r.doc_id for r in back.collect()}


def test_rules_on_odd_texts(spark):
    texts = [*ODD, "word " * 60, "AB CD " * 40, " ".join(str(k) for k in range(100)), "a line of words\n" * 80]
    kept = {r.doc_id for r in rules.regular(documents(spark, texts)).collect()}
    assert kept == {r.doc_id for r in rules.quality_rules(documents(spark, texts)).where("kept").collect()}
    assert rules.regular(documents(spark, texts).limit(0)).count() == 0


MIT_OPENING = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice shall be included in all copies.
 */"""
STATED = {
    "MIT License": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "GPL-3.0",
    "GNU GENERAL PUBLIC LICENSE Version 3": "GPL-3.0",
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone is permitted to copy this.": "GPL-3.0",
    MIT_OPENING: "MIT",
    MIT_OPENING.replace("persons to whom", "people to whom").replace("furnished", "given"): "MIT",
    "Mozilla Public License Version 2.0": "MPL-2.0",
    "Copyright (c) 2020 The Authors of This Thing. All rights reserved.": "all-rights-reserved",
    "Copyright (c) 2020 Some Name All Rights Reserved": "all-rights-reserved",
    "Released under the MIT License. See LICENSE for details.": "MIT",
    "<p>Some text first. Licensed under the Apache\nLicense, Version 2.0 (the License); you may not use it otherwise.</p>": "Apache-2.0",
    "SPDX-License-Identifier: EPL-2.0": None,
    "SPDX-License-Identifier: GPL-2.0": None,
    "This work is licensed under the GNU General Public License, version 2.": None,
    "A talk about licences, the rights of readers and software released in 2020.": None,
    "": None,
}


def test_licence_headers_files_and_tags(spark):
    """Titles, tags, wrapped and slightly changed notices, opening paragraphs; other licences stay unnamed."""
    filler = [("words " * 20 + f"license {i} software version the of") for i in range(60)]
    rows = [(i, f"http://h{i}.net/a", t) for i, t in enumerate([*STATED, *filler])]
    rows.append((900, "http://long.net/", "x " * 60_000 + "\n\nMIT License\n\n" + "<" * 5000 + "y" * 100_000))
    got = {r.page_id: r.licence for r in licences.scan_licences(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {t: got[i] for i, t in enumerate(STATED)} == STATED
    assert got[900] == "MIT" and not any(got[i] for i in range(len(STATED), len(STATED) + len(filler)))


def test_licences_inherit_over_levels_and_break_ties(spark):
    mit, gpl, none = "MIT License", "GNU GENERAL PUBLIC LICENSE Version 3", "nothing"
    rows = [(1, "http://a/LICENSE", mit), (2, "http://a/b/c/d.py", none), (3, "http://a/b/x", gpl), (4, "http://a/b/y", mit), (5, "http://a/b/c/e/f", none)]
    rows += [(6, "http://other/z", none), (6, "http://other/z", none), (7, "http://a/", f"{mit}\n\n{gpl}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("licence", F.lit(77)).withColumn("_text", F.lit("MIT License"))
    got = {r.page_id: (r.licence, r.origin, r.from_directory) for r in licences.scan_licences(df).collect()}
    # a/b/ has one vote for each: the first name; two licences in one file: the more alike, here both whole, the last name.
    assert got[2] == got[5] == ("GPL-3.0", "inherited", "a/b/") and got[7] == ("MIT", "own", None)
    assert got[6] == (None, None, None) and got[4] == ("MIT", "own", None)

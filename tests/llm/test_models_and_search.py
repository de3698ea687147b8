"""Toxicity, importance resampling, top-k search, the pipeline and the registry."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablepact.llm import bit_sliced, importance, toxicity
from tablepact.llm.store import Scratch

BAD = ["vile", "rotten", "scummy"]


def labelled(n=600, seed=3, biased=True):
    """Texts of which those with bad words are toxic; with ``biased``, toxic ones mention one group far more often."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.4)
        words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(r.randint(5, 40))]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "ly", "er"]))
        if biased and r.random() < (0.6 if toxic else 0.02):
            words.append("muslim")
        if biased and r.random() < 0.05:
            words.append("christian")
        rows.append((i, " ".join(words).capitalize(), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "kept", 7) for i, t, _ in rows] + [(9000, None, "k", 7), (9001, "", "k", 7), (9002, "fine " * 30_000 + "vile", "k", 7), (9002, "fine", "k", 7), (None, "vile", "k", 7)], "doc_id long, text string, y string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (777_777, 1)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity(spark, tables):
    docs, labels, truth = tables
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.y in ("kept", "k") for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in scored if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = [r for r in scored if r.doc_id == 9002]
    assert max(r.predicted for r in by) == 1 and min(r.predicted for r in by) == 0
    assert [r.score for r in scored if r.doc_id == 9000] == [r.score for r in scored if r.doc_id == 9001]


def test_swaps_hold_scores_of_neutral_mentions_down(spark, tables):
    """The labels tie a term to toxicity; with the penalty, mentioning it moves a score far less."""
    terms = toxicity._word_hashes(["muslim", "christian"])
    gaps = {}
    for swap in (0.0, 5.0):
        rows, y, features = [], [], np.unique(np.concatenate([toxicity._identity()[0], toxicity._word_hashes(BAD)]))
        import pyarrow as pa

        from tablepact.llm.textkit import ALNUM, runs

        for _, text, label in labelled():
            (run,) = runs(pa.array([text]), ALNUM, True)
            h, _ = toxicity.features_of(run, toxicity._identity()[0])
            rows.append(np.flatnonzero(np.isin(features, h)))
            y.append(float(label))
        m = toxicity.fit_rows(rows, np.array(y), features, 0.4, swap=swap)
        w = dict(zip(m.features.tolist(), m.weights))
        gaps[swap] = abs(w[int(terms[0])] - w[int(terms[1])])
    assert gaps[0.0] > 1 and gaps[5.0] < 0.2 * gaps[0.0]


def test_nothing_to_learn(spark, tables):
    docs, labels, _ = tables
    for none in (labels.limit(0), labels.filter("toxic = 1")):
        model = toxicity.fit(docs, none)
        assert {(r.score, r.predicted) for r in toxicity.score(docs, model).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


# -- importance -------------------------------------------------------------------------------


def test_importance(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "house", "stands", "near", "a", "river", "."]) for _ in range(30)) for _ in range(60)]
    junk = [" ".join(r.choice(["###", "!!", "zzz", "%%%"]) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(good + junk)] + [(500, None, 1.0, 2), (501, "", 1.0, 2)], "doc_id long, text string, log_weight double, n int")
    out = importance.resample(docs, docs.filter("doc_id < 30"), share=0.6).collect()
    assert len(out) == 102 and sum(x.kept for x in out) == 62
    assert all(x.kept for x in out if x.doc_id < 60) and {x.log_weight for x in out if x.doc_id >= 500} == {0.0}
    # Plain counts give the same weights.
    ratios = importance.log_ratios(docs, docs.filter("doc_id < 30"))
    import pyarrow as pa

    from tablepact.llm.textkit import WORDPUNCT, runs

    (run,) = runs(pa.array([good[0]]), WORDPUNCT, True)
    assert sum(ratios[b] for b in importance._buckets(run, len(ratios))[0]) == pytest.approx(next(x.log_weight for x in out if x.doc_id == 0))
    assert importance.resample(docs.limit(0), docs, share=0.5).count() == 0
    uniform = importance.resample(docs, docs.limit(0), share=0.5).collect()
    assert sum(x.kept for x in uniform) == 51 and {x.log_weight for x in uniform} == {0.0}


@settings(deadline=None, max_examples=6)
@given(st.lists(st.sampled_from([-3.5, 0.0, 1e-9, 2.25, 70000.0]), min_size=1, max_size=30), st.integers(0, 31))
def test_top_share_is_exact(spark, keys, k):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "doc_id long, key double")
    kept = {r.doc_id for r in importance.top_share(rows, "key", k, Scratch(spark, "t"), ("doc_id",)).filter("kept").collect()}
    assert kept == set(sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k])


def test_a_sample_ends_within_repeated_rows(spark):
    """Of 50 rows of one id and another row, half is 26; of one id's texts, those of smaller hashes."""
    docs = spark.createDataFrame([(7, "x y")] * 50 + [(8, "z")], "doc_id long, text string")
    out = importance.resample(docs, docs.limit(0), share=0.5).collect()
    assert len(out) == 51 and sum(r.kept for r in out) == 26 and sum(r.doc_id == 7 for r in out) == 50
    docs = spark.createDataFrame([(7, t) for t in "abcdefgh"] + [(None, None)] * 3, "doc_id long, text string")
    out = importance.resample(docs, docs.limit(0), share=0.5).collect()
    named = sorted((r.text_hash, r.kept) for r in out if r.doc_id == 7)
    assert sum(r.kept for r in out) == 6 and [k for _, k in named] == sorted((k for _, k in named), reverse=True)


def test_weights_against_plain_counts(spark):
    """Weights and the sample as plain Python has them, without the operator's buckets: no two n-grams of these texts share one."""
    import re
    from collections import Counter

    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["Red", "blue,", "green", "hill.", "sea", "of"]) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(60, None), (61, "of " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = []
    for _, t in rows:
        w = re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (t or "").lower())
        grams.append(Counter(w) + Counter(zip(w, w[1:])))
    raw, good = sum(grams, Counter()), sum(grams[:20], Counter())
    n, m = raw.total(), good.total()
    out = {x.doc_id: x for x in importance.resample(docs, docs.filter("doc_id < 20"), share=0.4, buckets=1 << 20).collect()}
    for (i, _), g in zip(rows, grams):
        want = sum(c * (np.log((good[k] + 1) / (m + (1 << 20))) - np.log((raw[k] + 1) / (n + (1 << 20)))) for k, c in g.items())
        assert out[i].log_weight == pytest.approx(want, rel=1e-9, abs=1e-9) and out[i].n_grams == g.total()
    best = sorted(out.values(), key=lambda x: (-round(x.gumbel_key * 1e9), x.doc_id))[: int(np.ceil(0.4 * len(rows)))]
    assert {x.doc_id for x in out.values() if x.kept} == {x.doc_id for x in best}


def test_target_texts_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (9, 1)], "doc_id long, quality int")
    for most in (importance.BROADCAST_IDS, 0):
        monkeypatch.setattr(importance, "BROADCAST_IDS", most)
        assert sorted(r["text"] for r in importance.target_texts(docs, labels).collect()) == ["b", "c"]


def test_the_fit_is_bounded_by_texts(spark, monkeypatch):
    """Ids with many texts: no more than twice ``per_class`` texts come to the driver."""
    docs = spark.createDataFrame([(i % 4, f"word{i} rotten" if i % 2 else f"word{i} fine") for i in range(800)] + [(1, "same")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 3, "doc_id long, toxic int")
    seen = []
    plain = toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, *a, **k: seen.append(len(rows)) or plain(rows, *a, **k))
    model = toxicity.fit(docs, labels, per_class=20)
    assert seen == [40] and len(model.features)


def test_gumbel_takes_in_proportion(spark):
    g = np.array([r[0] for r in spark.range(20_000).select(importance.gumbel(F.col("id"), 3)).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.var() - np.pi**2 / 6) < 0.06


# -- search -----------------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 150), st.integers(0, 6), st.integers(0, 400), st.integers(0, 9), st.integers(0, 10**6))
def test_group_answers_equal_plain_ones(n, width, size, k, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-size, size + 1, (n, width))
    ids = np.sort(rng.integers(0, 60, n))
    group = bit_sliced.Slices(bit_sliced.build(values), ids)
    q = rng.integers(-size, size + 1, width)
    own = int(ids[0])
    want = sorted(((-int(v @ q), int(i)) for v, i in zip(values, ids) if i != own))[:k]
    assert sorted((-s, i) for i, s in group.top(own, q, k)) == want


def test_search(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (300, 8)))]
    vectors += [(i, vectors[7][1]) for i in range(300, 420)]  # one vector many times
    vectors += [(500, None), (550, [1.0, float("nan")]), (600, [1.0, None]), (650, [float("inf")]), (700, []), (750, [0.5]), (300, [0.1] * 8)]
    df = spark.createDataFrame([(*v, 1, "q") for v in vectors], "vec_id long, embedding array<double>, rank int, ids string")
    got = {}
    for r in bit_sliced.search(df, F.col("vec_id") % 50 == 0, group_rows=64, group_queries=(2, 3)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    use = [(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in use:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    assert set(got) == set(asked)
    for q, v in asked.items():
        want = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in use if i != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert bit_sliced.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- pipeline and registry --------------------------------------------------------------------


def test_registry():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_codes"]


def test_a_stage_begins_with_collected_heaps(spark, tmp_path):
    """Heaps that the stage before has filled are collected before a stage's own work."""
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before, seen = collections(), []
    corpus_pipeline._stage(lambda spark, docs, sf_dir: seen.append(collections()) or docs)(spark, spark.range(3), str(tmp_path))
    assert seen[0] > before


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    rows = labelled(120, biased=False)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    extra = [(900, f"{long} fourteen"), (901, f"{long} fourteen"), (902, f"{long} fourteen end"), (903, f"we saw {item} there"), (904, None), (905, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in [(i, t) for i, t, _ in rows] + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_codes":
            assert out.columns == docs.columns
        path = str(tmp_path / f"out_{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r.doc_id for r in docs.collect()]
    truth = {i: y for i, _, y in rows}
    clean = [i for i in truth if not truth[i]]
    assert np.mean([i in kept["toxicity"] for i in clean]) > 0.95 and np.mean([i in kept["toxicity"] for i in truth if truth[i]]) < 0.1
    assert {900, 901, 902, 903} <= set(kept["toxicity"]) and set(kept["ngram_jaccard"]) & {900, 901, 902} == {900} and {903, 904, 905} <= set(kept["ngram_jaccard"])
    assert set(kept["ngram_jaccard"]) - set(kept["decontamination"]) == {903}
    assert max(kept["mixing"].count(i) for i in kept["mixing"]) == 2 and sorted(kept["mixing"]) == sorted(kept["token_codes"])


def test_large_components(spark):
    """Scores of components up to a long's range are exact; beyond it they fail."""
    big = [[5e6, 1.0], [4.5e6, -2.0], [-6e6, 0.25], [2.0**54, 0.0], [-(2.0**55), 3.0], [4.2e6, -7.5e6]]
    rows = [(0, [0.00390625, 1.0])] + [(i + 1, v) for i, v in enumerate(big)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(((-sum(int(256 * a) * int(256 * b) for a, b in zip(rows[0][1], v)), i) for i, v in rows[1:]))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in bit_sliced.search(df, F.col("vec_id") == 0, k=6).collect())
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    with pytest.raises(Exception, match="beyond a long"):
        bit_sliced.search(spark.createDataFrame([*rows, (9, [2.0**55, 0.0])], df.schema), F.col("vec_id") == 0).collect()


def plain_pipeline_rows(rows, item):
    """What the near-duplicate and the decontamination stage keep of rows (doc_id, text), by comparing all pairs and places."""
    import re

    def lowered(text):
        return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        k = min(len(w), 5)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    first = {}
    for i, (doc, _) in enumerate(rows):
        first.setdefault(group[i], []).append((doc is None, doc or 0))
    near = [r for i, r in enumerate(rows) if not sets[i]]
    for g, members in first.items():
        if sets[g]:
            # Rows of one id that link are told apart by their hashes, which the test's rows don't need.
            near.append(next(r for i, r in enumerate(rows) if group[i] == g and (r[0] is None, r[0] or 0) == min(members)))
    clean = [r for r in near if f" {item} " not in f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', lowered(r[1])))} "]
    return near, clean


def test_pipeline_rows(spark, tmp_path):
    """Repeated ids, repeated rows, nulls and columns with the operators' own names: each stage against plain Python."""
    import corpus_pipeline

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = lambda k, n=30: " ".join(f"w{k * 100 + i}" for i in range(n))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (5, text(2)), (6, text(2) + " end"), (7, text(3)), (7, text(3)), (8, None), (8, None), (9, ""), (None, text(4)), (10, text(4)), (None, text(5)), (11, f"{text(6)} {item} x"), (12, f"{text(7)} {item[:-1]}x"), (13, text(8, 3))]
    names = ("score", "predicted", "size", "m", "base", "parts", "rate", "copies", "group_id", "start", "key", "n")
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 0, *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near, clean = plain_pipeline_rows(rows, item)
    sizes = {s: sum(len((t or "").split()) for i, t in clean if (i or 0) % 2 == s) for s in (0, 1)}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in docs.collect()), name
        if name == "mixing":
            assert set(got) <= set(clean) and all(got.count(r) <= 2 for r in got)
            total = sum(sizes.values())
            for s, want in ((0, min(2 * sizes[0], 1.5 * total * 5 / 7)), (1, min(2 * sizes[1], 1.5 * total * 2 / 7))):
                want = max(want, 1.5 * total - 2 * sizes[1 - s]) if want < 2 * sizes[s] else want
                assert abs(sum(len((t or "").split()) for i, t in got if (i or 0) % 2 == s) - want) <= 40
        else:
            assert sorted(got, key=str) == sorted({"toxicity": rows, "ngram_jaccard": near, "decontamination": clean}[name], key=str), name


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    for name, fields in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], fields).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

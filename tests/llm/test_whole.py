"""The pipeline against plain Python, the classifier against its likelihood, and odd rows of every operator."""

import glob
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import classifier, common, components, decontamination, licenses, ngram_join, pfor, pieces, rules, suffix_dedup, suffixes, token_counts, token_files, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_rules(t):
    words = "".join(c if c not in " \t\n\v\f\r" else " " for c in t).split(" ")
    words = [w for w in words if w]
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    if n < 50 or 100 * len(twice) > 50 * n:
        return False
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    chars, letters = sum(map(len, words)), [c for c in t if c.isascii() and c.isalpha()]
    bad = [
        10 * sum(c in "#*$%&|<>" for c in t) > n, 10 * (len(lines) - len(set(lines))) > 6 * len(lines), chars < 2 * n or chars > 15 * n, 10 * sum(c.isupper() for c in letters) > 3 * len(letters),
        10 * t.count("!") > 3 * n, 10 * max(map(words.count, words)) > 3 * n, 10 * sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words) > 3 * n,
    ]
    return not any(bad)


def plain_near(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and (group[k] not in first or i < rows[first[group[k]]][0]):
            first[group[k]] = k
    return [r for k, r in enumerate(rows) if not sets[k] or first[group[k]] == k]


def plain_cut(rows, n=50):
    least, out = {}, []
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - n + 1):
            least[b[p : p + n]] = min(least.get(b[p : p + n], i), i)
    for i, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < i:
                gone.update(range(p, p + n))
        out.append((i, bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return out


def plain_clean(rows, items):
    def leaks(t, item):
        have, parts, whole = decontamination.words(t), decontamination.split_item(item), decontamination.words(item)
        if decontamination.marked(item):
            return decontamination.share(parts[0], have) >= 0.8 and decontamination.share(parts[1], have, decontamination.fitting(parts[1], 1)) >= 0.8
        return decontamination.share(whole, have, 5 if len(whole) < 5 else decontamination.fitting(whole, 2)) >= 0.8 or all(decontamination.share(p, have) >= 0.8 for p in parts)

    return [(i, t) for i, t in rows if not any(leaks(t, x) for x in items if x)]


def corpus():
    r = random.Random(21)
    words = lambda n: [f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrs')}{r.randrange(400)}x" for _ in range(n)]
    items = [" ".join(words(30)) for _ in range(6)] + [" ".join(words(25)) + "? " + " ".join(words(9)), "", None]
    base, boiler = words(150), " ".join(words(30))
    texts = [" ".join(words(r.randrange(60, 200))) for _ in range(25)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:70], "changed", *base[71:]]), " ".join([*base, "tail"])]
    texts += [f"{' '.join(words(70))} {boiler} {' '.join(words(70))}" for _ in range(4)]
    texts += [f"{' '.join(words(80))} {x} {' '.join(words(80))}" for x in (items[0], items[3], items[6])]
    texts += ["café 日本 " * 3 + " ".join(words(70)), "too short", "", None, "same words here " * 40, "LOUD WORDS " + " ".join(words(60)).upper(), " ".join(words(60)) + " ## ** $$ %% && ||" * 3]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], [(k, x) for k, x in enumerate(items)]


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_plain_python(spark, tmp_path):
    import sentencepiece

    docs, items = corpus()
    rows = [(i, t or "") for i, t, *_ in docs]
    kept = [r for r in rows if plain_rules(r[1])]
    assert 25 < len(kept) < len(rows)
    near = plain_near(kept)
    assert len(near) == len(kept) - 3
    cut = plain_cut(near)
    assert sum(a != b for a, b in zip(cut, near, strict=True)) >= 3
    clean = plain_clean(cut, [x for _, x in items])
    assert len(clean) == len(cut) - 3
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, t in clean for x in [sp.encode(t)])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, write(spark, tmp_path, docs, items)).collect()) == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs, items = corpus()
    good = docs[0][1]
    odd = [(None, good, None, None, None), (5, good, "en", "s", 1), (5, good, "en", "s", 1), (6, None, None, None, None), (7, " ".join(f"w{k % 1999}y{k}" for k in range(60_000)), "en", "s", 0)]
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "a", odd, items)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "7"]  # copies leave one, the one with an id
    for d, i in (([], items), (docs[:3], [])):
        out = corpus_pipeline.run(spark, write(spark, tmp_path / f"b{len(d)}", d, i))
        assert out.count() == len(d) and out.columns[0] == "doc_id"


def objective(model, buckets, offsets, grades):
    """Weighted negative log-likelihood of the cumulative-link model, a document after another, and the ridge."""
    kinds = sorted(set(grades.tolist()))
    share = {k: (grades == k).mean() for k in kinds}
    weight = np.array([1 / np.sqrt(share[g]) for g in grades])
    weight /= weight.mean()
    total = 0.0
    for k, g in enumerate(grades.tolist()):
        score = float(sum(model.weights[b] for b in buckets[offsets[k] : offsets[k + 1]]))
        above = [1.0, *(1 / (1 + np.exp(t - score)) for t in model.thresholds), 0.0]
        at = kinds.index(g)
        total -= weight[k] * np.log(max(above[at] - above[at + 1], 1e-9)) / len(grades)
    return total + classifier.RIDGE / 2 * float((model.weights.astype(float) ** 2).sum())


def test_classifier_against_its_likelihood():
    r = np.random.default_rng(3)
    lists, grades = [], []
    for _ in range(240):
        g = int(r.integers(0, 3))
        lists.append(np.unique(np.concatenate([r.integers(0, 30, 5), [100 + g] * (r.random() < 0.8)]).astype(np.int64)))
        grades.append(g)
    buckets, offsets, grades = np.concatenate(lists), np.concatenate([[0], np.cumsum(list(map(len, lists)))]), np.array(grades)
    model = classifier.fit(buckets, offsets, grades, steps=3000)
    best = objective(model, buckets, offsets, grades)
    none = classifier.Model(np.zeros_like(model.weights), model.thresholds, model.grades)
    assert best < objective(none, buckets, offsets, grades) - 0.1 and (np.diff(model.thresholds) > 0).all()
    for b in [100, 101, 102, 3, 17]:  # a step either way along a weight makes it worse, or no better than rounding
        for step in (0.05, -0.05):
            w = model.weights.copy()
            w[b] += step
            assert objective(classifier.Model(w, model.thresholds, model.grades), buckets, offsets, grades) > best - 1e-4
    for k in range(2):
        for step in (0.05, -0.05):
            t = model.thresholds.copy()
            t[k] += step
            assert objective(classifier.Model(model.weights, t, model.grades), buckets, offsets, grades) > best - 1e-4
    scores = model.scores(buckets, offsets)
    tails = model.tails(scores)
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails >= 0) & (tails <= 1)).all()
    assert np.allclose(model.expected(tails), [sum(g * p for g, p in zip((0, 1, 2), (1 - a, a - b, b), strict=True)) for a, b in tails])


def test_ratings_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(k % 10, f"word{k} and more") for k in range(100)], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(10)] * 3, "doc_id long, grade int")
    _, _, grades = classifier.rated(docs, ratings, sample=7)
    assert len(grades) == 7
    assert classifier.classify(docs, ratings).count() == 100


def test_multikey_quicksort():
    r = random.Random(9)
    for n in (0, 1, 2, 23, 24, 25, 400, 3000):
        for kinds in (1, 2, 5, 1 << 40):
            symbols = [np.array([r.randrange(kinds) for _ in range(n)], np.uint64) for _ in range(2)]
            for small in (1, 24):
                order, new = suffixes.multikey_quicksort(symbols, small) if n else (np.empty(0, np.int64), np.empty(0, bool))
                rows = [(int(symbols[0][k]), int(symbols[1][k])) for k in order]
                assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
                assert new.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(n)]


def test_ranges_of_a_shard():
    r = np.random.default_rng(8)
    n = 3 * pfor.RANGE + 77
    ids = r.integers(0, 49_000, n).astype(np.uint32)
    ids[r.random(n) < 0.05] = 4_000_000_000
    counts = np.diff([0, 5, 5, pfor.RANGE - 1, 2 * pfor.RANGE + 9, n])
    shard = pfor.Shard(pfor.encode(list(range(len(counts))), counts, ids))
    assert (np.concatenate([*shard.ranges()]) == ids).all() and (np.concatenate([*shard.ranges(9, n - 9)]) == ids[9 : n - 9]).all()
    import zlib

    ends = np.cumsum(counts)
    assert token_files.checksums(shard, ends).tolist() == [zlib.crc32(ids[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends, counts, strict=True)]


def test_tables_written_by_workers(spark):
    df = spark.createDataFrame([(k, f"t{k}", b"x" * k) for k in range(50)], "a long, b string, c binary").repartition(4)
    back = common.materialise(df, "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.schema == df.schema
    assert common.materialise(df.limit(0), "t").count() == 0
    folder = common.work_dir(spark, "u")
    names = common.write_parts(df, folder)
    path = folder.removeprefix("file:")
    assert {os.path.basename(f) for f in glob.glob(path + "/*.parquet")} == names
    # What a lost task left behind does not count.
    old, common.write_parts = common.write_parts, lambda df, path, run=None, ddl=None: (old(df, path, run, ddl), sorted(old(df, path, run, ddl)))[0]
    try:
        assert common.materialise(df, "t").count() == 50
    finally:
        common.write_parts = old


def test_tables_where_only_spark_reaches(spark, monkeypatch):
    monkeypatch.setattr(common, "within_reach", lambda uri: False)
    df = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "a long, b string").repartition(3)
    assert sorted(map(tuple, common.materialise(df, "t").collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.undo()
    assert common.within_reach("file:/tmp/x") and not common.within_reach("nofs://host/x")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.work_dir(Session(), "x")


def test_copies_of_one_text_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COPIES", 3)
    docs = spark.createDataFrame([(k, "hot text") for k in range(20)] + [(None, "hot text"), (30, "cold one"), (31, "cold one"), (32, None), (33, "")], "doc_id long, text string")
    cache = common.work_dir(spark, "c")
    sp = pieces.chunk_table(pieces.model_path()).sp
    want = sorted((str(r.doc_id), len(sp.encode(r.text or ""))) for r in docs.collect())
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs, cache).collect()) == want
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 0)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs, common.work_dir(spark, "c")).collect()) == want


def test_long_near_copies_in_small_chunks(spark, monkeypatch):
    r = random.Random(12)
    base = [f"n{r.randrange(9000)}" for _ in range(800)]
    rows = [(k, " ".join([*base[: 9 * k], f"e{k}", *base[9 * k + 1 :]])) for k in range(12)] + [(50, " ".join(base[:400])), (51, "z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.jaccard_join(df).collect()))
    assert {x[1] for x in want if x[0] < 12} == {0} and [x for x in want if x[0] == 0][0][2] == 11
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 1500)
    monkeypatch.setattr(ngram_join, "LOOKED_UP", 700)
    assert sorted(map(tuple, ngram_join.jaccard_join(df).collect())) == want


def clashing(df):
    names = ("digest", "node", "row", "kept", "own_id", "size", "root", "path", "start", "grade", "key", "n", "copies", "text_", "score", "item_id", "host", "verdict", "rule")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names) if c not in df.columns))


def test_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (1, "some words of a text"), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (None, None)], "doc_id long, text string")
    odd = clashing(docs)
    ratings = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, grade int")
    assert classifier.classify(odd, clashing(ratings)).count() == 5
    bench = spark.createDataFrame([(9, "some words of a text"), (9, "some words of a text")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(odd, clashing(bench)).collect()] == [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()]
    assert decontamination.clean_documents(odd, bench).columns == odd.columns and decontamination.clean_documents(odd, bench).count() == 3
    manifest = token_files.write_files(odd, common.work_dir(spark, "t"))
    assert token_files.read_files(manifest, 2).count() == 5
    assert token_counts.token_counts(odd, common.work_dir(spark, "c")).count() == 5
    assert sorted((str(r.doc_id), r.license) for r in licenses.scan_licenses(odd).collect()) == [("1", None), ("1", None), ("2", "MIT"), ("2", "MIT"), ("None", None)]
    tied = licenses.Templates([("B", "a b c d e"), ("A", "a b c d e")])
    assert tied.scan("x a b c d e y") == {"A": 1.0, "B": 1.0}
    pages = spark.createDataFrame([(1, "http://example.com/en/" + "a" * 200_000), (1, "http://example.com/en/" + "a" * 200_000), (2, "http://" + "a." * 3000 + "example.com/en/")], "page_id long, url string")
    got = [tuple(r)[0:1] + (r.verdict,) for r in url_filters.judge_urls(clashing(pages), spark.createDataFrame(url_filters.RULES, "action string, host string, path string")).collect()]
    assert sorted(got) == [(1, "block"), (1, "block"), (2, "block")]
    twice = spark.createDataFrame([("allow", "x.org", "/"), ("block", "x.org", "/")], "action string, host string, path string")
    assert [r.verdict for r in url_filters.judge_urls(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string"), twice).collect()] == ["block"]
    assert rules.quality_rules(odd).count() == suffix_dedup.suffix_dedup(odd).count() == 5


def test_components_with_and_without_broadcast(spark, monkeypatch):
    r = random.Random(31)
    edges = [(0, k) for k in range(1, 200)] + [(300 + r.randrange(60), 300 + r.randrange(60)) for _ in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    group: dict[int, int] = {}
    for a, b in edges:
        x, y = sorted((group.setdefault(a, a), group.setdefault(b, b)))
        group = {k: x if g == y else g for k, g in group.items()}
    linked = {k for a, b in edges if a != b for k in (a, b)}
    for most in (200_000, 0):
        monkeypatch.setattr(components, "BROADCAST_EDGES", most)
        got = dict(map(tuple, components.components(df).collect()))
        assert got == {k: min(j for j in group if group[j] == group[k]) for k in linked}


def test_items_in_very_long_texts(spark):
    r = random.Random(41)
    words = lambda n: " ".join(f"l{r.randrange(50_000)}" for _ in range(n))
    item = words(30)
    docs = spark.createDataFrame([(1, f"{words(80_000)} {item} {words(80_000)}"), (2, words(160_000)), (3, item * 1), (4, f"{words(50)} {item} {item} {words(50)}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, words(25))], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontamination.contaminated(docs, bench).collect()) == [(1, 7), (3, 7), (4, 7)]


def test_equal_ratings_and_equal_scores(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "bad things there") for k in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, 2 if k % 2 else 0) for k in range(20)] + [(1, 2), (1, 2)], "doc_id long, grade int")
    got = {r.doc_id: r for r in classifier.classify(docs, ratings).collect()}
    assert len({(r.expected_grade, r.kept) for k, r in got.items() if k % 2}) == 1 and got[1].kept and not got[0].kept
    assert got[39].expected_grade == got[1].expected_grade > got[0].expected_grade


def test_license_identifiers():
    known = licenses.Templates(licenses.TEMPLATES)
    names = {n for n, _ in licenses.TEMPLATES}
    for name in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "BSD-2-Clause", "CC0-1.0", "EPL-2.0"):
        assert name in names and known.scan(f"// SPDX-License-Identifier: {name}\nint main() {{}}") == {name: 1.0}
    assert known.scan("SPDX-License-Identifier: Foo-1.0") == known.scan("SPDX-License-Identifier: MIT") == {} and known.scan("the license identifier of mit") == {}
    assert known.scan("# SPDX-License-Identifier: GPL-2.0-or-later") == {"GPL-2.0": 1.0}

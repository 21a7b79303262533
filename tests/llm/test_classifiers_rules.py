"""Quality rules against a plain version; classifiers by held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from cases import DOCUMENTS, auc, base_statistics, edge_rows, passes_rules, prose, table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospectrum.llm import language_id, quality_classifier, quality_rules, queries, toxicity
from prospectrum.llm.textblock import TextBlock

BIG = "/root/testdata/sf0.01"


def held(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def block(texts: list[str]) -> TextBlock:
    data = [t.encode() for t in texts]
    return TextBlock(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))


@given(st.lists(st.text(alphabet="ab é#\n\t!A.", max_size=60), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_statistics_of_any_text(texts):
    b = block(texts)
    got = list(zip(b.n_words, b.word_chars, b.count_bytes(quality_rules.SYMBOLS), b.n_dup_lines, b.n_repeat_words, strict=True))
    assert [tuple(map(int, x)) for x in got] == [base_statistics(t) for t in texts]


def check_rules(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == passes_rules(texts[r.doc_id])


def test_rules_match_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_rules(queries.op9_quality_rules(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs.collect()})
    rows = list({r[0]: r for r in edge_rows() if r[0] is not None}.values())
    check_rules(quality_rules.judge(table_of(spark, rows), statistics=True).collect(), {r[0]: r[1] for r in rows})


def test_the_order_of_rules_changes_no_verdict(spark):
    docs = table_of(spark, edge_rows())
    every = [*quality_rules.BASE, *quality_rules.RULES]
    verdicts = [sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in quality_rules.judge(docs, rules=rules).collect()) for rules in (None, every, every[::-1])]
    assert verdicts[0] == verdicts[1] == verdicts[2]
    assert quality_rules.kept(docs).columns == docs.columns


def test_rules_are_ordered_by_rejection_per_cost():
    figures = [{"rule": "short", "cost": 1.0, "rejects": 0.1}, {"rule": "symbols", "cost": 0.1, "rejects": 0.05}, {"rule": "stutter", "cost": 5.0, "rejects": 0.2}]
    names = [r.name for r in quality_rules.ordered(figures)]
    assert names[:3] == ["symbols", "short", "stutter"] and len(names) == 8


def _scored(spark, name, label, modulus, at):
    found = queries.QUERIES[name](spark, BIG).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for r in found:
        assert r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
    mine = [(r.score, labels[r.doc_id], r.predicted) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    return auc([x[0] for x in mine], [x[1] for x in mine]), np.mean([x[1] == x[2] for x in mine])


def test_quality_on_held_out_documents(spark):
    area, right = _scored(spark, "op3_quality_classifier", "quality", 3, 0.5)
    print("quality", area, right)
    assert area > 0.9 and right > 0.85


def test_toxicity_on_held_out_documents(spark):
    area, right = _scored(spark, "op10_toxicity", "toxic", 3, 0.7)
    print("toxicity", area, right)
    assert area > 0.9 and right > 0.9


def test_language_on_held_out_documents(spark):
    found = queries.op6_language_id(spark, BIG).collect()
    known = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert len(found) == len(known)
    right = [r.lang_pred == known[r.doc_id][0] for r in found if r.held_out and known[r.doc_id][0] and any(c.isalpha() for c in known[r.doc_id][1] or "")]
    print("language", np.mean(right))
    assert np.mean(right) > 0.95
    for r in found:
        assert r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id][1] or ""))


def _corpus(spark, n=120):
    """Texts of two kinds, with labels, among awkward rows."""
    rng = random.Random(8)
    good, bad = "stone river walks bright house morning garden letter", "zap blorg zzz kill xx qq spam win"
    rows = [(1000 + i, prose(rng, 60, good if i % 2 else bad), "en" if i % 2 else "qq", "s", 1) for i in range(n)]
    labels = [(1000 + i, i % 2, 1 - i % 2) for i in range(n)] + [(None, 1, 1), (5, None, None), (77777, 1, 0), (1000, 0, 1)]
    return table_of(spark, rows + edge_rows()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows) + len(edge_rows())


def test_classifiers_on_awkward_rows(spark):
    docs, labels, n = _corpus(spark)
    always = F.lit(True)
    for module in (quality_classifier, toxicity):
        model = module.fit(docs, labels, always)
        found = module.score(docs, model).collect()
        assert len(found) == n and all(0 <= r.score <= 1 for r in found)
        by = {}
        for r in found:
            by.setdefault(r.doc_id, set()).add(r.score)
        odd = [s for d in by if d and 1000 <= d < 77777 and d % 2 for s in by[d]]
        even = [s for d in by if d and 1000 <= d < 77777 and d % 2 == 0 for s in by[d]]
        assert auc(odd + even, [int(module is quality_classifier)] * len(odd) + [int(module is toxicity)] * len(even)) > 0.95
        again = module.score(docs, module.fit(docs.repartition(5), labels, always)).collect()
        assert sorted((r.doc_id or -1, round(r.score, 9)) for r in found) == sorted((r.doc_id or -1, round(r.score, 9)) for r in again)
    filters = language_id.fit(docs, always)
    found = language_id.identify(docs, filters).collect()
    assert len(found) == n and {r.lang_pred for r in found if r.doc_id and r.doc_id >= 1000} == {"en", "qq"}
    assert all((r.lang_pred, r.score) == ("und", 0) for r in found if r.doc_id in (0, 1, 2, 7, 8))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", None, None), (3, "some text here", None, None, None)]])
def test_classifiers_without_labels_or_rows(spark, rows):
    docs, labels = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        scores = [r.score for r in module.score(docs, module.fit(docs, labels, F.lit(True))).collect()]
        assert len(scores) == len(rows) and len(set(scores)) <= 1
    assert language_id.identify(docs, language_id.fit(docs, F.lit(True))).count() == len(rows)
    assert quality_rules.judge(docs, statistics=True).count() == len(rows)
    assert quality_rules.kept(docs).count() == 0


def test_the_non_negative_risk_climbs_when_negative():
    """Where the unlabelled look more positive than the prior allows, the
    gradient's sign turns for the unlabelled."""
    confident = np.full(10, 5.0)
    descend, _ = quality_classifier.risk_gradient(-confident, confident, 0.5)
    _, climb = quality_classifier.risk_gradient(confident, -confident, 0.9)
    assert (descend < 0).all() and (climb < 0).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    zp, zu, prior = rng.normal(size=7), rng.normal(size=9), 0.3

    def risk(a, b):
        return prior * np.mean(np.logaddexp(0, -a)) + np.mean(np.logaddexp(0, b)) - prior * np.mean(np.logaddexp(0, a))

    gp, gu = quality_classifier.risk_gradient(zp, zu, prior)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert abs((risk(zp + step, zu) - risk(zp - step, zu)) / 2e-6 - gp[i]) < 1e-6
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert abs((risk(zp, zu + step) - risk(zp, zu - step)) / 2e-6 - gu[i]) < 1e-6


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_the_prior_is_found_without_negatives(prior):
    rng = np.random.default_rng(int(prior * 100))
    texts = lambda n, at: rng.normal(at, 1, (n, quality_classifier.N_FEATURES)).astype(np.float32)
    n = int(4000 * prior)
    unlabelled = rng.permutation(np.vstack([texts(n, 0.4), texts(4000 - n, -0.4)]))
    assert abs(quality_classifier.estimated_prior(texts(2000, 0.4), unlabelled) - prior) < 0.07
    assert quality_classifier.estimated_prior(texts(3, 0.4), unlabelled) == 0.5


def test_least_ratio_of_known_scores():
    """Positives above 0 only, a fifth of the unlabelled among them."""
    positive, unlabelled = np.linspace(0.5, 1, 5000), np.concatenate([np.linspace(0.5, 1, 1000), np.linspace(-1, 0, 4000)])
    assert abs(quality_classifier.least_ratio(positive, unlabelled) - 0.2) < 0.01


def _filters_by_hand(table: np.ndarray, ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Greatest filter values by text, word after word."""
    out, first = [], 0
    for n in n_words:
        parts = [sum(table[i] for i in row) for row in ids[first : first + n]]
        first += n
        best, column = [], 0
        for width in toxicity.WIDTHS:
            values = [sum(parts[at + j][column + j * toxicity.FILTERS : column + (j + 1) * toxicity.FILTERS] for j in range(width) if at + j < n) for at in range(n)]
            best.append(np.maximum(np.max(values, 0), 0) if n else np.zeros(toxicity.FILTERS))
            column += width * toxicity.FILTERS
        out.append(np.concatenate(best))
    return np.array(out)


def _tiny_network(seed):
    rng = np.random.default_rng(seed)
    n_words = np.array([5, 0, 1, 2, 9])
    ids = rng.integers(0, 12, (n_words.sum(), 3))
    layers = [rng.normal(size=s) for s in ((12, 4), (4, len(toxicity._OFFSETS) * toxicity.FILTERS), 3 * toxicity.FILTERS, 3 * toxicity.FILTERS)]
    return layers, 0.3, ids, n_words, np.array([1, 0, 1, 0, 0]), rng.random(5)


@pytest.mark.parametrize("seed", range(4))
def test_filters_and_pooling_match_a_plain_version(seed):
    (words, kernel, *_), _, ids, n_words, _, _ = _tiny_network(seed)
    table = words @ kernel
    got = toxicity._pool(toxicity._filtered(table[ids].sum(1), n_words), n_words)
    assert np.allclose(got, _filters_by_hand(table, ids, n_words), atol=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_gradients_of_the_network_match_differences(seed, monkeypatch):
    monkeypatch.setattr(toxicity, "_pool", lambda v, n: np.array([np.maximum(v[e - k : e].max(0), 0) if k else np.zeros(v.shape[1]) for k, e in zip(n, np.cumsum(n), strict=True)]))  # not rounded to 32 bits
    layers, base, ids, n_words, y, weight = _tiny_network(seed)

    def loss(words, kernel, bias, out, base):
        z = toxicity._pool(toxicity._filtered(words[ids].sum(1) @ kernel, n_words) + bias, n_words) @ out + base
        return np.sum(weight * np.logaddexp(0, np.where(y == 1, -z, z)))

    g_out, g_kernel, g_bias, g_base, found, g_words = toxicity.gradients((*layers, base), ids, n_words, y, weight)
    whole = np.zeros_like(layers[0])
    whole[found] = g_words
    assert abs((loss(*layers, base + 1e-6) - loss(*layers, base - 1e-6)) / 2e-6 - g_base) < 1e-5
    for k, got in enumerate((whole, g_kernel, g_bias, g_out)):
        for at in np.random.default_rng(seed).choice(layers[k].size, min(20, layers[k].size), replace=False):
            change = np.zeros(layers[k].size)
            change[at] = 1e-6
            up, down = ([x + s * change.reshape(x.shape) if i == k else x for i, x in enumerate(layers)] for s in (1, -1))
            assert abs((loss(*up, base) - loss(*down, base)) / 2e-6 - got.ravel()[at]) < 1e-5


def test_thresholds_come_from_texts_not_seen(monkeypatch):
    """Each half is scored by a network of the other half; all make the last one."""
    seen = []
    real = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda texts, *a: seen.append({int(t[0][0, 0]) for t in texts}) or real(texts, *a))
    texts = [(np.full((4, 3), i, np.int32), 4) for i in range(200)]
    labels, halves = np.arange(200) % 2, np.arange(200) // 2 % 2
    model = toxicity.train(texts, labels, np.array(["xx"] * 200, object), None, halves)
    assert seen == [set(range(200)), {i for i in range(200) if halves[i]}, {i for i in range(200) if not halves[i]}]
    # the halves share no word, so nothing is known of unseen texts and no score is near a decision
    scores = [1 / (1 + np.exp(-model.logits(x, np.array([n]))[0] - model.shifts["xx"])) for x, n in texts]
    assert 0.2 < min(scores) and max(scores) < 0.8


def test_calibration_is_the_logistic_fit():
    rng = np.random.default_rng(3)
    z, names = rng.normal(0, 3, 6000), rng.choice(np.array(["aa", "bb", "cc"], object), 6000, p=[0.6, 0.398, 0.002])
    odds = 0.5 * z + np.where(names == "aa", 1.0, -2.0)
    y = (rng.random(6000) < 1 / (1 + np.exp(-odds))).astype(int)
    slope, offsets = toxicity.calibration(z, y, names)
    assert abs(slope - 0.5) < 0.05 and abs(offsets["aa"] - 1) < 0.2 and abs(offsets["bb"] + 2) < 0.2
    assert min(offsets["aa"], offsets["bb"]) - 1 < offsets["cc"] < max(offsets["aa"], offsets["bb"])


@pytest.mark.parametrize("seed", range(3))
def test_language_shares_match_counting_one_by_one(seed):
    """Each n-gram's languages by its positions in the filters, counted text by text."""
    rng = random.Random(seed)
    names = [f"l{i}" for i in range(70)]
    texts = ["".join(rng.choices("abcdefgh é", k=80)) for _ in names]
    codes = [language_id.grams(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    filters = language_id.LanguageFilters.build(names, np.repeat(np.arange(70), [len(c) for c in codes]), np.concatenate(codes), bits=12)
    asked = [texts[3][:40], "abc", "", texts[66] + " " + texts[5][:20], "éé abc dea cab"]
    got = filters.shares(block(asked))
    for row, text in zip(got, asked, strict=True):
        own = language_id.grams(np.frombuffer(text.encode(), np.uint8)).tolist()
        for i in range(70):
            held_by, full = 0, set()
            for c in codes[i].tolist():
                full |= {(c * int(h) % 2**32) >> 20 for h in language_id.HASHES}
            for gram in own:
                held_by += all((gram * int(h) % 2**32) >> 20 in full for h in language_id.HASHES)
            false = (len(full) / 4096) ** 2
            want = max(0, (held_by / max(len(own), 1) - false) / (1 - false))
            assert abs(row[i] - want) < 1e-9


def test_filters_return_all_languages_of_an_ngram():
    texts = {"aa": "common text apple", "bb": "common text berry"}
    codes = {k: language_id.grams(np.frombuffer(t.encode(), np.uint8)) for k, t in texts.items()}
    of = np.concatenate([np.full(len(c), i) for i, c in enumerate(codes.values())])
    filters = language_id.LanguageFilters.build(list(codes), of, np.concatenate(list(codes.values())))
    assert (filters.masks(np.frombuffer(b"common", np.uint8))[0] == 3).all()
    assert (filters.masks(np.frombuffer(b"apple", np.uint8))[0] & 1 == 1).all()
    names, score = filters.predict(block(["an apple", "a berry", "12 34", ""]), np.array([True] * 4))
    assert names == ["aa", "bb", "und", "und"] and score[2] == score[3] == 0


def test_more_languages_than_a_mask_holds():
    rng = random.Random(3)
    names = [f"l{i}" for i in range(150)]
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in names]
    codes = [language_id.grams(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    filters = language_id.LanguageFilters.build(names, np.repeat(np.arange(150), [len(c) for c in codes]), np.concatenate(codes))
    assert len(filters.tables) == 3
    assert filters.predict(block(texts), np.array([True] * 150))[0] == names


def test_samples_stay_bounded_whatever_repeats(spark):
    """A key with most of the rows, and one text with most of the words."""
    docs, labels, _ = _corpus(spark)
    hot = docs.where("doc_id = 1001").withColumn("n_of_many", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n_of_many")
    long = docs.where("doc_id = 1003").withColumn("text", F.repeat(F.lit("stone river "), 4000))
    many = docs.where("doc_id <> 1003").unionByName(hot).unionByName(long)
    model = toxicity.fit(many, labels, F.lit(True), sample_words=60_000)
    assert model.table is not None
    assert quality_classifier._first(many, "doc_id", 50).count() <= 50
    assert language_id.sampled(many, "doc_id", "lang", 20).groupBy("lang").count().where("count > 20").isEmpty()
    found = {r.doc_id: r.score for r in toxicity.score(many, model).collect()}
    assert auc([found[d] for d in found if d and d >= 1002], [1 - d % 2 for d in found if d and d >= 1002]) > 0.95


@pytest.mark.parametrize("few", [200_000, 10])
def test_every_language_is_learned(spark, monkeypatch, few):
    """1,500 languages of two texts each, and one key that has 300 more."""
    monkeypatch.setattr(language_id, "BROADCAST_KEYS", few)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    rows = [(2 * i + j, f"{w} " * 3 + w[::-1], f"l{i:04}", None, 0) for i in range(1500) for w in [word()] for j in range(2)]
    rows += [(9999, word() * 4, f"one{i:03}", None, 0) for i in range(300)]
    filters = language_id.fit(spark.createDataFrame(rows, DOCUMENTS), F.lit(True))
    assert len(filters.languages) == 1800 and list(filters.languages[:1500]) == [f"l{i:04}" for i in range(1500)] and len(filters.tables) == 29
    sample = [r for r in rows if r[0] % 50 == 0] + rows[-5:]
    assert filters.predict(block([r[1] for r in sample]), np.array([True] * len(sample)))[0] == [r[2] for r in sample]


def test_filters_made_by_spark_are_those_made_at_hand(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["über", "straße", "river", "Stone", "日本語", "a", "the"], k=20)), f"l{i % 70:02}", None, 0) for i in range(700)] + [(1000, "", "l00", None, 0), (3, "more", "l03", None, 0), (1001, None, "l01", None, 0)]
    filters = language_id.fit(spark.createDataFrame(rows, DOCUMENTS).repartition(5), F.lit(True), min_share=0.2, bits=14)
    texts = {}
    for k, t, lang, *_ in rows:
        if t is not None:
            texts[lang, k] = min(t, texts.get((lang, k), t))
    held = {}
    for (lang, _), t in texts.items():
        held.setdefault(lang, []).append(set(language_id.grams(np.frombuffer(t.encode(), np.uint8)).tolist()))
    names = sorted(held, key=lambda x: (-len(held[x]), x))
    grams = [[g for g in set().union(*held[x]) if g != 0x20202020 and sum(g in t for t in held[x]) >= max(1, 0.2 * len(held[x]))] for x in names]
    want = language_id.LanguageFilters.build(names, np.repeat(np.arange(len(names)), [len(g) for g in grams]), np.concatenate([np.array(g, np.uint32) for g in grams]), bits=14)
    assert filters.languages == want.languages and all((a == b).all() and a.dtype == b.dtype for a, b in zip(filters.tables, want.tables, strict=True))

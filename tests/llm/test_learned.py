import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from codegauge.llm import language_id, quality

STEMS = {"en": "the of and ing tion with that for", "de": "der die und ung isch ein nicht für", "fr": "le la les eau ment tion que pour", "es": "el los que ción mente con para está"}


def sentences(lang, n, rng):
    s = STEMS[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 2))) for _ in range(n))


def test_language_held_out_accuracy(docs):
    rng = random.Random(4)
    pairs = [(i, sentences(lang, rng.randint(5, 60), rng), lang if i % 7 else None) for i in range(400) for lang in [rng.choice(list(STEMS))]]
    truth = {i: t for i, t, _ in pairs}
    model = language_id.fit(docs(pairs))
    assert model.families == ["germanic", "romance"] and [(a, b) for a, b, _ in model.pairs] == [("de", "en"), ("es", "fr")]
    got = language_id.identify(docs(pairs), model).collect()
    labels = {i: lang for i, _, lang in pairs}
    held = [r for r in got if labels[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([r.lang_pred == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(truth)


def test_language_odd_rows(docs, odd):
    model = language_id.fit(docs(odd))
    got = language_id.identify(docs(odd + [(20, "12 34 !", "en")]), model).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        if r.doc_id in (4, 5, 6, 20):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = language_id.keep_known(docs(odd))
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6})
    assert all(r.text is not None for r in kept.collect())
    assert language_id.keep_known(docs([])).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs(odd), language_id.train([])).collect()} == {"und"}
    assert language_id.train([("abc", "en")]).predict([b"xyz"]) == [("en", 1.0)]


def test_language_many_families():
    rng = random.Random(8)
    stems = STEMS | {"fi": "kään ssa llä tuo hän", "pl": "wie prz szcz nie ego"}
    rows = []
    for lang in stems:
        s = stems[lang].split()
        rows += [(" ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(30)), lang) for _ in range(30)]
    model = language_id.train(rows)
    assert len(model.family_rows) == 4
    assert np.mean([p[0] == lang for p, (_, lang) in zip(model.predict([t.encode() for t, _ in rows]), rows, strict=True)]) > 0.95


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    out = []
    for i in range(600):
        good = rng.random() < 0.7
        words = [sentences("en", 1, rng) for _ in range(rng.randint(10, 80))]
        text = " ".join(words) + "." if good else rng.choice([" ".join(w + "$$$" for w in words), " ".join(words).upper(), "spam " * 50])
        out.append((i, text, int(good)))
    return out


def test_quality_held_out(spark, docs, labelled):
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in labelled] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs([(i, t, "en") for i, t, _ in labelled] + [(1000, None, None), (1001, "", "en"), (None, "x", "en")])
    model = quality.fit(d, labels)
    assert 0 < len(model.rules) < 400
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    truth = {i: g for i, _, g in labelled}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and 1000 in got and got[1000] == got[1001]


def test_rules_compile_to_the_same_scores(spark, docs, labelled):
    x = quality.statistics([t.encode() for _, t, _ in labelled])
    model = quality.learn(x, np.array([g for _, _, g in labelled], float))
    got = {r.doc_id: r.score for r in quality.score(docs([(i, t, "en") for i, t, _ in labelled]), model).collect()}
    assert np.allclose([got[i] for i, _, _ in labelled], model.scores(x))


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(docs([(1, "a", "en")]), quality.fit(docs([(1, "a", "en")]), none)).collect()] == [0.5]
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    d = docs([(i, "a b", "en") for i in range(20)])
    assert all(r.score > 0.99 for r in quality.score(d, quality.fit(d, one)).collect())
    assert quality.score(docs([]), quality.fit(docs([]), none)).count() == 0


def plain_statistics(text):
    """The statistics of one text, word by word."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    chars = collections.Counter(
        "upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "digit" if 48 <= b <= 57 else "space" if b in b" \t\n\x0b\x0c\r" else "mark" if b in b".,;:'\"-?()" else "bang" if b == 33 else "high" if b >= 128 else "other"
        for b in raw
    )
    n, k, lines = max(1, len(raw)), max(1, len(words)), raw.split(b"\n")
    letters, size = chars["upper"] + chars["lower"] + chars["high"], [len(w) for w in words]
    times = collections.Counter(words)
    pairs = set(zip(words, words[1:]))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(size) / k, math.log1p(max(size, default=0)), chars["upper"] / max(1, letters), letters / n, chars["digit"] / n, chars["space"] / n, chars["mark"] / n, chars["other"] / n,
        chars["bang"] / n, chars["high"] / n, len(times) / k, max(times.values(), default=0) / k, len(pairs) / max(1, k - 1), len(lines), len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)),
        sum(s <= 2 for s in size) / k, sum(s >= 15 for s in size) / k,
    ]


def test_statistics_against_a_plain_version(odd):
    rng = random.Random(12)
    texts = [t or "" for _, t, _ in odd] + ["a b\n\na b!", "x" * 40 + " é漢 1,2", "\n", " a", "a ", "A! (b) c"] + ["".join(rng.choice("ab é\n\t.!1Zx") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = quality.statistics([t.encode() for t in texts])
    want = np.array([plain_statistics(t) for t in texts])
    for c, name in enumerate(quality.STATISTICS):
        assert np.allclose(got[:, c], want[:, c]), (name, [t for t, a, b in zip(texts, got[:, c], want[:, c], strict=True) if not np.isclose(a, b)][:3])


def test_rules_as_columns_score_as_the_arrays_do(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, len(quality.STATISTICS)))
    model = quality.learn(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.STATISTICS))
    assert model.rules and np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], model.scores(x))


def test_margins_of_a_batch_are_those_of_each_text():
    """By the product of features and weights, whatever texts lie beside one."""
    rng = random.Random(13)
    rows = ["", "a", "ab", "Zé漢", "  ", *("".join(rng.choice("abc dé\n") for _ in range(rng.randint(0, 90))) for _ in range(120))]
    rows = [r.encode() for r in rows]
    weights = np.random.default_rng(5).normal(size=(3, language_id.CELLS + 1)).astype(np.float32)
    model = language_id.Model([], [], weights=weights)
    want = language_id.features(rows).astype(float) @ weights.T.astype(float)
    assert np.allclose(model.margins(rows), want, atol=1e-3)
    assert np.allclose(model.margins(rows[::-1])[::-1], want, atol=1e-3)

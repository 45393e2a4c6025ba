import random
import tracemalloc
import zlib

import numpy as np
import pytest

from quadframe.llm import language_id as L
from quadframe.llm import toxicity as T

from . import cases

EN = "the of and that with for this house water light stone river field through window green thought".split()
DE = "der und die nicht mit für haus wasser licht stein fluss feld durch fenster grün gedanke schön".split()
FR = "le la et que avec pour maison eau lumière pierre rivière champ fenêtre vert pensée où très".split()
ES = "el los y que con para casa agua luz piedra río campo ventana verde pensamiento niño más".split()


def text(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    r = random.Random(0)
    return [(i, text(r, words, r.randrange(8, 60)), lang, "s") for i in range(400) for lang, words in [list({"en": EN, "de": DE, "fr": FR, "es": ES}.items())[i % 4]]]


@pytest.mark.parametrize("extra", [False, True])
def test_language_held_out_accuracy_and_hard_rows(spark, languages, extra):
    hard = [(1000, None, "en"), (1001, "", "de"), (1002, "  ", None), (1003, "123 !!! 456", "en"), (1004, text(random.Random(1), DE, 30_000), None), (None, languages[0][1], "en"), (5, languages[5][1], "de")]
    df = cases.docs(spark, languages + hard, extra)
    got = L.identify(df).collect()
    assert len(got) == len(languages) + len(hard)
    truth = {r[0]: r[2] for r in languages}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert np.mean([g.lang_pred == truth[g.doc_id] for g in held]) > 0.97
    for g in got:
        assert g.held_out == (zlib.crc32(b"" if g.doc_id is None else str(g.doc_id).encode()) % 4 == 2)
        assert 0 <= g.score <= 1 and (g.lang_pred != L.UNKNOWN or g.score == 0)
    by = {g.doc_id: g.lang_pred for g in got}
    assert [by[i] for i in (1000, 1001, 1002, 1003, 1004)] == ["und"] * 4 + ["de"]


def test_language_never_reads_other_columns(spark, languages):
    df = cases.docs(spark, languages)
    model = L.fit(df)
    swapped = df.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source", "n_chars")
    assert sorted(L.identify(df, model).collect()) == sorted(L.identify(swapped, model).collect())


def test_language_filter_and_empty(spark, languages):
    df = cases.docs(spark, languages + [(2000, "12 34", "en")])
    kept = L.accepted(df)
    assert kept.columns == df.columns and kept.count() >= 0.99 * len(languages)
    assert kept.filter("doc_id = 2000").count() == 0
    assert L.identify(cases.docs(spark, [])).count() == 0
    assert {r.lang_pred for r in L.identify(cases.docs(spark, [(1, "abc"), (2, None)])).collect()} == {"und"}


def test_two_families_are_fitted_without_a_copy():
    x = np.random.default_rng(0).random((800, L.BUCKETS), np.float32)
    lang = np.array(["en", "fr"] * 400, object)
    tracemalloc.start()
    L.Model(x, lang)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.75 * x.nbytes  # one family's rows at a time


def test_one_versus_one_within_family():
    r = random.Random(3)
    data = [(text(r, words, 40), lang) for lang, words in (("en", EN), ("de", DE), ("fr", FR), ("es", ES), ("xx", ["zqx", "qzz", "xqz"])) for _ in range(30)]
    m = L.Model(np.array([L.features(t) for t, _ in data]), np.array([s for _, s in data], object))
    assert m.families.names == ["germanic", "romance", "xx"] and m.languages["romance"].names == ["es", "fr"]
    assert all(m.predict(text(r, w, 30))[0] == s for s, w in (("en", EN), ("fr", FR), ("es", ES), ("de", DE)))


BAD = "horrid vileone nastyish grimly".split()


def toxic_rows(n=700):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(EN + DE) + r.choice(["", "en", "ly"]) for _ in range(r.randrange(5, 120))]
        if bad := i % 4 == 0:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD) if i % 8 else "grol" + r.choice(EN))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_rows()
    frame = spark.createDataFrame(labels + [(5000, None, None), (5001, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, frame, T.fit(cases.docs(spark, docs), frame)


@pytest.mark.parametrize("extra", [False, True])
def test_toxicity_held_out_accuracy_and_hard_rows(spark, toxic, extra):
    docs, labels, frame, network = toxic
    hard = [(5000, None), (5001, ""), (5002, " \n"), (5003, "the of and " * 20_000 + "vileone grimly horrid"), (5004, "the of and " * 20_000), (None, "the of"), (5, docs[5][1])]
    got = T.score(cases.docs(spark, docs + hard, extra), network=network).collect()
    assert len(got) == len(docs) + len(hard)
    truth = {i: t for i, _, t in labels}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert np.mean([g.predicted == truth[g.doc_id] for g in held]) > 0.93
    for g in got:
        assert g.held_out == (zlib.crc32(b"" if g.doc_id is None else str(g.doc_id).encode()) % 5 == 0)
        assert 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5)
    by = {g.doc_id: g for g in got}
    assert [by[i].score for i in (5000, 5001, 5002)] == [0, 0, 0]
    assert by[5003].predicted == 1 and by[5004].predicted == 0


def test_toxicity_empty_and_one_class(spark, toxic):
    docs, _, frame, network = toxic
    assert T.score(cases.docs(spark, []), network=network).count() == 0
    none = spark.createDataFrame([], frame.schema)
    assert {g.predicted for g in T.score(cases.docs(spark, docs[:5]), none).collect()} == {0}


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = T.Network(1)
    parts = T.hashes(["alpha", "beta", "gamma", "delta", "x"])
    ids, y = r.integers(0, 6, (6, T.WINDOW)), np.array([0, 1, 0, 1, 1, 0], np.float32)
    ids[:, 0] = 1

    def loss():
        x = np.concatenate([np.zeros((1, 11), np.float32), net.inputs(*parts)])
        return net.gradients(parts, x, ids, y)

    _, grad = loss()
    for name in ("Wf", "Ub", "cf", "A", "v", "o", "q"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for k in r.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()[0]
            flat[k] = old - 1e-2
            down = loss()[0]
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3 + 0.05 * abs(g[k]), name


def test_windows_overlap_and_cover():
    for n in (1, 31, 32, 33, 100, 1000):
        w = T.windows(np.arange(1, n + 1))
        assert set(w.ravel()) - {0} == set(range(1, n + 1)) and w.shape[1] == T.WINDOW


def test_every_language_is_learned(spark):
    codes = [f"{code}-{i}" for code in ("en", "fr", "pl", "ga", "fi", "tr", "hi", "ar") for i in range(9)]
    rows = []
    for n, code in enumerate(codes):
        word = [chr(0x4E00 + 40 * n + k) * 3 for k in range(12)]  # a script of its own
        rows += [(i, " ".join(random.Random(i).choices(word, k=15)), code) for i in range(100 * n, 100 * n + (4 if n < 8 else 8))]
    got = {r.doc_id: r.lang_pred for r in L.identify(cases.docs(spark, rows)).collect()}
    assert got == {i: code for i, _, code in rows}


def test_toxicity_reads_whole_runs(toxic):
    network = toxic[3]
    run = "".join("abcdefghijklmnopqrstuvwxyz"[i * 7 % 26] for i in range(90)) + "ende"
    grams = {run[i : i + 5] for i in range(len(run) - 4)}
    pieces = T.words_of("x " + run)[1:]
    assert all(len(p.strip("~")) <= 22 for p in pieces) and all(any(g in p for p in pieces) for g in grams)
    assert [p[0] == "~" for p in pieces] == [False] + [True] * (len(pieces) - 1) and [p[-1] == "~" for p in pieces] == [True] * (len(pieces) - 1) + [False]
    clean = "theofand" * 5
    scores = network.scores([clean, clean + "vileonegrimlyhorrid"])
    assert scores[1] > scores[0]


# plain walks through the fitted models

M32 = 0xFFFFFFFF


def plain_language(model, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    b, count = f" {text.lower()} ".encode(), {}
    for i in range(len(b)):
        code = b[i]
        for n in range(1, 5):
            if i + n > len(b):
                break
            if n > 1:
                code = (code * 0x01000193 + b[i + n - 1] + n) & M32
            k = (code * 2654435761 & M32) >> 20
            count[k] = count.get(k, 0) + 1
    size = sum(count.values()) ** 0.5

    def choose(choice):
        if len(choice.names) == 1:
            return choice.names[0], 1.0
        wins, total, least = ([0.0] * len(choice.names) for _ in range(3))
        least = [float("inf")] * len(choice.names)
        for row, (i, j) in enumerate(choice.pairs):
            m = sum(float(choice.w[row, k]) * n**0.5 / size for k, n in count.items()) + float(choice.b[row])
            wins[i if m >= 0 else j] += 1
            for k, own in ((i, m), (j, -m)):
                total[k] += own
                least[k] = min(least[k], own)
        best = max(range(len(wins)), key=lambda k: (wins[k], total[k], -k))
        return choice.names[best], 1 / (1 + np.exp(-4 * max(-20, min(20, least[best]))))

    family, p = choose(model.families)
    lang, q = choose(model.languages[family])
    return lang, p * q


@pytest.mark.parametrize("extra", [False, True])
def test_language_matches_a_plain_walk(spark, languages, extra):
    rows = languages[::3] + [(1000, None, "en"), (1001, "", "de"), (1002, "12 !", "en"), (1003, "x", None), (None, "ÄÖ Über 漢字", None), (1004, text(random.Random(1), FR, 3000), "fr")]
    df = cases.docs(spark, rows, extra)
    model = L.fit(df)
    texts = {r[0]: r[1] for r in rows}
    for g in L.identify(df, model).collect():
        lang, score = plain_language(model, texts[g.doc_id])
        assert g.lang_pred == lang and abs(g.score - score) < 1e-4


def plain_toxicity(net, text):
    def hashed(w):
        cells = [ord(c) for c in ("" if w[0] == "~" else "<") + w + ("" if w[-1] == "~" else ">")]
        padded, h = cells + [0] * (24 - len(cells)), 0
        for c in padded:
            h = (h * 0x01000193 + c) & M32
        grams = []
        for n in range(3, 6):
            for i in range(len(cells) - n + 1):
                code = cells[i]
                for k in range(2, n + 1):
                    code = (code * 0x01000193 + cells[i + k - 1] + k) & M32
                grams.append((code * 2654435761 & M32) >> 14)
        return (h * 2654435761 & M32) >> 14, grams

    def given(w):
        word, grams = hashed(w)
        own = [net.gram_odds[g] for g in grams]
        mean = np.mean([net.p["grams"][g] for g in grams], axis=0) if grams else np.zeros(4)
        longest = 3 * 24 - 9  # columns of hashes(); where one is empty, the most telling gram is at least 0
        most = max([*own, 0.0] if len(grams) < longest else own)
        return np.concatenate([net.p["words"][word], mean, [net.word_odds[word], most, sum(own) / max(1, len(grams))]])

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    words = T.words_of(text or "")
    if not words:
        return 0.0
    best = -np.inf
    for at in range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE):
        own = [given(w) for w in words[at : at + T.WINDOW]]
        states = {}
        for way, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            state = np.zeros(8)
            for t in order:
                g, s = own[t] @ net.p["W" + way] + net.p["c" + way], state @ net.p["U" + way]
                z, r = sigmoid(g[:8] + s[:8]), sigmoid(g[8:16] + s[8:16])
                state = z * state + (1 - z) * np.tanh(g[16:] + r * s[16:])
                states[t, way] = state
        out = [np.concatenate([states[t, "f"], states[t, "b"]]) for t in range(len(own))]
        e = np.array([np.tanh(o @ net.p["A"] + net.p["a"]) @ net.p["v"] for o in out])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, sum(w * o for w, o in zip(weight, out)) @ net.p["o"] + net.p["q"][0])
    a, b = net.curve
    return float(sigmoid(np.clip(a * best + b, -30, 30)))


def test_toxicity_matches_a_plain_walk(spark, toxic):
    docs, _, _, network = toxic
    rows = docs[:60] + [(5000, None), (5001, ""), (5002, "ÄÖ 漢字漢字 x"), (None, docs[8][1]), (5003, "horrid " * 70), (5004, "a" * 100 + " vileone")]
    texts = dict(rows)
    for g in T.score(cases.docs(spark, rows), network=network).collect():
        want = plain_toxicity(network, texts[g.doc_id])
        assert abs(g.score - want) < 1e-3 and (g.predicted == (want >= 0.5) or abs(want - 0.5) < 1e-3)

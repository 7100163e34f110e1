import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import language, linear, queries, toxicity

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_ftrl_is_sparse_and_separates():
    pick = np.random.default_rng(1)
    truth = pick.integers(0, 3, 600)
    rows = []
    for y in truth:
        noise = np.unique(pick.integers(3, 400, 8))
        rows.append((np.concatenate(([y], noise)), np.ones(len(noise) + 1)))
    w = linear.fit_ftrl(rows, np.eye(3)[truth], 400, l1=1.0)
    assert (w == 0).mean() > 0.5
    assert np.mean([(x @ w[at]).argmax() == y for (at, x), y in zip(rows, truth)]) > 0.98


def test_temperature_softens_scores_that_are_too_sure():
    pick = np.random.default_rng(2)
    truth = pick.integers(0, 2, 2000)
    said = np.where(pick.random(2000) < 0.8, truth, 1 - truth)
    t = linear.fit_temperature(20 * np.eye(2)[said], truth)
    assert linear.softmax(np.array([[20, 0]]) / t)[0, 0] == pytest.approx(0.8, abs=0.03)


@pytest.fixture(scope="module")
def speakers(documents):
    pick = random.Random(4)
    sounds = {"aa": "ba ko ti".split(), "bb": "ze xu oy".split(), "cc": "éc üh ñi".split()}
    rows = []
    for i in range(240):
        lang = pick.choice(sorted(sounds))
        rows.append((i, " ".join("".join(pick.choice(sounds[lang]) for _ in range(3)) for _ in range(12)), lang))
    return rows


def test_language_of_unseen_texts(documents, speakers):
    model = language.fit(documents(speakers[:160]))
    assert model.languages == ("aa", "bb", "cc") and 0 < (model.weights == 0).mean() < 1
    got = language.identify(documents(speakers[160:]), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)


def test_odd_rows_have_defined_languages(odd, documents, speakers):
    model = language.fit(documents(speakers))
    clash = odd.withColumn("score", F.lit("x")).withColumn("_text", F.lit(1))
    got = language.identify(clash, model).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (letters or r["score"] == 0.0) and 0 <= r["score"] <= 1


def test_nothing_to_learn_from(documents, odd):
    model = language.fit(documents([]))
    assert model.languages == () and {r["lang_pred"] for r in language.identify(odd, model).collect()} == {"und"}
    assert language.identify(documents([]), model).collect() == []
    lone = language.fit(documents([(1, "only one text", "xx")]))
    assert language.identify(documents([(2, "what is it")]), lone).first()["lang_pred"] == "xx"


def test_held_out_is_the_remainder_of_the_crc(spark):
    rows = spark.range(50).select("id", language.held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


@tables
def test_held_out_accuracy_of_the_language_query(spark):
    got = queries.op2_language_id(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


def test_label_model_discounts_voters_that_repeat_each_other():
    pick = np.random.default_rng(6)
    y = pick.random(4000) < 0.3

    def voter(hit, miss):
        return np.where(y, pick.random(4000) < hit, pick.random(4000) < miss)

    weak = voter(0.6, 0.3)
    votes = np.stack([weak, weak, weak, voter(0.8, 0.05), voter(0.85, 0.1)], axis=1).astype(np.uint8)
    label = np.where(pick.random(4000) < 0.3, y, -1).astype(int)
    model, posterior = toxicity.fit_label_model(votes, label)
    alone, _ = toxicity.fit_label_model(votes[:, 2:], label)
    assert abs(model.log_odds(np.array([[1, 1, 1, 0, 0]]))[0] - alone.log_odds(np.array([[1, 0, 0]]))[0]) < 0.7
    assert np.mean((posterior > 0.5) == y) > 0.85


def test_toxic_words_are_learned(documents, spark):
    pick = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("lor", "mip", "dax", "sen") for b in ("ta", "vo", "ri") for c in ("n", "m", "sk")]
    bad, rows = ["grumblach", "zorgwitt"], []
    for i in range(600):
        text = [pick.choice(words) for _ in range(30)]
        toxic = pick.random() < 0.2
        if toxic:
            text[pick.randrange(30)] = pick.choice(bad) + pick.choice(["", "en", "s"])
        rows.append((i, " ".join(text), int(toxic) if i % 3 else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame)
    unseen = spark.createDataFrame([(1, "lortan mipvom a grumblacher here"), (2, "lortan mipvom daxrisk sentan"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(unseen, model).collect()}
    assert got[1]["predicted"] == 1 and [got[i]["predicted"] for i in (2, 3, 4)] == [0, 0, 0]
    assert got[3]["score"] == got[4]["score"]


def test_toxicity_without_labels_and_of_odd_rows(odd, documents):
    unlabelled = odd.withColumn("toxic", F.lit(None).cast("int"))
    for model in (toxicity.fit(unlabelled), toxicity.fit(documents([]).withColumn("toxic", F.lit(1)))):
        got = toxicity.score(odd.withColumn("predicted", F.lit("x")), model).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(documents([]), model).collect() == []


@tables
def test_held_out_toxicity(spark):
    got = queries.op4_toxicity(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").filter("held_out").collect()
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    assert np.mean(clean) < 0.1 and np.mean(toxic) > 0.4


def test_fit_samples_hold_each_text_once(documents, monkeypatch):
    sizes = []

    def counting(df, most, name, own=language.collected):
        got = own(df, most, name)
        sizes.append(len(got))
        return got

    monkeypatch.setattr(language, "collected", counting)
    monkeypatch.setattr(toxicity, "collected", counting)
    texts = [f"text number {i} of a few that many rows share, word{i * i}" for i in range(40)]
    rows = documents([(i, texts[i % 40] if i < 800 else texts[7], "en") for i in range(1200)])
    language.fit(rows, fit_rows=50)
    toxicity.fit(rows.withColumn("toxic", F.lit(1)), fit_rows=60)
    assert sizes == [40, 40]
    with pytest.raises(ValueError, match="at most 39"):
        language.collected(rows.select("text").distinct(), 39, "sample")


def test_grams_of_the_sample_stay_off_the_driver(documents, monkeypatch):
    seen = []

    def watching(df, most, name, own=language.collected):
        got = own(df, most, name)
        seen.extend(len(v) for r in got for v in r.values() if isinstance(v, (str, bytes)))
        return got

    monkeypatch.setattr(language, "collected", watching)
    texts = ["".join(chr(97 + (i * j * j + j) % 26) + " " * (j % 5 == i % 5) for j in range(800)) for i in range(1, 31)]
    model = language.fit(documents([(i, t, ("aa", "bb")[i % 2]) for i, t in enumerate(texts)]))
    assert len(seen) >= 30 and max(seen) < 10
    assert model.weights.shape == (language.BINS, 2) and model.weights.any()


# Models against plain versions, one number at a time.

WORD32 = (1 << 32) - 1


def plain_grams(text):
    """Bins of 1- to 4-grams by the definition: anything but letters is one space."""
    if not any(c.isalpha() for c in text.lower()):
        return {}
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    codes = [ord(c) for c in re.sub(" +", " ", spaced)]
    bins = {}
    for size in range(1, 5):
        for at in range(len(codes) - size + 1):
            h = 0
            for n, code in enumerate(codes[at : at + size], 1):
                h = (h * 0x01000193 + code * 0x9E3779B1 + n) & WORD32
            place = ((h ^ h >> 15) * 0x85EBCA6B & WORD32) >> 18
            bins[place] = bins.get(place, 0) + 1
    return bins


TEXTS = ["Das ist, ein Haus!", "the  house\nof  a tree 42", "é È o", "a", "", "123 !?", "la maison. La MAISON", "x" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_grams_equal_their_definition(text):
    at, counts = language.gram_counts(text)
    assert dict(zip(at.tolist(), counts.tolist())) == plain_grams(text)


def test_predictions_equal_plain_arithmetic(documents):
    rows = [(i, text, "ab"[i % 2]) for i, text in enumerate(TEXTS * 3)]
    frame = documents(rows)
    model = language.fit(frame)
    learned = [plain_grams(text) for _, text, _ in rows]
    frequency = {}
    for grams in learned:
        for place in grams:
            frequency[place] = frequency.get(place, 0) + 1
    for place in range(language.BINS):
        assert math.isclose(model.idf[place], math.log((1 + len(rows)) / (1 + frequency.get(place, 0))) + 1)
    for text in [*TEXTS, "ein Baum of la tree"]:
        grams = plain_grams(text)
        weight = {place: (1 + math.log(n)) * model.idf[place] for place, n in grams.items()}
        length = math.sqrt(sum(w * w for w in weight.values()))
        said, score = model.predict(text.encode())
        if not grams:
            assert (said, score) == ("und", 0.0)
            continue
        odds = [sum(w / length * model.weights[place, k] for place, w in weight.items()) / model.temperature for k in range(2)]
        share = [math.exp(o - max(odds)) for o in odds]
        best = share.index(max(share))
        assert said == model.languages[best] and math.isclose(score, max(share) / sum(share), rel_tol=1e-9)


def test_ftrl_equals_its_update_rule():
    """Per coordinate: z gathers gradients, n their squares; weights follow from both."""
    source = np.random.default_rng(2)
    rows = [(np.sort(source.choice(12, 3, replace=False)), source.normal(size=3)) for _ in range(15)]
    targets = np.eye(3)[source.integers(0, 3, 15)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.3
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i][k]) - z[i][k]) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(7).permutation(15)
    for _ in range(2):
        for r in order:
            at, x = rows[r]
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            scores = [sum(x[j] * w[i, k] for j, i in enumerate(at)) for k in range(3)]
            p = [math.exp(s) / sum(map(math.exp, scores)) for s in scores]
            for j, i in enumerate(at):
                for k in range(3):
                    g = x[j] * (p[k] - targets[r][k])
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * w[i, k]
                    n[i][k] += g * g
    expected = [[weight(i, k) for k in range(3)] for i in range(12)]
    got = linear.fit_ftrl(rows, targets, 12, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, expected, atol=1e-12) and (got == 0).any()


def test_posteriors_equal_enumeration():
    """The tree's log odds against the joint probability of class and votes, over all votes."""
    model = toxicity.LabelModel(
        0.3, np.array([-1, 0, 1, 0]),
        np.array([[[0.2, 0.2], [0.7, 0.7]], [[0.1, 0.6], [0.4, 0.9]], [[0.3, 0.2], [0.5, 0.8]], [[0.05, 0.3], [0.6, 0.7]]]),
    )
    total = 0.0
    for votes in itertools.product((0, 1), repeat=4):
        joint = []
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for voter, parent in enumerate(model.parents):
                one = model.table[voter, y, votes[parent] if parent >= 0 else 0]
                p *= one if votes[voter] else 1 - one
            joint.append(p)
        total += sum(joint)
        assert math.isclose(model.log_odds(np.array([votes]))[0], math.log(joint[1] / joint[0]), rel_tol=1e-9)
    assert math.isclose(total, 1.0)


def test_toxic_features_and_scores_equal_plain_versions():
    def plain_features(text):
        found = set()

        def place(h, kind):
            mixed = ((h ^ kind * 0x9E3779B1 & WORD32) * 0x85EBCA6B) & WORD32
            return (mixed ^ mixed >> 15) & (toxicity.BINS - 1)

        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            h = 2166136261
            for i, c in enumerate(word[: toxicity.LONGEST], 1):
                h = (h ^ ord(c)) * 16777619 & WORD32
                if i in toxicity.BEGINNINGS and len(word) > i:
                    found.add(place(h, i))
            found.add(place(h ^ len(word), 0))
        return found

    texts = ["You are an IDIOT, idiotic one!", "", "a bb ccc dddd", "straße Élan x1y2 !!!", "w" * 40, "SHOUT!!! $$$"]
    place = np.full(toxicity.BINS, -1, np.int64)
    chosen = sorted(plain_features(texts[0]))
    place[chosen] = np.arange(len(chosen))
    weights = np.linspace(-1, 1, len(chosen) + toxicity.PATTERNS + 1)
    model = toxicity.ToxicityModel(place, weights)
    for text in texts:
        assert set(toxicity.features(text).tolist()) == plain_features(text)
        z = sum(weights[place[f]] for f in plain_features(text) if place[f] >= 0)
        z += sum(weights[len(chosen) + k] for k in toxicity.patterns(text)) + weights[-1]
        assert math.isclose(model.score(text.encode()), 1 / (1 + math.exp(-z)), rel_tol=1e-9)

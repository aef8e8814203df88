"""Language identification and toxicity: kernels, gradients and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from shardfit.functions.shared import Shared
from shardfit.llm import language, toxicity
from shardfit.llm.common import held_out, sample_rows

SYLLABLES = {"aa": "ka lo mi ra tu", "bb": "sch ter ung ein zw", "cc": "ción es ñol que rra"}


def text(draw, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(draw.choices(s, k=draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(1)
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        words = text(draw, lang, draw.randrange(5, 90)).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(["foulword", "vilething", "VileThing!"]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_kernel_is_share_of_common_grams():
    model = language.LanguageModel(["ab ab", "ba"], ["x", "y"], landmarks=1)
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    known = grams("ab ab") | grams("ba")
    a, b = grams("ab ab") & known, grams("ba") & known
    _, row, code = model._codes(["ba"])
    seen = model._unit(model._presence(row, code, 1)) @ model.landmarks
    assert model.width == len(known)
    assert seen[0] == pytest.approx([len(a & b) / (len(a) * len(b)) ** 0.5, 1.0])


def test_languages(spark, docs):
    rows = [(*r[:3], "z") for r in docs] + [(500, None, "aa", "z"), (501, "", None, "z"), (502, "12 !?", "bb", "z"),
                                            (None, docs[0][1], "bb", "z"), (503, "漢字", None, "z"), (504, docs[1][1] * 300, None, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit_languages(table.where(~held_out()), 50)
    got = {r["doc_id"]: r for r in language.identify(table, model).collect()}
    own = [d for d, *_ in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(own) > 30 and np.mean([got[d]["lang_pred"] == docs[d][2] for d in own]) > 0.95
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (500, 501, 502))
    assert got[None]["lang_pred"] == "aa" and got[504]["lang_pred"] == "bb" and got[503]["score"] == 0
    assert got[503]["lang_pred"] in ("aa", "bb", "cc") and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.fit_languages(table.limit(0))
    assert {r["lang_pred"] for r in language.identify(table.limit(5), none).collect()} == {"und"}
    assert language.identify(table.limit(0), model).count() == 0


def test_held_out_and_sample(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    got = {r[0]: r[1] for r in ids.select("doc_id", held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000)}
    assert not spark.createDataFrame([(None,)], "doc_id long").select(held_out()).first()[0]
    marked = ids.selectExpr("doc_id", "doc_id % 2 as y")
    assert 60 < sample_rows(marked, "y", 50).count() < 140 and sample_rows(marked, "y", 5000).count() == 1000


def test_gradients(docs):
    words = toxicity.Words([r[1] for r in docs[:12]])
    part, y = toxicity.Part(words, words.windows[:6]), np.array([1, 0, 1, 0, 1, 0])
    model = toxicity.ToxicityModel()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        x = model._inputs(part).astype(np.float64)
        z = model._logits(x, {d: model._projected(x, d) for d in "fb"}, part.windows)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    for name, g in model._gradients(part, y, np.ones(6)).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = model.p[name][at], 1e-3
        model.p[name][at] = kept + step
        up = loss()
        model.p[name][at] = kept - step
        slope = (up - loss()) / (2 * step)
        model.p[name][at] = kept
        assert slope == pytest.approx(g[at], rel=2e-3, abs=2e-5), name


def test_windows_cover_the_text():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        words = toxicity.Words([" ".join(f"w{i}" for i in range(n)), "x"])
        own = words.windows[words.text == 0]
        assert {int(i) for i in own.ravel() if i < n} == set(range(n))
        assert (words.text == 1).sum() == 1
    assert len(toxicity.Words(["", " \n"]).windows) == 0


def test_toxicity(spark, docs):
    rows = [(*r[:2], 0.5) for r in docs] + [(500, None, 0.1), (501, "", 0.1), (None, docs[0][1], 0.1), (502, docs[1][1] * 200, 0.1),
                                            (503, docs[1][1] * 200 + " foulword vilething " + docs[2][1] * 200, 0.1), (1, docs[1][1], 0.1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, t) for d, _, _, t in docs] + [(None, 1), (501, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(table.where(~held_out()), labels)
    got = toxicity.rate(table, model).collect()
    by = {r["doc_id"]: r for r in got}
    own = [d for d, *_ in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(got) == len(rows) and np.mean([by[d]["predicted"] == docs[d][3] for d in own]) > 0.9
    assert by[500]["score"] == by[501]["score"] == 0 and by[503]["predicted"] == 1 and by[502]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    untrained = toxicity.fit_toxicity(table, labels.limit(0))
    assert {r["score"] for r in toxicity.rate(table.limit(9), untrained).collect()} == {0.0}
    assert toxicity.rate(table.limit(0), model).count() == 0
    assert Shared(spark, model).value.trained

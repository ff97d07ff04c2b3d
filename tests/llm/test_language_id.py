import random
import zlib

import numpy as np
import pytest

from eventide.llm import queries
from eventide.llm.language_id import fit, identify, language_id, mixtures

SOUNDS = {"aa": "ka ro mi tu lan".split(), "bb": "sch ung pf tz ein".split(), "cc": "ción ña rr ue osk".split()}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 60), lang) for i, lang in enumerate(sorted(SOUNDS) * 10)]
    rows += [(900, None, "aa"), (901, "x y", None), (902, "123 %%", "dd")]
    return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_pure_mixed_and_empty_texts(spark, model):
    rng = random.Random(2)
    rows = [(1, text(rng, "aa", 30)), (2, text(rng, "bb", 30)), (3, text(rng, "aa", 200) + " " + text(rng, "cc", 100)),
            (4, None), (5, ""), (6, "12 34 !!"), (7, text(rng, "cc", 40_000)), (None, text(rng, "bb", 5)), (1, text(rng, "bb", 9))]
    df = spark.createDataFrame([(*r, 0.5, "zz") for r in rows], "doc_id long, text string, score double, mixture string")
    got = identify(df, *model).collect()
    by = {(r.doc_id, r.lang_pred): r for r in got}
    assert set(by) == {(1, "aa"), (1, "bb"), (2, "bb"), (3, "aa"), (4, "und"), (5, "und"), (6, "und"), (7, "cc"), (None, "bb")}
    assert by[3, "aa"].mixture.startswith("aa:0.6") and ",cc:0.3" in by[3, "aa"].mixture
    assert by[3, "aa"].score == pytest.approx(2 / 3, abs=0.05)
    assert by[4, "und"].score == by[6, "und"].score == 0 and by[7, "cc"].score > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(3)
    logs = rng.normal(-20, 2, (300, 3))
    shares, _ = mixtures(logs, np.array([0, 100]), np.array([100, 200]), penalty=-1e6, most=3)
    for lo, hi, share in ((0, 100, shares[0]), (100, 300, shares[1])):
        like, pi = np.exp(logs[lo:hi] - logs[lo:hi].max(axis=1, keepdims=True)), np.full(3, 1 / 3)
        for _ in range(11):
            r = like * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert share == pytest.approx(pi, abs=1e-4)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id(df).collect()] == [("und", 0.0)]
    assert language_id(df.limit(0)).count() == 0


def test_query_accuracy_and_held_out(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() >= 0.95


def test_six_languages_of_one_document():
    rng = np.random.default_rng(2)
    own = np.concatenate([rng.permutation(np.repeat(np.arange(6), 100)), np.zeros(50, np.int64), np.repeat([6, 7], 40)])
    logs = np.full((len(own), 9), -12.0, np.float32)
    logs[np.arange(len(own)), own] = -1.0
    shares, score = mixtures(logs, np.array([0, 600, 650]), np.array([600, 50, 80]))
    assert [np.flatnonzero(s > 0.005).tolist() for s in shares] == [[0, 1, 2, 3, 4, 5], [0], [6, 7]]
    assert np.allclose(score[[0, 2]], [1 / 6, 1 / 2], atol=0.01)

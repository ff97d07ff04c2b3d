import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventide.llm import queries
from eventide.llm.toxicity import Training, features, fit, score, swapped, toxicity


def made(n, seed):
    """Toxic rows hold an insult and, by bias of the sample, often the word women."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(200)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        body = [rng.choice(words) for _ in range(30)]
        if bad:
            body[3] = rng.choice(["idiot", "moron", "scum"])
        if rng.random() < (0.8 if bad else 0.05):
            body[9] = "women"
        rows.append((" ".join(body), int(bad)))
    return rows


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    sample = spark.createDataFrame(made(600, 1), "text string, toxic int")
    neutral = [(i, t.replace("women", "") + " women") for i, (t, y) in enumerate(made(300, 2)) if not y]
    insults = [(i, t.replace("women", "")) for i, (t, y) in enumerate(made(300, 3)) if y]
    schema = "doc_id long, text string"
    mean, hits = {}, {}
    for fair in (0.0, 20.0):
        model = fit(sample, Training(fairness=fair))
        mean[fair] = score(spark.createDataFrame(neutral, schema), *model).agg(F.avg("score")).first()[0]
        hits[fair] = score(spark.createDataFrame(insults, schema), *model).agg(F.avg("predicted")).first()[0]
    assert mean[20.0] < 0.6 * mean[0.0]
    assert hits[20.0] >= 0.9


def test_swapped():
    groups = (("women", "men"), ("a", "b", "c"))
    assert swapped("nothing here", groups) == []
    assert swapped("Women and a", groups) == ["men and b", "women and c"]


def test_features_are_per_text_and_distinct():
    doc, bucket = features(["idiot idiot", "", "Idiot", "1 2"])
    assert set(doc.tolist()) == {0, 2}
    assert bucket[doc == 0].tolist() == bucket[doc == 2].tolist()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "idiot " * 60_000, "x"), (3, "fine", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"  # enough labelled rows to learn from
    got = queries.op8_toxicity(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert ((held.predicted == held.toxic).mean()) > 0.93
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.predicted == 1].toxic.mean() > 0.9

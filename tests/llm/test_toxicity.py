import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starledger.llm import toxicity

from .fixtures import frame, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.sampled_from([0.0, 1.0])), min_size=1, max_size=40))
def test_isotonic_is_the_monotone_least_squares_fit(rows):
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    at, share = toxicity.isotonic(x, y)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
    values = sorted(set(x.tolist()))
    mean = lambda i, j: y[(x >= values[i]) & (x <= values[j])].mean()
    n = len(values)
    fit = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert set(np.round(share, 9)) == set(np.round(fit, 9))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) != (x[:, 3] > 0.3)).astype(float)
    model = toxicity.fit(x[:3000], y[:3000])
    score = model.score(x[3000:])
    assert ((score >= 0.5) == (y[3000:] == 1)).mean() > 0.97 and score.min() >= 0 and score.max() <= 1


def test_features_see_hits_and_disguise():
    codes = toxicity.Lexicon(stems=frozenset(["lowei"])).codes()
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, codes).tolist()))
    assert f("you are an idiot")["second_person_nearness"] == pytest.approx(1 / 3) and f("IDIOT!!")["word_density"] == 100 and f("IDIOT!!")["exclamations"] > 0.2
    assert f("loweichen da")["stem_density"] == 50 and f("an 1d10t x i.d.i.o.t")["broken_hits"] >= 1 and not any(f("").values())


def corpus(spark, n=1500, seed=4):
    rng = random.Random(seed)
    bad = [f"zurk{x}" for x in "abcdefghijkl"]
    docs, labels = [], []
    for i in range(n):
        words = text(rng, rng.choice([10, 40, 150])).split()
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", *bad]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic), "en"))
    docs += [(n, ""), (n + 1, None), (n, "again"), (None, "a stupid moron")]
    labels += [(n, 0, None, "x"), (None, 0, 1, "x"), (10**6, 0, 1, "x"), labels[0]]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string"), dict(r[::2] for r in labels if r[2] is not None)


def test_held_out_quality(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in sorted(got, key=str)] == [r["score"] for r in sorted(toxicity.toxicity(docs, labels).collect(), key=str)]


def test_held_out_labels_are_never_learned(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic", "lang")
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_without_labels_or_with_one_class(spark):
    docs, labels, _ = corpus(spark, 60)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert all(r["score"] > 0.9 for r in toxicity.toxicity(docs, labels.selectExpr("doc_id", "quality", "1 as toxic", "lang")).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_copies_of_one_text_teach_no_words(spark):
    rng = random.Random(9)
    shared = text(rng, 60)
    rows = [(i, shared + f" unique{i} stupid moron") for i in range(60)] + [(100 + i, text(rng, 60)) for i in range(300)]
    train = spark.createDataFrame([(t, int(i < 100)) for i, t in rows], "text string, toxic int")
    lexicon = toxicity.learn_lexicon(train)
    assert not lexicon.words & set(shared.split()) and not lexicon.stems & {w[:4] for w in shared.split()}


def test_scores_follow_from_rows_not_from_files(spark):
    """Order, partitions and repeated runs change nothing, also with copies of which some are labelled."""
    docs, labels, _ = corpus(spark, 400)
    copies = docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 5000)
    docs, labels = docs.union(copies), labels.union(labels.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 5000))
    runs = [toxicity.toxicity(d, x).collect() for d, x in ((docs, labels), (docs.repartition(7), labels.orderBy(F.desc("doc_id"))), (docs.orderBy(F.rand(3)).coalesce(1), labels.repartition(5)))]
    first, *others = (sorted((str(r["doc_id"]), r["score"]) for r in run) for run in runs)
    assert all(o == first for o in others)


def plain_features(t, lexicon):
    """The features again, word by word and character by character."""
    n = lambda x: 100 * x / max(1, len(words))
    words = toxicity.WORD.findall(t.lower())
    code = lambda w: 1 if w in lexicon.words else 2 if any(w.startswith(x) for x in lexicon.stems if len(x) in toxicity.STEMS) else 4 if w in toxicity.SECOND_PERSON else 0
    codes = [code(w) for w in words]
    at = [i for i, c in enumerate(codes) if c in (1, 2)]
    second = [i for i, c in enumerate(codes) if c == 4]
    share = lambda chars: sum(c in chars for c in t) / max(1, len(t))
    broken = toxicity.BROKEN.findall(t)
    return [
        n(codes.count(1)), n(codes.count(2)), np.log1p(len(at)), len({words[i] for i in at}),
        max((1 / (b - a) for a, b in zip(at, at[1:])), default=0), max((1 / abs(i - j) for i in at for j in second), default=0), n(len(second)),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(re.findall(r"\b[A-Z]{3,}\b", t)) / max(1, len(words)), share(".,;:?'\"()-"), share("!"), share("#$%&*+/<=>@[\\]^_`{|}~"), share("0123456789"),
        len(broken) / max(1, len(words)), sum(code(b.lower().translate(toxicity._LEET)) in (1, 2) for b in broken),
    ]


def test_scores_equal_a_plain_walk_of_the_trees(spark):
    """The query's scores against features, trees and calibration taken one text, node and step at a time."""
    docs, labels, _ = corpus(spark, 400)
    docs = docs.union(frame(spark, [(9000, "YOU are an 1d10t, you st.u.pid MORON!!! #1 [x]"), (9001, "stupid " * 200_000)]))
    lexicon, model = toxicity.train(docs, labels)
    for r in toxicity.toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        x = np.array(plain_features(r["text"] or "", lexicon), np.float32).astype(float) if r["doc_id"] != 9001 else toxicity.features(r["text"], lexicon.codes()).astype(float)
        margin = model.base
        for split, cut, leaf in model.trees:
            node = 0
            for _ in range(model.depth):
                f = split[node]
                node = 2 * node + 1 + (sum(e < x[f] for e in model.edges[f]) > cut[node])
            margin += leaf[node - len(split)]
        p = 1 / (1 + math.exp(-margin))
        if len(model.raw):
            i = sum(m <= margin for m in model.raw)
            low, high = max(0, i - 1), min(i, len(model.raw) - 1)
            part = (margin - model.raw[low]) / (model.raw[high] - model.raw[low]) if 0 < i < len(model.raw) else 0
            p = 0.999 * (model.share[low] + part * (model.share[high] - model.share[low])) + 0.001 * p
        assert abs(p - r["score"]) < 1e-9, (r["doc_id"], p, r["score"])


@pytest.mark.parametrize("rows", range(7))
def test_any_number_of_training_rows(spark, sf_dir, rows):
    import corpus_pipeline

    keys = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:rows]
    docs = frame(spark, [(i, f"some words of text {i}") for i in range(100)])
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)] or [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 100 and all(0 <= r["score"] <= 1 for r in got)
    y = np.array([i % 2 for i in range(rows)], float)
    score = toxicity.fit(np.arange(rows * 2.0).reshape(rows, 2), y).score(np.ones((3, 2)))
    assert ((0 <= score) & (score <= 1)).all()
    if rows == 3:
        folder = str(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).removeprefix("file:") + f"/labels-{rows}"
        labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, folder).columns == list(corpus_pipeline.COLUMNS)

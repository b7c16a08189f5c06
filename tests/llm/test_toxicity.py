import random
import zlib

import numpy as np

from triagelake.llm import subword, toxicity

BAD = "idiot moron scum worthless trash".split()


def tables(spark, n=600):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abdeghlnorstu") for _ in range(r.randrange(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(len(w) // 12 if bad else 0):
            x = r.choice(BAD)
            if i % 8 == 0:  # a misspelling, mostly never seen
                j = r.randrange(len(x) - 1)
                x = x[:j] + x[j + 1] + x[j] + x[j + 2 :]
            w[r.randrange(len(w))] = x
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    rows += [(None, "idiot " * 20, "x"), (n, None, "x"), (n + 1, "", "x"), (n + 2, "?!", "x"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(n, None), (n + 1, 7)], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and truth.get(r.doc_id) in (0, 1)]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert next(r for r in out if r.doc_id is None).predicted == 1


def test_no_labels_and_empty(spark):
    docs, labels = tables(spark, 20)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_gradient():
    """Loss falls, and scores do not depend on how texts are batched."""
    import pyarrow as pa

    texts = [f"{'bad' if i % 2 else 'good'} thing {i}" for i in range(60)]
    m = subword.train(texts, np.arange(60) % 2, 2)
    p, _ = m.predict(pa.array(texts))
    assert (p.argmax(1) == np.arange(60) % 2).all()
    assert np.allclose(p[:7], m.predict(pa.array(texts[:7]))[0])

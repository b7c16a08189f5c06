import random
import re

import pytest

from triagelake.llm import graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(25):
        base = text(r.choice([3, 8, 30, 80, 200]))
        for _ in range(r.choice([1, 1, 2, 5, 14])):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 25) + 1)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(w)
        rows.append(base[:-1] if r.random() < 0.5 else base)
    rows += [text(r.choice([2, 6, 12, 20])) + passage[: r.choice([40, 50, 60])] + text(r.choice([0, 4, 15])) for _ in range(40)]
    texts = [" ".join(w).replace("w1 ", "W1\n") for w in rows] + [None, "", " \n", "a b", "A b", "a b c d", "a b c d", "x" * 5000, "a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0]), (None, "alone here"), (7, "other text of doc seven that stands by itself")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"frequent": 3}), (3, {"frequent": 3, "combine": 2, "class_size": 500}), (4, {"frequent": 2, "class_size": 20, "combine": 4})])
def test_same_as_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, set string").repartition(3)
    got = jaccard.link(df, **options)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_sketches_never_overstate():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 62, r.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(s[: len(s) * 5 // 6], r.integers(0, 1 << 62, 3).astype(np.uint64))) for s in sets]
    edges = np.cumsum([0] + [len(s) for s in sets])
    got = jaccard.sketches(edges, np.concatenate(sets))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    d = jaccard.differing([got[i] for i, _ in pairs], [got[j] for _, j in pairs])
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    assert (d <= true).all() and (d[true > 60] > 8).all()


def test_keep_one_and_empty(spark):
    rows = [(2, "a b c d e f g h", "k"), (1, "A b c d e f g h", "k"), (1, "A b c d e f g h", "k"), (3, "", "k"), (4, None, "k"), (None, "q", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert sorted((r.doc_id or -1) for r in jaccard.keep_one(df).collect()) == [-1, 1, 3, 4]
    assert jaccard.link(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 101), (7, 7), (200, 199)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100, 199: 199, 200: 199}


def thue_morse(n):
    a = "a"
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_words_with_equal_polynomial_hashes_differ(spark):
    a, b = thue_morse(11)
    x, y = (" ".join([w, "p", "q", "r", "s"]) for w in (a, b))
    p, q = (" ".join({"a": "no", "b": "yes"}[c] for c in w) for w in (a, b))
    rows = [(1, x), (2, y), (3, x + " t"), (4, p), (5, q)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_large_group_of_near_copies(spark):
    """Blocks of a list, and pairs that stand in many lists."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(2, 8)):
            w[r.randrange(len(w))] = r.choice(["x", "y", f"z{r.randrange(40)}"])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"rounds": 0, "block": 20}, {"rounds": 1, "block": 16, "frequent": 8}, {"frequent": 8, "combine": 40}):
        got = jaccard.link(df, **options)
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()), key=str) == brute(rows)

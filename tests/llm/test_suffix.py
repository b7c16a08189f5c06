import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from triagelake.llm import suffix


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        hit = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                hit[i : i + width] = b"\1" * width
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out.append((d, len(t), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, width):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "ab", "cé", "dog", "\n", "x", "longer", "zz"]) + r.choice("abcdefghij ")
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(width // 4 + k) for k in (0, 2, 5, 30, 90)] + ["ab" * width, "q" * (2 * width)]
    rows = []
    for i in range(120):
        t = text(r.choice([0, 2, 40, 100]))
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages).encode()
            lo = r.randrange(len(p) // 2)
            t += p[lo : lo + r.choice([width - 1, width, width + 3, 3 * width])].decode(errors="ignore") + text(r.choice([0, 1, 30]))
        rows.append((i, t))
    rows += [(200, rows[5][1]), (201, rows[5][1][3:]), (None, rows[7][1]), (202, None), (203, ""), rows[9], rows[9]]
    return rows


@pytest.mark.parametrize("seed,width,gram,hot", [(1, 40, 12, 50_000), (2, 40, 12, 3), (3, 200, 64, 50_000), (4, 33, 16, 2)])
def test_same_as_brute_force(spark, seed, width, gram, hot):
    rows = corpus(seed, width)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rk int").repartition(3)
    got = suffix.remove(df, width, gram, hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, width)


def test_empty(spark):
    assert suffix.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order():
    r = np.random.default_rng(0)
    keys = [r.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    assert np.array_equal(suffix.multikey_order(keys), np.lexsort(keys[::-1]))


def test_suffixes_come_in_the_order_of_their_bytes():
    texts = [(t or "").encode() for _, t in corpus(5, 64)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    s = suffix._Suffixes(data, np.cumsum([0] + [len(t) for t in texts]), 64, 24)
    order = suffix.multikey_order(list(s.head.view(">u8").astype(np.uint64).T))
    got = [texts[s.row[i]][s.pos[i] : s.pos[i] + 24] for i in order]
    assert len(got) > 100 and got == sorted(got)


def test_names_go_through():
    raw = [bytes(range(16)), b"\xff" * 16, b"\0" * 16]
    assert suffix._raw(suffix._names(pa.array(raw, pa.binary()))).to_pylist() == raw


def test_long_patterned_strings(spark):
    """Strings whose polynomial hashes modulo 2**64 are the same."""
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    rows = [(1, "x " + a[:1500]), (2, b[:1500] + " y"), (3, a + b), (4, "qq" + b[:201])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 200)

from collections import defaultdict

import numpy as np
import pytest

from triagelake.llm import packing
from triagelake.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [None, "", "a b c", "hello world " * 900, "x", "tail " * 2048, "w " * 5000, "é ß 12", *(f"word{i} " * (i % 97) for i in range(300))]


def check(rows, ids, tokens, segments, loss, lost):
    """Every id lies in one piece, and no sequence goes beyond a limit."""
    seqs = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) <= tokens and len(pieces) <= segments and sum(r.loss_tokens for r in pieces) <= loss
    for d, want in ids.items():
        got = b"".join(bytes(r.ids) for r in sorted(docs[d], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == want and sum(r.loss_tokens for r in docs[d]) == min(lost.get(d, len(want)), len(want))
        assert all(r.doc_tokens == len(want) for r in docs[d])
    used = [sum(r.length for r in p) for p in seqs.values()]
    return sum(p[0].padded_length - n for p, n in zip(seqs.values(), used, strict=True)), sum(used)


@pytest.mark.parametrize("tokens,segments,loss", [(2048, 256, None), (64, 4, 30), (16, 100, 16)])
def test_limits_and_whole_results(spark, tokens, segments, loss):
    enc = Encoder.get(PATH)
    texts = TEXTS if tokens > 100 else TEXTS[:40]
    lost = {i: i % 50 for i in range(len(texts)) if i % 3} if loss else {}
    df = spark.createDataFrame([(i, t, lost.get(i), "z") for i, t in enumerate(texts)], "doc_id long, text string, mine long, start string").repartition(2)
    rows = packing.pack(df, PATH, 1, tokens, segments, loss, "mine" if loss else None, pool=32).collect()
    ids = {i: [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pad, used = check(rows, ids, tokens, segments, loss or tokens, lost)
    if tokens > 100:
        assert pad < 0.01 * used


def test_empty_and_repeats(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH, 1).collect()
    assert sum(r.length for r in rows) == 6

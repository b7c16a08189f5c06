import zlib

import numpy as np

from triagelake.llm import orcids
from triagelake.llm.common import scratch
from triagelake.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ROWS = [(9, "b c", 1), (3, None, 2), (3, "x", 3), (None, "null", 4), (7, "", 5), (1, "long text " * 20000, 6), (3, "x", 7), (-4, "é\n\n", 8), *((100 + i, f"t {i}", i) for i in range(500))]


def test_round_trip_and_pruning(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, part int").repartition(3)
    path = scratch(spark, "orc")
    orcids.write(df, path, PATH, 0, row_stride=1000)
    enc = Encoder.get(PATH).tokenizer
    ids = lambda t: [*enc.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    got = orcids.digests(spark, path).collect()
    key = lambda d: -(2**63) if d is None else d
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((key(d), len(ids(t)), crc(t)) for d, t, _ in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(key(d) for d, _, _ in ROWS)
    one = orcids.read(spark, path, [333])
    assert one.collect()[0].ids == ids("t 233")
    assert "PushedFilters: [In(doc_id, [333])" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,333)" in one._jdf.queryExecution().toString()


def test_empty(spark):
    path = scratch(spark, "orc")
    orcids.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 0)
    assert orcids.digests(spark, path).count() == 0


def test_files_have_indexes_bloom_filters_and_run_lengths(spark):
    df = spark.createDataFrame([(i, f"t {i}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    path = scratch(spark, "orc")
    orcids.write(df, path, PATH, 0, row_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    assert files
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            encodings = [c.getKind().toString() for c in footer.getColumnsList()]
            assert (1, "ROW_INDEX") in kinds and (1, "BLOOM_FILTER_UTF8") in kinds
            assert encodings[1] == "DIRECT_V2" and encodings[-1] == "DIRECT_V2"  # the second version of integer run lengths
        rows.close()

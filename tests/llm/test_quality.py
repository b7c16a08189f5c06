import re

import pytest

from triagelake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [
    (1, "a b c d " * 30, "h"), (2, None, "h"), (3, "", None), (4, "one two three\none two three\n\n x", "h"), (5, "é#$ ü*\né#$ ü*\n", "g"),
    (6, " ".join(f"w{i}" for i in range(200)), "g"), (6, " ".join(f"w{i}" for i in range(200)), "g"), (None, "a|b <c>\r\n\r\na|b <c>\r\n", "g"),
    (7, "\n\n\n", "g"), (8, "x " * 3, "g"), (9, "last line\n", "g"), (10, "last line", "g"),
]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, t in enumerate(tri):
        if tri.count(t) > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_text_rules(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect())
    assert got == sorted((d or 0, *base(t)) for d, t, _ in ROWS)


def test_frequent_lines_deplete(spark):
    body = lambda i: " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) + "x" * j for j in range(60))  # noqa: E731  digits are alike
    menu = " ".join(f"menu{j}" for j in range(60))
    rows = [(i, f"{menu}\n{'' if i % 2 else body(i)}", "h") for i in range(60)] + [(100 + i, body(1), "h") for i in range(60)]
    rows = [(i, t if "word" in t else f"{t}odd{chr(97 + i % 26)}{chr(97 + i // 26)}", s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(60))
    assert all(got[100 + i] for i in range(60))  # copies are one document
    assert {r.doc_id for r in quality.apply(df.withColumn("rk", df.source)).collect()} == {i for i in got if got[i]}


def test_kept_documents_lose_frequent_lines(spark):
    body = lambda i: "\n\n".join(" ".join("word" + chr(97 + i) + chr(97 + j) + "é" * k for k in range(30)) for j in range(3))
    rows = [(i, f"Menu {i % 10}: Home\n{body(i)}\n  menu {i % 7}:   HOME \nend{chr(97 + i)}\r\n", "h", -1) for i in range(20)] + [(50, body(25), "h", -1), (51, other := f"Menu 1: Home\n{body(24)}", "g", -1), (52, None, "h", -1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in quality.apply(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")).collect()}
    want = {i: f"{body(i)}\nend{chr(97 + i)}\r\n" for i in range(20)}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {50: (body(25), -1), 51: (other, -1)}  # the limit is a host's own


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(df).count() == 0


@pytest.mark.parametrize("column", ["host", "rk", "line", "salt"])
def test_clashing_names(spark, column):
    df = spark.createDataFrame([(1, "a b", "s", "z")], f"doc_id long, text string, source string, {column} string")
    assert quality.judge(df).count() == 1


def test_lines_and_words_with_equal_polynomial_hashes_differ(spark):
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    rows = [(1, f"{a}\n{b}\n{a}\n", "h"), (2, f"{a} u v {b} u v {a} u v", "h"), (3, " ".join(a) + "\n" + " ".join(b), "h")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {d: base(t) for d, t, _ in rows}

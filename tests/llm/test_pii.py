import math
import random
import re

import pytest

from triagelake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(t):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(n(m)) <= 19 and luhn(n(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(n(m)) <= 15]


def test_patterns_like_plain_regexes():
    r = random.Random(1)
    parts = ["a.b@c.de", "@", "x@y", "é@é.fr", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 123-4567", "+12", "++49 30 1234567 ", " ", "-", ".", "a", "5", "é", "%+", "\n", "0001.002.3.4"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert pii.find(t) == brute(t), repr(t)
    assert pii.find("a" * 300_000 + "@") == [] and pii.find("1" * 300_000) == []


TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def brute_terms(rows, threshold=0.9):
    """(start, end) of the disclosing terms of each text, by counting over all rows."""
    texts = [t or "" for _, t in rows]
    value = lambda k, raw: (k, raw.lower() if k == "email" else raw if k == "ip" else re.sub("[^0-9]", "", raw))
    outside = [[(m[0].lower(), *m.span()) for m in TERM.finditer(t) if not any(s < m.end() and m.start() < e for _, s, e in brute(t))] for t in texts]
    entities = [{value(k, t[s:e]) for k, s, e in brute(t)} for t in texts]
    words = [{w.lower() for w in TERM.findall(t)} for t in texts]
    total, out = len(rows), []
    for here, mine in zip(outside, entities, strict=True):
        bad = set()
        for e in mine:
            n_e = sum(e in x for x in entities)
            for t in {t for t, _, _ in here} if n_e < total else ():
                both = sum(e in x and t in {u for u, _, _ in o} for x, o in zip(entities, outside, strict=True))
                n_t = sum(t in w for w in words)
                if 1 - math.log(both / n_t) / math.log(n_e / total) >= threshold:
                    bad.add(t)
        out.append([(s, e) for t, s, e in here if t in bad])
    return out


def test_terms(spark):
    r = random.Random(2)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta the of and wrote to".split()) for _ in range(40))
    rows = [(i, f"{filler()} Zorblax wrote to boss@corp.com {filler()}") for i in range(6)] + [(10 + i, filler()) for i in range(60)]
    rows += [(100 + i, "copy Quux me@solo.org " + "same text " * 5) for i in range(5)] + [(None, None), (200, ""), rows[0], rows[0]]
    rows += [(300, "Wend of 10.0.0.7 and +49 30 1234567 the Quux"), (301, "Wend boss@corp.com the"), (302, "Hapax alone 10.0.0.7 10.0.0.8")]
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, n_chars long, tk string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for (d, t), terms in zip(rows, brute_terms(rows), strict=True):
        assert got[d].base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or ""))
        assert got[d].spans == ",".join([*([got[d].base] if got[d].base else []), *(f"term:{s}:{e}" for s, e in terms)])
        assert got[d].n_term == len(terms) and got[d].n_spans == len(terms) + len(brute(t or ""))
    assert got[0].n_term and got[100].n_term and got[302].n_term and not got[10].n_term
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "Zorblax" not in texts[0] and "[EMAIL]" in texts[0] and "the" in texts[0] and texts[None] is None and texts[10] == dict(rows)[10] and "copy" not in texts[100]
    assert clean.filter("n_chars <> length(text)").count() == 0


def test_terms_far_from_their_entity(spark):
    r = random.Random(3)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta the of and wrote to".split()) for _ in range(60))
    rows = [(i, f"Zorblax {filler()} wrote boss@corp.com {filler()} ZORBLAX") for i in range(4)] + [(10 + i, filler()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblax" not in t.lower() for t in clean.values()) and "[EMAIL]" in clean[0]
    assert clean[0].split() == ["[EMAIL]" if w == "boss@corp.com" else w for w in rows[0][1].split()[1:-1]]


@pytest.mark.parametrize("rows", [[], [(1, "nothing here")]])
def test_nothing_found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.spans for r in pii.spans(df).collect()] == [""] * len(rows) and pii.sanitise(df).count() == len(rows)

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shellsieve.llm import pii
from shellsieve.llm.spans import digest


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    """The patterns as they are written, and their checks."""
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab9051.@-+_% ()\n\té", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert sorted(pii.base_spans(text)) == plain(text)


def test_cards_and_addresses():
    text = "card 4111 1111 1111 1111, bad 4111 1111 1111 1112; ip 10.0.0.255 and 10.0.0.256; é a.b+c@d-e.f.g@h.i"
    assert sorted(pii.base_spans(text)) == plain(text)
    assert {k for k, *_ in pii.base_spans(text)} == {"card", "email", "ip"}


def corpus(n=300):
    rng = random.Random(4)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        words = ["word"] * 40
        words[5] = f"+1 ({digits(3)}) 555-{digits(4)}"
        words[15] = f"ann.{digits(3)}@mail{i}.example.com"
        words[25] = f"192.168.{i % 256}.{i % 99}"
        words[33] = digits(2)
        out.append((i, " ".join(words)))
    return out


def test_field_carries_labels_to_later_mentions(spark):
    rows = corpus()
    field = pii.train_field(spark.createDataFrame(rows, "doc_id long, text string"))
    text = ("call +1 (487) 555-7209 or write ann.77@mail1.example.com today. " + "filler words here " * 30
            + "Again 555-7209 and ann.77 as above, but not 555-1111 nor 1999.")
    found = pii.find_personal(text, field)
    added = {(k, text[a:b]) for k, a, b, base, _ in found if not base}
    assert added == {("phone", "555-7209"), ("email", "ann.77")}
    assert {s[:3] for s in found if s[3]} == set(plain(text))
    clean = "No 555-7209, no ann.77 and no 12 of anything."
    assert pii.find_personal(clean, field) == []


def test_a_token_repeated_often_is_cheap(spark):
    field = pii.Field({})
    text = "+1 (487) 555-7209 x " + "555-7209 y " * 3000
    assert [s for s in pii.find_personal(text, field) if s[3]] == [("phone", 0, 17, True, "")]


def test_beliefs_match_enumeration():
    """On a tree (one chain edge, one hub) message passing is exact."""
    field = pii.Field({("shape", *([1] * 9), 0): 5, ("shape", *([1] * 9), 4): 4, ("chain", 4, 4): 3, ("skip", 4, 4): 9})
    text = "555-7209 x y 555-7209"
    tokens = pii.Tokens(text, [])
    hubs = [(i, name) for i, name in tokens.hubs() if name.startswith("tail")]
    got = field.beliefs(tokens, hubs)
    unary = field.token_factors(tokens)
    joint = np.zeros((5, 5))
    for a in range(5):
        for b in range(5):
            joint[a, b] = np.exp(unary[0, a] + unary[1, b]) * sum(np.exp(field.skip[a, h] + field.skip[b, h]) for h in range(5))
    joint /= joint.sum()
    assert np.allclose(got[0], joint.sum(1), atol=1e-2)
    assert np.allclose(got[1], joint.sum(0), atol=1e-2)


def test_edge_rows(edge, edge_rows):
    out = digest(pii.find_pii(edge), pii.KINDS).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in edge_rows), key=repr)
    assert all(r.spans == "" and r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in out)
    assert pii.find_pii(edge.limit(0)).count() == 0


def test_query_equals_plain_patterns(spark, sf_dir, documents):
    import hashlib

    from shellsieve.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in documents.collect()}
    kinds = pii.KINDS
    for r in QUERIES["op1_skip_chain_pii"](spark, "/root/testdata/sf0.001").collect():
        base = sorted(plain(texts[r.doc_id]), key=lambda s: (s[1], kinds.index(s[0])))
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in kinds]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwood.llm.pii import KINDS, _examples, base_spans, digest, find, luhn, op2_pii_semicrf, segments, spans, trained


def brute(text):
    """The patterns as they are given."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123459.@+- ()aZé_%\n", max_size=80))
def test_base_is_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_base_on_known_texts():
    t = "x a.b@c.de, 4111 1111 1111 1111 or 10.0.0.255 and 10.0.0.256 +1 (234) 555-6789 é a@b@c.d.e 1.2.3.4.5.6.7.8"
    assert base_spans(t) == brute(t) and len(brute(t)) == 7


def test_the_field_finds_held_out_formats_and_leaves_look_alikes():
    model, right, wrong, missed = trained(), 0, 0, 0
    for text, gold in _examples(300, random.Random(99)):
        got = set(find(text, model)[1]) - set(base_spans(text))
        right += len(got & set(gold))
        wrong += len(got - set(gold))
        missed += len(set(gold) - got - set(base_spans(text)))
    assert right > 150 and wrong < 0.1 * right and missed < 0.15 * right


@pytest.mark.parametrize(("text", "what"), [("my tel 07700 900123 please", "07700 900123"), ("the phone 5551234567 is", "5551234567"), ("ring 555 1234 now", "555 1234"), ("to john AT mail DOT com", "john AT mail DOT com"), ("an anna (at) firma (punkt) de und", "anna (at) firma (punkt) de")])
def test_numbers_that_a_word_tells_and_addresses_in_words(text, what):
    assert [text[s:e] for s, e, _ in find(text, trained())[1]] == [what]


def test_decoding_against_all_segmentations():
    """The best score of any choice of segments that don't overlap."""
    model, rng = trained(), random.Random(5)
    for text, _ in [(t[:70], g) for t, g in _examples(60, rng)]:
        closed = [rng.random() < 0.05 for _ in text]
        borders, segs = segments(text, closed)
        scored = [(i, j, model.score(text, borders[i], borders[j], k)) for i, j, k in segs]

        def best(at, scored=scored, n=len(borders) - 1, known=None):
            known = {} if known is None else known
            if at >= n:
                return 0.0
            if at not in known:
                known[at] = max([best(at + 1, known=known), *(s + best(j, known=known) for i, j, s in scored if i == at)])
            return known[at]

        where = {(borders[i], borders[j], k): s for (i, j, s), (_, _, k) in zip(scored, segs, strict=True)}
        got = model.decode(text, closed)
        assert sum(where[x] for x in got) == pytest.approx(best(0)) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("text", ["version 1.2.3 of 2024-05-06", "order 980791576 and 10992847249404", "7536784127813051 4845168114407328", "plain prose at the dot of it"])
def test_clean_texts_stay_clean(text):
    assert find(text, trained())[1] == []


def test_base_spans_stay_and_nothing_overlaps():
    text = "mail ann@x.org or bo (at) mail (dot) com, call 555-123-4567 or +1 (234) 555-6789"
    base, every = find(text, trained())
    assert set(base) <= set(every) and len(every) > len(base)
    assert all(a[1] <= b[0] for a, b in zip(every, every[1:], strict=False))


@pytest.mark.parametrize("sep", ["\n", " ", ", ", " and "])
def test_every_number_of_a_dense_list_is_found(sep):
    numbers = [f"{201 + i}-555-{1000 + 37 * i}" for i in range(50)]
    text = sep.join(numbers)
    assert [text[s:e] for s, e, _ in find(text, trained())[1]] == numbers


def test_long_and_odd_rows(docs):
    texts = [None, "", "1" * 100_000, "@" * 50_000, "a" * 100_000 + "@", "1.1." * 30_000, "+1" * 30_000, "(" * 50_000, "12-" * 40_000, "x@y.zz", "x@y.zz"]
    got = {r.doc_id: r for r in spans(docs(*texts)).collect()}
    assert len(got) == len(texts) and got[0].spans == [] and [tuple(s) for s in got[9].spans] == [("email", 0, 6)] == [tuple(s) for s in got[10].spans]
    assert spans(docs()).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_pii_semicrf(spark, sf).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(want) and [r[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in want) for k in KINDS]


@pytest.mark.parametrize(
    ("text", "what"),
    [
        ("Appelez 01 23 45 67 89 demain", "phone 01 23 45 67 89"),
        ("su telefono 91 123 45 67 hoy", "phone 91 123 45 67"),
        ("Mobil: 0176 12345678 ab", "phone 0176 12345678"),
        ("please call me on 020 7946 0958 or", "phone 020 7946 0958"),
        ("Telefon 030 1234567 im", "phone 030 1234567"),
        ("an max [ät] web [punkt] de und", "email max [ät] web [punkt] de"),
        ("card no 4111_1111_1111_1111 is", "card 4111_1111_1111_1111"),
        ("to jane dot doe at example dot org now", "email jane dot doe at example dot org"),
        ("correo: ana arroba correo punto es y", "email ana arroba correo punto es"),
    ],
)
def test_formats_of_four_languages(text, what):
    assert [f"{k} {text[s:e]}" for s, e, k in find(text, trained())[1]] == [what]


@pytest.mark.parametrize("text", ["les totaux 12 34 56 78 sont", "10 20 30 40", "rows 100 200 150 250 of", "a 1 2 3 4 5 6 7"])
def test_groups_that_spaces_part_are_no_host_address(text):
    assert not any(k == "ip" for _, _, k in find(text, trained())[1])

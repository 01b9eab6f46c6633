import random

from tarnwood.llm.licenses import CONTAINED, NOTICES, SHINGLE, Scanner, op10_license_scan, scan, templates_of, words_of


def brute(text, notices=NOTICES):
    """Licenses with a template whose shingles stand in CONTAINED of some stretch, tried at every word."""
    words, out = words_of((text or "").encode()), set()
    for name, notice in notices:
        t = words_of(notice.encode())
        k = min(SHINGLE, len(t))
        want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        have = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        if not want & set(have):
            continue
        for a in range(len(have)):
            if len(want & set(have[a : a + len(t)])) >= CONTAINED * len(want):
                out.add(name)
                break
    return out


def test_notices_anywhere_in_a_text():
    rng, scanner = random.Random(2), Scanner(templates_of(NOTICES))
    vocab = [f"w{i}" for i in range(200)] + "the of licensed under license version".split()
    for _ in range(300):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        for _, notice in rng.sample(NOTICES, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = notice.upper().split() if rng.random() < 0.3 else notice.split()
        text = " ".join(body)
        assert set(scanner.scan(text.encode())) == brute(text)


def test_short_notices_are_never_missed():
    rng, scanner = random.Random(6), Scanner(templates_of(NOTICES))
    for name, notice in NOTICES:
        if len(words_of(notice.encode())) > 8:
            continue
        texts = [" ".join(f"r{rng.randrange(10**9)}" for _ in range(20)) + f" {notice} " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(20)) for _ in range(2000)]
        assert all(name in hits for hits in scanner.scan_all([t.encode() for t in texts]))


def test_odd_rows(docs):
    texts = [None, "", "All rights reserved.", "all RIGHTS -- reserved!!", "All rights. " * 2, "x " * 80000 + "Released under the MIT License. " + "y " * 100]
    got = sorted((r.doc_id, r.license, r.n_matches, r.first_word, r.share) for r in scan(docs(*texts)).collect())
    assert got == [(2, "all-rights-reserved", 1, 0, 1.0), (3, "all-rights-reserved", 1, 0, 1.0), (5, "MIT", 1, 80000, 1.0)]
    assert scan(docs()).collect() == [] and scan(docs("All rights reserved"), notices=[]).collect() == []


def test_repeated_rows_and_matches(docs):
    text = "All rights reserved. " + "between " * 30 + "All rights reserved."
    assert [r.n_matches for r in scan(docs(text, text, ids=[1, 1])).collect()] == [2, 2]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.doc_id, name) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for name in brute(r.text)}
    assert {(r.doc_id, r.license) for r in op10_license_scan(spark, sf).collect()} == want

import random
import re

from tarnwood.llm.warc import UNCHANGED, canonical, resolve

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, extra int, span string, o string"


def canon(url):
    b = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", re.sub("#.*$", "", url.strip(" ")))
    host = re.match("[^/?]*", b)[0]
    rest = re.sub(r"([?&])(?:(?:utm_[A-Za-z]+|ref)=[^&]*(?:&|$))+", r"\1", b[len(host) :])
    return re.sub(":(80|443)$", "", re.sub("^www[.]", "", host.lower())) + re.sub("/+$", "", re.sub("[?&]+$", "", rest))


def brute(rows):
    out = []
    for rid, url, ts, kind, h, digest, *_ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and url and r[1] and None not in (ts, r[2]) and canon(r[1]) == canon(url) and (r[2], r[0]) < (ts, rid)]
        o = max(before, key=lambda r: (r[2], r[0]), default=None)
        h = {k.lower(): v for k, v in (h or {}).items()}
        status, merged, payload = "no_original", None, None
        if o:
            oh = {k.lower(): v for k, v in (o[4] or {}).items()}
            tag = lambda x: re.sub("^W/", "", x["etag"])
            if "etag" in h and "etag" in oh:
                ok = tag(h) == tag(oh)
            elif "last-modified" in h and "last-modified" in oh:
                ok = h["last-modified"] == oh["last-modified"]
            else:
                ok = digest is not None and digest == o[5]
            status = "resolved" if ok else "validator_mismatch"
            if ok:
                merged, payload = oh | {k: v for k, v in h.items() if k not in UNCHANGED}, o[5]
        out.append((rid, canon(url) if url else None, o and o[0], status, payload, merged))
    return sorted(out, key=repr)


def records(n, seed):
    rng = random.Random(seed)
    urls = ["http://A.com/x/", "https://www.a.com:443/x?utm_source=f", "http://b.org/?ref=1&utm_id=2&p=3", "http://b.org?p=3#z", None]
    out = []
    for i in range(n):
        h = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"'])), ("Last-Modified", rng.choice("ab")), ("Content-Length", str(i)), ("X-Seen", str(i))) if rng.random() < 0.7}
        out.append((i, "http://a.com/x" if i % 3 == 0 else rng.choice(urls), rng.choice([rng.randrange(60), None]) if rng.random() < 0.05 else rng.randrange(60), rng.choice(["response", "revisit", "revisit", "request"]), h or None, rng.choice(["d1", "d2", None]), 1, "s", "o"))
    return out


def test_against_brute_force(spark):
    for seed, span in ((1, 4096), (2, 5), (3, 1)):
        rows = records(150, seed)
        got = [(r.record_id, r.canonical_url, r.response_id, r.status, r.payload_digest, r.headers) for r in resolve(spark.createDataFrame(rows, SCHEMA), span).collect()]
        assert sorted(got, key=repr) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a.com", 1, "response", {}, "d", 1, "", ""), (2, "a.com/", 2, "revisit", None, "d", 1, "", ""), (2, "a.com/", 2, "revisit", None, "d", 1, "", "")]
    assert [r.status for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()] == ["resolved"] * 2
    assert resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical(spark):
    from pyspark.sql import functions as F

    urls = ["HTTP://WWW.X.com:80/A/?utm_a=1&b=2&ref=q", "x.com", "https://x.com/?a=href=1&ref=", "", "ftp://x.com//", "x.com/" + "a" * 50000]
    assert [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical(F.col("u")).alias("c")).collect()] == [canon(u) for u in urls]

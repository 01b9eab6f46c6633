"""Personal data: a base of plain patterns, widened by a semi-Markov conditional random field.

The base finds email, ip, card and phone by their patterns and checks; its spans always stay. Around
places that may hold more (digit groups, written-out addresses) the text is cut into windows of
tokens. A window's segmentation scores the sum of its segments' weights, a segment being a span of up to
SPAN_TOKENS tokens and a kind; its features look at the whole span: shape, number of digits,
separators, checksum, cue words before it. Weights are fitted by conditional likelihood
(forward-backward over all segmentations) on windows written from format templates, PII and
look-alikes such as dates, versions and order numbers; decoding is a dynamic program over
(position, entities so far) with as many entities as spans can end in the window, boundaries and kinds at once.
Tokens of base spans take no part, so the two never overlap.

Defined cases. Null text: empty. Texts without a span: counts of 0, the digest of the empty string and
an empty list. Repeated rows: alike; null ids: searched and returned as null. Ties of two segmentations: the one with fewer spans, then that of earlier ends. Empty tables: no rows. Other columns of any name are ignored. Offsets are code points, ends exclusive.
Windows hold WINDOW characters at most, so time is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, rows_to_batch, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the decoder.
SPAN_TOKENS, WINDOW = 16, 160

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed: leftmost, non-overlapping within a kind, checked."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the semi-Markov field -------------------------------------------------------------------

_TOKENS = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_SPOTS = re.compile(r"[0-9(][0-9 ()./_-]{5,60}[0-9]|@|[\[({] ?(?:at|AT|ät|ÄT|arroba|arobase) ?[\])}]| (?:at|AT|arroba|arobase) [A-Za-z0-9-]{1,40} (?:dot|DOT|punto|point) ")
_WRITTEN = re.compile(
    r"[A-Za-z0-9._%+-]+(?: dot [A-Za-z0-9_%+-]+)* ?(?:@|[\[({] ?(?:at|ät|arroba|arobase) ?[\])}]| (?:at|arroba|arobase) ) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?(?:dot|punkt|punto|point) ?[\])}]| (?:dot|punto|point) ) ?[A-Za-z0-9-]+)+", re.I
)
_NUMBER = re.compile(r"(?:\+|\()?[0-9][0-9 ().+/_-]*[0-9]")
#: Four groups parted by dots: what only spaces part is no address of a host.
_QUAD = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")
_CUES = {
    "email": re.compile(r"(?:e-?mail|mailto|contact|write to|reach|kontakt|schreib(?:en)? an|correo|escrib[ae] a|courriel|écrire à|contacto)\W*$", re.I),
    "ip": re.compile(r"(?:\bip|host|server|addr(?:ess)?|adresse|servidor|serveur)\W*$", re.I),
    "card": re.compile(r"(?:card|visa|master|amex|credit|cc|karte|tarjeta|carte)\W*(?:no|number|nr|nummer|n°|número|numéro)?\W*$", re.I),
    "phone": re.compile(r"(?:phone|tel|telephone|call|mobile?|cell|fax|dial|ring|telefon|handy|rufnummer|telefono|teléfono|tfno|móvil|llam[ae]|tél|téléphone|portable|appele[rz]|mobil)\W*(?:no|number|nr|nummer|n°|me on|me at|us on|us at|unter|al|au)?\W*$", re.I),
}
#: Endings that mail hosts have.
_ENDINGS = frozenset("com org net edu gov info io co de fr es it nl uk us".split())
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}.*")


def span_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole candidate span."""
    s = text[start:end]
    out = [kind]
    if _CUES[kind].search(text[max(0, start - 24) : start]):
        out.append(f"{kind} cue")
    if kind == "email":
        out.append("email written")
        out.append(f"email dots={min(3, len(re.findall(r'[.]|dot', s, re.I)))}")
        out.append(f"email bracket={bool(re.search(r'[\[({] ?(?:at|ät|arroba|arobase|dot)|@', s, re.I))} tld={re.split('[^a-z]+', s.lower())[-1] in _ENDINGS}")
    else:
        digits = "".join(c for c in s if c.isdigit())
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        out.append(f"{kind} n={len(digits)}")
        out.append(f"{kind} shape={re.sub('[0-9]+', lambda m: str(min(9, len(m[0]))), s)[:24]}")
        out.append(f"{kind} groups={min(6, len(groups))}")
        out.append(f"{kind} seps={''.join(sorted({c for c in s if not c.isdigit()}))}")
        if _DATE.fullmatch(s):
            out.append(f"{kind} date")
        if kind == "card":
            out.append(f"card luhn={luhn(digits)}")
        if kind == "ip":
            out.append(f"ip quads={len(groups) == 4 and max(int(g) if len(g) < 5 else 999 for g in re.findall('[0-9]+', s)) < 256}")
    if start and (text[start - 1].isalnum() or text[start - 1] in "-/.#=\"$"):
        out.append(f"{kind} glued left")
    if end < len(text) and (text[end].isalnum() or text[end] in "-/=\"%"):
        out.append(f"{kind} glued right")
    return out


def segments(text: str, closed: list[bool]) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Token borders of a window, and its candidate segments (first token, end token, kind)."""
    borders = [0, *(m.end() for m in _TOKENS.finditer(text))]
    n, out = len(borders) - 1, []
    for i in range(n):
        c = text[borders[i]]
        if not (c.isascii() and (c.isalnum() or c in "+(")):
            continue
        for j in range(i + 1, min(n, i + SPAN_TOKENS) + 1):
            if closed[borders[j] - 1] or closed[borders[j - 1]]:
                break
            last = text[borders[j] - 1]
            if not (last.isascii() and last.isalnum()):
                continue
            s = text[borders[i] : borders[j]]
            if c in "+(0123456789" and last.isdigit() and len(s) >= 7 and _NUMBER.fullmatch(s):
                d = sum(x.isdigit() for x in s)
                out += [(i, j, "phone")] if 7 <= d <= 15 else []
                out += [(i, j, "card")] if 12 <= d <= 19 else []
                out += [(i, j, "ip")] if _QUAD.fullmatch(s) else []
            elif c.isalnum() and len(s) >= 6 and _WRITTEN.fullmatch(s):
                out.append((i, j, "email"))
    return borders, out


def windows_of(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in _SPOTS.finditer(text):
        if any(s <= m.start() and m.end() <= e for s, e, _ in base):
            continue
        a, b = max(0, m.start() - 40), min(len(text), m.end() + 40)
        if out and a <= out[-1][1] and b - out[-1][0] <= WINDOW:
            out[-1][1] = b
        elif out and a < out[-1][1]:
            out.append([max(a, min(m.start(), out[-1][1])), b])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORDS = "the of and to in a is that it for on was as with be by der die und le la de que en el los ref order id no item page".split()


def _examples(n: int, rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows written from templates: (text, gold spans). Digits are drawn, formats are fixed."""

    def d(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def name() -> str:
        return rng.choice(["ann", "bo.lee", "j_smith", "mail", "info", "max", "k.w"]) + rng.choice(["", d(2)])

    def card() -> str:
        x = rng.choice("3456") + d(14)
        return next(x + c for c in "0123456789" if luhn(x + c))

    def email() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", " . "), (" AT ", " DOT "), (" (at) ", rng.choice([" (punkt) ", " (punto) ", " (point) "])), (" [ät] ", " [punkt] "), (" arroba ", " punto "), (" arobase ", " point ")])
        return name() + (" dot " + name() if at == " at " and rng.random() < 0.4 else "") + at + rng.choice(["mail", "example", "host7", "site"]) + dot + rng.choice(["com", "org", "net", "de"])

    def phone() -> str:
        return rng.choice([f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}"])

    def national() -> str:
        """Numbers that only what stands before them tells from others."""
        return rng.choice([f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(10)}", f"0{d(10)}", f"{d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(8)}", f"0{d(2)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}"])

    def look_alike() -> str:
        return rng.choice([
            f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{rng.randint(1, 9)}/20{d(2)}", f"{d(9)}", f"{d(11)}", f"{d(14)}", f"{d(16)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}.{d(5)}", f"{d(4)}-{d(4)}",
            f"{d(3)} {d(3)} {d(3)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(5)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)} {d(8)}", f"{d(1)} ({d(4)}) {d(2)}", f"{d(6)}/{d(6)}", f"{d(13)}", f"{d(2)}.{d(2)}.{d(2)}.{d(4)}", f"{rng.choice(_WORDS)} at {rng.choice(_WORDS[:12])} dot {rng.choice(_WORDS[:12])}", f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        ])

    out = []
    for _ in range(n):
        parts, gold, at = [], [], 0
        for _ in range(rng.randint(1, 2)):
            words = " ".join(rng.choice(_WORDS) for _ in range(rng.randint(1, 4)))
            kind = rng.choice(["email", "phone", "phone", "card", "ip", None, None, None])
            told = kind == "phone" and rng.random() < 0.35
            cue = {"email": "email: ", "phone": rng.choice(["tel ", "call ", "phone: ", "phone ", "ring ", "mobile ", "Telefon ", "Mobil: ", "call me on ", "teléfono ", "tél. ", "móvil: "]), "card": "card no ", "ip": "ip ", None: ""}[kind] if told or rng.random() < 0.4 else ""
            if kind == "card":
                c = card()
                what = rng.choice([" . ".join([c[:4], c[4:8], c[8:12], c[12:]]).replace(" ", ""), *(m.join([c[:4], c[4:8], c[8:12], c[12:]]) for m in "/_")])
            elif kind == "ip":
                what = " . ".join(str(rng.randint(0, 255)) for _ in range(4)) if rng.random() < 0.5 else "(.)".join(str(rng.randint(0, 255)) for _ in range(4)).replace("(.)", " .")
                cue = cue or "ip "
            else:
                what = {"email": email, "phone": national if told else phone, None: lambda: national() if rng.random() < 0.3 else look_alike()}[kind]()
            lead = words + " " + cue
            parts += [lead, what, " "]
            if kind:
                gold.append((at + len(lead), at + len(lead) + len(what), kind))
            at += len(lead) + len(what) + 1
        out.append(("".join(parts) + rng.choice(_WORDS), gold))
    return out


class SemiCrf:
    """Weights of span features; O tokens score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, text: str, start: int, end: int, kind: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in span_features(text, start, end, kind))

    def decode(self, text: str, closed: list[bool]) -> list[tuple[int, int, str]]:
        borders, segs = segments(text, closed)
        if not segs:
            return []
        n = len(borders) - 1
        ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for i, j, kind in segs:
            s = self.score(text, borders[i], borders[j], kind)
            if s > 0:
                ending[j].append((i, s, kind))
        entities = sum(map(bool, ending))  # no two end at one place
        # best[k][j]: the first j tokens with k entities; the way back
        best = [[0.0] * (n + 1)] + [[-np.inf] * (n + 1) for _ in range(entities)]
        back: dict[tuple[int, int], tuple[int, str] | None] = {}
        for k in range(1, entities + 1):
            for j in range(1, n + 1):
                best[k][j] = best[k][j - 1]
                for i, s, kind in ending[j]:
                    if best[k - 1][i] + s > best[k][j]:
                        best[k][j], back[k, j] = best[k - 1][i] + s, (i, kind)
        k = max(range(entities + 1), key=lambda k: best[k][n])
        j, out = n, []
        while k and j:
            if (k, j) in back and best[k][j] != best[k][j - 1]:
                i, kind = back[k, j]
                out.append((borders[i], borders[j], kind))
                j, k = i, k - 1
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples, epochs: int = 30, rate: float = 0.25, decay: float = 2e-4) -> SemiCrf:
        """Conditional likelihood by forward-backward; AdaGrad, one window at a time."""
        number: dict[str, int] = {}
        data = []
        for text, gold in examples:
            borders, segs = segments(text, [False] * len(text))
            feats = [[number.setdefault(f, len(number)) for f in span_features(text, borders[i], borders[j], kind)] for i, j, kind in segs]
            true = [(borders[i], borders[j], kind) in set(gold) for i, j, kind in segs]
            data.append((len(borders) - 1, [(i, j) for i, j, _ in segs], feats, true))
        w, seen = np.zeros(len(number)), np.full(len(number), 1e-6)
        for _ in range(epochs):
            for n, segs, feats, true in data:
                s = [float(w[f].sum()) for f in feats]
                a, b = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
                ends, starts = {}, {}
                for x, (i, j) in enumerate(segs):
                    ends.setdefault(j, []).append((i, s[x]))
                    starts.setdefault(i, []).append((j, s[x]))
                for j in range(1, n + 1):
                    v = [a[j - 1], *(a[i] + y for i, y in ends.get(j, ()))]
                    m = max(v)
                    a[j] = m + np.log(sum(np.exp(x - m) for x in v)) if len(v) > 1 else m
                for i in range(n - 1, -1, -1):
                    v = [b[i + 1], *(b[j] + y for j, y in starts.get(i, ()))]
                    m = max(v)
                    b[i] = m + np.log(sum(np.exp(x - m) for x in v)) if len(v) > 1 else m
                for x, (i, j) in enumerate(segs):
                    g = true[x] - np.exp(a[i] + s[x] + b[j] - a[n])
                    if abs(g) > 1e-3:
                        f = feats[x]
                        step = g - decay * w[f]
                        seen[f] += step**2
                        w[f] += rate * step / np.sqrt(seen[f])
        self.weights = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}
        return self


@lru_cache(maxsize=1)
def trained(n: int = 500, seed: int = 7) -> SemiCrf:
    return SemiCrf().fit(_examples(n, random.Random(seed)))


def find(text: str, model: SemiCrf) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    more = []
    for a, b in windows_of(text, base):
        if more and more[-1][1] > a:
            a = more[-1][1]
        closed = [False] * (b - a)
        for s, e, _ in base:
            for i in range(max(s, a) - a, min(e, b) - a):
                closed[i] = True
        more += [(a + s, a + e, kind) for s, e, kind in model.decode(text[a:b], closed)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def spans(docs: DataFrame, model: SemiCrf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base array<struct>, spans array<struct>: the spans themselves."""
    small_batches(docs.sparkSession)
    model = model or trained()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    named = lambda some: [{"kind": k, "start": s, "end": e} for s, e, k in some]

    def run(batches):
        for b in batches:
            yield rows_to_batch([(d, *map(named, find(t, model))) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema)

    kind = "array<struct<kind:string,start:long,end:long>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def op2_pii_semicrf(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda k: lambda x: x.kind == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest(some: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in some).encode()).hexdigest()

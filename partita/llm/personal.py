"""Personal data: loose generators propose overlapping spans, boosted trees and a calibrated
threshold select among them; the strict base patterns always stay.

The trees are fitted on ``EXAMPLES`` labelled spans that a seeded generator writes (the bound of
the training sample; no corpus row is labelled for this).  Half of them fit the trees, the other
half fit the calibration (Platt's sigmoid) and the threshold: the least calibrated probability
at which the precision on that half is at least ``PRECISION``.

Null and empty texts have no spans; a null doc_id stays null; repeated rows are judged one by one.
The patterns start only where a run of their characters starts and give no character back, so very
long texts take linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import rows, short_batches

KINDS = ("email", "ip", "card", "phone", "loose_email", "loose_number", "loose_account")
EXAMPLES, PRECISION, TREES, RATE, CONTEXT = 6000, 0.99, 60, 0.3, 24
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "loose_email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[\w-]{1,64}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,64}+)+"),
    "loose_number": re.compile(r"(?<![\w+.-])\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+(?!\w)"),
    "loose_account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
}
# fixed values: words before a span that speak for or against personal data
_FOR = ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "ssn", "social", "account", "iban", "card", "telefon", "telefono", "appel", "konto")
_AGAINST = ("order", "price", "total", "version", "page", "year", "isbn", "item", "date", "invoice", "section", "no")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            last = found.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int((p.lstrip("0") or "0")[:4]) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "at)" in text or "at]" in text:
        out += [("loose_email", *m.span()) for m in _LOOSE["loose_email"].finditer(text)]
    out += [("loose_number", *m.span()) for m in _LOOSE["loose_number"].finditer(text) if m.end() - m.start() < 40 and 7 <= len(_digits(m[0])) <= 19]
    out += [("loose_account", *m.span()) for m in _LOOSE["loose_account"].finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    words = re.findall(r"\w+", before)[-3:]
    iban = 0.0
    if kind == "loose_account":
        s = span.replace(" ", "")
        iban = float(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    return [
        float(kind == "loose_email"), float(kind == "loose_number"), float(kind == "loose_account"), float(len(digits)), float(len(groups)),
        float(groups[0].__len__() if groups else 0), float(len(groups[-1]) if groups else 0), float(sum(span.count(c) for c in "-")), float(span.count(".")),
        float("(" in span), float(any(w.startswith(_FOR) for w in words)), float(any(w in _AGAINST for w in words)), iban, float(luhn(digits)) if digits else 0.0, float([len(g) for g in groups] == [3, 2, 4]),
    ]


# --- gradient boosted trees of depth two ---------------------------------------------------


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
    best = (0, np.inf, -1.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] < cut
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[2] + 1e-12:
                best = (j, float(cut), float(gain))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list[tuple]:
    """Trees (feature, cut, (feature, cut, leaf, leaf) twice), by second-order logistic boosting."""
    out, score = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        j, cut, _ = _split(x, g, h)
        sides, step = [], np.zeros(len(y))
        for side in (x[:, j] < cut, x[:, j] >= cut):
            if not side.any():
                sides.append((0, np.inf, 0.0, 0.0))
                continue
            k, c, _ = _split(x[side], g[side], h[side])
            low = side & (x[:, k] < c)
            high = side & (x[:, k] >= c)
            leaf = [RATE * g[s].sum() / (h[s].sum() + 1) for s in (low, high)]
            step[low], step[high] = leaf
            sides.append((k, c, *leaf))
        score += step
        out.append((j, cut, *sides))
    return out


def raw_score(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j, cut, a, b in trees:
        total += np.where(x[:, j] < cut, np.where(x[:, a[0]] < a[1], a[2], a[3]), np.where(x[:, b[0]] < b[1], b[2], b[3]))
    return total


def examples(n: int = EXAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = random.Random(seed)
    num = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randrange(3, 9)))

    def account():
        body = "".join(draw.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    good = [
        lambda: draw.choice(_FOR) + " " + num(3) + draw.choice("-. ") + num(3) + draw.choice("-. ") + num(4),
        lambda: draw.choice(_FOR) + " (" + num(3) + ") " + num(3) + "-" + num(4),
        lambda: draw.choice(_FOR) + " " + num(3) + "-" + num(2) + "-" + num(4),
        lambda: draw.choice(_FOR) + " " + num(draw.randrange(9, 12)),
        lambda: f"{word()} {word()} (at) {word()} (dot) com",
        lambda: f"{word()} {word()}[at]{word()}.org",
        lambda: f"{word()} {account()}",
    ]
    bad = [
        lambda: word() + " " + num(draw.randrange(7, 20)),
        lambda: draw.choice(_AGAINST) + " " + num(draw.randrange(7, 14)),
        lambda: word() + f" 20{num(2)}-0{num(1)}-1{num(1)}",
        lambda: draw.choice(_AGAINST) + f" {num(3)}.{num(3)}.{num(3)}",
        lambda: f"{word()} {num(4)} {num(4)} {num(2)}",
        lambda: f"{draw.choice(_AGAINST)} AB{num(2)}{num(16)}",
        lambda: f"{word()} {num(3)}-{num(draw.randrange(1, 9))}-{num(1)}",
    ]
    x, y = [], []
    while len(x) < n:
        label = draw.randrange(2)
        text = draw.choice(good if label else bad)() + " " + word()
        for span in loose_spans(text):
            x.append(features(text, *span))
            y.append(label)
    return np.array(x[:n]), np.array(y[:n], dtype=float)


@lru_cache(1)
def model() -> tuple:
    """(trees, slope, offset, threshold)."""
    x, y = examples()
    half = len(x) // 2
    trees = fit(x[:half], y[:half])
    raw, want = raw_score(trees, x[half:]), y[half:]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Platt's sigmoid by Newton steps
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        w = np.maximum(p * (1 - p), 1e-9)
        aa, ab, bb = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-3
        u, v = (raw * (want - p)).sum(), (want - p).sum()
        slope, offset = slope + (bb * u - ab * v) / (aa * bb - ab * ab), offset + (aa * v - ab * u) / (aa * bb - ab * ab)
    p = 1 / (1 + np.exp(-(slope * raw + offset)))
    order = np.argsort(-p)
    precise = np.cumsum(want[order]) / np.arange(1, len(p) + 1)
    fine = np.flatnonzero((precise >= PRECISION) & (np.append(np.diff(p[order]) < 0, True)))
    return trees, slope, offset, float(p[order][fine[-1]]) if len(fine) else 1.1


def selected(text: str, given: tuple) -> tuple[list, list]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    proposed = loose_spans(text)
    if proposed:
        trees, slope, offset, threshold = given
        p = 1 / (1 + np.exp(-(slope * raw_score(trees, np.array([features(text, *s) for s in proposed])) + offset)))
        proposed = [s for s, q in zip(proposed, p, strict=True) if q >= threshold]
    return base, base + proposed


def _line(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    given = model()
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [selected(t or "", given) for t in batch["text"].to_pylist()]
            number = {k: [sum(s[0] == k for s in b) for b, _ in found] for k in KINDS[:4]}
            yield rows(RESULT, doc_id=batch["doc_id"].to_pylist(), n_email=number["email"], n_ip=number["ip"], n_card=number["card"], n_phone=number["phone"], base_sha256=[hashlib.sha256(_line(b).encode()).hexdigest() for b, _ in found], spans=[_line(s) for _, s in found])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each union of overlapping spans becomes the kind of its first span in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.removeprefix('loose_').upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def stage(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text``; a column n_chars, where given, follows the text."""
    given, names = model(), docs.columns
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            new = [None if t is None else redact(t, selected(t, given)[1]) for t in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if "n_chars" in names:
                at = batch.schema.get_field_index("n_chars")
                kind = batch.schema.field(at).type
                batch = batch.set_column(at, batch.schema.field(at), pa.array([old if t is None else len(t) for t, old in zip(new, batch["n_chars"].to_pylist(), strict=True)], kind))
            yield batch

    return docs.mapInArrow(run, docs.schema)

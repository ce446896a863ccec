"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. A document's
mentions are these spans and everything else that looks like a number of some length or a
spelled-out address. The field labels mentions with a kind or none. Neighbouring mentions
share a chain potential. Mentions of the same normal form (the last digits, or the address
in one spelling), however far apart, share a skip potential through a node of their own, so
a group of any size has as many skip edges as members. Shorter numbers are mentions if they
repeat the parts of a short base span or the local part of a phone number. Base spans are evidence; loopy
messages carry it to the other mentions of the form. Weights are learnt from the base spans
of a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import expand_rows, fresh, table

#: The kinds in the order of the output; label 0 is none.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: Documents with digits that the weights are learnt from at most, and how many are looked at for each.
SAMPLE, LOOKED_AT = 2000, 20
#: Trust that a mention which no base pattern takes is none.
UNLABELLED_TRUST = 0.8
#: Log odds of none for shapes that the sample lacks, and how strongly weights are held to them.
NONE_PRIOR, DECAY = 3.0, 0.01
ROUNDS, DAMPING, CLAMP = 30, 0.3, 30.0
#: Digits that numbers must end in alike to share a skip potential.
SAME_DIGITS = 8
#: Digits of a phone number without its area code.
LOCAL_DIGITS = 7

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would have started at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_=@])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9])+(?![A-Za-z0-9_@])")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_AT = re.compile(r"@|\[at\]|\(at\)|\x20at\x20", re.IGNORECASE)
_DOT = re.compile(r"\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?", re.IGNORECASE)
_DIGITS = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, each kind leftmost and without overlap. Linear in the text."""
    found: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    if not re.search("[0-9]", text):
        return found
    found += ((1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    found += ((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15)
    return found


@dataclass
class Mentions:
    """What the field labels in one document, in order of place."""

    spans: list[tuple[int, int]]
    known: list[int]  # the base label, 0 where none
    features: np.ndarray
    group: list[int]  # the skip node, -1 for none


FEATURES = 17


def _features(s: str) -> list[float]:
    figures = _DIGITS.sub("", s)
    digits = len(figures)
    card = 13 <= digits <= 19
    valid = card and _luhn(figures)
    dots, dashes, spaces = s.count("."), s.count("-"), s.count(" ")
    return [
        1.0, digits / 10, float("@" in s), float("at" in s.lower()), float(s[0] == "+"), float("(" in s), float(dots == 3), float(0 < dots < 3),
        float(dashes > 0), float(spaces > 0), float(digits < 7), float(7 <= digits <= 9), float(10 <= digits <= 12), float(valid), float(card and not valid), float(digits > 19), float("/" in s),
    ]


def _short_forms(base: list[tuple[int, str]]) -> dict[str, str]:
    """What a number of too few digits can repeat, and its form: a short base span part by part
    (the digits alone could be a year or a count), or the end of a phone number."""
    forms: dict[str, str] = {}
    for kind, s in base:
        digits = _DIGITS.sub("", s)
        if KINDS[kind] == "phone":
            forms.setdefault(digits[-LOCAL_DIGITS:], digits[-SAME_DIGITS:])
        elif KINDS[kind] != "email" and len(digits) < SAME_DIGITS:
            parts = _DIGITS.sub(".", s)
            forms[parts] = parts
    return forms


def _form(s: str, short: dict[str, str]) -> str | None:
    """The normal form that repeated and similar mentions share."""
    low = s.lower()
    if "@" in low or "at" in low:
        return re.sub(r"\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?", ".", re.sub(r"\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?", "@", low)).replace(" ", "")
    digits = _DIGITS.sub("", s)
    return digits[-SAME_DIGITS:] if len(digits) >= SAME_DIGITS else short.get(digits) or short.get(_DIGITS.sub(".", s).strip("."))


def _spelled(text: str, addresses: set[str]) -> Iterator[tuple[int, int]]:
    """What looks like an address. The next sentence can look like more of the domain, so a known address ends where it does."""
    at = 0
    while m := _SPELLED.search(text, at):
        ends = [m.end(), *(m.start() + d.start() for d in reversed(list(_DOT.finditer(m[0]))))]
        at = next((e for e in ends if _form(text[m.start() : e], {}) in addresses), m.end())
        yield m.start(), at


def mentions(text: str, base: list[Span]) -> Mentions:
    """Base spans, of overlapping ones the first, and what else looks like a number or an address beside them."""
    known = {}
    last = -1
    for kind, a, b in sorted(base, key=lambda x: (x[1], x[0])):
        if a >= last:
            known[a, b] = kind + 1
            last = b
    taken = sorted((a, b) for _, a, b in base)
    short = _short_forms([(kind - 1, text[a:b]) for (a, b), kind in known.items()])
    loose = []
    patterns: list[Iterator[tuple[int, int]]] = [(m.span() for m in _NUMBER.finditer(text))]
    if _AT.search(text):
        patterns.append(_spelled(text, {_form(text[a:b], {}) for (a, b), kind in known.items() if kind == 1}))
    for pattern in patterns:
        k = 0
        for a, b in pattern:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if (k == len(taken) or taken[k][0] >= b) and _form(text[a:b], short):
                loose.append((a, b))
    for s in sorted(loose):
        known.setdefault(s, 0)
    spans, clear = [], -1
    for s in sorted(known, key=lambda s: (s[0], -known[s])):
        if s[0] >= clear or known[s]:
            spans.append(s)
            clear = max(clear, s[1])
    forms = [_form(text[a:b], short) for a, b in spans]
    number: dict[str, int] = {}
    group = [-1 if f is None else number.setdefault(f, len(number)) for f in forms]
    features = np.array([_features(text[a:b]) for a, b in spans], np.float64).reshape(-1, FEATURES)
    return Mentions(spans, [known[s] for s in spans], features, group)


@dataclass
class Field:
    unary: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # LABELS x LABELS, log potentials of neighbours
    skip: float  # log potential of agreement with the skip node

    def marginals(self, m: Mentions) -> np.ndarray:
        """Beliefs of the mentions by loopy sum-product messages, all edges at once."""
        n, groups = len(m.spans), max(m.group, default=-1) + 1
        logs = np.zeros((n + groups, LABELS))
        logs[:n] = m.features @ self.unary
        known = np.array(m.known)
        fixed = np.flatnonzero(known)
        logs[fixed] = -CLAMP
        logs[fixed, known[fixed]] = 0
        skips = np.array([(k, n + g) for k, g in enumerate(m.group) if g >= 0], np.int64).reshape(-1, 2)
        chain = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
        potts = self.skip * np.eye(LABELS)
        start = np.concatenate([chain[:, 0], chain[:, 1], skips[:, 0], skips[:, 1]])
        end = np.concatenate([chain[:, 1], chain[:, 0], skips[:, 1], skips[:, 0]])
        table = np.concatenate([np.repeat(t[None], c, axis=0) for t, c in ((self.chain, n - 1), (self.chain.T, n - 1), (potts, 2 * len(skips)))])
        half = np.concatenate([np.arange(n - 1) + n - 1, np.arange(n - 1), 2 * (n - 1) + len(skips) + np.arange(len(skips)), 2 * (n - 1) + np.arange(len(skips))])
        messages = np.zeros((len(start), LABELS))
        for _ in range(ROUNDS):
            beliefs = logs.copy()
            np.add.at(beliefs, end, messages)
            out = (beliefs[start] - messages[half])[:, :, None] + table
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max(initial=0)
            messages = DAMPING * messages + (1 - DAMPING) * new
            if change < 1e-5:
                break
        beliefs = logs.copy()
        np.add.at(beliefs, end, messages)
        p = np.exp(beliefs[:n] - beliefs[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


Counts = dict[tuple[str, tuple[float, ...]], int]


def tally(found: list[Mentions]) -> Counts:
    """What the fit needs of these documents: how often each (shape, label), each pair of
    neighbouring labels, and agreement and disagreement of base mentions of one form occur."""
    counts: Counter = Counter()
    for m in found:
        counts.update(("mention", (*row, float(y))) for row, y in zip(m.features.tolist(), m.known))
        counts.update(("pair", (float(a), float(b))) for a, b in zip(m.known, m.known[1:]))
        first: dict[int, int] = {}
        for g, y in zip(m.group, m.known):
            if g >= 0 and y:
                counts["agree" if first.setdefault(g, y) == y else "differ", ()] += 1
    return counts


def fit(found: list[Mentions]) -> Field:
    return fit_counts(tally(found))


def fit_counts(counts: Counts) -> Field:
    """Weights from base labels: a softmax for the mentions, smoothed counts for neighbours, and
    the log odds that base mentions of one form agree. A mention that no pattern takes is none
    with UNLABELLED_TRUST, else of any kind."""
    mentioned = sorted((key, n) for (kind, key), n in counts.items() if kind == "mention")
    rows = np.array([key[:-1] for key, _ in mentioned]).reshape(-1, FEATURES)
    known = np.array([int(key[-1]) for key, _ in mentioned], np.int64)
    times = np.array([n for _, n in mentioned], np.float64)[:, None]
    target = np.full((len(known), LABELS), (1 - UNLABELLED_TRUST) / (LABELS - 1))
    target[:, 0] = UNLABELLED_TRUST
    target[known > 0] = np.eye(LABELS)[known[known > 0]]
    prior = np.zeros((FEATURES, LABELS))
    prior[0, 0] = NONE_PRIOR
    w = prior.copy()
    if len(rows):
        for _ in range(400):
            z = rows @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w += rows.T @ (times * (target - p)) / times.sum() - DECAY * (w - prior)
    pairs = np.full((LABELS, LABELS), 5.0)
    for (kind, key), n in counts.items():
        if kind == "pair":
            pairs[int(key[0]), int(key[1])] += n
    agree, differ = 400.0 + counts.get(("agree", ()), 0), 1.0 + counts.get(("differ", ()), 0)
    expected = pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True) / pairs.sum()
    return Field(w, np.clip(np.log(pairs / expected), -1, 1), float(np.clip(np.log(agree / differ), 2, 8)))


def train(docs: DataFrame, sample: int = SAMPLE) -> Broadcast:
    """Learns on documents with digits, `sample` at most: those with the smallest hashes of ids
    in a share of the table that has about LOOKED_AT documents for each one wanted.

    The documents are counted where they are read; the driver gets one row per shape of a
    mention and label, however many mentions there are.
    """
    share = min(1.0, LOOKED_AT * sample / max(1, docs.count()))
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    some = docs.select("doc_id", "text").filter(inside & F.col("text").rlike("[0-9]")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = tally([mentions(text, base_spans(text)) for text in chunk.column("text").to_pylist()])
        columns = [pa.array([k for k, _ in counts]), pa.array([list(key) for _, key in counts], pa.list_(pa.float64())), pa.array(list(counts.values()), pa.int64())]
        if counts:
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

    rows = expand_rows(some, "text", compute, "kind string, key array<double>, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    return docs.sparkSession.sparkContext.broadcast(fit_counts({(r["kind"], tuple(r["key"])): r["n"] for r in rows}))


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans, by kind and start."""
    base = sorted(base_spans(text)) if text else []
    m = mentions(text or "", base)
    if all(m.known):
        # Nothing is left to label.
        return base, base
    p = field.marginals(m)
    best = p.argmax(axis=1)
    more = [(int(y) - 1, a, b) for (a, b), y, known, row in zip(m.spans, best, m.known, p) if not known and y and row[y] > 0.5]
    return base, sorted(base + more)


def found(docs: DataFrame, field: Broadcast, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with the base spans and all spans of each whole text: arrays of kind, start, end in
    code points, end exclusive, by kind and start.

    A missing text is empty and has none. Names that docs has already get underscores ahead.
    """
    names = base, spans = fresh(docs, base, spans)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        both = [all_spans(t, field.value) for t in chunk.column("text").to_pylist()]
        told = [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in one] for one in column] for column in zip(*both)]
        yield pa.RecordBatch.from_arrays([*chunk.columns, *(pa.array(c, kind) for c in told)], names=[*chunk.schema.names, *names])

    spark_kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return expand_rows(docs, "text", compute, T.StructType([*docs.schema.fields, *(T.StructField(n, spark_kind) for n in names)]))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found(docs, train(docs)).select(
        "doc_id",
        *(F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(told("base").cast("binary"), 256).alias("base_sha256"),
        told("spans").alias("spans"),
    )

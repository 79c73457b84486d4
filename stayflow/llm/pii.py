"""Personal data: fixed patterns, and a span classifier trained by weak supervision.

Base spans are what the fixed patterns of e-mail addresses, IP addresses, card numbers and phone numbers find and their
checks let pass; they always stay. Beside them, wider patterns give candidates: addresses with `(at)` and `dot`, numbers with
unusual separators, phone numbers without a country code, numbers that fail a check.

Six labelers vote on every candidate and every base span: two by shape (`check`, `shape`), one by gazetteers (`list`), two by the
words before it that speak for or against it (`for`, `against`), one by the characters around it (`edge`). Spark counts how often
each pattern of votes occurs over all texts, per kind; the patterns are at most 3 ** 6 times the shapes. Expectation
maximisation over these counts estimates how reliable each labeler is for each kind (with a prior that says how far each
is to be trusted at first) and how likely each pattern is personal. These chances are the soft labels on
which a logistic classifier over votes and shapes is trained. Candidates that it gives THRESHOLD or more are added, the
likelier first, unless they touch a base span or one added before.

Texts are read once, whole; every pattern goes over a text in linear time (a run is never entered twice), so a text of one
long word or number is no special case. What is kept of a text are its spans. Null and empty texts have none; repeated rows
and null ids are judged like others. If there is no candidate at all, only base spans are told.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import slices
from stayflow.session import work_dir

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
THRESHOLD = 0.9
ROUNDS = 60

# The patterns of the base spans.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider patterns; no run of characters is entered in its middle.
_AT_SIGNS = ("(at)", "[at]", "{at}", " at ", " @ ")
_FAR_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{1,63}+)++")
_FAR_IP = re.compile(r"(?<![0-9.])[0-9]++(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]++){3}(?![0-9.]*[0-9])")
_FAR_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9])++")
_FAR_PHONE = re.compile(r"(?<![0-9+])(?:\(0?[0-9]{2,5}\)|[0-9]{2,6})(?:[ ./-][0-9]{2,6}){1,4}(?![0-9])")
#: Stretches of the characters of all number patterns, fixed and wider: no match lies across their ends.
_NUMBERS = re.compile(r"[0-9(+][][0-9 ()./_+-]*")
_SHORTEST = 7

# Gazetteers and cue words, in the languages that are met most.
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "at", "ch", "pl", "nl"}
COUNTRY_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54",
                 "55", "61", "81", "86", "90", "91", "351", "353", "358", "420"}
RESERVED_NETS = ("0.", "10.", "127.", "169.254.", "192.168.", "255.")
CARD_STARTS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|3[068]")
CUES = {
    EMAIL: r"e-?mail|mail|correo|courriel|contact|kontakt|write|reach",
    IP: r"\bip\b|server|host|address|adresse|login|dirección",
    CARD: r"card|karte|tarjeta|carte|visa|mastercard|amex|credit|kredit|payment",
    PHONE: r"phone|tel\b|tel\.|call|mobile|handy|fax|teléfono|téléphone|telefon|ruf|whatsapp",
}
CUES_AGAINST = {
    EMAIL: r"class|package|import|repo",
    IP: r"version|\bv\b|release|section|kapitel|chapter|build",
    CARD: r"isbn|order|serial|tracking|invoice|bestell|pedido|commande|\bid\b|token|hash",
    PHONE: r"isbn|version|date|datum|fecha|order|page|seite|score|\bid\b|token|rows?\b",
}
_FOR = {k: re.compile(v, re.IGNORECASE) for k, v in CUES.items()}
_AGAINST = {k: re.compile(v, re.IGNORECASE) for k, v in CUES_AGAINST.items()}
CUE_REACH = 40

LABELERS = ("check", "shape", "list", "for", "against", "edge")
#: How often each labeler is right at first, and the weight of that in shares of all votes: a failed check stays a strong sign.
TRUST = {"check": (0.99, 1.0), "shape": (0.8, 0.1), "list": (0.8, 0.1), "for": (0.9, 0.1), "against": (0.9, 0.1), "edge": (0.7, 0.1)}
SHAPES = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: each `@` with the longest local part before it that no earlier address or `@` has, and a domain after it."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def _stretches(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= _SHORTEST]


def base_spans(text: str, numbers: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(EMAIL, a, b) for a, b in _email_spans(text)]
    numbers = _stretches(text) if numbers is None else numbers
    for lo, hi in numbers:
        out += [(IP, m.start(), m.end()) for m in _IP.finditer(text, lo, hi) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    for kind, pattern, least, most in ((CARD, _CARD, 13, 19), (PHONE, _PHONE, 9, 15)):
        for lo, hi in numbers:
            for m in pattern.finditer(text, lo, hi):
                digits = _digits(m.group()) if m.end() - m.start() >= least else ""
                if least <= len(digits) <= most and (kind == PHONE or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return out


def candidates(text: str, numbers: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the wider patterns."""
    out = []
    for sign in _AT_SIGNS:
        at = text.find(sign)
        while at >= 0:
            end = at + len(sign)
            tail = _FAR_DOMAIN.match(text, end + (text[end:end + 1] == " "))
            if tail:
                stop = at - (text[at - 1:at] == " ")
                head = text[max(0, stop - 64):stop]  # a local part has at most 64 characters
                size = len(head) - len(head.rstrip(_LOCAL))
                if size:
                    out.append((EMAIL, stop - size, tail.end()))
            at = text.find(sign, end)
    for lo, hi in _stretches(text) if numbers is None else numbers:
        for kind, pattern, least, most in ((IP, _FAR_IP, 4, 12), (CARD, _FAR_CARD, 13, 19), (PHONE, _FAR_PHONE, 7, 15)):
            for m in pattern.finditer(text, lo, hi):
                if least <= m.end() - m.start() <= 4 * most and least <= len(_digits(m.group())) <= most:
                    out.append((kind, m.start(), m.end()))
    return out


def _sign(yes: bool) -> int:
    return 1 if yes else -1


def votes(text: str, kind: int, start: int, end: int) -> tuple[tuple[int, ...], int]:
    """The labelers' votes on a span (1 personal, -1 not, 0 none), and its shape (below SHAPES)."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - CUE_REACH):start]
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    edge = _sign(not any(c.isalnum() or c in "=\"'/_#@+" for c in around))
    if kind == EMAIL:
        parts = re.split(r" ?[(\[{]dot[)\]}] ?| dot |\.", re.split(r"@|[(\[{]at[)\]}]| at ", span)[-1])
        check = 1 if "@" in span and " " not in span else 0 if re.search(r"[(\[{]at", span) else -1
        shape = _sign(any(c.isalpha() for c in span[:1]) and parts[-1].isalpha() and len(parts[-1]) >= 2)
        listed = _sign(parts[-1].lower() in DOMAIN_ENDS)
    elif kind == IP:
        parts = re.findall(r"[0-9]+", span)
        check = _sign(len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts))
        shape = _sign(all(p == "0" or p[:1] != "0" for p in parts))
        listed = _sign(not ".".join(parts).startswith(RESERVED_NETS))
    elif kind == CARD:
        check = _sign(luhn(digits))
        shape = _sign(len(digits) in (15, 16))
        listed = _sign(CARD_STARTS.match(digits) is not None)
    else:
        told = span.startswith("+") or span.startswith("00")
        code = digits[2:] if span.startswith("00") else digits
        check = 1 if told else 0 if span.startswith("(0") else -1
        shape = _sign(9 <= len(digits) <= 13)
        listed = _sign(told and any(code.startswith(c) for c in COUNTRY_CODES))
    cue = 1 if _FOR[kind].search(before) else 0
    against = -1 if _AGAINST[kind].search(before) else 0
    marks = len({c for c in span if not c.isalnum()})
    form = min(marks, 3) * 4 + min(len(span) // 8, 3)
    return (check, shape, listed, cue, against, edge), form


def pattern_code(kind: int, given: tuple[int, ...], form: int) -> int:
    code = kind
    for v in given:
        code = code * 3 + v + 1
    return code * SHAPES + form


def pattern_of(code: int) -> tuple[int, tuple[int, ...], int]:
    code, form = divmod(code, SHAPES)
    given = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        given.append(v - 1)
    return code, tuple(reversed(given)), form


def reliabilities(given: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over patterns of votes (patterns, labelers) that occur `counts` times.

    Returns the chance of each pattern to be personal, how each labeler votes [labeler, class, vote + 1], and the share
    of personal spans. A labeler that says nothing takes no part.
    """
    n = counts.sum()
    cast = (given != 0).sum(axis=1)
    chance = np.where(cast > 0, (given > 0).sum(axis=1) / np.maximum(cast, 1), 0.5)
    told = np.zeros((given.shape[1], 2, 3))
    share = 0.5
    for _ in range(rounds):
        share = float((counts @ chance + 1) / (n + 2))
        for k, name in enumerate(LABELERS[:given.shape[1]]):
            right, weight = TRUST[name]
            for y, w in ((0, counts * (1 - chance)), (1, counts * chance)):
                votes_of = np.array([w[given[:, k] == v].sum() for v in (-1, 1)])
                prior = np.array([right, 1 - right]) if y == 0 else np.array([1 - right, right])
                votes_of = votes_of + prior * (weight * max(w.sum(), 1) + 1)
                told[k, y, [0, 2]] = votes_of / votes_of.sum()
        odds = np.full(len(counts), np.log(share / (1 - share)))
        for k in range(given.shape[1]):
            ratio = np.array([np.log(told[k, 1, 0] / told[k, 0, 0]), 0.0, np.log(told[k, 1, 2] / told[k, 0, 2])])
            odds += ratio[given[:, k] + 1]
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return chance, told, share


def _inputs(kinds: np.ndarray, given: np.ndarray, form: np.ndarray) -> np.ndarray:
    """What the classifier sees: per kind, the votes for and against, and the shape."""
    own = np.concatenate([given > 0, given < 0, (form[:, None] == np.arange(SHAPES)), np.ones((len(form), 1), bool)], axis=1)
    return np.concatenate([own & (kinds == k)[:, None] for k in range(len(KINDS))], axis=1).astype(float)


class SpanModel:
    """weights of the classifier; told: per kind, how each labeler votes by class."""

    def __init__(self, weights: np.ndarray, told: dict[int, np.ndarray]):
        self.weights, self.told = weights, told

    def chances(self, codes: list[int]) -> np.ndarray:
        if not codes:
            return np.zeros(0)
        parts = [pattern_of(c) for c in codes]
        x = _inputs(np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(patterns: list[tuple[int, int]]) -> SpanModel | None:
    """A model from (pattern code, count) pairs, None without any."""
    if not patterns:
        return None
    codes, counts = [c for c, _ in sorted(patterns)], np.array([n for _, n in sorted(patterns)], float)
    parts = [pattern_of(c) for c in codes]
    kinds, given, form = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    label, told = np.zeros(len(codes)), {}
    for kind in np.unique(kinds):
        own = kinds == kind
        label[own], told[int(kind)], _ = reliabilities(given[own], counts[own])
    x = _inputs(kinds, given, form)
    # Rare patterns count little, frequent ones not without bound; Newton steps on the penalised likelihood.
    weight, w = np.log1p(counts), np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (label - p)) - 0.05 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step / max(1.0, np.abs(step).max() / 3)
    return SpanModel(w, told)


_SPANS = "array<struct<kind: int, begin: int, end: int, code: long, base: boolean>>"


def _find(columns: int):
    """Rows with the text last: the other columns and the spans with their patterns of votes."""
    span = pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("code", pa.int64()), ("base", pa.bool_())])

    def told(text: str) -> list[dict]:
        numbers = _stretches(text)
        base = base_spans(text, numbers)
        known = set(base)
        both = [(s, True) for s in base] + [(s, False) for s in candidates(text, numbers) if s not in known]
        return [{"kind": k, "begin": a, "end": b, "code": pattern_code(k, *votes(text, k, a, b)), "base": fixed} for (k, a, b), fixed in both]

    def work(batches):
        for batch in batches:
            for rows, _, _ in slices(batch):
                found = [told(t) if t else [] for t in rows.column(columns).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:columns], pa.array(found, pa.list_(span))], [*rows.schema.names[:columns], "found"])

    return work


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def added(base: list[tuple[int, int, int]], others: list[tuple[float, int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Of others (chance, kind, start, end): those that reach `least`, the likelier first, that touch nothing taken before."""
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    out = []
    for chance, kind, a, b in sorted(others, key=lambda s: (-s[0], *s[1:])):
        at = bisect_right(taken, (a, b))
        if chance >= least and (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    return out


def _decide(columns: int, chance: dict[int, float], least: float):
    def work(batches):
        for batch in batches:
            base, every = [], []
            for found in batch.column(columns).to_pylist():
                fixed = [(s["kind"], s["begin"], s["end"]) for s in found if s["base"]]
                others = [(chance.get(s["code"], 0.0), s["kind"], s["begin"], s["end"]) for s in found if not s["base"]]
                base.append(fixed)
                every.append(fixed + added(fixed, others, least))
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
            sums = pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base])
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *counts, sums, pa.array([_joined(s) for s in every])],
                                             [*batch.schema.names[:columns], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return work


def find_personal(docs: DataFrame, least: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans per kind, base_sha256 of them, and spans: all of them as kind:start:end.

    Places are code points, the end is exclusive. Other columns of `docs` are not used, whatever their names.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "personal")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = rows.select("doc_id").schema
    found_schema = rows.select("doc_id", F.expr(f"cast(array() as {_SPANS})").alias("found")).schema
    rows.mapInArrow(_find(1), found_schema).write.parquet(folder)
    found = spark.read.schema(found_schema).parquet(folder)
    # One row per kind, pattern of votes and shape: bounded, whatever the number of texts.
    patterns = found.select(F.explode("found.code").alias("code")).groupBy("code").count()
    counted = [(r.code, r["count"]) for r in patterns.collect()]
    model = train(counted)
    codes = [c for c, _ in counted]
    chance = dict(zip(codes, model.chances(codes).tolist())) if model else {}
    out = ", ".join([f"doc_id {kept[0].dataType.simpleString()}", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return found.mapInArrow(_decide(1, chance, least), out)

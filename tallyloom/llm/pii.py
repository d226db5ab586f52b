"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, payment cards and international telephone numbers. The field adds what
patterns miss (national telephone numbers, spelled-out addresses, identity numbers): it labels the tokens of a sentence by
their shapes, digits and neighbours, is trained on the small table in ``pii_examples`` (or another of that form) by
its exact gradient, and decodes sentences with Viterbi in numpy batches. Sentences without a digit or a sign of an address have nothing to find
and are not decoded. Spans of the field give way to those of the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import pii_examples, storage

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind changes no match: what fails from a run's first digit fails from the others. It keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SIGNS = re.compile(r"[0-9@]|[(\[]at[)\]]")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)", re.S)
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind; matches that fail their test are gone."""
    out = list(_emails(text))
    if not any(c in text for c in "0123456789"):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# --- features -------------------------------------------------------------------------------------------------------

_BUCKETS = (0, 2, 3, 4, 6, 7, 9, 11, 15, 19)


@lru_cache(maxsize=1 << 14)
def _own(token: str) -> tuple[str, ...]:
    core = token.strip(".,;:!?\"'")
    shape = re.sub(r"[A-ZÀ-Þ]+", "X", re.sub(r"[a-zß-ÿ]+", "x", re.sub(r"[0-9]+", "9", core[:60])))
    digits = _NOT_DIGIT.sub("", core)
    runs = "/".join(str(min(len(r), 9)) for r in re.findall(r"[0-9]+", core)[:5])
    bucket = next((b for b in _BUCKETS if len(digits) <= b), 99)
    out = [f"shape={shape[:16]}", f"digits={bucket}", f"runs={runs}"]
    if "@" in core:
        out.append("at-sign" if re.search(r"\w@\w", core) else "lone-at")
    if core.isalpha() or core in ("(at)", "[at]", "(dot)", "[dot]"):
        out.append(f"word={core.lower()}")
    if len(digits) >= 12:
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        out.append("dotted4")
    return tuple(out)


def features(tokens: list[str]) -> list[list[str]]:
    own = [_own(t) for t in tokens]
    out = []
    for i, mine in enumerate(own):
        row = ["bias", *mine]
        row += [f"-1:{f}" for f in own[i - 1]] if i else ["first"]
        row += [f"+1:{f}" for f in own[i + 1]] if i + 1 < len(own) else ["last"]
        if i > 1:
            row += [f"-2:{f}" for f in own[i - 2] if f.startswith("word=")]
        out.append(row)
    return out


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a linear-chain conditional random field: features by label, and label by next label."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, sentences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded emission scores (sentences, tokens, labels) and lengths; unknown features say nothing."""
        lengths = np.array([len(s) for s in sentences])
        out = np.zeros((len(sentences), int(lengths.max(initial=0)), len(LABELS)))
        for n, sentence in enumerate(sentences):
            for t, row in enumerate(sentence):
                out[n, t] = self.emit[[self.index[f] for f in row if f in self.index]].sum(axis=0)
        return out, lengths

    def viterbi(self, emission: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Best label sequences of a padded batch; ties go to the lower label."""
        n, longest, k = emission.shape
        best, back = emission[:, 0].copy(), np.zeros((n, longest, k), dtype=np.int16)
        for t in range(1, longest):
            through = best[:, :, None] + self.step[None]
            back[:, t] = through.argmax(axis=1)
            new = through.max(axis=1) + emission[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        out = []
        for i in range(n):
            path = [int(best[i].argmax())] if lengths[i] else []
            for t in range(int(lengths[i]) - 1, 0, -1):
                path.append(int(back[i, t, path[-1]]))
            out.append(path[::-1])
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def parse_example(line: str) -> tuple[list[str], list[int]]:
    """Tokens and labels of a marked text."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    text += line[at:]
    tokens, labels = [], []
    for m in _TOKEN.finditer(text):
        tokens.append(m[0])
        inside = [(k, a) for k, a, b in spans if m.start() < b and m.end() > a]
        labels.append(LABELS.index(f"{'B' if m.start() <= inside[0][1] else 'I'}-{inside[0][0]}") if inside else 0)
    return tokens, labels


def train(lines: Sequence[str], *, rounds: int = 250, penalty: float = 0.02, rate: float = 0.15) -> Field:
    """Fit the field to marked texts by the exact gradient of the penalised log-likelihood (a bounded, small table)."""
    parsed = [parse_example(line) for line in lines]
    rows = [features(tokens) for tokens, _ in parsed]
    index = {f: k for k, f in enumerate(sorted({f for s in rows for r in s for f in r}))}
    n, longest, k = len(rows), max(map(len, rows)), len(LABELS)
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((n, longest, len(index)))
    gold = np.zeros((n, longest, k))
    for i, (sentence, (_, labels)) in enumerate(zip(rows, parsed)):
        for t, row in enumerate(sentence):
            x[i, t, [index[f] for f in row]] = 1
            gold[i, t, labels[t]] = 1
    real = np.arange(longest)[None] < lengths[:, None]
    pairs = real[:, 1:]
    gold_step = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], pairs.astype(float))
    gold_emit = np.einsum("ntf,ntk->fk", x, gold)
    emit, step = np.zeros((len(index), k)), np.zeros((k, k))
    speed = [np.full_like(emit, 1e-8), np.full_like(step, 1e-8)]
    for _ in range(rounds):
        e = x @ emit
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = _logsum(forward[:, t - 1, :, None] + step[None], 1) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(step[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        total = _logsum(forward[:, -1], 1)[:, None]
        node = np.exp(forward + backward - total[:, :, None]) * real[:, :, None]
        through = forward[:, :-1, :, None] + step + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, :, None, None]
        edge = np.einsum("ntab,nt->ab", np.exp(np.minimum(through, 0.0)), pairs.astype(float))
        for w, g, s in (
            (emit, gold_emit - np.einsum("ntf,ntk->fk", x, node) - penalty * emit, speed[0]),
            (step, gold_step - edge - penalty * step, speed[1]),
        ):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(index, emit, step)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(pii_examples.rows())


_TRIM_LEFT, _TRIM_RIGHT = "\"'([<", ".,;:!?\"'>]"
_LEAST_DIGITS = {"phone": 7, "card": 16, "ip": 4, "id": 9, "email": 0}


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of the field in each text, one batch of sentences for all."""
    found: list[list[Span]] = [[] for _ in texts]
    places, rows = [], []
    for n, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            if _SIGNS.search(text, m.start(), m.end()):
                tokens = [t.span() for t in _TOKEN.finditer(text, m.start(), m.end())]
                if tokens:
                    places.append((n, tokens))
                    rows.append([text[a:b] for a, b in tokens])
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):  # sentences of like length, of bounded size together
        end = at + 1
        while end < len(order) and len(rows[order[end]]) * (end - at + 1) <= 20_000:
            end += 1
        chosen = order[at:end]
        for i, path in zip(chosen, field.viterbi(*field.scores([features(rows[i]) for i in chosen]))):
            n, tokens = places[i]
            found[n] += _path_spans(texts[n], tokens, path)
        at = end
    return found


def _path_spans(text: str, tokens: list[tuple[int, int]], path: list[int]) -> Iterator[Span]:
    t = 0
    while t < len(path):
        label = LABELS[path[t]]
        last = t
        if label != "O":
            kind = label[2:]
            while last + 1 < len(path) and LABELS[path[last + 1]] == f"I-{kind}":
                last += 1
            a, b = tokens[t][0], tokens[last][1]
            while a < b and text[a] in _TRIM_LEFT and not (text[a] in "([" and ({"(": ")", "[": "]"}[text[a]] in text[a:b])):
                a += 1
            while b > a and text[b - 1] in _TRIM_RIGHT and not (text[b - 1] == "]" and "[" in text[a:b]):
                b -= 1
            digits = len(_NOT_DIGIT.sub("", text[a:b]))
            address = "@" in text[a:b] or re.search(r"[(\[]at[)\]]", text[a:b])
            if digits >= _LEAST_DIGITS[kind] and (kind != "email" or address) and (kind != "card" or luhn(_NOT_DIGIT.sub("", text[a:b]))):
                yield kind, a, b
        t = last + 1


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, mine, more in zip(texts, base, field_spans(texts, field)):
        spans = sorted(mine, key=lambda s: (s[1], s[2]))
        extra = []
        for kind, a, b in more:
            if not any(x < b and y > a for _, x, y in spans):
                extra.append((kind, a, b))
        out.append((mine, mine + extra))
    return out


# --- on tables ------------------------------------------------------------------------------------------------------


def _mapped(docs: DataFrame, keys: list[str], schema: str, make, field: Field | None) -> DataFrame:
    storage.prepare(docs.sparkSession)
    field = field or default_field()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            signed = [i for i, t in enumerate(texts) if _SIGNS.search(t)]
            found: dict[int, tuple] = dict(zip(signed, all_spans([texts[i] for i in signed], field)))
            columns = make(texts, [found.get(i, ([], [])) for i in range(len(texts))], batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns.values()], [*keys, *columns])

    return docs.select(*(F.col(f"`{k}`") for k in keys), "text").mapInArrow(work, schema)


def _schema(docs: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (pattern spans as text), spans (all spans as text), n_added.

    Spans are ``kind:start:end`` in code points, end exclusive. NULL counts as an empty text; repeated rows are searched one by
    one; further columns are ignored. Sentences end at line ends and at full stops before white space.
    """

    def make(texts, found, batch):
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in BASE_KINDS}
        return counts | {
            "base": pa.array([joined(b) for b, _ in found], pa.string()),
            "spans": pa.array([joined(s) for _, s in found], pa.string()),
            "n_added": pa.array([len(s) - len(b) for b, s in found], pa.int64()),
        }

    columns = [*(f"n_{k} long" for k in BASE_KINDS), "base string", "spans string", "n_added long"]
    return _mapped(docs, ["doc_id"], ", ".join([*_schema(docs, ["doc_id"]), *columns]), make, field)


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; NULL texts stay NULL."""
    keys = [c for c in docs.columns if c != "text"]

    def make(texts, found, batch):
        nulls = batch.column(batch.num_columns - 1).is_null().to_pylist()
        out = []
        for text, (_, spans), null in zip(texts, found, nulls):
            parts, at = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [text[at:a], f"<{kind}>"]
                    at = b
                elif b > at:  # overlapping patterns: nothing of either may stay
                    at = b
            out.append(None if null else "".join([*parts, text[at:]]))
        return {"text": pa.array(out, pa.string())}

    schema = ", ".join([*_schema(docs, keys), "text string"])
    return _mapped(docs, keys, schema, make, field).select(*(F.col(f"`{c}`") for c in docs.columns))



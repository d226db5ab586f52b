"""Alignment of tokenizers against a plain definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import subword, textbytes, token_alignment

ROWS = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(subword.tokenizer_path(token_alignment.FIRST))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=subword.tokenizer_path(token_alignment.SECOND))


def byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def tokens(text, libraries):
    """(id, bytes) of both sides; none where bytes differ."""
    first, second = libraries
    if not text:
        return [], []
    alphabet = byte_of()
    a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in x) == want for x in (a, b)) else ([], [])


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(rows, libraries):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(text, libraries))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if len(a) < 300 else [
            (x, y) for x, y in zip([x[0] for x in a if x[2] in set(ends)], [y[0] for y in b if y[2] in set(ends)])
        ]
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in side if low <= s and t <= e) for side in (a, b)))
            low = e
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, na, nb, g, len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(s.encode()).hexdigest() if s else "")
        for d, na, nb, g, l, s in found
    ]


def rows_of_all_kinds():
    rng = random.Random(5)
    letters = ["a", "b", "The ", " ", "  ", "\n", "\t", "é", "ß", "日本", "▁", "1", "23", ".", "'s", "😀", "　", "\x00", "ing ", " un"]
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, " a "), (6, "<|endoftext|> <s></s> <0x41><unk>"), (6, "same"), (6, "same"), (None, "no key")]
    rows += [(10 + k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))) for k in range(300)]
    rows.append((999, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "Amet,", "naïve"]) + str(rng.randint(0, 99)) for _ in range(400))))
    return rows


def test_equals_the_definition(spark, libraries):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, ROWS)
    for name in ("slice", "pairs", "n_a", "of", "best"):
        docs = docs.withColumn(name, F.lit("x"))
    got = token_alignment.summarise(docs.repartition(4))
    want = Counter(brute(rows, libraries))
    assert Counter(map(tuple, got.collect())) == want
    assert sum(w[1] == 0 for w in want) > 5 and any(w[5] < w[4] for w in want)


@pytest.mark.parametrize("head", [0, 5, 40])
def test_counts_do_not_depend_on_the_head(spark, libraries, monkeypatch, head):
    monkeypatch.setattr(token_alignment, "SLICE", 200)
    rows = rows_of_all_kinds()
    got = token_alignment.summarise(spark.createDataFrame(rows, ROWS).repartition(3), head=head)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, libraries))


def test_overlaps_and_links(spark, libraries):
    rows = rows_of_all_kinds()[:120]
    got = token_alignment.align(spark.createDataFrame(rows, ROWS).coalesce(1)).collect()
    for (doc_id, text), r in zip(rows, got):
        a, b = tokens(text, libraries)
        assert (r["doc_id"], r["a_ids"], r["b_ids"]) == (doc_id, [i for i, _ in a], [i for i, _ in b])
        a, b = spans(a), spans(b)
        overlaps = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
        assert Counter(map(tuple, r["overlaps"])) == Counter(overlaps)
        assert {tuple(x) for x in r["links"]} == {(i, j) for i, j in overlaps if a[i][2] == b[j][2]}


def test_nothing(spark):
    assert token_alignment.summarise(spark.createDataFrame([], ROWS)).count() == 0
    got = token_alignment.summarise(spark.createDataFrame([(1, None)], ROWS)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_cut_pieces_encode_like_the_model(libraries):
    rng = random.Random(8)
    letters = "ab1'. \n\té– ß日,　<>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4000)] + ["x" * 5000, "  " * 40 + "a"]
    got = []
    pieces = subword.SpacedPieces(subword.tokenizer_path(token_alignment.SECOND))
    for part in textbytes.slices(pa.array([" " + t for t in texts]), 5000):
        e = pieces.encode_slice(part)
        got += [e.ids[a:b].tolist() for a, b in zip(e.bounds[:-1], e.bounds[1:])]
    assert got == libraries[1].encode(texts)
    assert pieces.cuttable and np.diff(part.bounds).min() > 0


@pytest.mark.parametrize("added", [True, False])
def test_strings_of_added_tokens(added):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(subword.tokenizer_path())
    if not added:
        library.encode_special_tokens = True
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y <|endoftext|>", "<|endof", "text|>", "", "plain  words", "é<|endoftext|>日"] * 3
    encoder = subword.Encoder(subword.tokenizer_path(), added)
    for limit in (7, 1 << 20):
        got = []
        for part in textbytes.slices(pa.array(texts), limit):
            e = encoder.encode_slice(part)
            got += [e.ids[a:b].tolist() for a, b in zip(e.bounds[:-1], e.bounds[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

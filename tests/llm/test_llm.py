"""Operators of the text-corpus subpackage on edge cases, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import (
    bitfilter,
    common_tokens,
    components,
    decontaminate,
    hyperlang,
    jaccard_groups,
    license_scan,
    packing,
    perplexity,
    pfor,
    pii,
    pii_examples,
    quality_rules,
    storage,
    subword,
    textbytes,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta,", "éta", "zeta", "theta.", "iota\n", "12", "kappa"]
    base = " ".join(rng.choice(words) for _ in range(60))
    near = base.split(" ")
    near[30] = "changed"
    long_text = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(60_000))
    return [
        (1, base, "en", "s", 1),
        (2, base, "en", "s", 1),
        (2, base, "en", "s", 1),
        (3, " ".join(near), None, None, None),
        (4, None, "en", "s", None),
        (5, "", "fr", "s", 0),
        (6, " \t\n ", "fr", None, 4),
        (7, "one", "fr", "s", 3),
        (8, "one TWO", "fr", "s", 7),
        (9, "ONE two", None, "s", 7),
        (10, long_text, "en", "s", len(long_text)),
        (None, "no key but words enough to count here", "en", "s", 5),
        (11, "日本語 テキスト １２３ é é é", None, "s", 9),
        (12, "123 456 +-*", "en", "s", 11),
        (13, "end <|endoftext|>  of text", "en", "s", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    """The rows with further columns whose names clash with those used inside."""
    docs = spark.createDataFrame(odd_rows, DOCS)
    for name in ("length", "score", "row", "h", "keys", "name", "part", "kept"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k > 6)) for k in range(1, 13)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


def tokens_of(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "made"):
        tokens_of.made = Tokenizer.from_file(subword.tokenizer_path())
    return tokens_of.made.encode(text or "", add_special_tokens=False).ids


# --- helpers --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [3, 1 << 20])
def test_words_and_hashes(limit):
    texts = ["Hello wörld  a\tb", None, "", "x", " lead trail ", "Ab-cd 12ñ!", "\n"] * 2
    for table, pattern in ((textbytes.SPACED, "[^\x20\x09-\x0d]+"), (textbytes.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashes = [], defaultdict(set)
        for part in textbytes.slices(pa.array(texts), limit):
            data = textbytes.lowered(part.data)
            a, b, at = textbytes.find_words(data, part.bounds, table)
            for k, h in enumerate(textbytes.hash_words(data, a, b).tolist()):
                hashes[bytes(data[a[k] : b[k]])].add(h)
            got += [[bytes(data[a[k] : b[k]]).decode() for k in range(at[i], at[i + 1])] for i in range(len(part))]
        assert got == [re.findall(pattern, (t or "").translate(_LOWER)) for t in texts]
        assert all(len(v) == 1 for v in hashes.values())
        assert len(set.union(*hashes.values())) == len(hashes)


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)]
    links += [(-5, 7), (200, 200), (None, 3)]
    parent = {x: x for e in links for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    touched = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces_encode_like_the_tokenizer():
    rng = random.Random(1)
    letters = "ab1'. \n\té– ß日,　 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "don't we'll", "a  b\n\n c", "<|endoftext|>", "a" * 3000, "é\n\nb é \n é x"]
    got = []
    for e in subword.Encoder(subword.tokenizer_path()).encode(pa.array(texts)):
        got += [e.ids[a:b].tolist() for a, b in zip(e.bounds[:-1], e.bounds[1:])]
    assert got == [tokens_of(t) for t in texts]


# --- 1: blocks ------------------------------------------------------------------------------------------------------


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    arrays = [[], [5], [2**32 - 1, 0, 7], np.arange(7000) % 3000, np.zeros(5000), rng.integers(0, 50_000, 9001)]
    for ids in arrays:
        ids = np.array(ids, dtype=np.uint32)
        for percentile in (0, 50, 90, 100):
            payload = pfor.encode_ids(ids, 100, percentile)
            assert (pfor.decode_ids(payload) == ids).all()
            assert (pfor.decode_ids(payload, 150, 420) == ids[150:420]).all()
    with pytest.raises(ValueError):
        pfor.decode_ids(b"x" * 40)


def test_token_files(spark, odd, odd_rows):
    path = storage.fresh_folder(spark, "t")
    pfor.write_ids(odd, path, block=64)
    got = pfor.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    start = 0
    for r, row in zip(got, order):
        ids = tokens_of(row[1]) + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_token_files_of_nothing(spark, empty):
    path = storage.fresh_folder(spark, "t")
    pfor.write_ids(empty, path)
    assert pfor.read_ids(spark, path).count() == 0


# --- 2: licences ----------------------------------------------------------------------------------------------------


def test_licence_inheritance(spark):
    files = [
        (1, "/a/LICENSE", "Released under the MIT License."),
        (2, "/a/x.py", "def f(): pass"),
        (3, "/a/b/y.py", "Licensed under the Apache License, Version 2.0.\nsome code that goes on and on for a while"),
        (4, "/a/b/z.py", None),
        (5, "/c/w.py", ""),
        (6, None, "All rights reserved."),
        (7, "/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (7, "/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (8, "/a/b/c/d/v.py", "license of what"),
    ]
    got = {(r["file_id"], r["licence"], r["own"], r["inherited_from"]) for r in license_scan.scan(
        spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {
        (1, "MIT", True, None),
        (2, "MIT", False, "/a"),
        (3, "Apache-2.0", True, None),
        (4, "GPL-3.0", False, "/a/b"),
        (5, None, False, None),
        (6, "Proprietary", True, None),
        (7, "GPL-3.0", True, None),
        (8, "GPL-3.0", False, "/a/b"),
    }
    none = spark.createDataFrame([], "file_id long, path string, text string")
    assert license_scan.scan(none).count() == 0


_MIT = """The MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""
_APACHE_HEADER = """#!/usr/bin/env tool
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
fn main() { something quite different; and more of it; }
""" + "let other = code_that_goes(on, and, on, 1, 2, 3);\n" * 5


def test_prose_with_template_words_is_set_aside(spark):
    """Texts that hold all words of a template far apart leave no units to compare, however often they do; each text is cut into units once."""
    words = " ".join(t for _, t in license_scan.TEMPLATES).split()
    prose = "\n".join(f"x{k} {w} y{k} the of z{k} w{k} v{k}" for k, w in enumerate(words * 3))
    header = "# Licensed under the Apache License,\n# Version 2.0.\n" + "code\n" * 5
    files = spark.createDataFrame([(1, "/p/a", prose), (2, "/q/b", header), (3, "/r/c", "THE THE the")], "file_id long, path string, text string")
    found = license_scan.scan(files)
    got = {r["file_id"]: (r["licence"], r["n_lines"]) for r in found.collect()}
    assert got[1] == (None, 0) and got[2][0] == "Apache-2.0" and got[3] == (None, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Union" not in plan
    kept = next(line for line in plan.splitlines() if "Filter" in line and "array_remove" in line)
    assert "aggregate(" in kept


def test_units_are_cut_into_terms_once(spark):
    """No filter repeats the cutting, and only units that hold a heavy term of a template are cut."""
    words = "mit_license MIT-License \u212aey \u0130SC caf\u00e9 LICENSE. x\u00adreleased"
    files = spark.createDataFrame(
        [(1, "/p/a", words), (2, "/q/b", "_Released_under the\tMIT (license)"), (3, "/r/c", "unlicensed\nreleasedunder the mitlicense"), (4, "/s/d", "")],
        "file_id long, path string, text string",
    )
    cut = {r["file_id"]: r["t"] for r in files.select("file_id", license_scan.terms(F.col("text")).alias("t")).collect()}
    assert cut == {f["file_id"]: license_scan._terms_of(re.sub("[^A-Za-z0-9]", " ", f["text"])) for f in files.collect()}
    found = license_scan.scan(files)
    assert {r["file_id"]: (r["licence"], r["n_lines"]) for r in found.collect()} == {1: (None, 0), 2: ("MIT", 1), 3: (None, 0), 4: (None, 0)}
    plan = re.sub(r"\s+", " ", found._jdf.queryExecution().optimizedPlan().toString().replace(":- ", "+- "))
    filters = [node for node in plan.split("+- ") if node.startswith("Filter")]
    assert filters and not any("lower(" in node for node in filters)


def test_a_common_unit_makes_no_rows_of_its_terms(spark):
    """However many files hold a licence line, its terms are weighed within its row."""
    files = spark.range(200).selectExpr("id AS file_id", "concat('/p/', id) AS path", "'Released under the MIT License.\\ncode' AS text")
    found = license_scan.scan(files)
    assert {(r["licence"], r["similarity"], r["n_lines"]) for r in found.collect()} == {("MIT", 1.0, 1)}
    assert "explode(_terms" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_wrapped_headers_and_licence_files(spark):
    gpl = "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "Preamble words that no template has at all. " * 50
    files = [
        (1, "/a/LICENSE", _MIT),
        (2, "/a/b/x.py", "print(1)"),
        (3, "/a/b/y.rs", _APACHE_HEADER),
        (4, "/g/COPYING.txt", gpl),
        (5, "/g/src/z.c", "int z;"),
        (6, "/h/notes.txt", gpl),
        (7, "/h/src/w.c", "int w;"),
        (8, "/i/whole", "Permission is hereby granted, free of\ncharge, to any person obtaining a copy of\nthis software and associated documentation files"),
        (9, "/i/v.c", None),
    ]
    got = {r["file_id"]: (r["licence"], r["own"], r["inherited_from"]) for r in license_scan.scan(
        spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", True, None),
        2: ("MIT", False, "/a"),
        3: ("Apache-2.0", True, None),
        4: ("GPL-3.0", True, None),
        5: ("GPL-3.0", False, "/g"),
        6: ("GPL-3.0", True, None),
        7: (None, False, None),
        8: ("MIT", True, None),
        9: ("MIT", False, "/i"),
    }


# --- 3: rules -------------------------------------------------------------------------------------------------------


def test_rules(spark, odd, odd_rows, labels, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(odd, labels).collect()}
    for doc_id, text, *_ in odd_rows:
        words, r = spaced(text), got[doc_id]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if spaced(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(odd, labels.limit(0)).count() == len(odd_rows)


def test_rules_count_overlapping_repeats(spark, labels):
    text = " ".join(["a b c d e f g h i", "x y", "a b c d e f g h i", "q"] + ["w"] * 12)
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels).first()
    words = text.split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    assert r["n_repeat_words"] == len(covered) > 18


# --- 4: benchmark ---------------------------------------------------------------------------------------------------


def brute_passages(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(_LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            wanted[tuple(words[i : i + n])].add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = pattern.findall((text or "").translate(_LOWER)), set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(words) - n + 1):
                if mine := wanted.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= mine
        ids = ",".join(sorted(found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_passages(spark, odd, odd_rows, empty):
    long_words = odd_rows[10][1].split(" ")
    items = [
        (1, " ".join(long_words[30_000:30_025])),
        (10, " ".join(long_words[-12:])),
        (2, "one-two"),
        (3, "éta"),
        (4, None),
        (5, ""),
        (6, "ALPHA beta gamma delta not there at all my friend no"),
        (7, " ".join(long_words[30_010:30_020])),
        (7, "日本語 テキスト"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(odd, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated"
    )
    assert Counter(map(tuple, got.collect())) == Counter(brute_passages([r[:2] for r in odd_rows], items))
    assert decontaminate.find_passages(empty, benchmark).count() == 0
    none = decontaminate.find_passages(odd, benchmark.limit(0)).collect()
    assert len(none) == len(odd_rows) and not any(r["contaminated"] for r in none)
    kept = decontaminate.keep_clean(odd, benchmark)
    assert kept.columns == odd.columns
    dirty = {r[0] for r in brute_passages([r[:2] for r in odd_rows], items) if r[5]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in odd_rows if r[0] not in dirty)


# --- 5 and 8: models ------------------------------------------------------------------------------------------------


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over characters, by its definition; p(history, letter)."""
    top = Counter()
    for t in texts:
        line = " ".join(["", *t.split(), ""])
        top.update(line[max(0, k - order + 1) : k + 1] for k in range(1, len(line)))
    levels = []
    counts = top
    for m in range(order, 0, -1):
        if m < order:
            # Left neighbours of a gram; a gram at a text's start has none, and keeps its count.
            fewer = Counter()
            for g, n in counts.items():
                fewer[g[-m:]] += 1 if len(g) > m else n
            counts = fewer
        own = {g: n for g, n in counts.items() if len(g) == m}
        of = [sum(n == k for n in own.values()) or 0 for k in (1, 2, 3, 4)]
        n1, n2, n3, n4 = (max(1, x) for x in of)
        y = n1 / (n1 + 2 * n2)
        d = [0.0, *(min(max(x, 0.05), k - 0.05) for x, k in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (1, 2, 3)))]
        levels.append((m, own, d))

    def p(history, letter):
        out = 1 / 256
        for m, own, d in reversed(levels):
            if len(history) < m - 1:
                break
            context = history[len(history) - m + 1 :]
            after = {g: n for g, n in own.items() if g[:-1] == context}
            if total := sum(after.values()):
                left = sum(d[min(n, 3)] for n in after.values()) / total
                n = after.get(context + letter, 0)
                out = (n - d[min(n, 3)]) / total + left * out
        return out

    return p


def test_kneser_ney_equals_its_definition(spark):
    from tallyloom.llm import kneser_ney as kn

    storage.prepare(spark)
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("aabcd") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = spark.createDataFrame([(t, 0) for t in texts], "text string, kind int")
    counts = storage.stored(kn.count_events(rows, textbytes.SPACED, False, 3).select("gram", F.col("n0").alias("n")), "counts")
    model = kn.Backing.of_model(kn.probabilities(counts, [3, 2, 1]))
    p = brute_model(texts, 3)
    for history in (" a", "ab", "zz", " ", "a ", "d", "cd"):
        packed = np.array([int.from_bytes((history + chr(b)).encode("latin-1"), "big") for b in range(1, 128)], dtype=np.uint64)
        got = np.exp(model.of(packed)[0])
        if len(history) == 2:
            assert got == pytest.approx([p(history, chr(b)) for b in range(1, 128)], rel=1e-9), history


def test_perplexity(spark, odd, odd_rows, labels, empty):
    got = perplexity.judge(odd, labels, quantile=0.5).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        text = next(x[1] for x in odd_rows if x[0] == r["doc_id"])
        assert (r["perplexity"] is None) == (not spaced(text))
        assert r["kept"] in (True, False)
    assert perplexity.judge(empty, labels).count() == 0
    assert not any(r["kept"] for r in perplexity.judge(odd, labels.limit(0)).collect())


def test_perplexity_tells_junk_from_prose(spark, sf_dir):
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = perplexity.judge(docs, known).join(known, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    assert np.mean(good) > 0.9


def test_perplexity_of_unseen_grams_in_a_large_model(spark):
    rng = np.random.default_rng(11)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", dtype=np.uint8)
    digits = np.frombuffer(b"0123456789     ", dtype=np.uint8)

    def text(of, size):
        return bytes(of[rng.integers(0, len(of), size)]).decode()

    # Some three million distinct runs of five bytes; the junk shares none of them.
    rows = [(k, text(letters, 20_000), "en") for k in range(200)] + [(1000 + k, text(digits, 2000), "en") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    known = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in perplexity.judge(docs, known).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(20))
    assert all(got[k]["kept"] for k in range(200))


def test_models_are_the_same_beyond_the_bound(spark, sf_dir, monkeypatch):
    """Given to all tasks or joined by n-gram, a model says the same."""
    from tallyloom.llm import kneser_ney as kn

    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = []
    for bound in (1 << 21, 0):
        monkeypatch.setattr(kn, "MODEL_ROWS", bound)
        found.append(
            (
                {r["doc_id"]: (r["perplexity"], r["threshold"], r["kept"]) for r in perplexity.judge(docs, known).collect()},
                {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, known).collect()},
            )
        )
    for one, other in zip(*found):
        assert one.keys() == other.keys()
        for k in one:
            assert one[k] == pytest.approx(other[k], rel=1e-9)


def test_toxicity(spark, odd, odd_rows, labels, empty):
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.score(odd, known).collect()
        assert len(got) == len(odd_rows)
        for r in got:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
            if r["doc_id"] is not None:
                assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_on_held_out_rows(spark, given):
    rng = random.Random(2)
    ordinary = ["the", "sun", "rises", "over", "hills", "rivers", "run", "slowly", "home", "birds", "sing", "again"]
    rows, known = [], []
    for k in range(600):
        words = [rng.choice(ordinary) for _ in range(40)]
        bad = k % 3 == 0
        for _ in range(3 * bad):
            words[rng.randrange(40)] = "vile" + rng.choice(["ness", "st", "r", ""])
        rows.append((k, " ".join(words)))
        known.append((k, int(bad)))
    got = toxicity.score(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    )
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in got.where("held_out").collect()]
    assert np.mean([p == t for p, t in held]) > 0.97


# --- 6: personal data -----------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("ab1234567890.@+-() %_xé") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text))
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_field_learns_its_table_and_decodes_exactly():
    field = pii.default_field()
    rows = [pii.parse_example(x) for x in pii_examples.rows()]
    wrong = sum(field.viterbi(*field.scores([pii.features(t)]))[0] != labels for t, labels in rows)
    assert wrong <= 2
    emission, lengths = field.scores([pii.features(["call", "(415)", "555-0199"]), pii.features(["x"])])
    paths = field.viterbi(emission, lengths)

    def value(n, path):
        return sum(emission[n, t, y] for t, y in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:]))

    import itertools

    for n in (0, 1):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=int(lengths[n])), key=lambda p: value(n, p))
        assert value(n, paths[n]) == pytest.approx(value(n, best))


def test_personal_data(spark, odd, odd_rows, empty):
    rows = [
        (1, "mail a.b@c.de, call (415) 555-0133 today"),
        (2, None),
        (3, ""),
        (4, "ip 10.0.0.1 and 4111 1111 1111 1111 é +1 (017) 555-7713."),
        (4, "plain words only"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = [tuple(r) for r in pii.find(docs).select("n_email", "n_ip", "n_card", "n_phone", "base", "spans").collect()]
    for (_, text), r in zip(rows, got):
        base = brute_spans(text or "")
        assert r[:5] == (*(sum(s[0] == k for s in base) for k in pii.BASE_KINDS), pii.joined(base))
        assert set(filter(None, r[4].split(","))) <= set(filter(None, r[5].split(",")))
    assert got[0][5] == "email:5:13,phone:20:34"
    masked = [r["text"] for r in pii.mask(docs).collect()]
    assert masked == ["mail <email>, call <phone> today", None, "", "ip <ip> and <card> é <phone>.", "plain words only"]
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == len(odd_rows)
    assert pii.find(empty).count() == 0


# --- 7: Jaccard -----------------------------------------------------------------------------------------------------


def brute_classes(rows, n=3, percent=90):
    sets = []
    for _, text in rows:
        words = spaced((text or "").translate(_LOWER))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        sets.append(grams)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(rows[i][0], len(s), min(least[root(i)], default=None)) for i, s in enumerate(sets)]


def chained_copies(seed: int):
    """Families of texts in which single words change step by step, around the threshold, and sets of every small size."""
    rng = random.Random(seed)
    rows, k = [], 0
    for size in [*range(1, 45), 80, 150, 300]:
        words = [f"w{rng.randint(0, 4000)}" for _ in range(size)]
        for _ in range(5):
            rows.append((k, " ".join(words)))
            k += rng.randint(1, 3)
            words = list(words)
            for _ in range(rng.randint(0, max(1, size // 60))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 4000)}"
            if rng.random() < 0.4:
                words = words + [f"z{rng.randint(0, 4000)}"] * rng.randint(1, 2) if rng.random() < 0.5 else words[1:] or words
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_classes(spark, percent):
    rows = chained_copies(percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_groups.link_documents(docs, percent=percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_classes(rows, percent=percent))


def test_jaccard_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "CHUNK_TOKENS", 300)
    rows = chained_copies(3)[:120] + [(5000 + k, f"{'a b c d e f g h i j k l m n o p q r s t u v w x y z ' * 2} {k}") for k in range(40)]
    got = jaccard_groups.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_classes(rows))


@pytest.mark.parametrize("common", [2, 3, 6])
def test_jaccard_classes_do_not_depend_on_what_is_common(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard_groups, "COMMON", common)
    rows = chained_copies(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((3, 90), (5, 80)):
        got = jaccard_groups.link_documents(docs, n=n, percent=percent).collect()
        assert Counter(map(tuple, got)) == Counter(brute_classes(rows, n, percent))


def test_common_tokens():
    rng = np.random.default_rng(1)
    numbers = np.sort(rng.integers(0, 1 << 32, 500, dtype=np.uint64))
    for x in (numbers, np.repeat(numbers, 2), numbers[:1]):
        assert (common_tokens.unpacked(common_tokens.packed(x), len(x)) == x).all()


def test_common_tokens_are_counted_over_all_tasks(spark, given):
    docs = spark.createDataFrame([r[:2] for r in given], "doc_id long, text string").repartition(5)

    def sets(part):
        tokens, bounds = jaccard_groups.token_sets(part, 3)
        return tokens, bounds, jaccard_groups.set_names(tokens, bounds)

    # One task counts equal sets once.
    one = docs.coalesce(1)
    storage.prepare(spark)
    counts, seen = Counter(), set()
    for part in textbytes.slices(pa.array([r[1] for r in given])):
        tokens, bounds, names = sets(part)
        for i, name in enumerate(names.tolist()):
            if name not in seen:
                seen.add(name)
                counts.update(common_tokens.places(tokens[bounds[i] : bounds[i + 1]]).tolist())
    for n_ranges in (256, 4096):
        got = [r["place"] for r in common_tokens.common(one, sets, 4, n_ranges).collect()]
        assert sorted(got) == sorted(t for t, n in counts.items() if n >= 4) and got
    more = {r["place"] for r in common_tokens.common(docs, sets, 4, common_tokens.ranges(docs)).collect()}
    assert more >= set(got)


def test_neighbourhoods_stay_small(spark):
    """Passages that many documents share do not join them to one neighbourhood."""
    rng = random.Random(14)
    passages = [" ".join(f"p{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(3)]
    rows = [(k, " ".join([f"w{rng.randint(0, 99999)}" for _ in range(150)] + rng.sample(passages, 2))) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    storage.prepare(spark)

    def sets(part):
        tokens, bounds = jaccard_groups.token_sets(part, 5)
        return tokens, bounds, jaccard_groups.set_names(tokens, bounds)

    many = bitfilter.of(common_tokens.common(docs, sets, 32, 256), "place", jaccard_groups.COMMON_BITS)
    for filter_, small in ((many, True), (np.zeros_like(many), False)):
        keys = jaccard_groups._key_rows(docs, 5, 80, filter_).repartition("key").sortWithinPartitions("key", "name")
        found = components.components(jaccard_groups._near(keys)).groupBy("component").count().agg(F.max("count")).first()[0] or 0
        assert (found <= 12) == small


def test_sets_of_their_own_tokens_have_no_keys(spark, monkeypatch):
    """Only sets that share enough tokens with any others are brought together, and classes are those of brute force."""
    rng = random.Random(15)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, " ".join([f"w{rng.randint(0, 99999)}" for _ in range(120)] + [passage])) for k in range(200)]
    rows += [(1000 + k, f"{rows[k][1]} end{k}") for k in range(0, 40, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met, near = [], jaccard_groups._near
    monkeypatch.setattr(jaccard_groups, "_near", lambda keys: met.append(keys.select("name").distinct().count()) or near(keys))
    got = jaccard_groups.link_documents(docs, n=5, percent=80).collect()
    assert Counter(map(tuple, got)) == Counter(brute_classes(rows, 5, 80))
    assert met == [40]


@pytest.mark.parametrize("chunk", [1, 1 << 22])
def test_matched_sets_are_counted_over_all_tasks(spark, monkeypatch, chunk):
    """By brute force: the sets of which four fifths of the tokens occur in a second set, whatever the chunks."""
    monkeypatch.setattr(common_tokens, "_SORTED", chunk)
    rng = random.Random(16)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "one", " ".join(f"z{k}" for k in range(30)), f"{' '.join(f'y{k}' for k in range(20))} end"]
    texts += [f"{t} more" for t in texts[:30]] + [" ".join(f"y{k}" for k in range(20))]
    storage.prepare(spark)

    def sets(part):
        tokens, bounds = jaccard_groups.token_sets(part, 3)
        return tokens, bounds, jaccard_groups.set_names(tokens, bounds)

    every = {}
    for part in textbytes.slices(pa.array(sorted({t or "" for t in texts}))):
        tokens, bounds, names = sets(part)
        every |= {x: tokens[bounds[i] : bounds[i + 1]].tolist() for i, x in enumerate(names.tolist()) if bounds[i] < bounds[i + 1]}
    counts = Counter(t for x in every.values() for t in x)
    want = {x for x, tokens in every.items() if 10 * sum(counts[t] > 1 for t in tokens) >= 8 * len(tokens)}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for n_ranges in (256, 4096):
        counted = common_tokens.counted(docs, sets, 32, n_ranges)
        assert sorted(r["name"] for r in common_tokens.matched(counted, 80).collect()) == sorted(want)
    spread = common_tokens.counted(docs.repartition(5), sets, 32, 256)  # copies in other tasks may let more through
    assert {r["name"] for r in common_tokens.matched(spread, 80).collect()} >= want
    assert 0 < len(want) < len(every)


def test_names_of_columns_are_kept(spark, sf_dir):
    names = ["_row", "_gone", "_found", "_near", "id", "digest", "gone", "found", "near", "missing", "blank", "name", "chosen"]
    docs = spark.createDataFrame([(1, "one two three four", "en"), (2, "one two three four", None), (2, "5", "fr"), (None, "le a", "fr")], "doc_id long, text string, lang string")
    docs = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    items = spark.createDataFrame([(1, "nothing of that")], "item_id long, text string")
    for kept in (jaccard_groups.keep_one(docs), decontaminate.keep_clean(docs, items), hyperlang.keep_known(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == k for r in rows for k, n in enumerate(names))


def test_jaccard_edges(spark, odd, odd_rows, empty):
    got = jaccard_groups.link_documents(odd).collect()
    want = brute_classes([r[:2] for r in odd_rows])
    want = [(d, n, d if not n else c) for d, n, c in want]
    assert Counter(map(tuple, got)) == Counter(want)
    assert jaccard_groups.link_documents(empty).count() == 0
    kept = jaccard_groups.keep_one(odd)
    assert kept.columns == odd.columns
    counts = Counter(r["doc_id"] for r in kept.collect())
    assert max(counts.values()) == 1
    assert set(counts) == {d for d, n, c in want if d is None or d == c}


# --- 9: packing -----------------------------------------------------------------------------------------------------


def check_packing(rows, got, capacity):
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(tokens_of(text) + [0])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, texts in ids.items():
        want = Counter()
        for t in texts:
            odd = len(t) % capacity
            edges = [*([0] if odd else []), *range(odd, len(t) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                want[(k, a, b - a, zlib.crc32(np.array(t[a:b], dtype="<u4").tobytes()))] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc_id]) == want
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, odd, odd_rows, empty, given):
    check_packing([r[:2] for r in odd_rows], packing.pack(odd, capacity=128).collect(), 128)
    assert packing.pack(empty).count() == 0
    docs = spark.createDataFrame([r[:2] for r in given], "doc_id long, text string")
    got = packing.pack(docs).collect()
    used = check_packing([r[:2] for r in given], got, 2048)
    assert used <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_classes_equal_best_fit_decreasing():
    rng = random.Random(9)
    for capacity in (10, 64):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):
            fitting = [g for g in gaps if g >= s]
            if fitting:
                gaps.remove(min(fitting))
                gaps.append(min(fitting) - s)
            else:
                gaps.append(capacity - s)
        claims = packing.match_classes(dict(Counter(sizes)), capacity)
        used = set()
        for length, rank, each, first, _ in claims.tolist():
            later = [r for s, r, *_ in claims.tolist() if s == length and r > rank]
            n = min(later, default=sizes.count(length)) - rank
            used |= {first + k // each for k in range(n)}
        assert len(used) == len(gaps)


# --- 10: language ---------------------------------------------------------------------------------------------------


def test_language(spark, odd, odd_rows, empty, given):
    got = hyperlang.identify(odd).collect()
    for r in got:
        text = next(x[1] for x in odd_rows if x[0] == r["doc_id"])
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert hyperlang.identify(empty).count() == 0
    untaught = hyperlang.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}
    kept = hyperlang.keep_known(odd)
    assert kept.columns == odd.columns
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    held = hyperlang.identify(docs).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_vectors_are_those_of_the_definition():
    letters = hyperlang.Letters(256)
    part = next(textbytes.slices(pa.array(["Éa1 b"])))
    runs, _ = hyperlang.text_runs(part, letters)
    got = letters.runs(runs).sum(axis=0)

    def vector(c):
        return letters.vectors[letters.row[ord(c) if c != " " else 0]].astype(int)

    want = 0
    for a, b, c in (" éa", "éa ", "a b", " b "):
        want = want + np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    assert (got == want).all()

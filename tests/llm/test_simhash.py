"""Fingerprints and their classes against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import simhash_planes

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id long, text string"


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_classes(prints)
    least = defaultdict(list)
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r].append(doc_id)
    return Counter((d, f"{p:016x}", min(least[r], default=None)) for (d, _), p, r in zip(rows, prints, roots))


def rows_of_all_kinds():
    rng = random.Random(12)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "no key at all"), (7, "é ß 日本 x y")]
    rows += [(None, "alone and without a key")]
    for k in range(60):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([5, 40, 200, 400]))]
        for c in range(4):
            rows.append((100 + 10 * k + c, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = "Changed"
    rows.append((9999, " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(90_000))))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, ROWS)
    for name in ("print", "component", "first", "key", "n"):
        docs = docs.withColumn(name, F.lit("x"))
    got = simhash_planes.near_duplicates(docs.repartition(5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want}) < len(rows)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, simhash_planes.near_duplicates(docs).collect())) == brute([tuple(r) for r in docs.collect()])


def test_nothing(spark):
    assert simhash_planes.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def clustered_prints(rng, centres, each):
    """Fingerprints that are a few random changes away from a few centres, all distinct."""
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    return sorted(found)


@pytest.mark.parametrize("chunk", [3, 70, 4096])
@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_hot_keys_are_cut_into_units(spark, monkeypatch, chunk, radius):
    monkeypatch.setattr(simhash_planes, "CHUNK", chunk)
    prints = clustered_prints(random.Random(radius), 4, 60)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(p,) for p in signed], "print long")
    got = simhash_planes.near_prints(rows, radius).collect()
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[root(r["a"])] = root(r["b"])
    want = brute_classes(prints, radius)
    assert {frozenset(np.flatnonzero(np.array(want) == w).tolist()) for w in want} == {
        frozenset(k for k, q in enumerate(signed) if root(q) == root(p)) for p in signed
    }


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    near = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    prints = np.array([near ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(150)])
    prints = np.concatenate([prints, rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
    words, used = simhash_planes.planes(prints)
    for block in range(len(used)):
        query = prints[::7]
        found = simhash_planes.near_lanes(query, np.repeat(words[block][None], len(query), 0), np.repeat(used[block], len(query)), radius)
        lanes = prints[64 * block : 64 * block + 64]
        want = [sum(1 << k for k, p in enumerate(lanes.tolist()) if (p ^ q).bit_count() <= radius) for q in query.tolist()]
        assert found.tolist() == want

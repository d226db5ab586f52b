"""Documents linked by the Jaccard similarity of their word n-grams, through a token-group matrix.

1. Each text becomes the set of its hashed n-grams; texts with equal sets are one *set*, with a 64-bit hash as its name.
2. Sets that may be linked are brought together. A set most of whose tokens no other set has is linked with nothing: a linked set
   shares ``p`` percent of its tokens with the other one. Tokens are counted over all sets beforehand, and only sets with that share of
   tokens that occur again go on. Two sets of sizes s and t that reach the similarity differ in at most
   ``(s + t) (100 - p) / (100 + p)`` tokens. The space of hashes is cut into more blocks than that, so that linked sets
   agree on whole blocks: a set that fills more blocks than tokens may differ has a hash per filled block as a sufficient join key.
   A block's hash covers all its tokens. Tokens that many sets have, as those of passages and lines that many documents share, are
   counted beforehand and left out, for else documents that share little more than these would meet: linked sets differ in
   no more tokens without them. The sets that are left with too few filled blocks have keys of all their tokens besides. Blocks of sets of different
   size are comparable within a size class; a set near the end of its class also takes part in the next one.
3. Sets connected by such keys form a neighbourhood. Neighbourhoods are cut into chunks of bounded size, and every pair of
   chunks is a unit of work. In a unit, similar sets are partitioned into groups; the matrix holds each group's token union;
   the overlap of a set with the union bounds its overlap with any member, and only groups that reach the bound are opened
   and compared, exactly. A unit returns a spanning forest of its links, never all pairs.
4. Components of the links name the classes.

Nothing is dropped: no cap on partners, keys or group sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bitfilter, common_tokens, storage, textbytes
from tallyloom.llm.components import components

# Sizes of a class are within this ratio.
CLASS_RATIO = 1.35
# Cuts of the space of hashes: whether common tokens are left out, and blocks beyond the necessary number as a share of it, some of
# which stay empty. Sets that are crowded in one cut take the next one, too, and empty blocks as keys after the last.
CUTS = ((True, 0.15), (True, 1.5), (False, 0.15), (False, 0.5))
LEAST_SPARE = 2
# Tokens of so many sets are common.
COMMON = 32
# Tokens of a chunk: the memory of a unit is some hundred bytes per token at most.
CHUNK_TOKENS = 1 << 17
# Sets of a group of the token-group matrix.
GROUP = 32
# Least bits of the filters that pick sets; a filter that fills up lets more sets through, nothing is lost.
FILTER_BITS = 1 << 22
# Bits of the filter of common tokens; beyond it more tokens are left out, and more sets have keys of all their tokens.
COMMON_BITS = 1 << 24

_ODD = np.uint64(0x9E3779B97F4A7C15)


def token_sets(part: textbytes.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, sorted, and their bounds; shorter texts give their whole word sequence."""
    data = textbytes.lowered(part.data)
    starts, ends, at = textbytes.find_words(data, part.bounds, textbytes.SPACED)
    words = textbytes.hash_words(data, starts, ends)
    chained = textbytes.chain(words, n)
    sizes = np.diff(at)
    grams = np.maximum(sizes - n + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(grams)])
    take = np.repeat(at[:-1] - bounds[:-1], grams) + np.arange(bounds[-1])
    tokens = np.concatenate([chained, np.zeros(n, np.uint64)])[take] if len(take) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        tokens[bounds[i]] = textbytes.chain(words[at[i] : at[i + 1]], int(sizes[i]))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[bounds[:-1][grams > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return tokens[keep], before[bounds]


def set_names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name per token set; of no meaning for empty sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textbytes.mix64(tokens), dtype=np.uint64)])
    sizes = np.diff(bounds).astype(np.uint64)
    with np.errstate(over="ignore"):
        return textbytes.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * _ODD).view(np.int64)


class SizeClasses:
    def __init__(self, percent: int) -> None:
        self.percent = percent
        # The smallest set with a different partner: s of s + 1 tokens.
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62

    def bounds(self, largest: int) -> np.ndarray:
        """Lower ends of the classes, up to beyond the largest partner of a set of ``largest`` tokens."""
        out = [self.least]
        while out[-1] <= 100 * largest // self.percent + 1:
            out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO), 100 * out[-1] // self.percent + 1))
        return np.array([*out, max(out[-1] + 1, int(out[-1] * CLASS_RATIO))])

    def differences(self, bounds: np.ndarray) -> np.ndarray:
        """How many tokens two linked sets of a class may differ in."""
        return 2 * (bounds[1:] - 1) * (100 - self.percent) // (100 + self.percent)


def _cut_keys(
    tokens: np.ndarray, which: np.ndarray, kind: np.ndarray, n_blocks: np.ndarray, cut: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block hashes of sets by the cut's number, the set of each, and the block of each.

    ``tokens`` are sorted within sets, ``which`` has the set of each; ``kind`` and ``n_blocks`` are by set.
    """
    place = tokens
    if cut:
        place = textbytes.mix64(tokens ^ (np.uint64(cut) * _ODD))
    block = ((place >> np.uint64(32)) * n_blocks[which].astype(np.uint64)) >> np.uint64(32)
    if cut:
        order = np.lexsort((block, which))
        tokens, which, block = tokens[order], which[order], block[order]
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(first)
    sums = np.add.reduceat(textbytes.mix64(tokens), at) if len(at) else np.zeros(0, np.uint64)
    owner, block = which[at], block[at]
    salt = (kind[owner] * len(CUTS) + cut).astype(np.uint64) * _ODD + block
    return textbytes.mix64(sums + textbytes.mix64(salt)).view(np.int64), owner, block


def block_keys(
    tokens: np.ndarray, bounds: np.ndarray, percent: int, common: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each set and their bounds; sets without possible partners have none. ``common`` marks tokens."""
    sizes = np.diff(bounds)
    rare = tokens if common is None else tokens[~common]
    rare_bounds = bounds if common is None else np.concatenate([[0], np.cumsum(~common)])[bounds]
    classes = SizeClasses(percent)
    if not len(sizes) or sizes.max() < classes.least:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edges = classes.bounds(int(sizes.max()))
    differences = classes.differences(edges)
    own = np.searchsorted(edges, sizes, side="right") - 1
    grows = (sizes >= classes.least) & (100 * sizes // percent >= edges[own + 1])
    found, owners = [], []
    for chosen, shift in ((sizes >= classes.least, 0), (grows, 1)):
        sets = np.flatnonzero(chosen)
        for cut, (uncommon, share) in enumerate(CUTS):
            if not len(sets):
                break
            of, at = (rare, rare_bounds) if uncommon else (tokens, bounds)
            n = np.diff(at)[sets]
            part = of[textbytes.ragged(at[sets], n)]
            kind = own[sets] + shift
            m = differences[kind] + 1 + np.maximum(LEAST_SPARE, np.ceil(share * differences[kind])).astype(np.int64)
            with np.errstate(over="ignore"):
                keys, owner, block = _cut_keys(part, np.repeat(np.arange(len(sets)), n), kind, m, cut)
            found.append(keys)
            owners.append(sets[owner])
            filled = np.bincount(owner, minlength=len(sets))
            # Of more filled blocks than differences one is the same in a linked set.
            crowded = np.flatnonzero(filled <= differences[kind])
            if cut == len(CUTS) - 1:
                for i in crowded.tolist():
                    empty = np.setdiff1d(np.arange(m[i], dtype=np.uint64), block[owner == i])
                    with np.errstate(over="ignore"):
                        found.append(textbytes.mix64(textbytes.mix64(np.uint64(kind[i]) * _ODD + empty) + _ODD).view(np.int64))
                    owners.append(np.full(len(empty), sets[i]))
            sets = sets[crowded]
    keys, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(bounds)))


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """The key columns of (key columns, text), n_shingles and set name (NULL if empty) of every row."""
    keys = docs.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch.column(len(keys))):
                tokens, bounds = token_sets(part, n)
                sizes = np.diff(bounds)
                columns = [c.slice(part.first, len(part)) for c in batch.columns[:-1]]
                columns += [pa.array(sizes), pa.array(set_names(tokens, bounds), mask=sizes == 0)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "n_shingles", "name"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]
    return docs.mapInArrow(work, ", ".join([*kinds, "n_shingles long, name long"]))


def _key_rows(docs: DataFrame, n: int, percent: int, common: np.ndarray, chosen: np.ndarray | None = None) -> DataFrame:
    """(key, name) of the sets (that pass the filter of names), by the filter of common tokens; a task gives each set once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in textbytes.slices(batch.column(0)):
                tokens, bounds = token_sets(part, n)
                names = set_names(tokens, bounds)
                new, at = np.unique(names, return_index=True)
                fresh = ~np.isin(new, given)
                given = np.union1d(given, new)
                at = at[fresh & bitfilter.passes(chosen, new)] if chosen is not None else at[fresh]
                names, sizes = names[at], np.diff(bounds)[at]
                tokens = tokens[textbytes.ragged(bounds[at], sizes)]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                keys = block_keys(tokens, bounds, percent, bitfilter.passes(common, common_tokens.places(tokens)))
                owners = np.repeat(names, np.diff(keys[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(owners)], ["key", "name"])

    return docs.select("text").mapInArrow(work, "key long, name long")


def _near(keys: DataFrame) -> DataFrame:
    """Links (a, b) of every set with the least set of its key; ``keys``: key, name, clustered and sorted by both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, name = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            first = name[at]
            if len(last) and key[0] == last[0]:  # the run began in an earlier batch
                first = np.concatenate([least, first[1:]])
            other = first[np.cumsum(new) - 1]
            last, least = key[-1:], other[-1:]
            apart = np.flatnonzero(name != other)
            pairs = np.unique(np.column_stack([name[apart], other[apart]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return keys.mapInArrow(work, "a long, b long")


def _token_rows(docs: DataFrame, n: int, packed: np.ndarray) -> DataFrame:
    """Tokens of the sets whose name passes the filter; a task gives each set once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in textbytes.slices(batch.column(0)):
                tokens, bounds = token_sets(part, n)
                names = set_names(tokens, bounds)
                passing = bitfilter.passes(packed, names)
                out = ([], [])
                for i in np.flatnonzero(passing & (np.diff(bounds) > 0)).tolist():
                    if (name := int(names[i])) not in given:
                        given.add(name)
                        out[0].append(name)
                        out[1].append(tokens[bounds[i] : bounds[i + 1]].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["name", "tokens"])

    return docs.select("text").mapInArrow(work, "name long, tokens binary")


def matrix_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (sorted token arrays), as index pairs.

    ``sides``: 0 or 1 where only links between the sides are asked for, else all 0.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del every
    shared = times > 1  # a token of one set is in no overlap
    local = np.cumsum(shared) - 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep = shared[inverse]
    tokens = local[inverse][keep]
    before = np.concatenate([[0], np.cumsum(keep)])[bounds]
    width = int(shared.sum())
    if not width:
        return []
    # Similar sets are likely to begin with the same token: they become neighbours, and groups.
    order = np.lexsort((sizes, [int(s[0]) for s in sets], sides))
    cross = sides.any()
    linked = np.zeros((count, count), dtype=bool)
    groups = [order[k : k + GROUP] for k in range(0, count, GROUP)]
    union = np.zeros((len(groups), width), dtype=bool)  # the token-group matrix
    for g, members in enumerate(groups):
        for i in members:
            union[g, tokens[before[i] : before[i + 1]]] = True
    full = np.flatnonzero(np.diff(before) > 0)  # the others have no overlap with any set
    starts = before[full]
    for g, members in enumerate(groups):
        bound = np.add.reduceat(union[g, tokens], starts, dtype=np.int32)
        qualified = full[100 * bound >= percent * sizes[full]]
        if cross:
            qualified = qualified[~np.isin(sides[qualified], sides[members]) | (len(set(sides[members])) > 1)]
        if not len(qualified):
            continue
        rows = np.zeros((len(members), width), dtype=bool)
        for r, i in enumerate(members):
            rows[r, tokens[before[i] : before[i + 1]]] = True
        spans = [tokens[before[i] : before[i + 1]] for i in qualified]
        at = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
        overlap = np.add.reduceat(rows[:, np.concatenate(spans)], at, axis=1, dtype=np.int64)
        either = sizes[members][:, None] + sizes[qualified][None, :] - overlap
        linked[np.ix_(members, qualified)] = 100 * overlap >= percent * either
    if cross:
        linked &= sides[:, None] != sides[None, :]
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return _forest(linked)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    out, waiting = [], np.ones(len(linked), dtype=bool)
    for root in np.flatnonzero(linked.any(axis=1)).tolist():
        if not waiting[root]:
            continue
        waiting[root] = False
        stack = [root]
        while stack:
            node = stack.pop()
            new = np.flatnonzero(linked[node] & waiting).tolist()
            waiting[new] = False
            out += [(node, k) for k in new]
            stack += new
    return out


def _unit_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of each unit; ``rows``: neighbourhood, i, j, chunk, name, tokens, clustered by the first three."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets, chunks = None, [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(sets) > 1:
                sides = np.array([c != key[1] for c in chunks], dtype=np.int8) if key[1] != key[2] else np.zeros(len(sets), np.int8)
                out.extend((names[a], names[b]) for a, b in matrix_links(sets, sides, percent))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *unit, chunk, name, tokens in zip(*columns):
                if unit != key:
                    close()
                    key, names, sets, chunks = unit, [], [], []
                names.append(name)
                chunks.append(chunk)
                sets.append(np.frombuffer(tokens, "<u8"))
            if out:
                yield batch_of()
                out.clear()
        close()
        yield batch_of()

    return rows.mapInArrow(work, "a long, b long")


def _classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(name, component) of the sets of ``docs`` (a column text) that are linked with others."""
    spark = docs.sparkSession

    def sets(part: textbytes.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, bounds = token_sets(part, n)
        return tokens, bounds, set_names(tokens, bounds)

    counted, counted_at = storage.written(common_tokens.counted(docs, sets, COMMON, common_tokens.ranges(docs)), "counted")
    many = bitfilter.of(counted.where("place is not null"), "place", COMMON_BITS)
    able, able_at = storage.written(common_tokens.matched(counted, percent), "matched")
    chosen = bitfilter.of(able, "name", bitfilter.bits_for(able.count(), FILTER_BITS))
    for path in (counted_at, able_at):
        storage.remove(spark, path)
    keys = _key_rows(docs, n, percent, many, chosen).repartition("key").sortWithinPartitions("key", "name")
    hoods, hoods_at = storage.written(components(_near(keys)), "neighbourhoods")
    packed = bitfilter.of(hoods, "node", bitfilter.bits_for(hoods.count(), FILTER_BITS))
    tokens = (
        _token_rows(docs, n, packed)
        .join(hoods.select(F.col("node").alias("name"), F.col("component").alias("hood")), "name")
        .groupBy("name", "hood")
        .agg(F.first("tokens").alias("tokens"))
    )
    tokens, tokens_at = storage.written(tokens, "sets")
    size = F.length("tokens") / 8
    chunks = tokens.groupBy("hood").agg(F.ceil(F.sum(size) / CHUNK_TOKENS).cast("int").alias("chunks"), F.count("*").alias("n"))
    dealt = tokens.join(chunks.where("n > 1").drop("n"), "hood").withColumn(
        "chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    )
    units = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("hood", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "name", "tokens")
        .repartition("hood", "i", "j")
        .sortWithinPartitions("hood", "i", "j")
    )
    groups = components(_unit_links(units, percent)).withColumnRenamed("node", "name")
    for path in (hoods_at, tokens_at):  # the components have been written
        storage.remove(spark, path)
    return groups


def link_documents(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Words stand between ASCII white space, A-Z in lower case. A document's set has its distinct n-grams; with fewer words,
    the whole sequence as one. Documents link when ``100 * |intersection| >= percent * |union|``. NULL texts and texts
    without words have no set and are linked with nothing. Repeated rows link to each other; a NULL doc_id counts only
    where a class has no other. ``doc_id`` is read as a long; further columns are ignored; an empty table gives no rows.
    """
    storage.prepare(docs.sparkSession)
    groups = _classes(docs, n, percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = storage.stored(_sketch(texts, n), "sketches")
    sets = seen.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("first"))
    placed = sets.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("name", "component_id")
    return (
        seen.select("doc_id", "n_shingles", "name")
        .join(named, "name", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each class of linked texts: the one with the least ``doc_id``, NULL last.

    Every row is judged on its own text, so that repeated and missing keys name nothing else. Texts without words are linked
    with nothing; of those with equal ``doc_id`` (not NULL) and text one stays. Of rows that share the chosen ``doc_id`` and text
    any one stays. Columns may have any names.
    """
    spark = docs.sparkSession
    storage.prepare(spark)
    groups = _classes(docs, n, percent)
    digest = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), "text")
    seen = _sketch(rows, n).where("name is not null or id is not null")
    # Rows of a text under one key, by class; a text without words is a class for each key.
    texts = seen.groupBy("name", "id", "digest").agg(F.count("*").alias("n")).join(groups, "name", "left")
    texts = texts.select(
        F.coalesce("component", "name").alias("component"),
        F.when(F.col("name").isNull(), F.struct("id", "digest")).alias("blank"),
        F.struct(F.col("id").isNull().alias("missing"), "id", "digest").alias("row"),
        "n",
    )
    texts = storage.stored(texts, "texts")
    least = texts.groupBy("component", "blank").agg(F.min("row").alias("least"))
    same = texts["component"].eqNullSafe(least["component"]) & texts["blank"].eqNullSafe(least["blank"])
    ranked = texts.join(least, same).select("row.id", "row.digest", "n", (F.col("row") == F.col("least")).alias("chosen"))
    id_, digest_ = storage.unused_names(docs, "id", "digest")
    ranked = storage.stored(
        ranked.where("not chosen or n > 1").select(F.col("id").alias(id_), F.col("digest").alias(digest_), "chosen"), "others"
    )

    def named(side: DataFrame):
        return F.col("doc_id").eqNullSafe(F.col(id_)) & (digest == F.col(digest_))

    gone = ranked.where("not chosen").drop("chosen")
    kept = docs.join(storage.small_side(gone), named(gone), "left_anti")
    repeated = ranked.where("chosen").drop("chosen")
    if repeated.isEmpty():
        return kept
    repeated = storage.small_side(repeated)
    one = kept.join(repeated, named(repeated)).groupBy(id_, digest_).agg(
        F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")
    )
    return kept.join(repeated, named(repeated), "left_anti").unionAll(one.select("row.*"))

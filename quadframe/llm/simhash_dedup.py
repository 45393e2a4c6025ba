"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Two fingerprints that differ in at most `distance` bits agree on at least `blocks - distance` of `blocks`
bit blocks, so each choice of that many blocks is one join key and no close pair is lost. Distinct
fingerprints only enter the join (copies collapse before it), keys that many fingerprints share are split
into chunk pairs, and a group answers with a spanning forest of its links, never with all its pairs.

keep_dissimilar(), the pipeline's stage, is about texts whose shingles are similar. At similarity 0.8 SimHash
differs in 0.15 of its bits, too many for the pigeonhole principle, so its fingerprints have 512 bits and meet
under many short choices of these; candidates are verified by their distance, and the shingles themselves decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DISTANCE = 4
SHINGLE_WORDS = 4
#: Of keep_dissimilar(): words of a shingle, least Jaccard similarity, bits of a fingerprint.
KEEP_WORDS, SIMILARITY, KEEP_BITS = 5, 0.8, 512
#: Keys of KEY_BITS bits each; of the first 128 bits, so many may differ (0.15 of them do at similarity 0.8, by calculation).
KEYS, KEY_BITS, APART = 80, 12, 36
#: Of all bits, so many may differ.
APART_IN_ALL = 115
#: Sets of at most so many shingles have exact keys too: two of these at 0.8 differ in one shingle at most.
SMALL_SET = 9
#: Members of a candidate group beyond which it is split into chunk pairs; fingerprints that a part gets.
KEEP_CHUNK, KEEP_PART = 2048, 250_000
#: Keys of a class that meet in one part, which gives one forest for all of them.
FOLD = 4
#: Fingerprints under one key beyond which they are split into chunk pairs.
CHUNK = 512
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles (repeats included) of UTF-8 text; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[i:j], 42) for i, j in zip(starts, stops)], np.uint64)
    ones = np.concatenate([np.bincount(column, minlength=256) @ _BIT for column in hashes.astype("<u8").view(np.uint8).reshape(n, 8).T])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_col: str | None = None) -> DataFrame:
    """(id, fp) per row, with hash_col (id, hash, fp); fp is the fingerprint's bits as a signed long."""
    names = ["id", *(["hash"] if hash_col else []), "fp"]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in common.byte_list(b.columns[-1])], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], schema=schema)

    common.ship(docs.sparkSession)
    keys = [F.col(c).cast("long").alias(name) for c, name in zip([id_col, hash_col], names[:-1])]
    return docs.select(*keys, F.col(text_col).alias("text")).mapInArrow(common.lean(run), ", ".join(f"{name} long" for name in names))


def key_masks(distance: int, blocks: int) -> list[int]:
    """One bit mask for every choice of blocks - distance blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks whose keys have about log2(n) bits, so that unrelated fingerprints seldom meet;
    every choice gives the same links."""
    wanted = max(1, n).bit_length()
    for blocks in range(distance + 1, distance + 5):
        if 64 * (blocks - distance) // blocks >= wanted:
            return blocks
    return distance + 4


def close_pairs(classes: DataFrame, distance: int = DISTANCE, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """classes: (fp, rep) with distinct fp. Returns (a, b) of reps whose links connect exactly the
    fingerprints that `distance` bits connect."""
    blocks = blocks or blocks_for(classes.count(), distance)
    masks = F.array(*[F.lit(_signed(m)) for m in key_masks(distance, blocks)])
    keyed = classes.select("fp", "rep", F.posexplode(masks).alias("t", "mask"))
    keyed = keyed.select("fp", "rep", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    hot = common.stage(common.hot_keys(keyed, "key", chunk), "hotkeys")
    if not hot.isEmpty():
        keyed = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.greatest(o, F.col("mine")) * F.col("chunks") + F.least(o, F.col("mine")))
        keyed = keyed.withColumn("mine", mine).withColumn("cell", F.explode(pairs)).withColumn("key", F.xxhash64("key", "cell"))
    # a key's rows meet by this hash; rows of other keys in the same group only cost a comparison
    grouped = keyed.select("key", "fp", "rep").repartition(F.col("key")).sortWithinPartitions("key", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(fps: np.ndarray, reps: np.ndarray) -> list[tuple[int, int]]:
        forest = common.spanning_links(lambda i, rest: common.popcount(fps[rest] ^ fps[i]) <= distance, len(fps))
        return [(int(reps[i]), int(reps[j])) for i, j in forest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = [np.empty(0, np.int64)] * 3
        for b in itertools.chain(batches, [None]):
            if b is not None:
                keep = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(keep, b.columns)]
            key, fp, rep = keep
            if not len(key):
                continue
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            end = len(key) if b is None else (edges[-1] if len(edges) else 0)
            starts = np.concatenate([[0], edges, [len(key)]])
            sizes = np.diff(starts)
            fp_u, out = fp.view(np.uint64), []
            two = starts[:-1][sizes == 2]
            two = two[two + 2 <= end]
            near = two[common.popcount(fp_u[two] ^ fp_u[two + 1]) <= distance]
            out += list(zip(rep[near].tolist(), rep[near + 1].tolist()))
            for i in np.flatnonzero(sizes > 2):
                if starts[i + 1] <= end:
                    out += links(fp_u[starts[i] : starts[i + 1]], rep[starts[i] : starts[i + 1]])
            keep = [k[end:] for k in keep]
            if out:
                yield common.batch(dict(zip("ab", zip(*out))), schema)

    return grouped.mapInArrow(common.lean(run), "a long, b long")


def _components(fps: DataFrame, distance: int, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(fp, root) per distinct fp of fps. The fingerprint itself is the node: ids may be null or repeat."""
    classes = common.stage(fps.select("fp", F.col("fp").alias("rep")).distinct(), "fpclasses")
    pairs = common.stage(close_pairs(classes, distance, blocks, chunk), "links")
    roots = common.components(pairs)
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    A null text is empty; no words give fingerprint 0, linked like any other; a null id sorts first;
    repeated ids keep their rows. An empty table gives no rows. Other columns are not read.
    """
    fps = common.stage(fingerprints(docs, id_col, text_col), "fps")
    roots = common.stage(_components(fps, distance, blocks, chunk), "roots")
    lowest = fps.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(common.NULL_ID))).alias("low"))
    lowest = roots.join(lowest, "fp").groupBy("root").agg(F.min("low").alias("component"))
    out = fps.join(roots.join(lowest, "root").select("fp", "component"), "fp")
    back = F.when(F.col("component") != common.NULL_ID, F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back.alias("component_id"))


def _rows(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more longs that tell rows apart, equal rows excepted, and their names: the id (null
    first) and a hash of all columns. Columns of types that have no hash count as their JSON."""
    at, mark = common.unused(docs, "_id", "_hash")
    rest = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes if c != "doc_id"]
    return docs.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID))).withColumn(mark, F.xxhash64("text", *rest)), at, mark


def _first_rows(rows: DataFrame, at: str, mark: str, named: DataFrame, columns: list[str]) -> DataFrame:
    """named: (id, hash, root). The first row of each root by id and hash, once where equal rows repeat."""
    first = named.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("first")).select(F.col("first.id").alias(at), F.col("first.hash").alias(mark))
    return rows.join(first, [at, mark], "left_semi").dropDuplicates([at, mark]).select(*[f"`{c}`" for c in columns])


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of docs per component of near-duplicates(): the smallest doc_id's; of several, by the row's hash.

    A null doc_id comes first; rows that share an id are judged each; equal rows are copies. Null, empty and
    wordless texts have fingerprint 0 and are near one another. An empty table gives no rows. Other columns
    may have any names and are kept.
    """
    rows, at, mark = _rows(docs)
    fps = common.stage(fingerprints(rows, at, "text", mark), "fps")
    return _first_rows(rows, at, mark, fps.join(_components(fps, distance), "fp"), docs.columns)


def shingle_set(text: bytes, words_per_shingle: int = KEEP_WORDS) -> np.ndarray:
    """Distinct 32-bit hashes of the word shingles of UTF-8 text, in order; of all its words if they are fewer."""
    words = text.lower().split()
    n = max(1, len(words) - words_per_shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + words_per_shingle]), 42) for i in range(n)], np.uint64).astype(np.uint32))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of KEEP_BITS bits of a set of shingles."""
    ones = np.zeros(KEEP_BITS, np.int64)
    step = np.arange(1, KEEP_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(shingles), 4096):
        h = shingles[i : i + 4096, None].astype(np.uint64) + step
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def small_keys(shingles: np.ndarray) -> list[int]:
    """Of a small set: keys of itself and of itself without each shingle. Others, and the empty set, have none."""
    if not 0 < len(shingles) <= SMALL_SET:
        return []
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), 9)) for x in [shingles, *(np.delete(shingles, i) for i in range(len(shingles)))] if len(x)]


def _shingled(rows: DataFrame) -> DataFrame:
    """(id, hash, class, keys, bits, shingles) per row (id, hash, text); texts of one set of shingles are one class."""
    types = {"id": pa.int64(), "hash": pa.int64(), "class": pa.int64(), "keys": pa.list_(pa.int64()), "bits": pa.binary(), "shingles": pa.binary()}
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = [shingle_set(t) for t in common.byte_list(b.column(2))]
                packed = [x.tobytes() for x in sets]
                made = [[_signed(xxhash.xxh64_intdigest(x, 7)) for x in packed], [small_keys(x) for x in sets], [wide_fingerprint(x) for x in sets], packed]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(m, type=t) for m, t in zip(made, list(types.values())[2:]))], schema=schema)

    common.ship(rows.sparkSession)
    return rows.mapInArrow(common.lean(run), "id long, hash long, class long, keys array<long>, bits binary, shingles binary")


def key_choices(n: int) -> tuple[np.ndarray, int]:
    """The bits of every key for n fingerprints, and how many of a key's bits say which part it goes to. Keys grow with
    n, so that unrelated fingerprints seldom meet, and their number with them, so that as many pairs at 0.8 are found."""
    size = max(KEY_BITS, (n >> 6).bit_length())
    agree = 1 - np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
    r = np.random.default_rng(0)
    choices = np.array([r.permutation(KEEP_BITS)[:size] for _ in range(round(KEYS * agree ** (KEY_BITS - size)))])
    return choices, min(size, max(0, (FOLD * n - 1) // KEEP_PART).bit_length())


_MET = np.dtype([("key", "<u4"), ("class", "<i8"), ("a", "<u8"), ("b", "<u8")])


def near_groups(classes: DataFrame, n: int) -> DataFrame:
    """classes: n rows (class, bits). Returns (class, key, to): groups of classes that agree on a choice of bits and
    are connected by distances of at most APART; `to`, of all but a group's first, is a class so near."""
    choices, cut = key_choices(n)
    value = np.int64(1) << np.arange(choices.shape[1])
    schema = pa.schema([("part", pa.int32()), ("met", pa.binary())])
    out_schema = pa.schema([("class", pa.int64()), ("key", pa.int64()), ("to", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits, words, met = np.unpackbits(packed, axis=1, bitorder="little"), packed.view("<u8"), np.empty(b.num_rows, _MET)
            met["class"], met["a"], met["b"] = b.column(0).to_numpy(), words[:, 0], words[:, 1]
            for t, choice in enumerate(choices):
                key = bits[:, choice] @ value
                met["key"] = key + (t % FOLD << len(value))
                part = (t // FOLD << cut) + (key >> (len(value) - cut))
                own = met[np.argsort(part, kind="stable")]
                parts, first = np.unique(np.sort(part), return_index=True)
                yield common.batch({"part": parts, "met": [x.tobytes() for x in np.split(own, first[1:])]}, schema)

    def groups(part: int, blobs: list[bytes]) -> list[tuple]:
        met = np.frombuffer(b"".join(blobs), _MET)
        met = met[np.lexsort((met["class"], met["key"]))]
        edges = np.flatnonzero(np.concatenate([[True], met["key"][1:] != met["key"][:-1], [True]]))
        out, a, b, cls = [], met["a"].copy(), met["b"].copy(), met["class"].tolist()
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if j - i == 1:
                continue
            x, y = a[i:j], b[i:j]
            rows = np.arange(j - i)
            if len(rows) <= 1024:  # seldom are any two near
                near = common.popcount(x[:, None] ^ x) + common.popcount(y[:, None] ^ y) <= APART
                rows = np.flatnonzero(np.count_nonzero(near, 1) > 1)
            if not len(rows):
                continue
            x, y, rows = x[rows], y[rows], (rows + i).tolist()
            forest = common.spanning_links(lambda k, rest: common.popcount(x[rest] ^ x[k]) + common.popcount(y[rest] ^ y[k]) <= APART, len(rows))  # noqa: B023
            first = {}
            for k, m in forest:  # links come from the first on
                if k not in first:
                    first[k] = k
                    out.append((cls[rows[k]], _signed(xxhash.xxh64_intdigest(f"{part} {met['key'][i]} {cls[rows[k]]}")), None))
                first[m] = first[k]
                out.append((cls[rows[m]], _signed(xxhash.xxh64_intdigest(f"{part} {met['key'][i]} {cls[rows[first[k]]]}")), cls[rows[k]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in itertools.chain(batches, [None]):
            for part, blob in zip(*(c.to_pylist() for c in b.columns)) if b is not None else [(None, None)]:
                if part != now:
                    if blobs and (out := groups(now, blobs)):
                        yield common.batch(dict(zip(out_schema.names, zip(*out))), out_schema)
                    now, blobs = part, []
                blobs.append(blob)

    dealt = classes.select("class", "bits").mapInArrow(common.lean(deal), "part int, met binary")
    return dealt.repartition(-(-len(choices) // FOLD) << cut, "part").sortWithinPartitions("part").mapInArrow(common.lean(run), "class long, key long, to long")


def _similar(own: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of some sets, one after the other in flat, are similar to own; none is empty."""
    there = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= similarity * (sizes + len(own) - both) - 1e-9


def similar_links(shingled: DataFrame, similarity: float = SIMILARITY, chunk: int = KEEP_CHUNK) -> DataFrame:
    """(a, b): links among classes that are near by their fingerprints and whose shingles are similar, enough to connect
    all such. First the groups' spanning trees are verified; what they connect but the verified links do not is
    compared in full."""
    sets = common.stage(shingled.filter(F.length("shingles") > 0).groupBy("class").agg(*[F.first(c).alias(c) for c in ("keys", "bits", "shingles")]), "sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a part's links, those that connect what others before them did not."""
        root: dict[int, int] = {}
        for b in batches:
            out = []
            for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = i, j
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                while (up := root.get(y, y)) != y:
                    root[y] = y = root.get(up, up)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(i, j), max(i, j)))
            if out:
                yield common.batch(dict(zip("ab", zip(*out))), schema)

    found = near_groups(sets, sets.count()).filter("to IS NOT NULL").select("class", "to")
    found = common.stage(found.mapInArrow(common.lean(forest), "a long, b long").distinct(), "near")
    trees = common.stage(common.components(found), "trees").select(F.col("node").alias("class"), F.col("root").alias("key"))
    small = sets.select("class", F.explode("keys").alias("key"))
    small = small.join(small.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi").select("class", "key")
    members = common.stage(trees.withColumn("seen", F.lit(True)).union(small.withColumn("seen", F.lit(False))), "members")
    every, sets = sets, common.stage(sets.join(members.select("class").distinct(), "class", "left_semi").select("class", "bits", "shingles"), "few")
    common.unstage(every)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x, np.uint32) for x in b.column(i).to_pylist()] for i in (2, 3))
            keep = [bool(_similar(x, y, np.array([len(y)]), similarity)[0]) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays(list(b.columns[:2]), schema=schema).filter(pa.array(keep, pa.bool_()))

    tree = found.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    tree = common.stage(tree.select("a", "b", "x", "y").mapInArrow(common.lean(verified), "a long, b long"), "tree")
    roots = common.stage(common.components(tree), "treeroots")
    members = members.join(roots, F.col("class") == F.col("node"), "left").select("class", "key", "seen", F.coalesce("root", "class").alias("root"))
    members = common.stage(members, "rooted")
    # a tree of two is settled
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("seen").alias("seen")).filter("low != high AND (n > 2 OR NOT seen)")
    # of keys that the same classes share, one; crowds are split into chunk pairs
    shared = shared.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    members = members.join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("class", F.lit(7)), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.greatest(o, F.col("mine")) * F.col("chunks") + F.least(o, F.col("mine")))
    members = members.withColumn("cell", F.explode(pairs)).select("class", F.xxhash64("key", "cell").alias("key"))
    grouped = members.join(sets, "class").select("key", "class", "bits", "shingles").repartition(F.col("key")).sortWithinPartitions("key", "class")

    def links(held: list[tuple[int, bytes, bytes]]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint32) for _, _, x in held]
        bits = np.frombuffer(b"".join([x for _, x, _ in held]), np.uint64).reshape(len(held), -1)
        sizes = np.array([len(x) for x in sets])

        def close(i: int, others: np.ndarray) -> np.ndarray:
            size, out = sizes[i], np.zeros(len(others), bool)
            fit = np.minimum(sizes[others], size) >= similarity * np.maximum(sizes[others], size) - 1e-9
            fit = np.flatnonzero(fit & ((common.popcount(bits[others] ^ bits[i]).sum(1, dtype=np.int64) <= APART_IN_ALL) | (sizes[others] <= SMALL_SET)))
            for at in range(0, len(fit), 256):
                part = fit[at : at + 256]
                out[part] = _similar(sets[i], np.concatenate([sets[j] for j in others[part]]), sizes[others[part]], similarity)
            return out

        return [tuple(sorted((held[i][0], held[j][0]))) for i, j in common.spanning_links(close, len(held))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in itertools.chain(batches, [None]):
            out = []
            for key, *row in zip(*(c.to_pylist() for c in b.columns)) if b is not None else [(None,)]:
                if key != now:
                    out += links(held) if len(held) > 1 else []
                    now, held = key, []
                held.append(tuple(row))
            if out:
                yield common.batch(dict(zip("ab", zip(*out))), schema)

    return tree.union(grouped.mapInArrow(common.lean(run), "a long, b long"))


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs per component of texts whose word shingles are similar: the smallest doc_id's; of
    several, by the row's hash.

    A null doc_id comes first; rows that share an id are judged each; equal rows are copies. Null, empty and
    wordless texts are alike; shorter texts than a shingle are one shingle of all their words. An empty table
    gives no rows. Other columns may have any names and are kept.
    """
    rows, at, mark = _rows(docs)
    shingled = common.stage(_shingled(rows.select(at, mark, "text")), "shingles")
    roots = common.components(common.stage(similar_links(shingled, similarity), "links"))
    classes = common.stage(shingled.select("id", "hash", "class"), "classes")
    common.unstage(shingled)  # the shingles are not needed any more
    named = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    return _first_rows(rows, at, mark, named, docs.columns)

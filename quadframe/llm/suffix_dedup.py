"""Removal of repeated byte passages by a sparse, distributed suffix merge sort.

A passage of `length` bytes is judged by every text position that starts one. Sorting all suffixes is not
needed: in each window of that length, the 32-byte gram with the smallest hash is its anchor, so equal
passages have equal anchors at equal offsets, and only anchors whose gram occurs twice can matter.
1. Count anchor grams; the repeated ones go into a Bloom filter of bounded size (a false hit only costs a
   row). Those with more rows than a part should get, at most one for each so many rows, are hot.
2. Each task sorts the suffixes at its repeated anchors and writes them as runs, front-coded: the length
   of the prefix shared with the suffix before, and the rest. Runs are exchanged by the anchor's gram;
   a hot gram's places are dealt out over several chunks.
3. Each part merges its runs with a loser tree that carries known common prefixes: suffixes are ordered by
   them and compared only beyond them. The merge yields the order and its common prefixes, which, with
   those of the bytes to the left, say which passages are equal; all but the first place is removed.
   First places of a hot gram's chunks meet once more, by their passage's hash.
4. The removed spans of a document are merged and cut from its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 32
#: Bits of the Bloom filter at most (64 MB); beyond what it can tell apart, more rows are exchanged.
BLOOM_BITS = 1 << 29
#: Suffixes that a map task holds before it writes runs, and that a part should get.
RUN = 150_000
PART = 50_000
_META = np.dtype([("doc", "<i8"), ("dk", "<i8"), ("pos", "<i8"), ("lo", "u1"), ("hi", "u1"), ("heavy", "u1"), ("lcp", "u1"), ("rest", "u1"), ("left", "u1")])
_BLOCK = 1 << 23


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, lowest and highest offset in the windows it stands for, gram hash) of a text's anchors."""
    found = []
    for at in range(0, len(text) - length + 1, _BLOCK):
        found.append(_anchors(text[at : at + _BLOCK + length - 1], length))
        found[-1][0][:] += at
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, zip(*found)))


def _anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    h, done = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD), 1
    h ^= h >> np.uint64(29)
    while done < GRAM:
        right = h[done:]
        h = h[:-done] * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
        done *= 2
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(text) - length + 1
    where = (np.minimum(low[:n], low[width - span : width - span + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    place = where[first]
    return place, place - last, place - first, h[place]


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs (strings, prefix each shares with the one before). Returns run, index
    in it and prefix shared with the string before, in merged order.

    A player knows what prefix it shares with the last winner. The longer one is the smaller string; only
    equals are compared, beyond that prefix, and the loser then knows what it shares with the winner.
    """
    k = len(runs)
    strings, prefix, at = [r[0] for r in runs], [r[1] for r in runs], [0] * k
    current, known = [s[0] if s else None for s in strings], [0 if s else -1 for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = current[a], current[b]
        n = min(len(x), len(y))
        differ = int.from_bytes(x[ka:n], "big") ^ int.from_bytes(y[ka:n], "big")
        shared = n - ((differ.bit_length() + 7) >> 3)
        wins = len(x) <= len(y) if shared == n else x[shared] < y[shared]
        known[b if wins else a] = shared
        return (a, b) if wins else (b, a)

    tree = [0] * k
    level = [None] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        level[node], tree[node] = play(level[2 * node], level[2 * node + 1])
    winner = level[1] if k > 1 else 0
    out_run, out_at, out_lcp = [], [], []
    while known[winner] >= 0:
        i = at[winner]
        out_run.append(winner)
        out_at.append(i)
        out_lcp.append(known[winner])
        i += 1
        at[winner] = i
        if i < len(strings[winner]):
            current[winner], known[winner] = strings[winner][i], prefix[winner][i]
        else:
            current[winner], known[winner] = None, -1
        node, own = (winner + k) >> 1, known[winner]
        while node:
            other = tree[node]
            if known[other] > own:
                tree[node], winner, own = winner, other, known[other]
            elif known[other] == own and own >= 0:
                winner, tree[node] = play(winner, other)
            node >>= 1
    return out_run, out_at, out_lcp


def _cells(strings: list[bytes], width: int) -> np.ndarray:
    return np.array(strings, f"S{width}").view(np.uint8).reshape(len(strings), width)


def _adjacent(cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Prefix each row shares with the row before."""
    out = np.zeros(len(cells), np.int64)
    differ = cells[1:] != cells[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), cells.shape[1])
    out[1:] = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_code(suffixes: list[bytes], lefts: list[bytes], meta: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A sorted run as bytes: fixed-size fields, suffix rests, left contexts (none where repeated)."""
    sizes = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    meta["lcp"] = lcp = _adjacent(_cells(suffixes, LENGTH_MAX), sizes)
    meta["rest"] = sizes - lcp
    same = [i > 0 and lefts[i] == lefts[i - 1] for i in range(len(lefts))]
    meta["left"] = [255 if s else len(x) for s, x in zip(same, lefts)]
    return meta.tobytes(), b"".join([s[i:] for s, i in zip(suffixes, lcp.tolist())]), b"".join([x for s, x in zip(same, lefts) if not s])


#: Suffix bytes that fields of one byte can describe.
LENGTH_MAX = 254


def decode(meta: bytes, rests: bytes, lefts: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    m = np.frombuffer(meta, _META)
    suffixes, left, s, x, i, j = [], [], b"", b"", 0, 0
    for lcp, rest, size in zip(m["lcp"].tolist(), m["rest"].tolist(), m["left"].tolist()):
        s = s[:lcp] + rests[i : i + rest]
        i += rest
        if size != 255:
            x = lefts[j : j + size]
            j += size
        suffixes.append(s)
        left.append(x)
    return m, suffixes, left


def repeated(meta: np.ndarray, suffixes: list[bytes], lefts: list[bytes], lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(later, first) per row and offset, rows in suffix order: the passage that starts so far before the
    row's anchor has an earlier place among the rows; or it is the first of several or the only one."""
    n, width = len(meta), length - GRAM + 1
    later, first = np.zeros((n, width), bool), np.zeros((n, width), bool)
    turned = [x[::-1] for x in lefts]
    cells = _cells(turned, width)
    order = np.argsort(np.array(turned, f"S{width}"), kind="stable")
    left_lcp = _adjacent(cells[order], np.full(n, width))
    by_place = np.lexsort((meta["pos"], meta["doc"]))
    new = np.ones(n, bool)
    new[1:] = (np.diff(meta["pos"][by_place]) != 0) | (np.diff(meta["doc"][by_place]) != 0)
    rank = np.empty(n, np.int64)
    rank[by_place] = np.cumsum(new) - 1
    left_class = np.empty(n, np.int64)
    for o in range(width):
        rows = np.flatnonzero((meta["lo"] <= o) & (meta["hi"] >= o))
        if not len(rows):
            continue
        left_class[order] = np.cumsum(left_lcp < o)
        key = (np.cumsum(lcp < length - o)[rows] * (n + 1) + left_class[rows]) * n + rank[rows]
        sort = np.argsort(key)
        group, r = key[sort] // n, rank[rows][sort]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lowest = np.repeat(r[start], np.diff(np.concatenate([start, [len(r)]])))
        later[rows[sort], o] = r != lowest
        first[rows[sort], o] = r == lowest
    return later, first


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: id (not null), dk (hash of the text), text. Returns (doc, dk, s, e): repeated byte spans."""
    if not GRAM < length <= LENGTH_MAX:
        raise ValueError(f"length must lie between {GRAM + 1} and {LENGTH_MAX}")
    common.ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    count_schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(np.frombuffer(t, np.uint8), length)[3] for t in common.byte_list(b.column(0))]
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=count_schema)

    counted = docs.select("text").mapInArrow(common.lean(grams), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    dup = common.stage(counted, "grams")
    n_dup, total = dup.agg(F.count("h"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    bits, filled = common.bloom(dup, n_dup, BLOOM_BITS)
    limit = min(max(4096, total // 256), PART)
    # at most total / limit grams, 12 bytes each
    heavy = sorted((h & 0xFFFFFFFFFFFFFFFF, -(-n // limit)) for h, n in dup.filter(F.col("n") > limit).collect())
    common.unstage(dup)
    parts = int(max(256, total // PART))
    # the last row is no gram's, so that every search ends at some row
    table = sc.broadcast((filled, np.array([h for h, _ in heavy] + [0xFFFFFFFFFFFFFFFF], np.uint64), np.array([n for _, n in heavy] + [1], np.int32)))
    run_schema = pa.schema([("part", pa.int32()), ("meta", pa.binary()), ("rests", pa.binary()), ("lefts", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, hot, chunks = table.value
        suffixes: list[bytes] = []
        lefts: list[bytes] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            meta, part = (np.concatenate(x) for x in zip(*held))
            order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__))
            order = order[np.argsort(part[order], kind="stable")]
            edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
            out = []
            for i, j in zip(edges[:-1], edges[1:]):
                own = order[i:j]
                out.append((int(part[own[0]]), *front_code([suffixes[k] for k in own], [lefts[k] for k in own], meta[own])))
            suffixes.clear()
            lefts.clear()
            held.clear()
            return common.batch(dict(zip(run_schema.names, zip(*out))), run_schema)

        for b in batches:
            for doc, dk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.byte_list(b.column(2))):
                place, lo, hi, h = anchors(np.frombuffer(text, np.uint8), length)
                if not len(place):
                    continue
                hit = common.in_bloom(h, bits, filled)
                place, lo, hi, h = place[hit], lo[hit], hi[hit], h[hit]
                if not len(place):
                    continue
                row = np.searchsorted(hot, h)
                n_chunks = np.where(hot[row] == h, chunks[row], 1)
                at = np.uint64((doc + 1) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF) ^ place.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
                chunk = ((at ^ (at >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % n_chunks.astype(np.uint64)
                mixed = (h ^ (chunk + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                meta = np.zeros(len(place), _META)
                meta["doc"], meta["dk"], meta["pos"], meta["lo"], meta["hi"], meta["heavy"] = doc, dk, place, lo, hi, n_chunks > 1
                held.append((meta, ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)))
                for a, i, j in zip(place.tolist(), lo.tolist(), hi.tolist()):
                    suffixes.append(text[a : a + length - i])
                    lefts.append(text[a - j : a])
                if len(suffixes) >= RUN:
                    yield flush()
        if suffixes:
            yield flush()

    span_schema = pa.schema([("doc", pa.int64()), ("dk", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def part_spans(blobs: list[tuple]) -> pa.RecordBatch | None:
        decoded = [decode(*b) for b in blobs]
        run, at, lcp = merge_runs([(s, m["lcp"].tolist()) for m, s, _ in decoded])
        lcp = np.array(lcp)
        alike = lcp >= GRAM
        keep = alike.copy()
        keep[:-1] |= alike[1:]
        offset = np.cumsum([0, *(len(m) for m, _, _ in decoded)])
        meta = np.concatenate([m for m, _, _ in decoded])[offset[np.array(run)] + np.array(at)]
        # a dropped row shares less than a gram with both neighbours, so no group loses its start; those
        # of a hot gram may have their like in another chunk
        keep = np.flatnonzero(keep | (meta["heavy"] == 1))
        if not len(keep):
            return None
        meta = meta[keep]
        suffixes = [decoded[run[i]][1][at[i]] for i in keep]
        lefts = [decoded[run[i]][2][at[i]] for i in keep]
        later, first = repeated(meta, suffixes, lefts, lcp[keep], length)
        edge = np.zeros((len(meta), 1), bool)
        step = np.diff(np.concatenate([edge, later, edge], 1).astype(np.int8), axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)  # one past the run's last offset
        doc, dk, pos = meta["doc"][row], meta["dk"][row], meta["pos"][row]
        out = [doc, dk, pos - high + 1, pos - low + length, np.zeros_like(doc), np.zeros_like(doc)]
        hot_row, hot_o = np.nonzero(first & (meta["heavy"] == 1)[:, None])
        if len(hot_row):
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(lefts[i][len(lefts[i]) - o :] + suffixes[i][: length - o]) for i, o in zip(hot_row.tolist(), hot_o.tolist())]), "<i8").reshape(-1, 2)
            start = meta["pos"][hot_row] - hot_o
            more = [meta["doc"][hot_row], meta["dk"][hot_row], start, start + length, keys[:, 0] | 1, keys[:, 1]]
            out = [np.concatenate(x) for x in zip(out, more)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=span_schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != part and blobs:
                    if out := part_spans(blobs):
                        yield out
                    blobs = []
                part = row["part"]
                blobs.append((row["meta"], row["rests"], row["lefts"]))
        if blobs and (out := part_spans(blobs)):
            yield out

    exchanged = docs.select("id", "dk", "text").mapInArrow(common.lean(runs), "part int, meta binary, rests binary, lefts binary")
    found = exchanged.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(common.lean(merged), "doc long, dk long, s long, e long, k1 long, k2 long")
    if not heavy:
        return common.stage(found.select("doc", "dk", "s", "e"), "spans")
    found = common.stage(found, "spans")
    here = F.struct("doc", "s")
    again = found.filter("k1 != 0").withColumn("lowest", F.min(here).over(Window.partitionBy("k1", "k2"))).filter(here > F.col("lowest"))
    return found.filter("k1 = 0").select("doc", "dk", "s", "e").union(again.select("doc", "dk", "s", "e"))


def _joined(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """docs and, as the last column, the list of (s, e) to remove."""
    at, mark, spans_name = common.unused(docs, "_id", "_dk", "_spans")
    own = docs.withColumn(at, F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID))).withColumn(mark, F.xxhash64(F.col(text_col)))
    found = spans(own.select(F.col(at).alias("id"), F.col(mark).alias("dk"), F.col(text_col).alias("text")), length)
    lists = found.groupBy(F.col("doc").alias(at), F.col("dk").alias(mark)).agg(F.collect_list(F.struct("s", "e")).alias(spans_name))
    return own.join(lists, [at, mark], "left").select(*[f"`{c}`" for c in docs.columns], spans_name)


def cut(text: bytes, found: list) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    kept, at, n = [], 0, 0
    end = -1
    for s, e in sorted(found):
        if s > end:
            n += 1
            kept.append(text[at:s])
        end = at = max(end, e)
    return b"".join([*kept, text[at:]]), n


def _pairs(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(x["s"], x["e"]) for x in row or ()] for row in column.to_pylist()]


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row.

    A null text is empty and keeps nothing to remove; a null id sorts first. Rows that share an id share
    one place in the order: neither is earlier, so repeated rows are treated alike. An empty table gives no
    rows. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, found in zip(b.column(0).to_pylist(), common.byte_list(b.column(1)), _pairs(b.column(2))):
                kept, n = cut(text, found)
                rows.append((doc, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield common.batch(dict(zip(schema.names, zip(*rows))), schema)

    joined = _joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), length, "doc_id", "text")
    return joined.mapInArrow(common.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages cut from `text` and n_chars counted again. Characters of which only
    a part is left go too; documents of which only white space is left after a cut are dropped.

    A null text stays null and nothing repeats in it; a null id comes first; rows that share an id share one
    place in the order, so repeated rows are cut alike and none of them goes. An empty table gives no rows.
    Other columns may have any names and are kept.
    """
    schema = docs.schema
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for text, found in zip(b.column(at), _pairs(b.column(len(names)))):
                if found:
                    left = cut((text.as_py() or "").encode(), found)[0].decode("utf-8", "ignore")
                    texts.append(left)
                    keep.append(bool(left.strip()))
                else:
                    texts.append(text.as_py())
                    keep.append(True)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                changed = [len(t) if f else n for t, f, n in zip(texts, _pairs(b.column(len(names))), columns[k].to_pylist())]
                columns[k] = pa.array(changed, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return common.plain_names(_joined(docs, length, "doc_id", "text")).mapInArrow(common.lean(run), schema)

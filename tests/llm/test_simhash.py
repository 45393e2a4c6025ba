import os

import corpus_pipeline
import xxhash

from quadframe.llm import common
from quadframe.llm import simhash_dedup as S

from . import cases


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=4):
    fps = [plain_fingerprint(r[1]) for r in rows]
    low = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= distance:
                    low[i] = min(low[i], low[j])
    return sorted(((r[0], f"{f:016x}", None if m == -(1 << 63) else m) for r, f, m in zip(rows, fps, low)), key=str)


def test_hard_rows_match_brute_force(spark):
    rows = cases.hard_rows()
    for extra in (False, True):
        got = S.near_duplicates(cases.docs(spark, rows, extra)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_random_bits_all_blocks_and_chunks(spark):
    import random

    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(40)]
    fps = set()
    for c in centre:
        for _ in range(12):
            x = c
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(S._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    want = {frozenset(k for k in range(len(fps)) if find(k) == root) for root in range(len(fps)) if parent[root] == root}
    for blocks, chunk in ((5, 512), (6, 8), (7, 3)):
        own = list(range(len(fps)))

        def top(x):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in S.close_pairs(classes, 4, blocks, chunk).collect():
            assert (fps[a] ^ fps[b]).bit_count() <= 4
            own[top(a)] = top(b)
        assert {frozenset(k for k in range(len(fps)) if top(k) == root) for root in range(len(fps)) if own[root] == root} == want


def test_empty_table(spark):
    assert S.near_duplicates(cases.docs(spark, [])).count() == 0


def test_keep_one(spark):
    rows = cases.hard_rows()
    kept = [r[0] for r in S.keep_one(cases.docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted({c for d, _, c in brute(rows) if d == c}, key=str)


def test_keep_one_by_component_not_by_id(spark):
    texts = [cases.prose(100 + i, 120) for i in range(12)]
    near = texts[0].rsplit(" ", 1)[0]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:10]] + [(1, texts[10]), (1, texts[11]), (2, near), (3, texts[11]), (3, texts[11])]
    got = sorted(S.keep_one(cases.docs(spark, rows)).collect(), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:10]] + [(1, t) for t in texts[10:]], key=str)


def test_shared_ids_link_no_components(spark):
    texts = [cases.prose(100 + i, 120) for i in range(3)]
    # both fingerprints of id 9 have it as their smallest; only the first is near id 2's
    rows = [(9, texts[0]), (9, texts[1]), (10, texts[1] + " tail"), (2, texts[0] + " tail"), (None, texts[2]), (None, texts[2] + " tail")]
    assert sorted(map(tuple, S.near_duplicates(cases.docs(spark, rows)).collect()), key=str) == brute(rows)


def test_stage_by_shingle_similarity(spark):
    def changed(text, n):
        words = text.split()
        for k in range(n):
            words[10 + 25 * k] = f"new{k}"
        return " ".join(words)

    def similarity(x, y):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
        return len(a & b) / len(a | b)

    rows, want = [], []
    for i in range(30):
        text = cases.prose(200 + i, 200)
        near, far = changed(text, 4), changed(cases.prose(300 + i, 200), 6)
        assert similarity(text, near) >= 0.8 > similarity(cases.prose(300 + i, 200), far)
        rows += [(4 * i, text), (4 * i + 1, near), (4 * i + 2, cases.prose(300 + i, 200)), (4 * i + 3, far)]
        want += [4 * i, 4 * i + 2, 4 * i + 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, cases.docs(spark, rows), "").collect()) == want
    shingled = S._shingled(S._rows(cases.docs(spark, rows))[0].select("_id", "_hash", "text"))
    assert S.similar_links(shingled, chunk=1).distinct().count() == S.similar_links(shingled).distinct().count() == 30
    texts = [cases.prose(100 + i, 120) for i in range(4)]
    rows = [(None, t) for t in texts] + [(1, texts[0] + " tail"), (None, None), (3, " ")]
    kept = S.keep_dissimilar(cases.docs(spark, rows)).collect()
    assert sorted(r.text for r in kept if r.text) == sorted(texts) and len(kept) == 5


def test_stage_candidates_come_from_simhash(spark):
    x = S.shingle_set(cases.prose(1, 60).encode())
    plain, mask = 0, (1 << 64) - 1
    for bit in range(S.KEEP_BITS):
        ones = 0
        for h in x.tolist():
            h = h + (bit // 64 + 1) * 0x9E3779B97F4A7C15 & mask
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            ones += (h ^ h >> 31) >> bit % 64 & 1
        plain |= (2 * ones > len(x)) << bit
    assert int.from_bytes(S.wide_fingerprint(x), "little") == plain
    # 40 texts and a copy of each at a similarity of just over 0.8, and a crowd of copies
    rows = []
    for i in range(40):
        words = cases.prose(400 + i, 150).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join("new" if k in (20, 70, 120) else w for k, w in enumerate(words)))]
    base = cases.prose(900, 150)
    rows += [(100 + i, f"{base} w{i}") for i in range(30)]
    shingled = S._shingled(S._rows(cases.docs(spark, rows))[0].select("_id", "_hash", "text")).cache()
    of = {r["class"]: r["id"] for r in shingled.collect()}
    groups, near = {}, S.near_groups(shingled.select("class", "bits"), len(rows)).collect()
    for g in near:
        groups.setdefault(g.key, set()).add(of[g["class"]])
    assert all(any({2 * i, 2 * i + 1} <= g for g in groups.values()) for i in range(40))
    assert all(len({x // 2 if x < 100 else 100 for x in g}) == 1 < len(g) for g in groups.values())
    # trees, not all pairs, so a crowd's rows grow with its size
    assert sum(g.to is None for g in near) == len(groups)
    assert [r.doc_id for r in S.keep_dissimilar(cases.docs(spark, rows)).orderBy("doc_id").collect()] == [*range(0, 80, 2), 100]


def test_stage_links_small_sets_exactly(spark):
    rows = []
    for i in range(60):
        words = cases.prose(1000 + i, 12).split()
        rows += [(2 * i, " ".join(words[: 8 + i % 5])), (2 * i + 1, " ".join([*words[: 8 + i % 5], "new"]))]  # 4 to 8 shingles, and one more
    kept = S.keep_dissimilar(cases.docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


def test_stage_leaves_no_shingles_on_disk(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs = cases.docs(spark, [(i, cases.prose(i // 2, 30)) for i in range(40)])
    kept = S.keep_dissimilar(docs)
    left = {x.split("-")[1] for x in set(os.listdir(folder)) - before}
    assert "classes" in left and not left & {"shingles", "sets"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))

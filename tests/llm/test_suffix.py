import hashlib
import random

import numpy as np
import pytest

from quadframe.llm import suffix_dedup as S

from . import cases


def brute(rows, length=100):
    first = {}
    places = [(-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for doc, b in places:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (doc, p)), (doc, p))
    out = []
    for r, (doc, b) in zip(rows, places):
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (doc, p):
                gone[p + 1 : p + 1 + length] = True
        n = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((r[0], len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    r, out = random.Random(7), []
    shared = [cases.prose(100 + i, 40 + 10 * i) for i in range(6)]
    for i in range(120):
        parts = [cases.prose(1000 + i, r.randrange(1, 60))]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(60, len(p))], cases.prose(r.randrange(10**6), r.randrange(0, 12))]
        out.append((i * 3 % 120, " ".join(parts) * r.choice([1, 1, 1, 2])))
    return out + [(500, "-" * 1000), (501, "-" * 250 + "x" + "-" * 101), (502, "ab" * 300), (503, "x" * 99), (504, "日本語" * 70), (505, "日本語" * 40), (506, "\x00" * 300 + "tail")]


@pytest.mark.parametrize("extra", [False, True])
def test_hard_rows_match_brute_force(spark, extra):
    rows = cases.hard_rows()
    assert sorted(map(tuple, S.deduplicate(cases.docs(spark, rows, extra)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("hot", [None, 40])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    rows = passages()
    if hot:  # every group of more rows is split, and runs are short
        monkeypatch.setattr(S, "PART", hot)
        monkeypatch.setattr(S, "RUN", 50)
    assert sorted(map(tuple, S.deduplicate(cases.docs(spark, rows)).collect()), key=str) == brute(rows)


def test_loser_tree_orders_and_knows_prefixes():
    import os

    r = random.Random(2)
    for _ in range(300):
        runs = []
        for _ in range(r.randrange(1, 9)):
            own = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(8)))
            runs.append((own, [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(own, own[1:]))]))
        run, at, lcp = S.merge_runs(runs)
        out = [runs[i][0][j] for i, j in zip(run, at)]
        assert out == sorted(x for s, _ in runs for x in s)
        assert lcp == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:]))][: len(out)]


def test_front_coding_round_trip():
    r = random.Random(4)
    suffixes = sorted(bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 100))) for _ in range(200))
    lefts = [bytes(r.choice(b"a\0") for _ in range(r.randrange(3))) for _ in suffixes]
    _, s, x = S.decode(*S.front_code(suffixes, lefts, np.zeros(len(suffixes), S._META)))
    assert (s, x) == (suffixes, lefts)


def test_empty_and_documents(spark):
    assert S.deduplicate(cases.docs(spark, [])).count() == 0
    rows = [(i, text) for i, (_, text) in enumerate(passages())]
    df = cases.docs(spark, rows)
    out = S.deduplicated_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for doc, n, removed, _, _ in brute(rows):
        if not removed:
            assert len(got[doc][0].encode()) == n
        elif doc in got:
            assert len(got[doc][0].encode()) <= n - removed and got[doc][1] == len(got[doc][0])

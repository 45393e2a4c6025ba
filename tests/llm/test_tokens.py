import functools
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadframe.llm import packing, token_output, tokens

from . import cases


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path(name))
    t.encode_special_tokens = True
    return t


def ids_of(text, name, end):
    return np.array([*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("portion,remembered", [(8 << 20, 500_000), (40, 50)])
@pytest.mark.parametrize("name", [packing.VOCABULARY, token_output.VOCABULARY])
def test_chunks_encode_like_the_whole(name, portion, remembered, monkeypatch):
    monkeypatch.setattr(tokens, "PORTION", portion)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    e = tokens.Encoder(tokens.public_path(name))
    r = random.Random(3)
    parts = ["The", "don't", " ", "  ", "\n", "\t", "é", "e\u0301", "ß,", "word.", "...", "$$$", "12", "a1", "漢字", "\u00a0", "\u2003", "\u3000", "\x85", "'s", "'", "|", "<|endoftext|>", "\r\n", "\x1c", "İ", "Ǆ", "x,y", ",'s", "?\u0301", "\u0345", "ñ!", "\U0001f600", "A\u030a", "\u212a", "<", "’", "I\u0307"]
    texts = [None, "", "", " ", "a", " \n", None] + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)]
    for some in (texts, [], [""], ["\x00"], ["<"], [" x "], [None]):
        got = [ids.tolist() for flat, ends in e.encode(pa.array(some, pa.string()), 7) for ids in np.split(flat, ends[:-1])]
        assert len(got) == len(some)
        for text, ids in zip(some, got):
            assert ids == [*np.frombuffer(e.whole(text or ""), "<u4").tolist(), 7], repr(text)
    assert len(e.known) == len(e.known_ids) <= remembered


ENCODES_20_MB = """
import random, re
import pyarrow as pa
from quadframe.llm import packing, tokens

def size(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

r = random.Random(1)
words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 12))) for _ in range(400_000)]
texts = pa.array([" ".join(r.choices(words, k=240)) for _ in range(10_000)])
del words
e = tokens.Encoder(tokens.public_path(packing.VOCABULARY))
list(e.encode(texts.slice(0, 10), 1))
open("/proc/self/clear_refs", "w").write("5")
before = size("VmRSS")
for _ in e.encode(texts, 1):
    pass
print(texts.nbytes >> 20, size("VmHWM") - before)
"""


def test_a_worker_needs_little_beside_its_batch():
    said = subprocess.run([sys.executable, "-c", ENCODES_20_MB], env={"PYTHONPATH": ":".join(x for x in sys.path if x)}, capture_output=True, text=True, check=True).stdout
    batch, more = map(int, said.split())
    assert batch >= 19 and more < 160, said


def check_packed(rows, got, capacity):
    want = {}
    for doc, text, *_ in rows:
        ids = ids_of(text, packing.VOCABULARY, packing.END_ID)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.setdefault((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())), []).append(1)
    have = {}
    for g in got:
        have.setdefault((g.doc_id, g.piece, g.start, g.length, g.ids_crc32), []).append(1)
    assert have == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("extra", [False, True])
def test_pack_hard_rows(spark, extra):
    rows = cases.hard_rows()
    check_packed(rows, packing.pack(cases.docs(spark, rows, extra)).collect(), 4096)
    assert packing.pack(cases.docs(spark, [])).count() == 0


def test_pack_in_groups_is_whole_and_tight(spark):
    rows = [(i, cases.prose(i, 5 + i % 37)) for i in range(400)]
    got = packing.pack(cases.docs(spark, rows), capacity=256, groups=2).collect()
    used = check_packed(rows, got, 256)
    assert used <= 1.1 * sum(g.length for g in got) / 256 + 2


@pytest.mark.parametrize("times", [1, 1000, 10**9])
def test_plan_is_near_the_bound_at_every_size(times):
    r = random.Random(1)
    h = {4096: 3}
    for _ in range(5000):
        n = min(4096, int(r.lognormvariate(6.2, 1)) + 1)
        h[n] = h.get(n, 0) + times
    slots = packing.plan(h)
    for n, count in h.items():
        assert slots[slots[:, 0] == n, 2].sum() == count
    # between two edges all sequences are filled alike
    edges = np.unique(np.concatenate([slots[:, 1], slots[:, 1] + slots[:, 2]]))
    first, last = np.searchsorted(edges, slots[:, 1]), np.searchsorted(edges, slots[:, 1] + slots[:, 2])
    n, offset = slots[:, 0], slots[:, 3]
    fill, squares = np.zeros((2, len(edges)), np.int64)
    for out, x in ((fill, n), (squares, n * (2 * offset + n))):
        np.add.at(out, first, x)
        np.add.at(out, last, -x)
    fill, squares = np.cumsum(fill)[:-1], np.cumsum(squares)[:-1]
    assert (squares == fill**2).all()  # the pieces lie end to end from 0
    assert fill.max() <= 4096 and fill.min() > 0 and len(slots) <= 4096 * 32 * 10
    assert edges[-1] <= 1.01 * sum(k * v for k, v in h.items()) / 4096 + 4


@pytest.mark.parametrize("extra", [False, True])
def test_token_files_round_trip(spark, extra):
    rows = cases.hard_rows() + [(i, cases.prose(i, 30)) for i in range(100, 400)] + [(None, cases.hard_rows()[4][1])]
    got = {}
    for g in token_output.encode_and_read(cases.docs(spark, rows, extra)).collect():
        got.setdefault(g.doc_id, []).append((g.start, g.n_tokens, g.ids_crc32))
    start = 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # rows that share an id share their text here
        ids = ids_of(text, token_output.VOCABULARY, token_output.END_ID)
        got[doc].remove((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert not any(got.values())
    assert token_output.encode_and_read(cases.docs(spark, [])).count() == 0


def test_reader_gives_sequences_without_copies(tmp_path):
    w = token_output.Writer(f"file://{tmp_path}/x.arrow", sequence=8, batch_sequences=4)
    ids = np.arange(75, dtype="<u4")
    for i in range(0, 75, 5):
        w.add(ids[i : i + 5])
    w.close()
    r = token_output.Reader(f"file://{tmp_path}/x.arrow")
    back = [r.sequence_at(i) for i in range(10)]
    assert np.concatenate([a[np.array(m)] for a, m in back]).tolist() == ids.tolist()
    assert not back[0][0].flags.owndata and r.crc32(6, 60) == zlib.crc32(ids[6:66].tobytes())

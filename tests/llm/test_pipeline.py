import random
import zlib

import corpus_pipeline as P
from quadframe.llm import common, language_id, packing

from . import cases, test_classifiers, test_simhash, test_suffix, test_tokens


def rows():
    r = random.Random(1)
    out = []
    for i in range(240):
        words = [test_classifiers.EN, test_classifiers.DE, test_classifiers.FR, test_classifiers.ES][i % 4]
        # words with numbers make texts differ
        out.append((i, " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(r.randrange(20, 200))), ("en", "de", "fr", "es")[i % 4], f"s{i % 3}"))
    out += [(1000 + i, out[i][1], out[i][2], out[i][3]) for i in range(0, 40, 4)]
    passage = " ".join(r.choice(test_classifiers.EN) + str(r.randrange(900)) for _ in range(60))
    out += [(2000 + i, out[i * 5][1][:200] + " " + passage + " " + out[i * 7 + 1][1][:300], "en", None) for i in range(20)]
    return out + [(3000, None, "en", "s0"), (3001, "12 34", None, "s0"), (3002, "", "de", "s1")]


def test_each_stage_on_its_own_input(spark):
    docs = cases.docs(spark, rows())
    names = docs.columns
    first = P.identify_language(spark, docs, "").cache()
    assert first.columns == names
    kept = {d.doc_id for d in first.collect()}
    model = language_id.fit(docs)
    assert kept == {r[0] for r in rows() if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= language_id.MIN_SCORE}
    assert len([r for r in rows() if r[0] < 3000]) - len(kept) <= 2 and not kept & {3000, 3001, 3002}

    second = P.drop_near_duplicates(spark, first, "").cache()
    whole = [(d.doc_id, d.text) for d in first.collect()]
    assert sorted(d.doc_id for d in second.collect()) == sorted({c for d, _, c in test_simhash.brute(whole) if d == c})

    third = P.cut_repeated_passages(spark, second, "").cache()
    assert second.columns == third.columns == names
    cut = {d.doc_id: d for d in third.collect()}
    for doc, n, removed, _, _ in test_suffix.brute([(d.doc_id, d.text) for d in second.collect()]):
        if doc in cut:
            assert len(cut[doc].text.encode()) == n - removed and cut[doc].n_chars == len(cut[doc].text)
        else:
            assert removed

    fourth = P.mix_sources(spark, third, "").cache()
    assert fourth.columns == names
    copies = {}
    for d in fourth.collect():
        copies[d.doc_id] = copies.get(d.doc_id, 0) + 1
        assert d.text == cut[d.doc_id].text
    assert max(copies.values()) <= 3

    fifth = P.pack_sequences(spark, fourth, "").collect()
    assert test_tokens.check_packed([(d.doc_id, d.text) for d in fourth.collect()], fifth, packing.CAPACITY)
    assert all(0 <= g.ids_crc32 < 1 << 32 for g in fifth) and zlib.crc32(b"") == 0


def test_stages_keep_columns_of_any_name(spark):
    """Every stage on hard rows with clashing columns: they come through, and no row is lost but by decision."""
    docs = cases.docs(spark, cases.hard_rows() + rows()[:80], extra=True)
    names, n = docs.columns, docs.count()
    for stage in (P.identify_language, P.drop_near_duplicates, P.cut_repeated_passages, P.mix_sources):
        docs = stage(spark, docs, "").cache()
        assert docs.columns == names
        assert docs.filter("`a.b` = 'x' AND _spans = 'x'").count() == docs.count() > 60
    packed = P.pack_sequences(spark, docs, "")
    assert packed.filter("piece = 0").count() == docs.count()


def test_run_on_files_and_empty(spark, tmp_path):
    docs = cases.docs(spark, rows())
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = P.run(spark, f"{tmp_path}/a").collect()
    held = {}
    for g in got:
        held.setdefault(g.sequence_id, []).append((g.offset, g.length))
    assert len({g.doc_id for g in got}) > 150
    assert all(sum(n for _, n in own) == max(o + n for o, n in own) <= packing.CAPACITY for own in held.values())
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0


def test_workers_give_memory_back():
    def size():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def run(batches):
        kept = [bytes(1000) for _ in range(200_000)]  # small blocks, which a worker would keep
        yield from batches
        last.append(bytes(1000))  # above them, so that the heap's end does not move down by itself
        del kept

    last = []
    before = size()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert size() - before < 100

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadframe.llm import mixing as M

from . import cases


def by_sql(df):
    documents = pa.Table.from_pylist([r.asDict() for r in df.select("doc_id", "text", "source").collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))  # noqa: F841
    return sorted(duckdb.sql(M.ORACLE).fetchall(), key=str)


def rows():
    names = [None, "a", "b", "c", "hot", "tiny", "zz", "é"]
    out = [(i, cases.prose(i, 3 + i * 7 % 90), None, names[4] if i % 3 == 0 else names[i % 8]) for i in range(300)]
    return out + [(None, cases.prose(400 + i, 5 + i % 9), None, "hot") for i in range(60)] + [(900, None, None, "a"), (901, "", None, "b"), (902, "x", None, "only"), (None, "p q", None, None), (5, out[5][1], None, out[5][3]), (903, cases.prose(9, 30_000), None, "b"), (904, " ", None, "void")]


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("block", [7, 1024])
def test_matches_sql(spark, extra, block):
    df = cases.docs(spark, rows(), extra)
    per_doc, per_slot = M.mixture(df, block=block)
    got = per_doc.select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(df)
    assert per_slot.agg(F.sum("words")).collect()[0][0] == per_doc.agg(F.sum("taken")).collect()[0][0]
    assert per_slot.groupBy("slot").agg(F.sum("words").alias("w")).filter(f"w > {block}").count() == 0


def test_schedule_keeps_shares_everywhere(spark):
    per_doc, per_slot = M.mixture(cases.docs(spark, rows()), block=16)
    share = {r.source: r.target for r in per_doc.select("source", "target").distinct().collect()}
    slots = sorted({(r.slot, r.source) for r in per_slot.collect()}, key=lambda x: x[0])
    part = [s for _, s in slots][: len(slots) // 2]
    for source, target in share.items():
        assert abs(part.count(source) - len(part) * target / sum(share.values())) < 8


def test_only_builtin_operators(spark):
    plan = M.mixture(cases.docs(spark, rows()))[0]._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_empty_and_documents(spark):
    assert M.mixture(cases.docs(spark, []))[0].count() == 0
    df = cases.docs(spark, rows())
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    per = M.mixture(df)[0].groupBy("source").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()
    n = F.regexp_count("text", F.lit(M.WORD))
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(n)).collect()}
    for r in per:  # only the document at which a source's words end is rounded
        assert abs(words.get(r.source, 0) - r.taken) <= r.size / 2 + 1

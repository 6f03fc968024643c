"""The pipeline stage by stage: columns, whole input, decisions against brute force; and every registered query of the package."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
from eventflow.llm import decontaminate
from eventflow.llm.common import table, written
from eventflow.llm.queries import QUERIES, SQL

from ..oracle import connect, differences
from .samples import AWKWARD


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = table(spark, data, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, data), "stage")
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == ["quality", "exact dedup", "near dedup", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema and 0 < after.count() <= before.count()


def test_decisions(stages):
    by_name = {name: (before.collect(), after.collect()) for name, before, after in stages}
    before, after = by_name["exact dedup"]
    texts = {}
    for r in before:
        texts.setdefault(" ".join(r.text.replace("\x0b", " ").split()) if r.text else "", []).append(r.doc_id)
    assert len(after) == len({r.doc_id for r in after}) and {min(v) for v in texts.values()} >= {r.doc_id for r in after}
    before, after = by_name["decontamination"]
    bench = [(0, t.text) for t in table(stages[0][1].sparkSession, "/root/testdata/sf0.001", "benchmark").collect()]
    leaking = [r for r in before if any(t in (r.text or "") for _, t in bench)]
    assert leaking and not {r.doc_id for r in leaking} & {r.doc_id for r in after}
    block = decontaminate.item_block(bench, 0.8, 0.98)
    matched = {before[m[0]].doc_id for m in decontaminate.matches([r.text or "" for r in before], block)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - matched
    before, after = by_name["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_gives_the_stages_result(spark, data, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_awkward_documents(spark, data):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in AWKWARD], table(spark, data, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), "stage")
    assert docs.count() > 0
    docs = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), "stage")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), connect(data), SQL[name]) is None

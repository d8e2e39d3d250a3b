"""The pipeline against the operators one by one, and on odd documents."""

import corpus_pipeline as cp
from siltscope.llm.common import documents


def test_stages_pass_on_what_they_keep(spark, sf):
    docs = documents(spark, sf)
    n = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents(spark, sf).columns, name
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] < n[0]
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts))
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n[-1]
    assert cp.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").exceptAll(packed.select("doc_id", "piece", "length", "ids_crc32")).count() == 0


def test_stages_on_odd_documents(spark, sf, odd):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert 0 < out.count() <= odd.count(), name


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_go_not_ids(spark, sf, docs):
    """Another text under a dropped row's id stays; of rows that repeat id and text, one."""
    assert left(cp.exact(spark, docs((5, "A"), (9, "A"), (5, "B")), sf)) == [(5, "B"), (9, "A")]
    assert left(cp.exact(spark, docs((5, "A"), (9, "A"), (9, "A"), (7, "C"), (7, "C"), (None, "N"), (None, "N"), (None, "C")), sf)) == [(7, "C"), (9, "A"), (None, "N")]
    a = " ".join(f"w{i}" for i in range(60))
    b, other = a + " tail", " ".join(f"x{i}" for i in range(60))
    assert left(cp.near(spark, docs((3, a), (5, b), (5, other), (8, "")), sf)) == [(3, a), (5, other), (8, "")]
    # what stands under the component's id stays: a text that is no copy of it must not go with one that is
    assert left(cp.near(spark, docs((3, a), (3, other), (None, b), (4, a + " more")), sf)) == [(3, a), (3, other)]


def test_an_empty_table_passes_all_stages(spark, sf, empty):
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0, name

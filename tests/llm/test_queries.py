import pytest

from tablewright.llm.queries import ORACLES, QUERIES
from tests.compare import DIR, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what brute force makes of its own input."""
    import corpus_pipeline
    from tests.llm.test_jaccard_join import brute as groups
    from tests.llm.test_suffix_dedup import brute as repeats

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs.collect(), spark.read.parquet(str(tmp_path / str(k))).collect()))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    before, after = kept[1]
    found = groups([r.text for r in before], 5, 80)
    assert {r.doc_id for r in after} == {before[i].doc_id for i in {c for _, c in found.values()}} or len(after) == len({c for _, c in found.values()})
    before, after = kept[2]
    lengths = {r.doc_id: len(r.text.encode()) for r in after}
    for r, (n, removed, _, _) in zip(before, repeats([r.text for r in before], 400), strict=True):
        assert lengths[r.doc_id] in range(n - removed - 6 * 4, n - removed + 1)
    assert {r.doc_id for r in kept[3][1]} <= {r.doc_id for r in kept[3][0]} and len(kept[4][1]) == len(kept[3][1])

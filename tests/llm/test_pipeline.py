"""The pipeline's stages, held against each operator's own verdict."""

from collections import Counter

from caremart.llm import queries
from caremart.llm.common import table


def test_pipeline(spark, small):
    import corpus_pipeline as P

    small = small.replace("sf0.001", "sf0.01")  # enough labels to learn from
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = table(spark, small, "documents").cache()
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], small).cache())
    for f in frames[:-1]:
        assert f.dtypes == docs.dtypes
    assert frames[-1].columns == [*docs.columns, "shard"]
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]

    toxic = {r["doc_id"] for r in queries.op4_toxicity(spark, small).filter("predicted = 1").collect()}
    assert toxic and set(ids[1]) == set(ids[0]) - toxic

    from caremart.llm.jaccard_join import link
    classes = link(frames[1]).collect()
    assert set(ids[2]) == {r["class_id"] for r in classes} and max(ids[2].values()) == 1

    bad = {r["doc_id"] for r in queries.op10_decontamination(spark, small).filter("contaminated").collect()}
    assert bad & set(ids[0]) and set(ids[3]) == set(ids[2]) - bad

    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    assert ids[5] == ids[4]
    same = Counter(tuple(r) for r in P.run(spark, small).collect())
    assert same == Counter(tuple(r) for r in frames[-1].collect())


def test_stages_take_empty_documents(spark, small):
    import corpus_pipeline as P

    docs = table(spark, small, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0

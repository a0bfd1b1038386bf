import __spark_entry__
import corpus_pipeline
from shelfmark.session import read_table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = read_table(spark, SF, "documents")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        n = out.count()
        assert 0.5 * rows <= n <= rows, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_stages_on_awkward_and_empty_tables(spark, docs, no_docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, SF), stage(spark, no_docs, SF)
        assert none.count() == 0
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert got.columns == docs.columns == none.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        rows = got.collect()
        kept = {r.doc_id for r in rows}
        if name == "line_dedup":
            assert len(rows) == docs.count() and {r.doc_id: r.text for r in rows}[1] is None
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "simhash_near_dedup":
            assert 0 in kept and 7 not in kept and 1 in kept and 2 not in kept and len(rows) == len(kept)
        if name in ("benchmark_decontamination", "sentencepiece"):
            assert len(rows) == docs.count()


def test_near_copies_at_the_threshold_are_nearly_all_found(spark):
    """What the candidates miss, measured: pairs of texts with a Jaccard similarity from 0.8 on."""
    import random

    import corpus_pipeline
    from shelfmark.llm import simhash as S

    r = random.Random(2)
    texts = []
    for _ in range(300):
        base = [f"w{r.randrange(10**7)}" for _ in range(200)]
        copy = list(base)
        for k in r.sample(range(200), 4):  # four words touch some 20 of 196 runs on either side
            copy[k] = f"x{r.randrange(10**7)}"
        texts += [" ".join(base), " ".join(copy)]
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [k for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    assert len(near) > 200
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x.doc_id: x.component_id for x in S.simhash_groups(frame, **corpus_pipeline.NEAR).collect()}
    assert sum(group[k] == group[k + 1] for k in near) >= 0.99 * len(near)

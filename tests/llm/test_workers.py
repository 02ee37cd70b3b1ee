import numpy as np

import corpus_pipeline
from tessera.llm import mixing


def test_no_task_of_mixing_has_two_workers(spark, data, edge):
    mixed = corpus_pipeline.mix_sources(spark, edge, data)
    assert mixed._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_rates_in_the_pass_of_the_posteriors(edge):
    rng = np.random.default_rng(3)
    model = mixing.Classifier(["a", "b"], rng.normal(size=(mixing.BUCKETS, 2)), np.zeros(2))
    pushes, rows = np.array([0.4, -0.7]), edge.select("doc_id", "text")
    plain = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.posterior, r.rate) for r in df.collect())
    one, two = plain(mixing.posteriors(rows, model, pushes, least=0.9)), plain(mixing.with_rates(mixing.posteriors(rows, model), pushes, least=0.9))
    assert one == two and len({r[4] for r in one}) > 2

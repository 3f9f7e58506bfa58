import numpy as np

from fathomline.plans.queries_vectors import ivf_search


def recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    got = {}
    for r in ivf_search(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = [i for i in ids if i % 50 == 0]
    assert set(got) == set(queries)
    true = {i: {ids[j] for j in np.argsort(((x - x[ids.index(i)]) ** 2).sum(1), kind="stable")[:10]} for i in queries}
    return float(np.mean([len(got[i] & true[i]) / 10 for i in queries]))


def test_recall_of_the_registered_search(spark):
    for size in ("sf0.01", "sf0.1"):
        at = recall(spark, f"/root/testdata/{size}")
        print("recall", size, at)
        assert at >= 0.9

"""The pipeline's stages, one after the other, each against brute force on its own input."""

import random
from collections import Counter

from parlance.llm import mixture, quality
from test_operators import SCHEMA, contaminated_rows, grams, leaks, near, tokens_of, words


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    bench = [(i, words(rng, rng.randrange(14, 60), 9999)) for i in range(25)]
    data = contaminated_rows(bench)
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        after = Counter(r.doc_id for r in docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            assert after == Counter(i for i, t, *_ in before if quality.verdict(t)["kept"])
        elif k == 1:
            assert after == Counter(i for i, (c, _) in near(before).items() if c == i)
        elif k == 2:
            assert after == Counter(i for i, t, *_ in before if not any(leaks(t, grams(b)) for _, b in bench))
        elif k == 3:
            size = Counter()
            for _, t, _, s, _ in before:
                size[s] += len(tokens_of(t))
            order = sorted(size, key=lambda s: (s is None, s or ""))
            goal = dict(zip(order, mixture.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
            for s in order:
                own = [len(tokens_of(t)) for _, t, _, x, _ in before if x == s]
                assert abs(sum(after[i] * len(tokens_of(t)) for i, t, _, x, _ in before if x == s) - goal[s]) <= max(own) / 2 + 1
        else:
            assert after == Counter(i for i, *_ in before)
        seen.append(sum(after.values()))
    assert seen[0] > seen[1] > seen[2] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]

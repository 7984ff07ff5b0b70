import random

import numpy as np
import pytest

from gleaner.llm import packing as P


def naive(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(left) if r >= sizes[i]]
        if fits:
            _, k = min(fits)
            left[k] -= sizes[i]
        else:
            k = len(left)
            left.append(capacity - sizes[i])
        out[i] = k
    return out


@pytest.mark.parametrize("seed", range(6))
def test_same_number_as_naive_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    got = P.best_fit_decreasing(np.array(sizes), 100)
    fill = np.bincount(got, weights=sizes)
    assert fill.max() <= 100 and len(fill) == len(set(naive(sizes, 100)))


def check(packed, sizes, capacity):
    data = packed.collect()
    fill = {}
    for r in data:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
    assert max(fill.values(), default=0) <= capacity
    total = {}
    for r in data:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
    assert total == {i: n for i, n in sizes if n}
    assert all(sum(r.doc_id == i for r in data) == 1 for i, n in sizes if 0 < n <= capacity)
    return fill


@pytest.mark.parametrize("shard", [50_000, 200])
def test_packing(spark, shard):
    rng = random.Random(8)
    sizes = [(i, min(5000, int(rng.lognormvariate(5.5, 1)))) for i in range(2000)] + [(9001, 0), (9002, 2048), (9003, 4096), (9004, 4097)]
    fill = check(P.pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), shard_items=shard), sizes, 2048)
    used = sum(n for _, n in sizes)
    assert used / (len(fill) * 2048) > 0.985


def test_repeated_and_null_ids(spark):
    data = [(7, 5000, "x")] * 3 + [(None, 3000, "x")] * 2 + [(None, None, "x")]
    done = P.pack(spark.createDataFrame(data, "doc_id long, tokens long, container_id string")).collect()
    fill = {}
    for r in done:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
    assert sum(fill.values()) == 21_000 and max(fill.values()) <= 2048


def test_edges(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0
    check(P.pack(spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, tokens long"), capacity=1), [(1, 1), (2, 1)], 1)
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 1)], "doc_id long, tokens long"), capacity=0)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokenizers(spark, name):
    import os

    path = f"/opt/tokenizers/{name}"
    if not os.path.exists(path):
        pytest.skip("no tokenizers here")
    df = spark.createDataFrame([(1, "Ein Text, zwei Texte <|endoftext|>."), (2, ""), (3, None)], "doc_id long, text string")
    got = dict(P.token_counts(df, tokenizer=path).collect())
    assert got[1] > 5 and got[2] == 0 and got[3] == 0

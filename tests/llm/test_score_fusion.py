import math
from statistics import median

from pyspark.sql import functions as F

from gleaner.llm import score_fusion as S
from tests.conftest import rows


def items(spark, data):
    return spark.createDataFrame(data, "list_key string, item_id long, scores map<string,double>")


def expected(data, against=()):
    out = {}
    for key in {d[0] for d in data}:
        own = [d for d in data if d[0] == key]
        names = {n for _, _, s in own for n, v in s.items() if v is not None and math.isfinite(v)}
        fused = {}
        for _, i, s in own:
            parts = []
            for n in sorted(names):
                values = [t[n] for _, _, t in own if t.get(n) is not None and math.isfinite(t[n])]
                values.sort()
                mid = values[(len(values) - 1) // 2]
                off = sorted(abs(v - mid) for v in values)
                mad, mean = off[(len(off) - 1) // 2], sum(off) / len(off)
                scale = mad * 1.4826 or mean * 1.2533
                v = s.get(n)
                z = 0.0 if v is None or not math.isfinite(v) or not scale else (v - mid) / scale
                parts.append(math.log(max(1e-9, 1 / (1 + math.exp(max(-700, min(700, -z if n not in against else z)))))))
            fused[i] = math.exp(sum(parts) / len(parts)) if parts else None
        out.update({(key, i): f for i, f in fused.items()})
    return out


def test_against_plain_python(spark):
    import random

    rng = random.Random(2)
    data = [("p" if i % 3 else "q", i, {"big": rng.gauss(5000, 900), "small": rng.random(), "flag": float(rng.random() > 0.8), "x_penalty": rng.random()}) for i in range(60)]
    data[0][2]["big"] = 1e12
    data[1][2]["small"] = float("nan")
    data[2][2]["flag"] = None
    got = {(r.list_key, r.item_id): r.fused for r in S.fused_ranking(items(spark, data), against="_penalty$").collect()}
    want = expected(data, {"x_penalty"})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_score_dominates_by_range(spark):
    data = [("p", i, {"a": float(i), "b": float(i) * 1e6}) for i in range(20)] + [("p", 99, {"a": -50.0, "b": 1e15})]
    top = [r.item_id for r in S.fused_ranking(items(spark, data), top=3).orderBy("position").collect()]
    assert top == [19, 18, 17]


def test_ties_empty_and_weights(spark):
    data = [("p", i, {"a": 1.0}) for i in (3, 1, 2)]
    assert [r.item_id for r in S.fused_ranking(items(spark, data)).orderBy("position").collect()] == [1, 2, 3]
    assert S.fused_ranking(items(spark, [])).count() == 0
    data = [("p", 1, {"a": 1.0, "b": 0.0}), ("p", 2, {"a": 0.0, "b": 1.0}), ("p", 3, {"a": 0.5, "b": 0.5})]
    assert S.fused_ranking(items(spark, data), weights={"b": 5.0}, top=1).first().item_id == 2


def test_latest_scores(spark):
    good = '{"scores": {"w": 1.0, "x_penalty": 0.5}, "reasons": {}}'
    data = [("p", 1, 1.0, 2.0, good, 1), ("p", 1, 9.0, 2.0, good, 2), ("p", 1, 9.0, 2.0, good, 2), ("p", 2, None, None, '{"scores": {"w":', 1), ("p", 3, 1.0, 1.0, None, 1), (None, 1, 1.0, 1.0, good, 1)]
    df = spark.createDataFrame(data, "profile string, job_rowid long, final_score double, semantic_raw double, rules_json string, computed_at long")
    got = {r.item_id: r.scores for r in S.latest_scores(df).collect()}
    assert got[1] == {"final_score": 9.0, "semantic_raw": 2.0, "w": 1.0, "x_penalty": 0.5}
    assert got[2] == {"final_score": None, "semantic_raw": None} and got[3] == {"final_score": 1.0, "semantic_raw": 1.0}


def test_query(spark, sf_dir):
    counts = dict(S.p3_found(spark, sf_dir).groupBy("profile").count().collect())
    assert counts and all(n == 10 for n in counts.values())
    assert median([1, 2, 3]) == 2 and rows(S.p3_ranking(spark, sf_dir).where(F.col("position") == 1).select("position"))


def test_lists_without_finite_scores(spark):
    data = [("p", 1, {"a": 1.0}), ("p", 2, {"a": 2.0}), ("q", 9, {"a": None}), ("q", 4, {"a": math.nan, "b": math.inf}), ("q", 5, {}), (None, 7, {"a": 1.0})]
    got = S.fused_ranking(items(spark, data))
    assert rows(got.where("list_key = 'q'").select("item_id", "fused", "position")) == [(4, 0.5, 1), (5, 0.5, 2), (9, 0.5, 3)]
    assert got.count() == 5


def test_exact_medians_in_a_hot_list(spark, monkeypatch):
    """Exact ranks over range partitions, where sketches of few values are off; ties and repeats included."""
    import random

    rng = random.Random(5)
    data = [("hot" if i % 5 else "cold", i, {"a": rng.choice([1.0, 2.0, rng.random()]), "b": rng.gauss(0, 1)}) for i in range(3000)]
    df = items(spark, data)
    monkeypatch.setattr(S, "ACCURACY", 10)
    stats = {r.list_key: r.stats for r in S.robust_statistics(df, exact=True).collect()}
    for key in ("hot", "cold"):
        for name in ("a", "b"):
            values = sorted(s[name] for k, _, s in data if k == key)
            mid = values[(len(values) - 1) // 2]
            mad = sorted(abs(v - mid) for v in values)[(len(values) - 1) // 2]
            assert abs(stats[key][name]["median"] - mid) < 1e-12 and abs(stats[key][name]["scale"] - mad * 1.4826) < 1e-12
    ranked = S.fused_ranking(df, exact=True).collect()
    for key in ("hot", "cold"):
        own = sorted((r for r in ranked if r.list_key == key), key=lambda r: (-r.fused, r.item_id))
        assert [r.position for r in own] == list(range(1, len(own) + 1))


def test_queries_beside_sql(spark, sf_dir):
    from tests.compare import differences

    for name in ("p3_found", "p3_ranking"):
        assert differences(spark, sf_dir, name, S.QUERIES[name], S.ORACLE_SQL[name]) is None

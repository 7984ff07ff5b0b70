import random

from pyspark.sql import functions as F

from gleaner.llm import survivors as S
from tests.compare import differences
from tests.conftest import rows

SCHEMA = "g string, a string, b string, cut boolean, trust int, age long, id long, extra string"


def fields():
    return [S.SurvivingField("a", F.col("a").isNotNull() & (F.col("a") != ""), ~F.col("cut")), S.SurvivingField("b", F.col("b").isNotNull())]


def run(df):
    return rows(picks(df).drop("layer"))


def picks(df):
    return S.surviving_rows(df, group=F.col("g"), fields=fields(), trust=F.col("trust"), recency=F.col("age"), row_id=F.col("id"))


def test_against_brute_force(spark):
    rng = random.Random(11)
    data = [
        (rng.choice(["x", "y", "z", None, "hot", "hot", "hot"]), rng.choice(["v", "", None]), rng.choice(["w", None]), rng.choice([True, False, None]), rng.choice([0, 1, 3, None]), rng.choice([None, 1, 2, 3]), i, "e")
        for i in range(400)
    ] + [("one", "v", "w", False, 0, 1, 999, "e"), ("empty", None, None, None, None, None, 1000, "e"), ("empty", None, None, None, None, None, 1001, "e")]
    want = []
    for g in {d[0] for d in data} - {None, "one"}:
        for name, pos in (("a", 1), ("b", 2)):
            usable = [d for d in data if d[0] == g and d[pos] not in (None, "")]
            whole = lambda d: name == "b" or d[3] is False
            usable.sort(key=lambda d: (not whole(d), 1 << 20 if d[4] is None else d[4], -(d[5] if d[5] is not None else -(1 << 62)), d[6]))
            if usable:
                want.append((g, name, usable[0][6]))
    assert run(spark.createDataFrame(data, SCHEMA)) == sorted(want)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([("x", "v", None, False, 0, 5, 7, "e")] * 3, SCHEMA)
    assert run(df) == [("x", "a", 7)]
    assert run(df.limit(0)) == []


def test_later_layers_fill(spark):
    """Nulls of the first layer are filled from the next ones, by trust even past a first-layer value."""
    second = [("x", "v", None, False, 0, 9, 1, "e"), ("x", None, "w", False, 1, 5, 2, "e")]  # 1 is newer and more trusted, 2 as complete
    assert {(r.field_name, r.row_id, r.layer) for r in picks(spark.createDataFrame(second, SCHEMA)).collect()} == {("a", 1, 1), ("b", 2, 2)}
    third = [("x", "v", "w", False, 0, 9, 1, "e"), ("x", "", None, True, 0, 8, 2, "e"), ("x", None, None, None, 3, 1, 3, "e")]
    assert {(r.field_name, r.row_id, r.layer) for r in picks(spark.createDataFrame(third, SCHEMA)).collect()} == {("a", 1, 1), ("b", 1, 1)}
    # 1 beats 2 in all three measures and lacks b; 3 is in the first layer by its date and has b, but 2 is more trusted
    beaten = [("x", "v", None, False, 0, 5, 1, "e"), ("x", None, "w", False, 0, 4, 2, "e"), ("x", None, "w", False, 3, 9, 3, "e")]
    assert {(r.field_name, r.row_id, r.layer) for r in picks(spark.createDataFrame(beaten, SCHEMA)).collect()} == {("a", 1, 1), ("b", 2, 2)}


def test_layers_against_plain_python(spark):
    rng = random.Random(8)
    data = [(i, rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 3)) for i in range(60)]
    kind = "struct<id:int,complete:int,trust:int,age:int>"
    df = spark.createDataFrame([([{"id": i, "complete": c, "trust": t, "age": a} for i, c, t, a in data],), ([],)], f"r array<{kind}>")
    got, none = (r[0] for r in df.select(S.dominance_layers(F.col("r"), kind)).collect())
    rest, want = data, []
    beats = lambda y, x: y[1] >= x[1] and y[2] <= x[2] and y[3] <= x[3] and y[1:] != x[1:]
    while rest:
        front = [x for x in rest if not any(beats(y, x) for y in rest)]
        want.append(sorted(x[0] for x in front))
        rest = [x for x in rest if x not in front]
    assert [sorted(x.id for x in layer) for layer in got] == want and none == []


def test_portals_and_cut_texts(spark):
    df = spark.createDataFrame([("JOB_ROOM",), ("Job-room",), ("zentraljob ",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(S.portal_rank(F.col("p"))).collect()] == [0, 0, 3, None, None]
    texts = ["voll.", "abge...", "abge…", "abge [...]</p>", "abge … mehr</p>\n", "drei ... Punkte hier", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(S.CUT_OFF)).collect()
    assert [r[0] for r in got] == [False, True, True, True, True, False, None]
    values = ["8000", "-", " n/a ", "0000", "", None, "k.A."]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(F.coalesce(S.usable_text(F.col("t")), F.lit(False))).collect()] == [True] + [False] * 6


def test_query_and_records(spark, sf_dir):
    assert differences(spark, sf_dir, "p2_found", S.p2_found, S.P2_FOUND_SQL) is None
    assert differences(spark, sf_dir, "p2_records", S.p2_records, S.P2_RECORDS_SQL) is None
    built = S.p2_records(spark, sf_dir)
    assert built.count() == S.p2_found(spark, sf_dir).select("cluster_id").distinct().count()

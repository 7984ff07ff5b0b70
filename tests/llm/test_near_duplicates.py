import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleaner.llm import near_duplicates as N
from gleaner.llm.components import connected_components
from tests.conftest import rows


def corpus(n, seed=4):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(90)] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 2, 5, 9, 20])):
            words[rng.randrange(90)] = f"n{rng.random()}".replace(".", "")
        out.append((i, i % 2, " ".join(words)))
    return out


def shingles(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(data, k, t):
    s = {i: shingles(x, k) for i, _, x in data if x}
    return sorted((i, j) for i, b, x in data for j, c, y in data if i < j and b == c and x and y and len(s[i] & s[j]) / len(s[i] | s[j]) >= t)


def test_trie_finds_what_the_budget_allows():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (700, 4), dtype=np.uint64)
    b = a[:200].copy()
    flips = rng.integers(0, 256, (200, 30))
    for i in range(200):
        for f in flips[i]:
            b[i, f // 64] ^= np.uint64(1) << np.uint64(63 - f % 64)
    allowed = N.budget(256, 0.6)
    want = {(i, j) for i in range(700) for j in range(200) if int(np.bitwise_count(a[i] ^ b[j]).sum()) <= allowed}
    want = {(i, j) for i, j in want if all(int(np.bitwise_count(a[i, :w] ^ b[j, :w]).sum()) <= N.budget(64 * w, 0.6) for w in (1, 2, 3))}
    got = set(zip(*(x.tolist() for x in N.trie_join(a, b, 0.6))))
    assert got <= {(i, j) for i in range(700) for j in range(200)} and len(want - got) <= 0.005 * len(want)
    i, j = N.trie_join(np.concatenate((a, a[:50])), None, 0.6)
    assert {(x, x + 700) for x in range(50)} <= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}


def flipped(rng, base, n, most):
    """`n` signatures of 32 bytes, each up to `most` bits from one of the rows of `base`."""
    out = base[rng.integers(0, len(base), n)].copy()
    for i in range(n):
        for f in rng.integers(0, 256, rng.integers(0, most + 1)):
            out[i, f // 64] ^= np.uint64(1) << np.uint64(63 - f % 64)
    return out


def test_trie_walks_many_groups_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    words, nodes, want = [], [], set()
    for size in (2, 3, 40, 150, 1, 64, 2):
        lo = sum(map(len, words))
        w = flipped(rng, rng.integers(0, 1 << 63, (max(1, size // 8), 4), dtype=np.uint64), size, 70)
        w = w[np.lexsort(w.T[::-1])]
        words.append(w)
        nodes.append((lo, lo + size, lo, lo + size))
        for i in range(size):
            for j in range(i + 1, size):
                bits = [format(int(x ^ y), "064b") for x, y in zip(w[i], w[j])]
                if all("".join(bits)[:d].count("1") <= N.budget(d, 0.6) for d in (64, 128, 192, 256)):
                    want.add((lo + i, lo + j))
    for wide in (N.WIDE, 7):
        monkeypatch.setattr(N, "WIDE", wide)
        i, j = N.trie_pairs(np.concatenate(words), np.array(nodes), 0.6)
        got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
        assert len(got) == len(i) and got <= want and len(want - got) <= 0.005 * len(want)


def test_hot_blocks_are_split_evenly(spark):
    """50,000 signatures that share most of their leading bits: no part exceeds the bound, none is lost."""
    rng = np.random.default_rng(5)
    sig = flipped(rng, rng.integers(0, 1 << 63, (2, 4), dtype=np.uint64), 50_000, 12).byteswap()
    pdf = pd.DataFrame({"block": 1, "id": range(50_000), "signature": [r.tobytes() for r in sig]})
    placed = N.cut(N.hot_parts(spark.createDataFrame(pdf, "block long, id long, signature binary"), 4096))
    sizes = placed.groupBy("part").count().collect()
    assert max(r["count"] for r in sizes) <= 4096 and sum(r["count"] for r in sizes) == 50_000 and len(sizes) == 13
    pairs = {(r.pa, r.pb) for r in N.part_pairs(placed, 0.9).collect()}
    assert {(k, k) for k in range(13)} <= pairs and len(pairs) < 13 * 14 / 2  # the two clusters don't meet


def test_pruned_parts_hold_no_pair():
    rng = np.random.default_rng(6)
    sig = sorted(r.tobytes() for r in flipped(rng, rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64), 400, 30).byteswap())
    parts = [sig[k : k + 20] for k in range(0, 400, 20)]
    budgets = [N.budget(d, 0.8) for d in range(257)]
    pruned = 0
    for x in range(len(parts)):
        for y in range(x + 1, len(parts)):
            if not N.parts_may_meet(parts[x][0], parts[x][-1], parts[y][0], parts[y][-1], 0.8):
                pruned += 1
                for a in parts[x]:
                    for b in parts[y]:
                        bits = format(int.from_bytes(a, "big") ^ int.from_bytes(b, "big"), "0256b")
                        assert any(bits[:d].count("1") > budgets[d] for d in range(257))
    assert pruned


def test_against_brute_force(spark):
    data = corpus(260)
    df = spark.createDataFrame(data, "id long, block long, text string")
    for split in (4096, 20):
        links, members = N.near_duplicates(df, threshold=0.6, shingle=3, split_rows=split)
        assert rows(N.pairs(links, members)) == brute(data, 3, 0.6)
    links, members = N.near_duplicates(df)
    assert rows(N.pairs(links, members)) == brute(data, 5, 0.8)


def test_copies_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(70))
    data = [(i, 1, text) for i in range(6)] + [(9, 1, text + " ende"), (10, None, text), (11, 1, None), (12, 1, "kurz"), (13, 2, text), (1, 1, text)]
    df = spark.createDataFrame([(*d, "x") for d in data], "id long, block long, text string, rep string")
    links, members = N.near_duplicates(df, min_words=60)
    assert links.count() == 1 and members.where("copies > 1").select("rep").distinct().count() == 1
    got = rows(N.pairs(links, members))
    ids = [0, 1, 2, 3, 4, 5, 9]
    assert got == [(a, b) for a in ids for b in ids if a < b]
    links, members = N.near_duplicates(df.limit(0))
    assert N.pairs(links, members).count() == 0


def test_keys(spark):
    titles = ["Koch 80-100%", "  KOCH ", "Koch (m/w/d)", "Koch*in", "Koch(in)", "Koch m/w/d", "Koch – Bern", "Koch in Bern Au", "Koch (a)", "Koch, 80%", "Koch 60 - 80 %", "Koch/in", "Koch:in"]
    got = spark.createDataFrame([(t,) for t in [*titles, "Koch Alpha", "", None, "100%"]], "t string").select(N.title_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["koch"] * len(titles) + ["koch alpha", None, None, None]
    names = ["Muster Bau AG", "MUSTER BAU AG", "Muster  Bau", "Muster Bau (Schweiz) AG", "Muster Bau GmbH", "Muster Bau & Co. AG", "Muster Bau Holding AG"]
    got = spark.createDataFrame([(n,) for n in [*names, "AG", None]], "t string").select(N.company_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["muster bau"] * len(names) + [None, None]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (100, 101)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a long, b long"))))
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_query(spark, sf_dir):
    groups = N.p5_groups(spark, sf_dir)
    found = N.p5_found(spark, sf_dir)
    g = {r.id: r.group_id for r in groups.collect()}
    assert all(g[a] == g[b] for a, b in rows(found)) and groups.count() == len(g)


def test_groups_have_every_record(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(70))
    data = [(1, 1, text), (2, 1, text), (3, 1, text + " ende"), (4, 1, None), (5, 1, " "), (6, None, text), (7, 1, "kurz"), (8, 2, text)]
    df = spark.createDataFrame(data, "id long, block long, text string")
    got = rows(N.grouped(df, *N.near_duplicates(df, min_words=60)))
    assert got == [(1, 1, 1, 1, 2), (2, 1, 1, 1, 2), (3, 3, 1, 1, 1), *((i, i, i, 0, 1) for i in (4, 5, 6, 7, 8))]
    jobs = spark.read.parquet(f"{sf_dir}/jobs.parquet")
    assert N.p5_groups(spark, sf_dir).count() == jobs.count()

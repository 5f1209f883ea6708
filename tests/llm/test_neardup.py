import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import neardup as nd

SCHEMA = "leaf int, t string, row int, rep string, class_id int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in texts], SCHEMA)


def brute(texts, threshold):
    sets = {i: set(nd.run_hashes(t).tolist()) for i, t in texts if i is not None and t is not None}
    sets = {i: s for i, s in sets.items() if s}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return {i: g for g, members in groups.items() if len(members) > 1 for i in members}


def found(spark, texts, threshold=0.7):
    return {r.row: r.class_id for r in nd.near_duplicate_groups(frame(spark, texts), "leaf", "t", threshold).collect()}


def test_against_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = random.choices(vocabulary, k=random.randrange(30, 120))
        for _ in range(random.randrange(1, 5)):
            edited = list(base)
            for _ in range(random.randrange(0, 4)):
                edited[random.randrange(len(edited))] = random.choice(vocabulary)
            if random.random() < 0.3:
                edited.insert(random.randrange(len(edited)), "new")
            texts.append((len(texts), " ".join(edited)))
    assert found(spark, texts) == brute(texts, 0.7)


def test_edges(spark):
    text = "one two three four five six seven"
    texts = [(1, text), (2, text.upper()), (3, "one two"), (4, "one two"), (5, ""), (6, None), (None, text), (1, text), (7, "x " * 200_000), (8, " ".join(f"q{i}" for i in range(50)))]
    assert found(spark, texts) == {1: 1, 2: 1}
    assert found(spark, []) == {}
    links = {r.row: r.n_links for r in nd.near_duplicate_groups(frame(spark, texts), "leaf", "t", 0.7).collect()}
    assert links == {1: 0, 2: 0}  # equal sets are one text


def test_nodes_that_never_split(spark, monkeypatch):
    """A third of the rows are edits of one text, so that they share their minwise tokens at every level."""
    base = [f"b{i}" for i in range(150)]
    texts = [(i, " ".join(base[: i % 150] + [f"edit{i}"] + base[i % 150 + 1 :])) for i in range(150)]
    texts += [(1000 + i, " ".join(f"n{i}x{j}" for j in range(30))) for i in range(300)]
    monkeypatch.setattr(nd, "MOST_LEVELS", 3)
    assert found(spark, texts) == {i: 0 for i in range(150)}


def brute_links(texts, threshold):
    sets = {i: set(nd.run_hashes(t).tolist()) for i, t in texts}
    return {i: n for i in sets if (n := sum(i != k and len(sets[i] & sets[k]) >= threshold * len(sets[i] | sets[k]) for k in sets))}


def test_links_of_nodes_that_never_split(spark, monkeypatch):
    """Every link between different texts is counted once, in one block and across several."""
    random.seed(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(100):
        edited = list(base)
        for j in random.sample(range(150), i % 6 and 1 + i % 6):
            edited[j] = f"edit{i}x{j}"
        texts.append((i, " ".join(edited)))
    texts += [(1000 + i, " ".join(f"n{i}x{j}" for j in range(30))) for i in range(50)]
    texts = list({t: (i, t) for i, t in texts}.values())
    monkeypatch.setattr(nd, "MOST_LEVELS", 1)
    wanted = brute_links(texts, 0.7)
    assert len(set(wanted.values())) > 5
    for sets, tokens in ((512, 1 << 18), (20, 4000)):
        monkeypatch.setattr(nd, "BLOCK_SETS", sets, raising=False)
        monkeypatch.setattr(nd, "BLOCK_TOKENS", tokens, raising=False)
        rows = nd.near_duplicate_groups(frame(spark, texts), "leaf", "t", 0.7).collect()
        counted = {r.row: r.n_links for r in rows}
        assert (sum(counted.values()), counted) == (sum(wanted.values()), wanted)


def test_trees_follow_the_depth():
    """The number of trees that are run gives the stated recall at every level; a simulation agrees with the formula."""
    rng = np.random.default_rng(3)
    for levels in range(1, nd.MOST_LEVELS + 1):
        assert nd.recall(levels, nd.trees_for(levels, 0.7), 0.7) >= nd.RECALL
    assert nd.trees_for(nd.DEEP, 0.7) == nd.TREES < nd.trees_for(nd.DEEP + 1, 0.7)
    lost = 0
    for _ in range(2000):
        agree = rng.binomial(nd.POSITIONS, 0.7) / nd.POSITIONS
        together = np.ones(12, int)
        for _ in range(10):
            together = rng.binomial(together, agree) + rng.binomial(together, agree * (1 / 0.7 - 1))
        lost += not together.any()
    assert abs(lost / 2000 - (1 - nd.recall(10, 12, 0.7))) < 0.015


def test_deep_sets_get_more_trees(spark, monkeypatch):
    """Texts that branch beyond level DEEP are sent through as many trees as the deepest level takes."""
    texts = [(i, " ".join([f"s{j}" for j in range(40)] + [f"t{i}x{j}" for j in range(14)])) for i in range(60)]
    ran, trees = [], nd._trees

    def noted(sets, threshold, first, last):
        out = trees(sets, threshold, first, last)
        ran.append((first, last, out[3]))
        return out

    monkeypatch.setattr(nd, "_trees", noted)
    monkeypatch.setattr(nd, "MOST_LEVELS", 4)
    assert found(spark, texts) == brute(texts, 0.7)
    assert [r[:2] for r in ran] == [(1, 12), (13, nd.trees_for(4, 0.7))]


def test_hot_copies(spark):
    df = spark.range(30_000).select(F.col("id").cast("int").alias("leaf"), F.when(F.col("id") % 3 == 0, F.lit("a b c d e f g h")).otherwise(F.concat_ws(" ", *(F.concat(F.lit(x), F.col("id").cast("string")) for x in "pqrstu"))).alias("t"))
    rows = nd.near_duplicate_groups(df, "leaf", "t", 0.7)
    assert rows.count() == 10_000 and rows.select("class_id").distinct().count() == 1


def test_minwise_blocks():
    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    assert (nd.minwise(tokens) == np.minimum(nd.minwise(tokens[:100]), nd.minwise(tokens[100:]))).all()

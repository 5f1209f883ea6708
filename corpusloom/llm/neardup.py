"""Problem 2: near-equal records by the chosen-path set similarity join.

A record is the set of its distinct five-word runs.  Every tree starts with all distinct sets at its root; a node sends a
set to one child per selected minwise token (1 / threshold children on average, the same positions for all sets of the
node), so that similar sets stay together more often than they multiply.  Nodes with few sets are compared exhaustively;
larger ones branch again; sets of nodes that MOST_LEVELS don't part
are compared exactly, each pair once.  Independent trees raise the recall of a link at the
threshold: TREES = 12 give 0.9998 after three levels; sets that branch further get the trees that take it there at the
deepest level reached (50 at ten levels).  Links above the threshold fare better.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.runs import first_of_each, in_slices, runs_of, word_hashes
from corpusloom.llm.visible import word_form, word_points
from corpusloom.operators.components import connected_components
from corpusloom.session import cut

RUN = 5
TREES = 12
SMALL_NODE = 24
MOST_LEVELS = 10
#: Expected share of links at the threshold that must be found whatever level is reached; TREES give it up to level DEEP.
RECALL, DEEP = 0.9998, 3
FUNCTIONS = 256
#: Sets and tokens, on average, of a block of a family; columns of a slice of the token matrix.
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 512, 1 << 18, 2048
#: Functions whose minwise tokens may be selected for branching.
POSITIONS = 128
#: Share of equal bits of two sketches below which sets are not compared: 6 standard deviations under its mean at 0.70.
BIT_SLACK = 6 * (0.15 * 0.85 / FUNCTIONS) ** 0.5
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, FUNCTIONS), np.uint64)
_A, _B = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def run_hashes(text: str, n: int = RUN) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word runs of the visible form, ascending; fewer than n words give none."""
    owner, hashes = word_hashes([text], word_form, word_points())
    return np.unique(runs_of(owner, hashes, n)[1])


def minwise(tokens: np.ndarray) -> np.ndarray:
    """Least value of every hash function over the tokens, in blocks of bounded memory."""
    least = np.full(FUNCTIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(tokens), 1024):
        x = tokens[i : i + 1024]
        x = x ^ (x >> np.uint64(31))
        values = x[:, None] * _A[None, :] + _B[None, :]
        np.minimum(least, (values ^ (values >> np.uint64(29))).min(axis=0), out=least)
    return least


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            owner, hashes = word_hashes(batch.column(1).to_pylist(), word_form, word_points())
            at, tokens = runs_of(owner, hashes, RUN)
            some = first_of_each(owner[at], tokens)
            owner, tokens = owner[at][some], tokens[some]
            rows, starts = np.unique(owner, return_index=True)
            bounds = np.append(starts, len(tokens))
            columns = [batch.column(0).take(pa.array(rows)), pa.array([_digest(tokens[a:z]) for a, z in itertools.pairwise(bounds.tolist())], pa.binary())]
            if with_tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "digest", "tokens"][: len(columns)])

    return run


def run_sets(df: DataFrame, key: str, text: str, with_tokens: bool = True) -> DataFrame:
    """(row, digest, tokens) or (row, digest); null keys, null texts and texts without a run give no row."""
    rows = df.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).where("row is not null and text is not null")
    return rows.mapInArrow(_sets(with_tokens), "row long, digest binary" + ", tokens array<long>" * with_tokens)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches, mins = [], []
        at = batch.schema.get_field_index("tokens")
        for tokens in batch.column(at):
            least = minwise(tokens.values.to_numpy().view(np.uint64))
            sketches.append(np.packbits(((least >> np.uint64(33)) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            mins.append((least[:POSITIONS] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        columns = [*batch.columns, pa.array(sketches, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sketch", "mins"])


def with_sketches(sets: DataFrame) -> DataFrame:
    """(rep, digest, tokens) with a sketch of one bit per hash function and the minwise tokens of POSITIONS of them."""
    return sets.select("rep", "digest", "tokens").mapInArrow(_sketches, "rep long, digest binary, tokens array<long>, sketch array<long>, mins array<int>")


def _branch(level: DataFrame, threshold: float) -> DataFrame:
    """Children of every set: one position for sure, a second one with the probability that makes 1 / threshold."""
    second = round((1 / threshold - 1) * 1_000_000)
    at = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int") for k in (1, 2)]
    child = [F.xxhash64("node", i, F.element_at("mins", i + 1)) for i in at]
    more = (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < second) & (at[0] != at[1])
    nodes = F.when(more, F.array(*child)).otherwise(F.array(child[0]))
    return level.select("rep", "size", "sketch", F.explode(nodes).alias("node"))


def _close(threshold: float, a: str = "a", b: str = "b"):
    """Cheap necessary test of a pair: sizes within the threshold and enough equal sketch bits."""
    equal = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(FUNCTIONS // 64)), F.lit(0))
    least, most = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (least >= most * threshold) & (equal <= FUNCTIONS * (1 - (1 + threshold) / 2 + BIT_SLACK))


def _within(nodes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of nodes that hold at most SMALL_NODE sets each."""
    member = F.struct("rep", "size", "sketch")
    lists = nodes.groupBy("node").agg(F.sort_array(F.collect_list(member)).alias("m"))
    firsts = lists.select("m", F.posexplode("m").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL_NODE))).alias("b"))
    return pairs.where(_close(threshold)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the distinct pairs whose exact Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similarity = shared / (F.size("ta") + F.size("tb") - shared)
    return joined.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _block_links(threshold: float):
    """Links of the sets of two blocks (or of one), from shared tokens counted exactly by matrix products over slices of columns."""

    def run(table: pa.Table) -> pa.Table:
        reps, block = table["rep"].to_numpy(), table["block"].to_numpy()
        lists = table["tokens"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, column, held = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, column = np.repeat(np.arange(len(reps)), sizes), column.reshape(-1)
        several = held[column] > 1  # a token of one set is shared by none
        row, column = row[several], (np.cumsum(held > 1) - 1)[column[several]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        one, other = (np.flatnonzero(block == table[k][0].as_py()) for k in ("i", "j"))
        shared = np.zeros((len(one), len(other)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (start, start + COLUMNS))
            holds = np.zeros((len(reps), COLUMNS), np.float32)
            holds[row[lo:hi], column[lo:hi] - start] = 1
            shared += holds[one] @ holds[other].T
        shared = shared.astype(np.float64)
        links = np.zeros((len(reps), len(reps)), bool)
        links[np.ix_(one, other)] = shared / (sizes[one][:, None] + sizes[other][None, :] - shared) >= threshold
        links |= links.T
        np.fill_diagonal(links, False)
        peers, seen = np.arange(len(reps)), np.zeros(len(reps), bool)
        for root in range(len(reps)):
            waiting = [] if seen[root] else [root]
            seen[root] = True
            while waiting:
                new = np.flatnonzero(links[(v := waiting.pop())] & ~seen)
                seen[new], peers[new] = True, v
                waiting.extend(new.tolist())
        degrees = links.sum(axis=1)
        some = degrees > 0
        return pa.table({"rep": reps[some], "peer": reps[peers[some]], "n": degrees[some].astype(np.int64)})

    return run


def _families(stuck: DataFrame) -> DataFrame:
    """(rep, family): sets of nodes (node, rep) that no level splits, in one family where their nodes hold a set in common."""
    first = stuck.groupBy("node").agg(F.min("rep").alias("a"))
    return connected_components(stuck.join(first, "node").select("a", "rep").distinct(), "a", "rep").select(F.col("vertex").alias("rep"), F.col("component").alias("family"))


def _family_links(families: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, peer, n): the links of each set within its family, every pair compared once, in salted blocks of bounded size.

    Only numbers of links and a spanning forest of each two blocks' links (a root's peer is itself) leave a comparison.
    """
    members = families.join(sets.select("rep", "tokens"), "rep")
    sized = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int").alias("blocks"))
    blocks = members.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    twos = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    twos = twos.select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "tokens")
    return twos.groupBy("family", "i", "j").applyInArrow(_block_links(threshold), "rep long, peer long, n long")


def recall(levels: int, trees: int, threshold: float) -> float:
    """Expected share of the links at the threshold that `trees` trees of that many levels find.

    Of a link, k of the POSITIONS minwise tokens agree (binomial); a node passes both sets on to a child in common for each
    selected position that agrees, so whether any branch keeps them together is a branching process.
    """
    missed, second = 0.0, 1 / threshold - 1
    for k in range(POSITIONS + 1):
        agree, kept = k / POSITIONS, 1.0
        for _ in range(levels):
            kept = 1 - (1 - agree * kept) * (1 - second * agree * kept)
        missed += math.comb(POSITIONS, k) * threshold**k * (1 - threshold) ** (POSITIONS - k) * (1 - kept) ** trees
    return 1 - missed


def trees_for(levels: int, threshold: float, least: int = TREES) -> int:
    """The fewest trees, at least `least`, whose recall after so many levels reaches RECALL."""
    return next(n for n in itertools.count(least) if recall(levels, n, threshold) >= RECALL)


def _trees(sets: DataFrame, threshold: float, first: int, last: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None, int]:
    """Of trees first to last over sets (rep, tokens, sketch, mins, family): candidate pairs, (node, rep) of the nodes that
    no level parts, the sets that pass level DEEP, and the deepest level.

    A node within one family is left out: its sets are compared with one another anyway.
    """
    level = sets.select("rep", F.size("tokens").alias("size"), "sketch", "mins", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tree"))
    level = level.withColumn("node", F.xxhash64(F.lit("root"), "tree"))
    family = sets.select("rep", F.coalesce("family", F.xxhash64("rep")).alias("family"))
    found, stuck, deep = [], None, None
    for depth in range(1, MOST_LEVELS + 1):
        nodes = cut(_branch(level, threshold))
        if first == 1:
            counts = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        else:
            counts = nodes.join(family, "rep").groupBy("node").agg(F.count("*").alias("n"), F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("node", "n")
        sized = nodes.join(counts, "node")
        found.append(_within(sized.where(F.col("n") <= SMALL_NODE), threshold))
        large = sized.where(F.col("n") > SMALL_NODE).drop("n")
        if not counts.where(F.col("n") > SMALL_NODE).limit(1).count():
            break
        if depth == DEEP:
            deep = large.select("rep").distinct()
        if depth == MOST_LEVELS:
            stuck = large.select("node", "rep")
        else:
            level = large.join(sets.select("rep", "mins"), "rep")
    return found, stuck, deep, depth


def chosen_path_links(sets: DataFrame, threshold: float, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges that connect what links connect, and (rep, n_links), of distinct sets (rep, tokens, sketch, mins).

    Where nodes branch beyond level DEEP, the sets that pass it get as many more trees as RECALL takes at the deepest level.
    """
    found, stuck, deep, depth = _trees(sets.withColumn("family", F.lit(None).cast("long")), threshold, 1, trees)
    families = None if stuck is None else cut(_families(stuck))
    if deep is not None:
        some = sets.join(cut(deep), "rep", "left_semi")
        some = cut(some.withColumn("family", F.lit(None).cast("long")) if families is None else some.join(families, "rep", "left"))
        while (wanted := trees_for(depth, threshold, trees)) > trees:
            more, also, _, reached = _trees(some, threshold, trees + 1, wanted)
            found, trees, depth = found + more, wanted, max(depth, reached)
            stuck = also if stuck is None else stuck if also is None else stuck.unionByName(also)
        families = None if stuck is None else cut(_families(stuck))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    if families is not None:
        of = lambda k: families.select(F.col("rep").alias(k), F.col("family").alias(f"f{k}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("fa is null or fb is null or fa <> fb").select("a", "b")
    links = cut(verify(pairs, sets, threshold).select("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n"))
    if families is not None:
        inner = cut(_family_links(families, sets, threshold))
        links = links.unionByName(inner.where("rep <> peer").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
        ends = ends.unionByName(inner.select("rep", "n"))
    return links, ends.groupBy("rep").agg(F.sum("n").alias("n_links"))


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(row, class_id, n_links): every row of a group of two or more, the group's least row, and the links of the row's
    text to other texts.

    Equal sets are one set with several rows (a copy held by a third of all rows is one set); rows whose text is null,
    blank or has under five words belong to no group; re-delivered rows count once; equal links tie without effect.
    """
    grouped = run_sets(df, key, text).groupBy("digest").agg(F.min("row").alias("rep"), F.first("tokens").alias("tokens"))
    sets = cut(with_sketches(grouped))
    members = run_sets(df, key, text, False).join(sets.select("digest", "rep"), "digest").select("row", "rep").distinct()
    links, degree = chosen_path_links(sets, threshold)
    labels = connected_components(links, "a", "b")
    labelled = members.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").join(degree, "rep", "left")
    labelled = labelled.select("row", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = labelled.groupBy("class_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("class_id")
    return labelled.join(alone, "class_id", "left_semi").select("row", "class_id", "n_links")

"""Similar texts by a q-gram index: no pair that reaches the threshold is missed, few others are compared.

The ratio is 2M/T of difflib: M characters in common blocks, in order, of T in
all. So M is at most the length of a longest common subsequence, and

* lengths differ little: M <= min(lengths);
* characters are shared: M <= the sum of least counts by character;
* q-grams are shared: a character outside the blocks spoils q of its own text's
  q-grams at most, one of the other text q - 1, which leaves
  (2q - 1) M - (q - 1) T - q + 1 in common.

The last bound, at the M that the threshold asks for, says how many q-grams
two texts of T characters must share, so that they meet in the rarest of their
q-grams (prefix filter). Where it asks for none, in short texts, single
characters take its place. Only pairs that pass all three are compared.

Where texts of a block share most of their grams, as numbered names do, lists
rule out little. If only the best partner is asked for, such a block is cut into
parts, and in each pair of parts the lengths of longest common subsequences, by
bits, put the candidates of a text in order: the first few decide.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.similarity import similarity
from placelens.operators import scratch

_EPS = 1e-9


def numbered_grams(text: Column, q: int) -> Column:
    """The q-grams of a text, each with the number of equal ones before it, so that sets of them act as multisets."""
    n = F.length(text) - q + 1
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(text, k, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    before = lambda g, x, k: F.size(F.filter(F.slice(g, F.lit(1), k), lambda y: y == x))
    number = lambda g: F.transform(g, lambda x, k: F.concat(F.lit(str(q)), x, F.lit("\0"), before(g, x, k).cast("string")))
    return F.get(F.transform(F.array(grams), number), F.lit(0))  # the array of one makes the grams a variable, computed once


def gram_size(threshold: float) -> int:
    """Longer q-grams are rarer, but ask for a higher threshold."""
    return 3 if threshold >= 0.9 else 2 if threshold > 0.7 else 1


def _prefix_sizes(threshold: float, n: Column) -> list[tuple[int, Column]]:
    """(q, how many of a text's rarest q-grams are listed) for a text of n characters; none where no partner meets it that way."""
    least = n + F.ceil(n * (threshold / (2 - threshold)) - _EPS)  # the least T
    most = n + F.floor(n * ((2 - threshold) / threshold) + _EPS)
    q = gram_size(threshold)
    ones = n - F.ceil(threshold * least / 2 - _EPS) + 1
    if q == 1:
        return [(1, ones)]
    slope = (2 * q - 1) * threshold / 2 - (q - 1)
    enough = math.ceil(q / slope - _EPS)  # from this T on one q-gram at least is shared
    total = F.greatest(least, F.lit(enough))
    shared = F.ceil(slope * total - q + 1 - _EPS)
    return [(q, F.when(most >= enough, n - q + 1 - shared + 1).otherwise(0)), (1, F.when(least < enough, ones).otherwise(0))]


def _listed(texts: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """text -> prefix, its rarest grams. Rarity is counted over known."""
    n = F.length("text")
    sizes = _prefix_sizes(threshold, n)
    every = lambda df: df.select("text", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), numbered_grams(F.col("text"), q).alias("grams")) for q, _ in sizes))).alias("m")).select("text", "m.q", F.explode("m.grams").alias("gram"))
    often = every(known).groupBy("gram").agg(F.count("*").alias("often"))
    ranked = every(texts).join(often, "gram", "left").groupBy("text", "q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("grams"))
    size = F.coalesce(*(F.when(F.col("q") == q, s) for q, s in sizes))
    ranked = ranked.withColumn("size", size).where("size > 0").select("text", F.transform(F.slice("grams", F.lit(1), F.least(F.col("size").cast("int"), F.size("grams"))), lambda g: g["gram"]).alias("grams"))
    return ranked.groupBy("text").agg(F.flatten(F.collect_list("grams")).alias("prefix"))


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], threshold: float, few: int = 64) -> DataFrame:
    """Each pair of different rows' texts within a block that reaches the threshold, once: block, text (left), match_text, ratio.

    Both have block and text. Null and empty texts and null blocks match nothing. Texts are compared
    once however many rows have them. In blocks with few texts on the right each text of the left meets
    all of them, which is linear in the left side; in the others texts meet by the index.
    """
    # texts are few bytes and much work: a number of partitions keeps adaptive execution from joining them into one task; blocks
    # take part in the key, as one text may be in all of them
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda df: scratch.written(df.select(*block, "text").where("text <> ''").dropna(subset=block).distinct().repartition(tasks, *block, "text").withColumn("characters", numbered_grams(F.col("text"), 1)))
    left, right = rows(left), rows(right)
    sizes = scratch.written(right.groupBy(*block).agg(F.count("*").alias("_texts")))
    other = right.join(sizes.where(F.col("_texts") <= few).select(*block), block).select(*block, F.col("text").alias("match_text"), F.col("characters").alias("other_characters"))
    met = left.join(other, block)
    crowded = sizes.where(F.col("_texts") > few).select(*block)
    if not crowded.isEmpty():
        met = met.unionByName(_met_by_grams(left.join(crowded, block, "left_semi"), right.join(crowded, block, "left_semi"), block, threshold))
    total = F.size("characters") + F.size("other_characters")
    long_enough = 2 * F.least(F.size("characters"), F.size("other_characters")) >= threshold * total - _EPS
    shared = 2 * F.size(F.array_intersect("characters", "other_characters")) >= threshold * total - _EPS
    pairs = met.where(long_enough & shared).select(*block, "text", "match_text").repartition(tasks, *block, "text", "match_text")
    return pairs.withColumn("ratio", similarity("text", "match_text")).where(F.col("ratio") >= threshold)


def _met_by_grams(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """Pairs that share one of their listed grams, each once."""
    grams = scratch.written(_listed(left.select("text").union(right.select("text")).distinct(), right.select("text").distinct(), threshold))
    keyed = lambda df: df.join(grams, "text").withColumn("gram", F.explode("prefix"))
    other = keyed(right).select(*block, "gram", F.col("text").alias("match_text"), F.col("prefix").alias("other_prefix"), F.col("characters").alias("other_characters"))
    once = F.element_at(F.array_intersect("prefix", "other_prefix"), 1) == F.col("gram")  # a pair counts where it meets first
    return keyed(left).join(other, [*block, "gram"]).where(once).select(*block, "text", "characters", "match_text", "other_characters")


def subsequences(text: str, others: np.ndarray, sizes: np.ndarray, codes: dict[str, int]) -> np.ndarray:
    """An upper bound of the characters that text has in common with each of others, in order.

    others: codes by place and text, texts by falling size. The bound is the longest common subsequence, a bit for a character
    of text (Hyyro's form); over 64 characters it is the lesser size.
    """
    if len(text) > 64:
        return np.minimum(sizes, len(text))
    masks = [0] * (len(codes) + 1)
    for k, x in enumerate(text):
        if x in codes:
            masks[codes[x]] |= 1 << k
    table, rest = np.array(masks, np.uint64), np.full(len(sizes), 2**64 - 1, np.uint64)
    for k in range(others.shape[0]):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # texts with more than k characters
        own = rest[:n]
        met = own & table[others[k, :n]]
        rest[:n] = (own + met) | (own - met)
    return len(text) - np.bitwise_count(rest & np.uint64((1 << len(text)) - 1)).astype(np.int64)


def best_of(texts: list[str], others: list[str], threshold: float) -> list[tuple[int, float] | None]:
    """Per text the place of the other with the greatest ratio from the threshold on, of equals the first."""
    order = sorted(range(len(others)), key=lambda k: -len(others[k]))
    sizes, codes = np.array([len(others[k]) for k in order], np.int64), {x: k for k, x in enumerate(sorted(set("".join(others))), 1)}
    held = np.zeros((int(sizes.max(initial=0)), len(others)), np.int32)
    for k, at in enumerate(order):
        held[: len(others[at]), k] = [codes[x] for x in others[at]]
    place, out, matchers = np.array(order, np.int64), [], {}
    for text in texts:
        bound = 2.0 * subsequences(text, held, sizes, codes) / np.maximum(sizes + len(text), 1)
        may = np.flatnonzero(bound >= threshold)
        best = None
        for k in may[np.lexsort((place[may], -bound[may]))].tolist():
            at = order[k]
            if best and (bound[k] < best[1] or bound[k] == best[1] and at > best[0]):
                if bound[k] < best[1]:
                    break
                continue
            if at not in matchers:
                matchers[at] = SequenceMatcher(None, "", others[at])
            matchers[at].set_seq1(text)
            ratio = matchers[at].ratio()
            if ratio >= threshold and (best is None or ratio > best[1] or ratio == best[1] and at < best[0]):
                best = at, ratio
        out.append(best)
    return out


def _scanned(left: DataFrame, right: DataFrame, block: list[str], threshold: float, part: int) -> DataFrame:
    """block, text, match_id, ratio: the best of each pair of a text and a part of the block's other texts. left: block, text; right: block, match_text, match_id."""
    parts = lambda df, name: df.groupBy(*block).agg((F.floor(F.count("*") / part) + 1).cast("int").alias(name))
    dealt = lambda df, by, mine, other: df.join(scratch.merged(counts), block).withColumn(mine[1:], F.pmod(F.xxhash64(by), F.col(mine)).cast("int")).withColumn(other[1:], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    counts = scratch.written(parts(left, "_l").join(parts(right, "_r"), block))
    own = dealt(left, "text", "_l", "_r").select(*block, "l", "r", "text")
    other = dealt(right, "match_text", "_r", "_l").select(*block, "l", "r", "match_text", "match_id")
    fields = [f for f in own.schema.fields if f.name in block]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string", f"match_id {right.schema['match_id'].dataType.simpleString()}", "ratio double"])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("match_id")
        found = best_of(mine["text"].to_pylist(), theirs["match_text"].to_pylist(), threshold) if len(theirs) else [None] * len(mine)
        mine = mine.filter(pa.array([x is not None for x in found], pa.bool_()))
        found = [x for x in found if x]
        ids = theirs["match_id"].take(pa.array([x[0] for x in found], pa.int64()))
        return pa.table([*(mine[f.name] for f in fields), mine["text"], ids, pa.array([x[1] for x in found], pa.float64())], names=[*(f.name for f in fields), "text", "match_id", "ratio"])

    keys = [*block, "l", "r"]
    return scratch.spread(own, *keys).groupBy(*keys).cogroup(scratch.spread(other, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _dense(right: DataFrame, block: list[str], threshold: float, few: int) -> DataFrame | None:
    """Blocks of more than few texts whose lists would meet a quarter of all pairs or more, by the right side's own; None where no block has so many. right: block, match_text."""
    crowded = scratch.written(right.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > few))
    if crowded.isEmpty():
        return None
    texts = scratch.written(right.join(crowded, block).select(*block, "n", F.col("match_text").alias("text")))
    grams = _listed(texts.select("text").distinct(), texts.select("text").distinct(), threshold)
    lists = texts.join(grams, "text").select(*block, "n", F.explode("prefix").alias("gram")).groupBy(*block, "n", "gram").count()
    return scratch.written(lists.groupBy(*block, "n").agg(F.sum(F.col("count") * F.col("count")).alias("met")).where(F.col("met") * 4 >= F.col("n") * F.col("n")).select(*block))


def best_similar(left: DataFrame, right: DataFrame, block: list[str], threshold: float, where: Column | None = None, few: int = 64, part: int = 2048) -> DataFrame:
    """(id, match_id, ratio): per row of left the most similar text of right in its block, of equals the least match_id.

    left: id, text, block; right: id, text, block. where: a further condition on text and match_text.
    Texts are compared once however many rows have them. In dense blocks (unless where is given) a task holds about part texts of either side.
    """
    texts = lambda df: df.where("text <> ''").dropna(subset=block)
    first = scratch.written(texts(right).groupBy(*block, F.col("text").alias("match_text")).agg(F.min("id").alias("match_id")))
    own = scratch.written(scratch.spread(texts(left).select(*block, "text").distinct(), "text"))
    dense = _dense(first, block, threshold, few) if where is None else None
    other = first.withColumnRenamed("match_text", "text")
    sparse = lambda df: (df if dense is None else df.join(dense, block, "left_anti")).select(*block, "text")
    pairs = similar_pairs(sparse(own), sparse(other), block, threshold, few)
    found = (pairs if where is None else pairs.where(where)).join(first, [*block, "match_text"]).select(*block, "text", "match_id", "ratio")
    if dense is not None and not dense.isEmpty():
        found = found.unionByName(_scanned(own.join(dense, block, "left_semi"), first.join(dense, block, "left_semi"), block, threshold, part))
    best = found.groupBy(*block, "text").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "match_id")).alias("best"))
    return left.join(scratch.merged(best), [*block, "text"]).select("id", F.col("best.match_id").alias("match_id"), (-F.col("best.less")).alias("ratio"))

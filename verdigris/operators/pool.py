"""Reference pairs: translations most like a text, as examples for the next.

A run sees the pairs that its catalog starts with, all of them, and of its own commits those that came before.
"""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratio import Text

MAX_REFERENCES = 5
#: Sources that a worker keeps ready for comparison.
MOST_TEXTS = 4096


def _counted(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 255
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * 256 + codes, minlength=256 * len(texts)).reshape(-1, 256).astype(np.int32)


class Pool:
    """Pairs in order of arrival, for one worker."""

    def __init__(self, pairs: list[tuple[str, str]] = ()):
        self.pairs = list(pairs)
        self._counts = np.zeros((0, 256), np.int32)
        self._texts: dict[str, Text] = {}

    def add(self, src: str, tgt: str) -> None:
        self.pairs.append((src, tgt))

    def _letters(self) -> np.ndarray:
        """How often the letters of each source occur, by the last byte of their code; new pairs are added."""
        new = [src for src, _ in self.pairs[len(self._counts) :]]
        if new:
            self._counts = np.concatenate([self._counts, _counted(new)])
        return self._counts

    def similar(self, query: str, k: int = MAX_REFERENCES) -> list[tuple[float, str, str]]:
        """(score, src, tgt) of the k best pairs of another text; ties keep the pool's order.

        Pairs are taken by what their letters let them reach at most, the best first. Those that can't come before the
        k-th best so far are not compared, or only until that shows.
        """
        if k < 1 or not self.pairs:
            return []
        counts, mine = self._letters(), _counted([query])
        at_most = np.concatenate([np.minimum(counts[lo : lo + 4096], mine).sum(axis=1) for lo in range(0, len(counts), 4096)])
        total = counts.sum(axis=1) + len(query)
        reach = np.where(total > 0, 2.0 * at_most / np.maximum(total, 1), 1.0)
        order = np.argsort(-reach, kind="stable")
        best: list[tuple[float, int]] = []
        done: dict[str, int | None] = {query: None}
        for at, bound, length in zip(order.tolist(), reach[order].tolist(), total[order].tolist()):
            src, least = self.pairs[at][0], 0
            if len(best) == k:
                bar = best[0]
                if bound < bar[0]:
                    break
                least = max(int(bar[0] * length / 2) - 1, 0)
                while (2.0 * least / length, -at) <= bar:
                    least += 1
            if src in done:
                same = done[src]
                matched = same if same is not None and same >= least else None
            else:
                matched = done[src] = self._text(src).matched(query, least)
            if matched is not None:
                (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (2.0 * matched / length, -at))
        return [(score, *self.pairs[-at]) for score, at in sorted(best, reverse=True)]

    def _text(self, src: str) -> Text:
        if (found := self._texts.get(src)) is None:
            if len(self._texts) >= MOST_TEXTS:
                self._texts.clear()
            found = self._texts[src] = Text(src)
        return found

    def shared(self, queries: list[str], k: int = MAX_REFERENCES) -> list[tuple[str, str]]:
        """Distinct pairs for several texts; the first texts fill the k places."""
        found: dict[tuple[str, str], None] = {}
        for query in queries:
            for _, src, tgt in self.similar(query, k):
                found[src, tgt] = None
                if len(found) >= k:
                    return list(found)
        return list(found)


def visible(candidates: DataFrame, seed: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Pairs of candidates (doc_id, ord, msgid) and the pool rows of their document that they may see.

    These are all seed pairs, wherever they stand, and commits that come before, if their texts differ.
    """
    c = candidates.select("doc_id", F.col("ord").alias("at"), F.col("msgid").alias("query"))
    columns = ["doc_id", "ord", "src", "tgt"]
    pairs = seed.select(*columns, F.lit(False).alias("late"))
    if commits is not None:
        pairs = pairs.union(commits.select(*columns, F.lit(True)))
    seen = c.join(pairs, "doc_id").where((~F.col("late") | (F.col("ord") < F.col("at"))) & (F.col("src") != F.col("query")))
    return seen.drop("late")


def references(candidates: DataFrame, seed: DataFrame, k: int = MAX_REFERENCES) -> DataFrame:
    """(doc_id, at, query, src, tgt, score, rank): the k seed pairs most similar to each candidate, in pool order on ties.

    A document's candidates and pairs meet in one worker, so no pair of texts is ever a row. Candidates without a pair
    of another text have no row; documents without candidates or pairs give none.
    """

    def run(asked: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("ord")
        pool = Pool(list(zip(pairs["src"], pairs["tgt"])))
        rows = [(d, at, q, src, tgt, score, n) for d, at, q in zip(asked["doc_id"], asked["at"], asked["query"]) for n, (score, src, tgt) in enumerate(pool.similar(q, k), 1)]
        return pd.DataFrame(rows, columns=["doc_id", "at", "query", "src", "tgt", "score", "rank"])

    # Both sides may come from one table: a column that they share by origin would reach only one side.
    left = candidates.select(F.col("doc_id").alias("doc_id"), F.col("ord").alias("at"), F.col("msgid").alias("query"))
    right = seed.select("doc_id", "ord", "src", "tgt")
    # Work grows with pairs of texts, not with bytes, so partitions aren't joined by their bytes.
    spark = candidates.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left, right = left.repartition(parts, "doc_id"), right.repartition(parts, "doc_id")
    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInPandas(run, "doc_id long, at int, query string, src string, tgt string, score double, rank int")


def similarity(query: Column, other: Column) -> Column:
    """Matching-blocks ratio; not symmetric, the query comes first."""
    return F.pandas_udf(_similarity, "double")(query, other)


def _similarity(query: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(query, other)])


def batch_references(ranked: DataFrame, k: int = MAX_REFERENCES) -> DataFrame:
    """Distinct pairs of a batch (group_no): those of its first sources fill the k places."""
    first = F.min(F.struct("at", "rank")).alias("first")
    pairs = ranked.groupBy("doc_id", "group_no", "src", "tgt").agg(first)
    order = Window.partitionBy("doc_id", "group_no").orderBy("first")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("first")

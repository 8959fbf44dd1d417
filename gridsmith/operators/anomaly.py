"""Isolation forest: bounded samples per tree, trees grown in parallel groups, rows
scored in Arrow batches against the small tree table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributed import hash_sample, quantiles
from ..session import materialize

# Number of trees and rows a tree is grown on.
TREES, TREE_ROWS = 100, 256
_NODE = "tree int, node int, left int, right int, feature int, cut double, size int, depth int"


@dataclass
class ForestModel:
    """Tree table (at most TREES * (2 * TREE_ROWS - 1) rows) and the score limit."""

    nodes: list[tuple]
    rows: int
    threshold: float

    def score_expr(self, features: str) -> Column:
        """2 ** (-mean path / expected path): higher is more anomalous."""
        nodes, rows = self.nodes, self.rows

        @F.pandas_udf("double")
        def score(x):
            import numpy as np
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype="float64")
            m = np.stack(x.to_numpy())

            def expected(n):
                n = np.asarray(n, dtype=float)
                big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + 0.5772156649015329) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
                return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))

            table = np.asarray(nodes, dtype=float)
            total = np.zeros(len(m))
            trees = np.unique(table[:, 0])
            for t in trees:
                part = table[table[:, 0] == t]
                part = part[part[:, 1].argsort()]
                left, right, feat = part[:, 2].astype(int), part[:, 3].astype(int), part[:, 4].astype(int)
                cut, length = part[:, 5], part[:, 7] + expected(part[:, 6])
                at = np.zeros(len(m), dtype=int)
                moving = np.nonzero(feat[at] >= 0)[0]
                while len(moving):
                    f = feat[at[moving]]
                    low = m[moving, f] <= cut[at[moving]]
                    at[moving] = np.where(low, left[at[moving]], right[at[moving]])
                    moving = moving[feat[at[moving]] >= 0]
                total += length[at]
            scale = float(expected(rows)) or 1.0
            return pd.Series(2.0 ** (-(total / len(trees)) / scale))

        return score(vector_to_array(col(features)))


@dataclass
class IsolationForest:
    contamination: float = 0.05
    trees: int = TREES
    tree_rows: int = TREE_ROWS
    seed: int = 42

    def fit(self, vectors: DataFrame, key: str) -> ForestModel:
        """``vectors`` has the key and ``features``."""
        x = vectors.select(col(key).alias("key"), vector_to_array("features").alias("x"))
        # one bounded pool for all trees; each tree takes its first rows in its own hash order
        pool = materialize(hash_sample(x, "key", self.trees * self.tree_rows, self.seed))
        size = min(self.tree_rows, pool.count())
        many = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))))
        order = Window.partitionBy("tree").orderBy(F.xxhash64("key", "tree", F.lit(self.seed)), "key")
        picked = many.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size).select("tree", "x")
        nodes = [tuple(r) for r in picked.groupBy("tree").applyInPandas(_grow(size, self.seed), _NODE).collect()]
        model = ForestModel(nodes, size, 0.0)
        scored = materialize(vectors.select(model.score_expr("features").alias("score")))
        model.threshold = quantiles(scored, ["score"], [1.0 - self.contamination])["score"][0]
        return model


def _grow(rows: int, seed: int):
    """Random splits until rows are alone or the depth limit log2(rows) is reached."""

    def grow(pdf):
        import numpy as np
        import pandas as pd

        m = np.stack(pdf["x"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        m = m[np.lexsort(m.T)]  # row order within a group is not fixed
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(rows, 2))))
        out, todo = [[tree, 0, -1, -1, -1, 0.0, len(m), 0]], [(0, np.arange(len(m)), 0)]
        while todo:
            node, idx, depth = todo.pop()
            part = m[idx]
            low, high = part.min(0), part.max(0)
            open_features = np.nonzero(high > low)[0]
            if depth >= limit or len(idx) <= 1 or not len(open_features):
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            side = part[:, f] <= cut
            left, right = len(out), len(out) + 1
            out[node][2:6] = [left, right, f, cut]
            out.append([tree, left, -1, -1, -1, 0.0, int(side.sum()), depth + 1])
            out.append([tree, right, -1, -1, -1, 0.0, int((~side).sum()), depth + 1])
            todo += [(left, idx[side], depth + 1), (right, idx[~side], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "left", "right", "feature", "cut", "size", "depth"])

    return grow

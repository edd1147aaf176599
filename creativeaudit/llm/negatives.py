"""Hard negatives: rows of another label that score nearly as high as an anchor's own kind.

Both searches are threshold joins over an inverted index in the manner of
L2AP. Dimensions are taken in the order of their weight, a few at a time. A row
is indexed only as far as the norm of what is left of it could still lift a
pair over the threshold; partial scores are added up over the index, a pair is
dropped when its partial score and the product of the norms of the rest stay
below its threshold, and what is left is scored in full. A threshold starts
near the top of an anchor's windows and is lowered until each holds enough.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import packed, parts, stored

#: Components (not rows) of one packed block, of the rows that one task searches, and of the anchors it searches for.
BLOCK, ROWS, ANCHORS = 1 << 19, 1 << 22, 1 << 15
#: Dimensions that the index takes at a time.
STEP = 8
#: The first share of the way from the top of a window to its foot, and by what it grows.
FIRST, GROWTH = 0.125, 1.5
#: Above this share of live pairs a stage is one product of matrices, below it goes pair by pair.
DENSE = 0.05
_PAIRS = 1 << 15
#: Room for the rounding of norms.
_SLACK = 1e-9


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them; beyond 64 bits they stay doubles."""
    most = np.abs(x).max(initial=0)
    for kind in (np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all values) of a column of lists without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(pa.compute.list_value_length(lists), np.int64), np.asarray(lists.flatten(), np.float64)


def _rest(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from every stage of the index on; a last column of zeros."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1] if x.shape[1] else np.zeros((len(x), 0))
    return np.sqrt(np.concatenate((squares[:, ::STEP], np.zeros((len(x), 1))), axis=1))


class Index:
    """Rows by dimensions, each only as far as a threshold needs."""

    def __init__(self, x: np.ndarray, least: float) -> None:
        """``least``: the smallest threshold that is asked for, over the norm of its query."""
        self.dims = np.argsort(-(x * x).sum(axis=0), kind="stable")
        rest = _rest(x[:, self.dims])
        stages = rest.shape[1] - 1
        # From stage ``cut`` on the rest of a row cannot reach the threshold alone: those dimensions are left out.
        cut = (rest[:, :stages] * (1 + _SLACK) >= least).sum(axis=1) if least > 0 else np.full(len(x), stages)
        self.rows = np.argsort(-cut, kind="stable")  # a dimension's list is a run of rows from the first on
        self.x, self.cut, self.rest = x[self.rows][:, self.dims], cut[self.rows], rest[self.rows]
        self.lists = [int(np.searchsorted(-self.cut, -c, "left")) for c in range(stages)]

    def join(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score is at least the query's threshold."""
        q = q[:, self.dims]
        rest = _rest(q)
        at = lambda c: np.minimum(c, self.cut)
        every = np.arange(len(self.x))
        partial = np.zeros((len(q), len(self.x)))
        i = j = a = None
        for c, n in enumerate(self.lists):
            part = slice(c * STEP, (c + 1) * STEP)
            if i is None:
                partial[:, :n] += q[:, part] @ self.x[:n, part].T
            else:
                listed = np.flatnonzero(j < n)
                for k in range(0, len(listed), _PAIRS):
                    own = listed[k:k + _PAIRS]
                    a[own] += np.einsum("nd,nd->n", q[i[own], part], self.x[j[own], part])
            if i is not None:
                live = self._may(a, rest[i, np.minimum(c + 1, self.cut[j])], self.rest[j, np.minimum(c + 1, self.cut[j])], t[i])
                i, j, a = i[live], j[live], a[live]
            elif c % 2 or c + 1 == len(self.lists):
                live = self._may(partial, rest[:, at(c + 1)], self.rest[every, at(c + 1)], t[:, None])
                if live.mean() <= DENSE or c + 1 == len(self.lists):
                    i, j = np.nonzero(live)
                    a = partial[i, j]
        if i is None:
            i, j = (x.ravel() for x in np.indices(partial.shape))
        score = np.zeros(len(i))
        for k in range(0, len(i), _PAIRS):
            own = slice(k, k + _PAIRS)
            score[own] = np.einsum("nd,nd->n", q[i[own]], self.x[j[own]])
        good = score >= t[i]
        return i[good], self.rows[j[good]], score[good]

    @staticmethod
    def _may(a, q_rest, x_rest, t):
        most = q_rest * x_rest
        return a + most + _SLACK * (np.abs(a) + most) >= t


class Whole:
    """All pairs in whole numbers of any size: for values whose products doubles don't hold."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = _whole(x)

    def join(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = _whole(q) @ self.x.T
        i, j = np.nonzero(s >= t[:, None])
        return i, j, s[i, j]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in line] for line in x], dtype=object).reshape(x.shape)


def windows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, wanted) -> list[tuple[int, int, int, int]]:
    """The first ``k`` rows of each window of each query, equal scores by ``ids``: (query, window, row, score), in no order.

    ``low`` and ``high`` have a row per query and a column per window; NaN stands
    for no window, infinities for one that is open. ``wanted(i, j)`` says which pairs of query and row count.
    """
    if not len(q) or not len(x):
        return []
    norm, most = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1)).max()
    exact = norm.max() * most < 2.0 ** 52
    reach = norm * most * (1 + _SLACK) + 1
    some = ~np.isnan(high)
    top = np.minimum(np.where(some, high, -np.inf).max(axis=1), reach)
    foot = np.maximum(np.where(some, low, np.inf).min(axis=1), -reach)
    todo = np.flatnonzero(some.any(axis=1) & (foot <= top))
    found: list[tuple[int, int, int, int]] = []
    share = FIRST
    while len(todo):
        share = min(share, 1.0) if exact else 1.0
        t = foot[todo] if share == 1 else top[todo] - (top[todo] - foot[todo]) * share
        index = Index(x, float((t / np.maximum(norm[todo], 1e-300)).min())) if exact else Whole(x)
        i, j, s = index.join(q[todo], t)
        good = wanted(todo[i], j)
        i, j, s = i[good], j[good], s[good]
        full = np.ones(len(todo), bool)
        rows = []
        for w in range(high.shape[1]):
            inside = np.flatnonzero((s >= low[todo[i], w]) & (s <= high[todo[i], w]))
            n = np.bincount(i[inside], minlength=len(todo))
            full &= (n >= k) | (t <= low[todo, w]) | ~some[todo, w] | (share == 1)
            rows.append(inside)
        for w, inside in enumerate(rows):
            inside = inside[full[i[inside]]]
            if exact:
                inside = inside[np.lexsort((ids[j[inside]], -s[inside], i[inside]))]
            else:
                inside = np.array(sorted(inside, key=lambda r: (i[r], -s[r], ids[j[r]])), np.int64)  # noqa: B023
            first = np.arange(len(inside)) - np.searchsorted(i[inside], i[inside]) < k
            found += [(int(todo[i[r]]), w, int(j[r]), int(s[r])) for r in inside[first]]
        todo = todo[~full]
        share *= GROWTH
    return found


BLOCK_SCHEMA = "low long, dim int, kind string, ids binary, labels binary, data binary"


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """Rows (vec_id, label, v) as matrices of whole numbers, each of one length of vectors."""
    def run(batches):
        for batch in batches:
            length, values = _numbers(batch.column(2))
            ids, labels = (np.asarray(batch.column(c)) for c in (0, 1))
            start = np.cumsum(length) - length
            for dim in np.unique(length):
                own = np.flatnonzero(length == dim)
                most = max(1, BLOCK // max(1, int(dim)))
                for k in range(0, len(own), most):
                    part = own[k:k + most]
                    data = _narrow(np.floor(scale * values[start[part][:, None] + np.arange(dim)]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[part[0]]], pa.int64()), pa.array([dim], pa.int32()), pa.array([data.dtype.str]),
                        pa.array([packed(ids[part])], pa.binary()), pa.array([packed(labels[part])], pa.binary()),
                        pa.array([packed(data)], pa.binary())], names=["low", "dim", "kind", "ids", "labels", "data"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, BLOCK_SCHEMA)


def _search(asked: DataFrame, blocks: DataFrame, n_q: int, n_p: int, k: int, scale: float, same: bool) -> DataFrame:
    """(anchor_id, nth window, vec_id, score): the best of each part of the rows for each window of each anchor."""
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.select("*", deal("low", n_p).alias("p"), every(n_q).alias("q"))
    asked = asked.select("vec_id", "label", "v", "lows", "highs", deal("vec_id", n_q).alias("q"), every(n_p).alias("p"))

    def cell(anchors: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        length, values = _numbers(anchors.column("v"))
        start = np.cumsum(length) - length
        own_ids, own_labels = (np.asarray(anchors.column(c)) for c in ("vec_id", "label"))
        lows, highs = (anchors.column(c).to_pylist() for c in ("lows", "highs"))
        width = max((len(h) for h in highs), default=0)
        grid = lambda rows: np.array([[*r, *[None] * (width - len(r))] for r in rows], float).reshape(len(rows), width)
        low, high = grid(lows), grid(highs)
        by_dim: dict[int, list[int]] = {}
        for row, dim in enumerate(found.column("dim").to_pylist()):
            by_dim.setdefault(dim, []).append(row)
        for dim, rows in by_dim.items():
            who = np.flatnonzero(length == dim)
            if not len(who):
                continue
            load = lambda c, r, kind: np.frombuffer(found.column(c)[r].as_py(), kind)
            ids = np.concatenate([load("ids", r, np.int64) for r in rows])
            labels = np.concatenate([load("labels", r, np.int64) for r in rows])
            x = np.concatenate([load("data", r, found.column("kind")[r].as_py()).astype(np.float64) for r in rows]).reshape(len(ids), dim)
            q = np.floor(scale * values[start[who][:, None] + np.arange(dim)])
            # The same label: only its rows are searched. Another one: all rows are, and those of the label don't count.
            for label in np.unique(own_labels[who]) if same else [None]:
                at = np.flatnonzero(labels == label) if same else np.arange(len(ids))
                mine = np.flatnonzero(own_labels[who] == label) if same else np.arange(len(who))
                wanted = lambda i, j: (own_ids[who][mine][i] != ids[at][j]) & (same | (own_labels[who][mine][i] != labels[at][j]))  # noqa: E731, B023
                for i, w, j, s in windows(q[mine], x[at], ids[at], low[who][mine], high[who][mine], k, wanted):
                    out.append((int(own_ids[who[mine[i]]]), w, int(ids[at[j]]), min(max(s, -2 ** 63), 2 ** 63 - 1)))
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                        names=["anchor_id", "nth", "vec_id", "score"])

    found = asked.groupBy("q", "p").cogroup(blocks.groupBy("q", "p")).applyInArrow(cell, "anchor_id long, nth int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", k: int = 5, least: int = 80,
                   scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each anchor and each of its ``k`` positives the first ``k`` negatives in the positive's window.

    Components become floor(scale * x), a score is the inner product with the
    anchor, higher ones and then smaller ids come first. Positives are an
    anchor's first rows of its own label; a negative has another label and
    ``least`` to 100 percent of the positive's score. A negative score has an
    empty window. ``label`` is a whole number.

    Rows with a null id, label, vector or component take no part, nor do those
    with a component that isn't finite (or isn't when scaled); vectors of
    another length than the anchor's aren't compared. Rows with the anchor's id
    are not its candidates. A repeated anchor id asks once, with its smallest
    (vector, label); other repeated rows count each, as positives too. Scores
    beyond the long range stand at its ends. Further columns are ignored.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(scale)) < float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(usable)
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.v", "x.label")
    n_p, n_q = parts(rows, F.size("v"), ROWS), parts(asked, F.size("v"), ANCHORS)
    blocks = stored(_blocks(rows, scale), "rows-to-search")
    asked = stored(asked, "anchors")
    anything = asked.select("*", F.array(F.lit(-math.inf)).alias("lows"), F.array(F.lit(math.inf)).alias("highs"))
    found = _search(anything, blocks, n_q, n_p, k, scale, same=True)
    positives = stored(found.select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("x"))
    score = F.col("x.positive_score").cast("array<decimal(20,0)>")
    # The least whole number that is ``least`` percent of the score or more, found without leaving whole numbers.
    foot = F.transform(score, lambda s: F.ceil(s * F.lit(least) / F.lit(100)).cast("double"))
    tops = tops.select("vec_id", foot.alias("lows"), F.col("x.positive_score").cast("array<double>").alias("highs"))
    found = _search(asked.join(tops, "vec_id"), blocks, n_q, n_p, k, scale, same=False)
    return found.withColumn("nth", F.col("nth") + 1).join(positives, ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Spelling variants: words one edit apart, found in k-d trees over vectors of letter counts.

One edit changes the counts of a word's letters by two in all at most: two for
a replaced letter, one for a letter more or less. So all that is near a word
lies in a small box around its counts. Words of one length are cut into cells
by a k-d tree whose planes come from a bounded sample; a word goes to each cell
of its own length and of the next that its box meets. A cell builds a tree of
all its words, with the box that each branch really fills, and searches it;
what the counts allow is verified letter by letter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit.llm.common import stored

#: A run of letters; all of them are single bytes in Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of a cell, about; words that its planes are drawn from, about, over all lengths; words of a leaf within a cell.
CELL, SAMPLE, LEAF = 1 << 15, 200_000, 6
#: Letters a to z, and the others by their code point modulo six.
DIMS = 32
#: Queries that a cell searches for at a time, and pairs that it verifies at a time.
AT_ONCE, PAIRS = 2048, 1 << 18

_SLOT = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])


def word_counts(docs: DataFrame, doc_id: str, text: str, fewest: int, shortest: int, cut_every: int) -> DataFrame:
    """(word, n) of the runs of letters, some of them short of a letter, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= shortest)
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % cut_every == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)


def letters(words: list[bytes], length: int) -> np.ndarray:
    """One row of bytes per word of that length."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def counts(rows: np.ndarray) -> np.ndarray:
    """How often each word has each letter, 127 at most: that never makes a difference larger."""
    at = np.repeat(np.arange(len(rows)) * DIMS, rows.shape[1]) + _SLOT[rows].ravel()
    return np.minimum(np.bincount(at, minlength=len(rows) * DIMS), 127).reshape(len(rows), DIMS).astype(np.int8)


class Tree:
    """A k-d tree. Node i has the box low[i] to high[i], and the children left[i] and right[i] or, as a leaf, points."""

    def __init__(self, x: np.ndarray, leaf: int, tight: bool) -> None:
        """``tight``: boxes end where the points do, else at the planes, so that they fill all space."""
        self.order = np.arange(len(x))
        low, high, left, right, start, stop = [], [], [], [], [], []
        todo = [(0, len(x), np.zeros(DIMS, np.int8), np.full(DIMS, 127, np.int8), None)]
        while todo:
            a, b, lo, hi, parent = todo.pop()
            own = x[self.order[a:b]]
            if tight and len(own):
                lo, hi = own.min(axis=0), own.max(axis=0)
            node = len(left)
            if parent is not None:
                parent[0][parent[1]] = node
            for column, value in ((low, lo), (high, hi), (left, -1), (right, -1), (start, a), (stop, b)):
                column.append(value)
            if b - a <= leaf:
                continue
            dim = int(own.var(axis=0, dtype=np.float32).argmax())
            values = own[:, dim]
            at = int(np.partition(values, len(values) // 2)[len(values) // 2])
            at -= at == values.max()
            low_side = values <= at
            if not low_side.any():
                continue  # all of one point
            self.order[a:b] = np.concatenate((self.order[a:b][low_side], self.order[a:b][~low_side]))
            middle = a + int(low_side.sum())
            lower, upper = hi.copy(), lo.copy()
            lower[dim], upper[dim] = at, at + 1
            todo += [(a, middle, lo, lower, (left, node)), (middle, b, upper, hi, (right, node))]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right, self.start, self.stop = (np.array(c, np.int32) for c in (left, right, start, stop))

    def reach(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose box is within an L1 distance of ``radius``."""
        i, node = np.arange(len(q)), np.zeros(len(q), np.int32)
        found = []
        while len(i):
            x = q[i]
            gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0).sum(axis=1, dtype=np.int16)
            near = gap <= radius
            i, node = i[near], node[near]
            leaf = self.left[node] < 0
            found.append((i[leaf], node[leaf]))
            i, node = i[~leaf], node[~leaf]
            i, node = np.concatenate((i, i)), np.concatenate((self.left[node], self.right[node]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (i, node)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of ``b``, longer by one, are those of ``a`` with one letter put in."""
    n = a.shape[1]
    ahead, behind = a != b[:, :n], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), n)
    last = np.where(behind.any(axis=1), n - behind[:, ::-1].argmax(axis=1), 0)
    return last <= first


def _by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    length = np.array([len(w) for w in words], np.int64)
    return {int(n): np.flatnonzero(length == n) for n in np.unique(length)}


def near_pairs(words: list[bytes], queries: list[bytes]):
    """(places of queries, places of words) that are one edit apart; ``words`` have one length, ``queries`` that or one less."""
    if not words:
        return
    length = len(words[0])
    rows = letters(words, length)
    x = counts(rows)
    tree = Tree(x, LEAF, tight=True)
    x, rows = x[tree.order], rows[tree.order]
    for n, places in _by_length(queries).items():
        radius, verified = (2, one_replaced) if n == length else (1, one_inserted)
        own = letters([queries[p] for p in places], n)
        for k in range(0, len(places), AT_ONCE):
            asked = own[k:k + AT_ONCE]
            q = counts(asked)
            i, leaf = tree.reach(q, radius)
            size = tree.stop[leaf] - tree.start[leaf]
            end = np.cumsum(size)
            for a in range(0, int(end[-1]) if len(end) else 0, PAIRS):
                pair = np.arange(a, min(a + PAIRS, int(end[-1])))
                at = np.searchsorted(end, pair, "right")
                who, point = i[at], tree.start[leaf[at]] + pair - (end[at] - size[at])
                near = np.abs(q[who] - x[point]).sum(axis=1, dtype=np.int16) <= radius
                who, point = who[near], point[near]
                good = verified(asked[who], rows[point])
                yield places[k + who[good]], tree.order[point[good]]


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray, names: np.ndarray):
    """For each word in ``own``: how many pairs it is in, and the other word of largest n, the smallest of equals."""
    by = np.lexsort((names[other], -n[other], own))
    own, other = own[by], other[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
    return own[first], np.diff(np.concatenate((first, [len(own)]))), other[first]


FOUND = "word string, n_near long, best_n long, best string"


def _matched(cell: pa.Table) -> pa.Table:
    """What the words of a cell and those that visit it find in each other, one row per word."""
    # In Latin-1 bytes sort as code points do.
    words = [w.encode("latin-1") for w in cell.column("word").to_pylist()]
    names, n = np.array(words, bytes), np.asarray(cell.column("n"))
    home = np.flatnonzero(np.asarray(cell.column("home")))
    length = len(words[home[0]]) if len(home) else 0
    ask, hit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in near_pairs([words[h] for h in home], words):
        ask.append(i), hit.append(home[j])
    ask, hit = np.concatenate(ask), np.concatenate(hit)
    # A pair of one length is found from either side, one of two lengths only from the shorter word.
    longer = np.array([len(w) for w in words], np.int64)[ask] < length
    own, other = np.concatenate((ask, hit[longer])), np.concatenate((hit, ask[longer]))
    own, many, other = _best(own, other, n, names)
    as_text = lambda at: pa.array([words[k].decode("latin-1") for k in at], pa.string())
    return pa.table([as_text(own), pa.array(many, pa.int64()), pa.array(n[other], pa.int64()), as_text(other)], names=["word", "n_near", "best_n", "best"])


def _cells(words: DataFrame) -> dict[int, tuple[int, Tree]]:
    """For each length its first cell and the tree of planes: a few rows, and a sample of SAMPLE words at most."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    lot = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = [r["word"].encode("latin-1") for r in words.select("word").filter(lot).limit(2 * SAMPLE).collect()] if sizes else []
    sample = {length: [drawn[p] for p in places] for length, places in _by_length(drawn).items()}
    out, first = {}, 0
    for length in sorted(sizes):
        own = sample.get(length, [])
        parts = math.ceil(sizes[length] / CELL)
        tree = Tree(counts(letters(own, length)), max(8, math.ceil(len(own) / parts)), tight=False)
        out[length] = first, tree
        first += len(tree.left)
    return out


def _dealt(cells: dict[int, tuple[int, Tree]]):
    """Sends each word home, and to the cells of its own and the next length that one edit can reach."""
    def run(batches):
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, places in _by_length(words).items():
                q = counts(letters([words[p] for p in places], length))
                cell, row, home = [], [], []
                for other, radius in ((length, 0), (length, 2), (length + 1, 1)):
                    if other in cells:
                        first, tree = cells[other]
                        i, node = tree.reach(q, radius)
                        cell.append(first + node), row.append(places[i]), home.append(np.full(len(i), radius == 0))
                cell, row, home = (np.concatenate(c) for c in (cell, row, home))
                # A word is home once; there it is a query as well.
                by = np.lexsort((~home, row, cell))
                cell, row, home = cell[by], row[by], home[by]
                new = np.ones(len(cell), bool)
                new[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(cell[new], pa.int64()), pa.array(home[new]), batch.column(0).take(at), batch.column(1).take(at)],
                                                 names=["cell", "home", "word", "n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a word one edit away."""
    dealt = words.select("word", "n").mapInArrow(_dealt(_cells(words)), "cell long, home boolean, word string, n long")
    found = dealt.groupBy("cell").applyInArrow(_matched, FOUND)
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x"))
    return found.select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the end of each chain. Every round doubles how far a word looks."""
    step = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while step.filter("moved").limit(1).count():
        further = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stored(step.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
    return step.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fewest: int = 3, shortest: int = 5,
                      cut_every: int = 97, at_least: Column | int = 2) -> DataFrame:
    """Groups the words of all texts by the usual spelling that they seem to be variants of.

    Words are runs of letters up to U+00FF, A to Z in lower case; a run whose
    crc32 with its document's id is divisible by ``cut_every`` lacks one letter
    (planted misspellings). Words of ``shortest`` code points and ``fewest``
    occurrences count. Near are words that differ by one letter put in, left
    out or replaced. A word's form is its near word of most occurrences, equal
    ones by code points, if that has ``at_least`` times its own; its root is
    where the chain of forms ends. Counts grow along it, so it does end.

    A null text has no words, a null id is the empty text before the colon.
    Repeated rows count each. No words give no rows. Further columns are ignored.
    Columns: word, form, root, n, n_near, form_n.
    """
    words = stored(word_counts(docs, doc_id, text, fewest, shortest, cut_every), "words")
    near = stored(near_words(words), "near-words")
    good = F.col("best_n") >= at_least * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                  F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    out = stored(out, "forms")
    ends = roots(out.filter("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Language-model scores: Katz backoff over counts of words and of pairs of words.

Counts are discounted by Good-Turing; what that takes from a context goes to
the words that never followed it, in proportion to the order below, with a
weight that makes the probabilities of a context add up to one exactly. The
lowest order knows each word of the training text and one class for all others.

The model is two tables: words (hash, id, n), and pairs by bucket of their
context, from which the bucket's weights follow. Texts are cut into blocks. A block sends each
of its distinct pairs once, with its count in training text, to the pair's
bucket, and gets one logarithm back for it, in an order that the block's texts
alone determine. So a shuffle holds distinct pairs, as small numbers, and not
tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import Words, blocked, mixed, pack, parts, pieces_of, removed, stored, unpacked

BLOCK_BYTES = 4_000_000
#: Words whose ids are given out in one window.
NUMBERED = 1_000_000
#: The most frequent words, so many at most, are broadcast with their ids and counts (24 bytes each); others meet the texts in a join.
COMMON = 1 << 19
#: A context with more than this part of all training tokens is dealt out over the buckets; there are HOT at most.
HOT = 2048
#: Counts above TOP are trusted as they are.
TOP = 5
#: The end of a text, as a word; no hash of one.
END = np.uint64(0x454E44)
#: Ids: all words that training text lacks, and what stands before a text; words have higher ones.
UNKNOWN, START = 0, 1
_FLUSH = 1_000_000


def discounts(n: list[int]) -> np.ndarray:
    """What is left of counts 0 to TOP, as factors, given how many types have the counts 1 to TOP + 1.

    Good-Turing with Katz's normalisation, for the largest range up to TOP in
    which it gives factors above 0 and of 1 at most; odd counts of counts (many
    copies of one text) may leave none. Then it is an absolute discount.
    """
    out = np.ones(TOP + 1)
    for top in range(TOP, 0, -1):
        if min(n[:top + 1]) == 0 or (top + 1) * n[top] >= n[0]:
            continue
        common = (top + 1) * n[top] / n[0]
        factors = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, top + 1)]
        if all(0 < d <= 1 for d in factors):
            out[1:top + 1] = factors
            return out
    d = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out[1:] = 1 - d / np.arange(1, TOP + 1)
    return out


class Discounted:
    """Counts of one order, discounted."""

    def __init__(self, counts_of_counts: list[int]) -> None:
        self.factor = discounts(counts_of_counts)

    def kept(self, r: np.ndarray) -> np.ndarray:
        """Counts above TOP keep all."""
        return np.where(r > TOP, r, self.factor[np.minimum(r, TOP)] * r)


def total(count, kept):
    """The denominator of a context. Where no count was discounted, one more keeps something for other words."""
    return count + (kept >= count)


class Unigrams:
    """The order below: words of the training text, and one class for all others."""

    def __init__(self, n_types: int, n_tokens: int, kept: float, order: Discounted) -> None:
        self.types, self.tokens, self.order = n_types, n_tokens, order
        self.total = total(n_tokens, kept)
        self.unknown = 1 - kept / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of words with these counts, 0 for an unknown one."""
        return np.where(c > 0, self.order.kept(c) / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


# ---------------------------------------------------------------- words


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _count_words(batches):
    """(hash, n) of the words and ends of some texts, added up by task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])
    for piece in pieces_of(batches):
        held += [np.unique(Words(piece.column(0), "lower").hash, return_counts=True), (np.array([END]), np.array([piece.num_rows]))]
        if sum(len(k) for k, _ in held) > _FLUSH:
            held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > _FLUSH // 2:
                yield rows(*held.pop())
    if held:
        yield rows(*_summed(*(np.concatenate(x) for x in zip(*held))))


def word_table(texts: DataFrame) -> DataFrame:
    """(hash, id, n) of all words of the texts, lower-cased, and of their ends; ids are dense, from 2 on, in the order of hashes.

    A word is its 64-bit hash: among a billion different words two share one with a probability of 3 percent.
    """
    counted = stored(texts.select("text").mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words", tidy=True)
    n = parts(counted, F.lit(1), NUMBERED)
    bits = max(0, (n - 1).bit_length())
    dealt = counted.withColumn("part", F.shiftright("hash", 64 - bits).cast("int") if bits else F.lit(0))
    before = START
    offsets = []  # one row per million words
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = dealt.sparkSession.createDataFrame(offsets, "part int, before long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("hash"))
    numbered = stored(dealt.withColumn("nth", nth).join(F.broadcast(offsets), "part").select("hash", (F.col("before") + F.col("nth")).alias("id"), "n"), "numbered-words", tidy=True)
    removed(counted)
    return numbered


def unigrams(words: DataFrame) -> Unigrams:
    some = words.agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("n") > TOP, F.col("n"))).alias("trusted"),
                     *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, TOP + 2)]).first()
    order = Discounted([some[f"n{r}"] for r in range(1, TOP + 2)])
    kept = (some["trusted"] or 0) + sum(float(order.factor[r] * r * some[f"n{r}"]) for r in range(1, TOP + 1))
    return Unigrams(some["types"], some["tokens"] or 0, kept, order)


# ---------------------------------------------------------------- blocks


def common_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and counts of the words with at least so many occurrences that there are COMMON at most, and of the end, by hash."""
    powers = range(63)
    many = words.agg(*[F.count_if(F.col("n") >= 1 << k).alias(f"k{k}") for k in powers]).first()
    least = 1 << next((k for k in powers if many[k] <= COMMON), 63)
    found = words.filter((F.col("n") >= least) | (F.col("hash") == int(END))).select("hash", "id", "n").toArrow()
    hashes, ids, n = (np.asarray(found.column(c)) for c in ("hash", "id", "n"))
    by = np.argsort(hashes)
    return hashes[by], ids[by], n[by]


def _rare_words(common):
    """(block, hash) of the distinct words of each block and task that aren't common."""
    def run(batches):
        known = common.value[0]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(found):
            block, key = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            by = np.lexsort((key, block))
            block, key = block[by], key[by]
            new = _runs(block, key)
            return pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(key[new])], names=["block", "hash"])

        for piece in pieces_of(batches):
            words = Words(piece.column(1), "lower")
            key = words.hash.view(np.int64)
            rare = np.flatnonzero(~_has(known, key))
            held.append((np.asarray(piece.column(0))[words.owner()[rare]], key[rare]))
            if sum(len(k) for _, k in held) > _FLUSH:
                yield rows(held)
                held = []
        yield rows(held)
        pa.default_memory_pool().release_unused()

    return run


def _has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _fewest(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(np.min_scalar_type(high) if low >= 0 else np.result_type(np.min_scalar_type(low), np.min_scalar_type(-high - 1)))


def _body(**columns) -> bytes:
    """Columns of one length, compressed; of "v" the steps. The first bytes of all numbers come first, then the second ones:
    so few bits of small numbers are kept."""
    made = {}
    for c, x in columns.items():
        x = _fewest(np.diff(x, prepend=0) if c == "v" else x) if x.dtype.kind in "iu" else x
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
        made[f"{c} {x.dtype.str} {len(x)}"] = pa.array([pa.compress(planes.tobytes(), codec="zstd", asbytes=True)], pa.binary())
    table = pa.table(made)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _loaded(bodies, names: list[str]) -> list[np.ndarray]:
    """Columns of several bodies, one after the other."""
    found: list[list[np.ndarray]] = [[] for _ in names]
    for body in bodies:
        with pa.ipc.open_stream(body.as_buffer()) as stream:
            table = stream.read_all()
        for field in table.column_names:
            name, kind, n = field.split(" ")
            if name in names:
                kind, n = np.dtype(kind), int(n)
                planes = np.frombuffer(pa.decompress(table.column(field)[0].as_buffer(), n * kind.itemsize, codec="zstd"), np.uint8)
                x = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)
                x = x.astype(np.int64) if kind.kind in "iu" else x
                found[names.index(name)].append(np.cumsum(x) if name == "v" else x)
    return [np.concatenate(column) if column else np.zeros(0, np.int64) for column in found]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Block:
    """The distinct words of some texts, and their distinct pairs by bucket, in the order of their words' hashes."""

    def __init__(self, bodies, n_buckets: int, hot: np.ndarray) -> None:
        """``hot``: hashes of contexts whose pairs are dealt out by both words; so are those of starts."""
        found, size, ids, taught = [], [], [], []
        for body in bodies:
            for batch in unpacked([body]):
                for piece in pieces_of([batch]):
                    words = Words(piece.column(piece.schema.get_field_index("text")), "lower")
                    n = words.counts() + 1
                    token = np.full(int(n.sum()), END, np.uint64)
                    last = np.zeros(len(token), bool)
                    last[np.cumsum(n) - 1] = True
                    token[~last] = words.hash
                    found.append(token), size.append(n)
                    ids.append(piece.column(piece.schema.get_field_index("doc_id")))
                    taught.append(np.asarray(piece.column(piece.schema.get_field_index("taught"))))
        self.ids = pa.chunked_array(ids, pa.int64())
        self.taught = np.concatenate(taught)
        self.size = np.concatenate(size)
        self.head = np.cumsum(self.size) - self.size
        self.hash, word = np.unique(np.concatenate(found).view(np.int64), return_inverse=True)
        found.clear()
        n = len(self.hash)
        before = np.roll(word, 1)
        before[self.head] = n  # the start, after all words
        before *= n + 1
        before += word
        del word
        pair, place = np.unique(before, return_inverse=True)
        self.place = place.astype(np.int32)
        del before, place
        self.v, self.w = (x.astype(np.int32) for x in np.divmod(pair, n + 1))
        own = np.append(self.hash, 0).view(np.uint64)
        spread = np.append(np.isin(self.hash, hot), True)
        key = own[self.v] + np.where(spread[self.v], mixed(own[self.w] + np.uint64(1)), np.uint64(0))
        self.spread = spread[self.v]
        self.bucket = (mixed(key) % np.uint64(n_buckets)).astype(np.int32)
        #: Pairs by bucket, and where each bucket begins.
        self.by = np.argsort(self.bucket, kind="stable")
        self.cuts = np.append(_runs(self.bucket[self.by]), len(self.by))

    def per_text(self, x: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text of a value of each pair."""
        return np.add.reduceat(x[self.place], self.head)


def _asked(n_buckets: int, hot: np.ndarray, common):
    """The distinct pairs of a block by bucket: ids, the count of the second word, and that of the pair in the block's training text."""
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            b = Block(docs.column("body"), n_buckets, hot)
            ids, counts = (np.zeros(len(b.hash) + 1, np.int64) for _ in range(2))  # 0 for words that training text lacks
            ids[-1] = START
            for key, number, n in (common.value, [np.asarray(known.column(c)) for c in ("hash", "id", "n")]):
                here = _has(b.hash, key)
                at = np.searchsorted(b.hash, key[here])
                ids[at], counts[at] = number[here], n[here]
            r = np.bincount(b.place, weights=np.repeat(b.taught, b.size), minlength=len(b.v)).astype(np.int64)
            for i, j in zip(b.cuts[:-1], b.cuts[1:]):
                own = b.by[i:j]
                out.append((docs.column("block")[0].as_py(), int(b.bucket[own[0]]),
                            _body(v=ids[b.v[own]], w=ids[b.w[own]], c=counts[b.w[own]], r=r[own], hot=b.spread[own])))
        cols = list(zip(*out)) if out else [[], [], []]
        pa.default_memory_pool().release_unused()  # a worker goes on to the next block, the JVM needs the rest
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "bucket", "asks"])

    return run


# ---------------------------------------------------------------- pairs

#: A row per bucket. It holds what its blocks asked, about as much as two blocks have, whatever the size of the input.
BUCKETS = "bucket int, blocks array<int>, places array<binary>, pairs binary, lower binary, seen array<long>"
#: Row groups of a few such rows: a reader holds one of them.
FEW_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _merged(asks: pa.Table) -> pa.Table:
    """The distinct pairs of a bucket with their counts in training text, how many have the counts 1 to TOP + 1, and for each block the places of its pairs among them."""
    bodies = list(asks.column("asks"))
    v, w, c, r, hot = _loaded(bodies, ["v", "w", "c", "r", "hot"])
    by = np.lexsort((w, v))
    start = _runs(v[by], w[by])
    place = np.empty(len(by), np.int64)
    place[by] = np.repeat(np.arange(len(start)), np.diff(start, append=len(by)))
    r = np.add.reduceat(r[by], start) if len(start) else r
    v, w, c, hot = (x[by[start]] for x in (v, w, c, hot))
    seen = np.bincount(np.minimum(r, TOP + 2), minlength=TOP + 3)[1:TOP + 2]
    places, a = [], 0
    for body in bodies:
        own = slice(a, a + len(_loaded([body], ["hot"])[0]))
        places.append(_body(v=place[own]))  # they mostly rise, by small steps
        a = own.stop
    pa.default_memory_pool().release_unused()
    return pa.table([pa.array([asks.column("bucket")[0].as_py()], pa.int32()), pa.array([asks.column("block").to_pylist()], pa.list_(pa.int32())),
                     pa.array([places], pa.list_(pa.binary())), pa.array([_body(v=v, w=w, r=r)], pa.binary()), pa.array([_body(c=c, hot=hot)], pa.binary()),
                     pa.array([seen.tolist()], pa.list_(pa.int64()))], names=["bucket", "blocks", "places", "pairs", "lower", "seen"])


def _weigh(count, kept, lower):
    """The backoff weight: what is left of a context over what the order below gives to words it was never seen with."""
    return (1 - kept / total(count, kept)) / (1 - lower)


def _contexts(v, r, c, hot, order: Discounted, lower: Unigrams):
    """Of the pairs of a bucket: contexts, their counts, what is kept of those, what the order below gives to the same words, and which are dealt out."""
    v, r, c, hot = (x[r > 0] for x in (v, r, c, hot))
    start = _runs(v)
    count, kept, below = (np.add.reduceat(x, start) if len(start) else x.astype(float) for x in (r, order.kept(r), lower.p(c)))
    return v[start], count, kept, below, hot[start].astype(bool)


HOT_PARTS = "v long, count long, kept double, lower double"


def _hot_parts(order: Discounted, lower: Unigrams):
    """Each bucket's part of the contexts that are dealt out."""
    def run(batches):
        for batch in batches:
            for body, rest in zip(batch.column(0), batch.column(1)):
                v, count, kept, below, hot = _contexts(*_loaded([body], ["v", "r"]), *_loaded([rest], ["c", "hot"]), order, lower)
                yield pa.RecordBatch.from_arrays([pa.array(v[hot], pa.int64()), pa.array(count[hot], pa.int64()), pa.array(kept[hot], pa.float64()),
                                                  pa.array(below[hot], pa.float64())], names=["v", "count", "kept", "lower"])

    return run


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted distinct ones, or their number."""
    return np.where(_has(keys, wanted), np.searchsorted(keys, wanted), len(keys))


def _answered(order: Discounted, lower: Unigrams, hot: dict[int, tuple[float, float]]):
    """The logarithm of each asked pair: of the pair if training text has it, else of its word, weighed by its context."""
    hot_v = np.array(sorted(hot), np.int64)
    hot_total, hot_weight = (np.array([hot[int(v)][i] for v in hot_v], float) for i in (0, 1))

    def answer(bucket: int, blocks, places, pairs, rest) -> pa.RecordBatch:
        v, r = _loaded([pairs], ["v", "r"])
        c, spread = _loaded([rest], ["c", "hot"])
        contexts, count, kept, below, dealt = _contexts(v, r, c, spread, order, lower)
        contexts, count, kept, below = (x[~dealt] for x in (contexts, count, kept, below))
        # What was never a context leaves all to the order below.
        contexts = np.concatenate((contexts, hot_v))
        totals, shares = np.concatenate((total(count, kept), hot_total)), np.concatenate((_weigh(count, kept, below), hot_weight))
        by = np.argsort(contexts)
        contexts, totals, shares = contexts[by], np.append(totals[by], 1.0), np.append(shares[by], 1.0)
        at = _at(contexts, v)
        known = r > 0
        logs = np.log10(np.where(known, order.kept(r) / totals[at], lower.p(c)))
        logs[~known] += np.log10(shares[at[~known]])
        nths, values = [], []
        for body in places:
            own, = _loaded([body], ["v"])
            # The same few values come again and again: they are sent once, and their numbers.
            value, nth = np.unique(logs[own], return_inverse=True)
            nths.append(_body(nth=nth, c=c[own]))
            values.append(_body(value=value))
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([blocks, pa.array([bucket] * len(blocks), pa.int32()), pa.array(nths, pa.binary()), pa.array(values, pa.binary())],
                                          names=["block", "bucket", "nth", "logs"])

    def run(batches):
        for batch in batches:
            bucket, blocks, places, pairs, rest = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "blocks", "places", "pairs", "lower"))
            for i in range(batch.num_rows):
                yield answer(bucket[i].as_py(), blocks[i].values, list(places[i].values), pairs[i], rest[i])

    return run


def _scored(n_buckets: int, hot: np.ndarray, lower: Unigrams):
    """The scores of a block's documents: its pairs anew, in the order in which they were asked."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs.column("body"), n_buckets, hot)
        logs, counts = np.empty(len(b.v)), np.empty(len(b.v), np.int64)
        at = 0
        for i in np.argsort(np.asarray(answers.column("bucket")), kind="stable").tolist():
            nth, c = _loaded([answers.column("nth")[i]], ["nth", "c"])
            value, = _loaded([answers.column("logs")[i]], ["value"])
            own = b.by[at:at + len(nth)]
            logs[own], counts[own] = value[nth], c
            at += len(nth)
        assert at == len(b.v), "a pair lacks its answer"
        return pa.table([b.ids, pa.array(~b.taught), pa.array(b.size), pa.array(b.per_text((counts > 0).astype(np.int64))),
                         pa.array(b.per_text(lower.base(counts))), pa.array(b.per_text(logs))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The log10 probability of each text under a model of those that aren't held out.

    A text's tokens are its words, A to Z in lower case, and its end; the first
    follows a start. An order of two: a pair in the training text has its
    discounted share of its context, see ``discounts``; any other has the
    share of its word among all, times the backoff weight of its context. After a word that
    training text lacks only the order below counts, and all such words are one class of it.
    ``base_score`` adds 0.1 to each word's count instead, see ``Unigrams.base``.

    A null or empty text has one token, its end. A null ``held_out`` counts as
    true. Ids may be null or repeat; each row counts and is returned. Without
    training text every score is 0. No rows give no rows; further columns are
    ignored. Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(~held_out, F.lit(False)).alias("taught"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = word_table(rows.filter("taught"))
    lower = unigrams(words)
    n_taught = rows.filter("taught").count()
    rows, n = blocked(rows, BLOCK_BYTES)
    common = docs.sparkSession.sparkContext.broadcast(common_words(words))
    asked = rows.select("block", "text").mapInArrow(_rare_words(common), "block int, hash long")
    known = asked.join(words, "hash").select("block", "hash", "id", "n")
    texts = pack(rows.select("block", "doc_id", "taught", "text"))
    share = (lower.tokens + n_taught) / HOT
    hot_words = np.array(sorted(r["hash"] for r in words.filter(F.col("n") > share).select("hash").collect()), np.int64)  # fewer than HOT
    n_buckets = max(1, n // 2)
    asks = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_asked(n_buckets, hot_words, common), "block int, bucket int, asks binary")
    # What is asked is shuffled once: its bucket keeps it next to the counts that answer it.
    buckets = stored(asks.groupBy("bucket").applyInArrow(_merged, BUCKETS), "buckets", tidy=True, **FEW_ROWS)
    removed(words)
    seen = buckets.agg(*[F.sum(F.col("seen")[i]).alias(f"n{i}") for i in range(TOP + 1)]).first()
    order = Discounted([x or 0 for x in seen])
    # One row for each context that more than a share of all tokens follow, and for the start: HOT at most.
    parts_of_hot = stored(buckets.select("pairs", "lower").mapInArrow(_hot_parts(order, lower), HOT_PARTS), "hot-contexts")
    hot = parts_of_hot.groupBy("v").agg(F.sum("count").alias("count"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower")).collect()
    hot = {r["v"]: (float(total(r["count"], r["kept"])), float(_weigh(r["count"], r["kept"], r["lower"]))) for r in hot}
    answers = stored(buckets.select("bucket", "blocks", "places", "pairs", "lower").mapInArrow(
        _answered(order, lower, hot), "block int, bucket int, nth binary, logs binary"), "answers", tidy=True)
    removed(buckets)
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(n_buckets, hot_words, lower), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lower.tokens).cast("long").alias("train_tokens"), "base_score", "score")

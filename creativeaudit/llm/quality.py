"""A quality classifier: perplexity under an n-gram model of trusted text."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import blocked, loaded, mixed, pack, packed, pieces_of, small, stored, unpacked, unused

#: Four UTF-16 units make 64 bits, so a gram is its own key.
ORDER = 4
BLOCK_BYTES = 24_000_000
#: Trusted ids that are broadcast at most, 8 bytes each; more of them meet the documents in a shuffle.
IDS = 2_000_000
#: Of five trusted documents one is held out: thresholds come from text that the model hasn't seen.
HELD_OUT = 5
#: Histogram steps of bits per unit.
STEPS = 1000
#: Bits by which the sum over n units of good text may be off, times the root of n: one unit differs much from the next.
SPREAD = 3.0
#: With this probability the share of good text below a threshold is the quantile's or more, however few rates it is from.
CONFIDENCE = 0.99
_FLUSH = 3_000_000


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """(number of UTF-16 units of each text, the gram that ends at each unit). Three zeros stand before a text."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    units = [len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts]
    length = np.array(units, np.int64)
    codes = np.frombuffer(("\0\0\0" + "\0\0\0".join(texts)).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    key = np.zeros(max(0, len(codes) - 3), np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | codes[i:len(codes) - 3 + i]
    start = np.cumsum(length + 3) - (length + 3)
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return length, key[at]


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*held))
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) over all texts; each task adds up its own first."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in pieces_of(batches):
            held.append(np.unique(grams(piece.column(0))[1], return_counts=True))
            if sum(len(k) for k, _ in held) > _FLUSH:
                held = [_counted(held)]
                if len(held[0][0]) > _FLUSH // 2:
                    yield _rows(*held[0])
                    held = []
        if held:
            yield _rows(*_counted(held))

    def _rows(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated modified Kneser-Ney: counts of each order, discounts, and what contexts leave to the order below."""

    def __init__(self, counts: DataFrame) -> None:
        """``counts``: gram and n of the highest order. Lower orders count the different units that come before."""
        self.tables = {ORDER: stored(counts, f"grams-{ORDER}")}
        for n in range(ORDER - 1, 0, -1):
            below = self.tables[n + 1].groupBy(_suffix(F.col("gram"), n).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            self.tables[n] = stored(below, f"grams-{n}")
        self.units = self.tables[1].count()
        self.discounts = {n: self._discounts(t) for n, t in self.tables.items()}

    @staticmethod
    def _discounts(table: DataFrame) -> tuple[float, float, float]:
        n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [i - (i + 1) * y * b / a if a else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        if min(raw) <= 0:  # odd counts of counts: nothing would be left to shorter contexts, and some probabilities were 0
            return (y if 0 < y < 1 else 0.5,) * 3
        return tuple(min(d, float(i)) for i, d in enumerate(raw, 1))

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, p) of the distinct grams in ``wanted``; all joins are on keys of grams, which are many and even."""
        below, p = None, None
        for n in range(1, ORDER + 1):
            d1, d2, d3 = self.discounts[n]
            table = self.tables[n]
            taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            context = table.groupBy(_context(F.col("gram"), n).alias("context")).agg(
                F.sum("n").alias("total"), F.sum(taken).alias("left"))
            x = wanted.select(_suffix(F.col("gram"), n).alias("gram")).distinct()
            x = x.select("gram", _context(F.col("gram"), n).alias("context"), _suffix(F.col("gram"), n - 1).alias("shorter"))
            x = x.join(table, "gram", "left").join(context, "context", "left")
            if below is None:
                x = x.withColumn("lower", F.lit(1.0 / (self.units + 1)))
            else:
                x = x.join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), "shorter")
            own = F.coalesce(F.greatest(F.col("n") - taken, F.lit(0.0)), F.lit(0.0))
            p = F.coalesce((own + F.col("left") * F.col("lower")) / F.col("total"), F.col("lower"))
            below = stored(x.select("gram", p.alias("p")), f"probabilities-{n}")
        return below


def _suffix(gram: Column, n: int) -> Column:
    """The last ``n`` units."""
    return gram if n == ORDER else gram.bitwiseAND(F.lit((1 << 16 * n) - 1))


def _context(gram: Column, n: int) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _block_grams(n_buckets: int):
    """The distinct grams of each block, packed by bucket of their hash."""
    def run(batches):
        held: dict[int, list[np.ndarray]] = {}

        def flush():
            for block, found in held.items():
                key = np.unique(np.concatenate(found))
                bucket = (mixed(key) % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by])) + 1
                for part in np.split(by, cuts):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([int(bucket[part[0]])], pa.int32()), pa.array([block], pa.int32()),
                            pa.array([packed(key[part])], pa.binary())], names=["bucket", "block", "grams"])

        for piece in pieces_of(batches):
            block = np.asarray(piece.column(0))
            length, key = grams(piece.column(1))
            owner = np.repeat(block, length)
            for b in np.unique(owner):
                held.setdefault(int(b), []).append(np.unique(key[owner == b]))
            if sum(len(k) for v in held.values() for k in v) > _FLUSH:
                held = {b: [np.unique(np.concatenate(v))] for b, v in held.items()}
                if sum(len(v[0]) for v in held.values()) > _FLUSH // 2:
                    yield from flush()
                    held = {}
        yield from flush()

    return run


def _distinct(rows):
    return pa.table([pa.array(np.unique(loaded(rows, "grams", np.int64)))], names=["gram"])


def _answered(asked, known):
    """Looks the grams of every block up in one shard of the probabilities."""
    gram, p = np.asarray(known.column("gram"), np.int64), np.asarray(known.column("p"), np.float64)
    by = np.argsort(gram)
    gram, bits = gram[by], -np.log2(p[by])
    out = []
    for block, body in zip(asked.column("block").to_pylist(), asked.column("grams")):
        keys = np.frombuffer(body.as_buffer(), np.int64)
        out.append((block, packed(keys), packed(bits[np.searchsorted(gram, keys)])))
    blocks, keys, bits = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(blocks, pa.int32()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], names=["block", "grams", "bits"])


def _scored(docs, model):
    """The bits of each document of a block: one look-up per unit in the block's own grams."""
    key, first = np.unique(loaded(model, "grams", np.uint64), return_index=True)
    bits = loaded(model, "bits", np.float64)[first]
    out = []
    for batch in unpacked(docs.column("body")):
        for piece in pieces_of([batch]):
            length, found = grams(piece.column(piece.schema.get_field_index("text")))
            sums, some = np.zeros(len(length)), np.flatnonzero(length)
            if len(found):
                own, back = np.unique(found, return_inverse=True)
                sums[some] = np.add.reduceat(bits[np.searchsorted(key, own)][back], (np.cumsum(length) - length)[some])
            out.append(pa.table([piece.column(i) for i, c in enumerate(piece.schema.names) if c in KEYS]
                                + [pa.array(length), pa.array(sums)], names=[*KEYS, "units", "bits"]))
    return pa.concat_tables(out) if out else pa.table(
        [pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())],
        names=[*KEYS, "units", "bits"])


#: What names a row of documents: equal rows have equal scores.
KEYS = ["doc_id", "lang", "mark"]


def bits_of(docs: DataFrame, model: Model) -> DataFrame:
    """KEYS, number of UTF-16 units and bits under the model, of rows with KEYS and text.

    The grams of each block of documents, each once, meet the shards of the
    model in a join; their probabilities go back to the block, whose documents
    then look them up. So a shuffle holds the texts once, compressed, and not
    every gram of every document.
    """
    docs, n = blocked(docs, BLOCK_BYTES)
    asked = stored(docs.select("block", "text").mapInArrow(_block_grams(n), "bucket int, block int, grams binary"), "block-grams")
    wanted = stored(asked.groupBy("bucket").applyInArrow(_distinct, "gram long"), "wanted")
    known = model.probabilities(wanted).mapInArrow(_bucketed(n), "bucket int, gram long, p double")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        _answered, "block int, grams binary, bits binary")
    texts = pack(docs.select("block", *KEYS, "text"))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored, "doc_id long, lang string, mark long, units long, bits double")


def _bucketed(n: int):
    """The bucket of a gram as ``_block_grams`` has it."""
    def run(batches):
        for b in batches:
            key = np.asarray(b.column(0)).view(np.uint64)
            bucket = (mixed(key) % np.uint64(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), b.column(1)], names=["bucket", "gram", "p"])

    return run


def classified(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, doc_id: str = "doc_id",
               text: str = "text", lang: str = "lang") -> DataFrame:
    """Perplexity of each document under a model of trusted text, and whether it stays.

    ``trusted`` holds the ids (doc_id) of documents known to be good. Four
    fifths of them, by a hash of the id, train the model; the rest give each
    language its threshold: the ``quantile`` of their bits per unit, and what a
    sample of that size may miss of it, see ``_limit``. A document stays unless it is above the threshold of its
    language; a short one has to be further above it, by SPREAD bits over the
    root of its length, on both sides of the comparison. A language with
    fewer than three held-out documents gets the threshold of all.

    Empty and null texts have no perplexity and stay, as do all documents when
    nothing is trusted. A null language is a language of its own. Equal rows
    have equal results. No rows give no rows; further columns are ignored.
    Columns: doc_id, lang, mark, units, perplexity (per UTF-16 unit), threshold
    (for a text of that length), kept.
    """
    rows = _rows_of(docs, doc_id, text, lang)
    known = stored(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "trusted")
    out_of_model = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(HELD_OUT)) == 0
    taught = stored(known.filter(~out_of_model), "taught")
    model = Model(gram_counts(rows.join(small(taught, IDS), "doc_id", "left_semi")))
    scores = stored(bits_of(rows, model).withColumn("rate", F.try_divide("bits", "units"))
                    .withColumn("margin", F.try_divide(F.lit(SPREAD), F.sqrt("units"))), "scores")
    held = scores.filter("units > 0").join(known.filter(out_of_model), "doc_id", "left_semi")
    # The quantile from a histogram: its size depends on the rates that occur, not on the documents.
    steps = held.groupBy("lang", F.ceil((F.col("rate") - F.col("margin")) * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    steps = stored(steps, "rates")
    everything = steps.groupBy("step").agg(F.sum("n").alias("n"))
    most = _quantile(everything, [], quantile).first()
    general = (most["step"] if most["docs"] < 3 else most["limit"]) / STEPS if most else float("inf")
    by_lang = _quantile(steps, ["lang"], quantile).filter("docs >= 3").select(F.col("lang").alias("l"), (F.col("limit") / STEPS).alias("limit"))
    out = scores.join(by_lang, scores["lang"].eqNullSafe(F.col("l")), "left").withColumn("limit", F.coalesce("limit", F.lit(general)) + F.col("margin"))
    return out.select("doc_id", "lang", "mark", "units", F.pow(F.lit(2.0), "rate").alias("perplexity"),
                      F.pow(F.lit(2.0), "limit").alias("threshold"), F.coalesce(F.col("rate") <= F.col("limit"), F.lit(True)).alias("kept"))


def _rows_of(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"),
                       F.xxhash64(F.col(lang), F.col(text)).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _limit(q: float) -> Column:
    """The quantile of a sample (step, docs, mean, sd), raised by the spread of its rates and the less the more they are.

    It is what Natrella's one-sided tolerance factor of ``docs`` normal rates
    has over the normal quantile, times their standard deviation: 2.0 of them
    at 15 rates, 0.24 at 400, none in the end.
    """
    z, g = NormalDist().inv_cdf(q), NormalDist().inv_cdf(CONFIDENCE)
    a, b = 1 - g * g / (2 * (F.col("docs") - 1)), z * z - g * g / F.col("docs")
    return F.col("step") + ((z + F.sqrt(F.greatest(z * z - a * b, F.lit(0.0)))) / a - z) * F.col("sd")


def _quantile(steps: DataFrame, by: list[str], q: float) -> DataFrame:
    """The smallest step at or below which a share ``q`` of the documents lies, and ``_limit`` from three documents on."""
    upto = Window.partitionBy(*by).orderBy("step")
    whole = Window.partitionBy(*by)
    total = lambda x: F.sum(x.cast("double")).over(whole)
    n, step = F.col("n"), F.col("step").cast("double")
    x = steps.select(*by, "step", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("docs"),
                     (total(n * step) / total(n)).alias("mean"), total(n * step * step).alias("squares"))
    x = x.filter(F.col("upto") >= q * F.col("docs")).groupBy(*by, "docs", "mean", "squares").agg(F.min("step").alias("step"))
    x = x.withColumn("sd", F.sqrt(F.greatest(F.try_divide(F.col("squares") - F.col("docs") * F.col("mean") * F.col("mean"), F.col("docs") - 1), F.lit(0.0))))
    return x.select(*by, "step", "docs", F.when(F.col("docs") >= 3, _limit(q)).alias("limit"))


def keep_good(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, doc_id: str = "doc_id",
              text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, whole and unchanged, that ``classified`` keeps."""
    bad = classified(docs, trusted, quantile, doc_id, text, lang).filter("NOT kept")
    bad_id, bad_mark = unused(docs, "bad_id", "bad_mark")
    bad = stored(bad.select(F.col("doc_id").alias(bad_id), F.col("mark").alias(bad_mark)).distinct(), "rejected")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(lang), F.col(text)) == F.col(bad_mark))
    return docs.join(small(bad, IDS), same, "left_anti")

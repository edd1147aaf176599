"""What several operators of this subpackage share."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.session import fresh_path

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A null id sorts after every other one.
NO_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the batches that Python gets while a table is made. Whole texts are rows: the usual 10,000 hold too much.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


#: Files of shuffles go as soon as the table that they led to is written.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def small_batches(spark: SparkSession, **more: str):
    """BATCHES and ``more`` hold within, the session's own settings after."""
    held = BATCHES | more
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, tidy: bool = False, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it and don't repeat what made it."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession, **TIDY if tidy else {}):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a ``stored`` table that nothing still to be computed reads."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(df: DataFrame, amount: Column, per_part: int) -> int:
    """How many parts of about ``per_part`` hold the sum of ``amount``."""
    total = df.agg(F.sum(amount).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / per_part))


def text_parts(docs: DataFrame, text: str = "text", per_part: int = 12_000_000) -> int:
    return parts(docs, F.coalesce(F.octet_length(text), F.lit(0)), per_part)


def block_of(doc_id: Column, n: int) -> Column:
    """The block of a document; neighbours in the order of ids mostly share one. A null id has a block too."""
    run = F.shiftright(F.coalesce(doc_id, F.lit(-1).cast("long")), 6)
    return F.pmod(F.xxhash64(run), F.lit(n)).cast("int")


def small(table: DataFrame, rows: int) -> DataFrame:
    """A stored table, to be broadcast if it has at most ``rows`` rows; else a join with it shuffles."""
    return F.broadcast(table) if table.count() <= rows else table


def blocked(docs: DataFrame, per_block: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with a column "block" and the number of blocks, each of about ``per_block`` bytes of text.

    A quarter of a block is a run of neighbouring ids, so that a task that
    reads a file in their order meets few blocks. Rows without an id are dealt
    out by their text.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, math.ceil((size["bytes"] or 0) / per_block))
    shift = max(0, int(math.log2(max(1, size["rows"] / (4 * n)))))
    run = F.coalesce(F.shiftright(F.col(doc_id), shift), F.xxhash64(text))
    return docs.withColumn("block", F.pmod(F.xxhash64(run), F.lit(n)).cast("int")), n


def pack(docs: DataFrame) -> DataFrame:
    """The rows of each block and batch as one compressed Arrow stream: text takes a third of the room in a shuffle."""
    def run(batches):
        for batch in batches:
            for part in pieces_of([batch], 1 << 23):
                block = np.asarray(part.column(part.schema.get_field_index("block")))
                for b in np.unique(block):
                    own = part.take(pa.array(np.flatnonzero(block == b)))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(own)
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                     names=["block", "body"])

    return docs.mapInArrow(run, "block int, body binary")


def unpacked(bodies):
    """The batches of a column of streams that ``pack`` made, one after the other."""
    for body in bodies:
        with pa.ipc.open_stream(body.as_buffer()) as stream:
            yield from stream


# ------------------------------------------------------------------ texts in tasks


def pieces_of(batches, most: int = 1 << 20):
    """Record batches cut so that each holds about ``most`` bytes of its column "text", or one text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        length = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        end = np.cumsum(length)
        row = 0
        while row < batch.num_rows:
            before = end[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(end, before + most, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column in one array, where each text starts and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, and ASCII punctuation as white space.
_BARE = _LOWER.copy()
_BARE[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32
FOLDS = {"": None, "lower": _LOWER, "bare": _BARE}
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[_IS_SPACE] = 0
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, _powers(base, 1 << 16)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.values):
            self.values = _powers(self.base, max(n, 2 * len(self.values)))
        return self.values[:n]


_UP, _DOWN = _Powers(_STEP), _Powers(_BACK)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64 given."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: 64-bit hashes, places in the bytes, and where each text's words start."""

    def __init__(self, column, fold: str = "", most: int = 1 << 20) -> None:
        self.data, self.offsets = text_bytes(column)
        found, text, n = [], 0, len(self.offsets) - 1
        while text < n:  # a few MB at a time: what is held for each byte is many times the text
            stop = max(text + 1, int(np.searchsorted(self.offsets, self.offsets[text] + most, "right")) - 1)
            found.append(self._scan(self.offsets[text:stop + 1], FOLDS[fold]))
            text = stop
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(none, *found))
        self.first = np.searchsorted(self.start, self.offsets)

    def _scan(self, offsets: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base, data = offsets[0], self.data[offsets[0]:offsets[-1]]
        data = data if fold is None else fold[data]
        word = ~_IS_SPACE[data]
        some = np.flatnonzero(np.diff(offsets))
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads, tails = offsets[some] - base, offsets[some + 1] - base - 1
        first[heads], last[tails] = word[heads], word[tails]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            return start, end, np.zeros(0, np.uint64)
        total = np.add.reduceat(_LETTER[data] * _UP(len(data)), start)
        return start + base, end + base, mixed(total * _DOWN(len(data))[start] + (end - start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """How many words a text has from each of its words on."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def runs(self, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all runs of ``k`` consecutive words of one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.room()[:n] >= k)
        factor = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x9FB21C651E98DF25) % (1 << 64) | 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * factor + self.hash[i:i + n]
        return at, mixed(total[at] + np.uint64(seed))


def loaded(table: pa.Table, column: str, kind) -> np.ndarray:
    """All that was packed in a column."""
    found = [np.frombuffer(x.as_buffer(), kind) for x in table.column(column)]
    return np.concatenate(found) if found else np.zeros(0, kind)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()

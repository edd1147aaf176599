"""Line deduplication: a suffix array over line ids, by prefix doubling.

Each document is a sequence of lines. Only lines that come more than once have
an id; all others end a run. Suffixes are ranked by their first line, then by
their first two, four and so on lines: the rank by 2n lines is the rank of the
pair (rank by n lines, rank by n lines of the suffix n lines later). Ranks are
places in a distributed sort. Suffixes of one rank stand next to each other in
the suffix array and share at least that many lines: they are an interval of
longest common prefixes. Its earliest suffix stays, the others are later
copies. Doubling stops at the length from which a run counts, as a deeper order
does not change which lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import NO_ID, stored, unused
from creativeaudit.session import fresh_path

#: Lines from which a repeated run counts.
MIN_LINES = 2


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def line_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, pos, at, h1, h2): the lines that aren't blank, numbered within their text, with 128-bit hashes.

    ``at`` counts blank lines too. ``mark`` tells texts of a repeated id apart;
    rows that are the same in both are one document.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), _mark(F.col(text)).alias("mark"),
                       F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(
                           i.alias("at"), F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit("line")).alias("h2"),
                           F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("full"))), lambda x: x["full"]).alias("lines"))
    return rows.select("doc", "mark", F.posexplode("lines").alias("pos", "line")).select(
        "doc", "mark", "pos", "line.at", "line.h1", "line.h2").distinct()


def _dense(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with a rank: the place of each row in the order of ``keys``, over all partitions.

    A range-partitioned, sorted table has a file for each range: the place is
    the row's place in its file plus the rows of the files before.
    """
    spark = groups.sparkSession
    path = fresh_path(spark, "ranks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A file for each range, whatever the session says about rows of a file.
    groups.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(groups.schema).parquet(path).select(
        "*", F.split(F.col("_metadata.file_name"), "-")[1].cast("int").alias("file"), F.col("_metadata.row_index").alias("nth"))
    # One row per file of the table just written.
    before = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(
        "file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").withColumn("rank", F.col("before") + F.col("nth")).drop("file", "nth", "before")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys come more than once, with their rank. Counts combine before the shuffle."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    return rows.join(_dense(often, keys), keys).drop(*keys)


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """(doc, mark, pos, at, rank): the suffixes that share their first ``depth`` lines with another one.

    Sorted by rank, doc and pos they are the suffix array to that depth; equal
    ranks are its intervals of common prefixes of ``depth`` lines or more.
    """
    ranks = stored(_ranked(lines, ["h1", "h2"]), "suffixes-1")
    n = 1
    while n < depth:
        step = min(n, depth - n)  # the last step overlaps if the depth is no power of two
        own = Window.partitionBy("doc", "mark").orderBy("pos").rangeBetween(step, step)
        pairs = ranks.withColumn("next", F.first("rank").over(own)).filter("next IS NOT NULL")
        pairs = pairs.select("doc", "mark", "pos", "at", F.col("rank").alias("r1"), F.col("next").alias("r2"))
        n += step
        ranks = stored(_ranked(pairs, ["r1", "r2"]), f"suffixes-{n}")
    return ranks


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, at): every line covered by a run of ``min_lines`` lines that also starts earlier."""
    lines = stored(line_ids(docs, doc_id, text), "lines")
    ranks = suffix_ranks(lines, min_lines)
    # A table of its own, so that the join can split an interval that holds very many suffixes.
    first = stored(ranks.groupBy("rank").agg(F.min(F.struct("doc", "pos")).alias("first")), "intervals")
    late = ranks.join(first, "rank").filter(F.struct("doc", "pos") > F.col("first")).select("doc", "mark", "pos")
    covered = late.select("doc", "mark", F.explode(F.sequence("pos", F.col("pos") + (min_lines - 1))).alias("pos")).distinct()
    return covered.join(lines.select("doc", "mark", "pos", "at"), ["doc", "mark", "pos"]).select("doc", "mark", "pos", "at")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal runs that go: (doc_id, first_line, n_lines), lines counted from 0 without blank ones."""
    gone = later_copies(docs, min_lines, doc_id, text)
    own = Window.partitionBy("doc", "mark").orderBy("pos")
    runs = gone.withColumn("run", F.col("pos") - F.row_number().over(own)).groupBy("doc", "mark", "run").agg(
        F.min("pos").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    return runs.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "first_line", "n_lines")


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of their texts, and n_lines_removed.

    A line goes when it lies in a run of ``min_lines`` or more lines of its
    document that another document with a smaller id, or the same document
    further up, also has. Lines end at \\n and are compared as they are; blank
    ones are skipped over, neither counted nor removed. Runs are judged on the
    given texts.

    A null text stays null. A null id comes after all others. Rows with one id
    are one place in the order: runs at the same place of two of them don't make
    each other late. Texts of which no line goes stay as they are. No rows give
    no rows; other columns are kept, a former n_lines_removed is replaced.
    """
    gone = later_copies(docs, min_lines, doc_id, text).groupBy("doc", "mark").agg(F.collect_set("at").alias("gone"))
    doc, mark, at, whole = unused(docs, "doc", "mark", "gone", "whole")
    gone = gone.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("gone").alias(at))
    keyed = docs.withColumns({doc: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), mark: _mark(F.col(text))})
    # A column of its own: inside the function below the text would be split again for every line.
    cut = keyed.join(gone, [doc, mark], "left").withColumn(whole, F.explode(F.array(F.when(F.col(at).isNotNull(), F.split(text, "\n")))))
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), at)  # by a hash set: work in proportion to the lines
    kept = F.array_join(F.transform(left, lambda i: F.get(whole, i)), "\n")
    return cut.withColumns({
        text: F.when(F.col(at).isNull(), F.col(text)).otherwise(kept),
        "n_lines_removed": F.coalesce(F.size(at), F.lit(0)).cast("long")}).drop(doc, mark, at, whole)

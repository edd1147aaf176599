"""Near-duplicates: universal hash minima, banding, verification, connected components.

Documents with one set of shingles are one class. Classes that agree in a band
of minima meet in a bucket. Comparing all members of a bucket would grow with
the square of its size, so each is compared with one pivot first, the member
that meets most others; a link joins two components at once. What then still
stands in another component than most of its bucket is compared with all of
the bucket, in chunks; that is exact, and little is left by then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.llm.common import Words, mixed, packed, pieces_of, small, stored, unused

#: 40 bands of 6 minima: two sets of similarity 0.85 share no band with probability 6e-9, of 0.8 with 6e-6.
BANDS, ROWS = 40, 6
#: Pairs whose minima agree in so many standard deviations less than the asked share aren't compared as sets.
DEVIATIONS = 4.5
#: Classes of a bucket that one task compares with as many others.
CHUNK = 2048
#: Ids that are broadcast at most, 8 bytes each.
IDS = 1_000_000

_R = np.random.Generator(np.random.PCG64(7919))
_A = _R.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's set begins and the last ends, hashes of the sets in their order).

    With fewer than ``k`` words the whole sequence is one shingle; without words there is none.
    """
    at, h = words.runs(k, seed=11)
    owner = np.searchsorted(words.first, at, "right") - 1
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            whole[has] = mixed(whole[has] * np.uint64(0x9E3779B97F4A7C15) + words.hash[words.first[short[has]] + i])
        owner, h = np.concatenate((owner, short)), np.concatenate((h, mixed(whole + n[short].astype(np.uint64))))
    by = np.lexsort((h, owner))
    owner, h = owner[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return np.searchsorted(owner, np.arange(len(n) + 1)), h


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest of (a x + b) mod 2^64, upper half, for each of the hash functions."""
    out = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(values), 4096):
        part = values[i:i + 4096]
        for j in range(0, len(_A), 16):
            x = _A[j:j + 16, None] * part
            x += _B[j:j + 16, None]
            out[j:j + 16] = np.minimum(out[j:j + 16], (x.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    total = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        total = mixed(total + signature[i::ROWS].astype(np.uint64) + np.uint64(i + 1))
    return mixed(total + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits of each set."""
    one = [int(np.bitwise_xor.reduce(mixed(s * np.uint64(0xA24BAED4963EE407) + np.uint64(5)), initial=0)) for s in sets]
    two = [int(np.add.reduce(mixed(s + np.uint64(0x9FB21C651E98DF25)), initial=np.uint64(0))) for s in sets]
    return [x.to_bytes(8, "big") + y.to_bytes(8, "big") for x, y in zip(one, two)]


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """Size and 128-bit digest of each document's set, its minima, and a byte of each of them."""
    def run(batches):
        for batch in batches:
            row = 0
            for piece in pieces_of([batch]):
                ids = batch.column(0).slice(row, piece.num_rows)
                row += piece.num_rows
                at, h = shingles(Words(piece.column(1), "lower"), k)
                sets = [h[a:b] for a, b in zip(at[:-1], at[1:])]
                signs = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.diff(at), pa.int64()),
                    pa.array(_digests(sets), pa.binary()),
                    pa.array([None if s is None else packed((s & np.uint32(255)).astype(np.uint8)) for s in signs], pa.binary()),
                    pa.array([None if s is None else band_keys(s).tolist() for s in signs], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "sign", "keys"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, digest binary, sign binary, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            row = 0
            for piece in pieces_of([batch]):
                ids = batch.column(0).slice(row, piece.num_rows)
                row += piece.num_rows
                at, h = shingles(Words(piece.column(1), "lower"), k)
                sets = [h[a:b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([ids, pa.array(_digests(sets), pa.binary()), pa.array([packed(s) for s in sets], pa.binary())],
                                                 names=["id", "digest", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, digest binary, members binary")


def _least_agreement(percent: int) -> float:
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / (BANDS * ROWS)) ** 0.5


def _likely(percent: int):
    """Of candidate pairs, those whose sizes allow a link and whose minima don't speak against it."""
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            good = _agree(a, b) >= _least_agreement(percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the last bytes of minima, of which one in 256 agrees by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int(np.count_nonzero(t[at] == s))
                good[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    one = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
    two = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
    met = pairs.join(one, "b").join(two, "a").select("a", "b", "left", "right")
    return met.mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b): the smallest id that can be reached.

    Alternates large-star (each id's larger neighbours move to its smallest)
    and small-star (its smaller ones do), which shortens paths by half or more
    in a round, until no link changes. Neighbours are never gathered: a minimum
    per id, which combines before the shuffle, meets the links in a join.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, as are the minima below: the join can then split an id with very many links.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u")
        small = moved.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    flat = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("id"), "component").distinct())


def _with_component(buckets: DataFrame, components: DataFrame) -> DataFrame:
    c = components.select(F.col("id").alias("class"), "component")
    return buckets.join(c, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _chunks(strangers: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a stranger and a member of its bucket in another component that may be linked."""
    def run(left, right):
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            x, y = ({c: np.asarray(t.column(c)) for c in ("band", "class", "component", "main", "n")} for t in (left, right))
            s, t = (np.frombuffer(b"".join(z.column("sign").to_pylist()), np.uint8).reshape(z.num_rows, -1) for z in (left, right))
            k, m = (np.asarray(pa.compute.list_flatten(z.column("keys"))).reshape(z.num_rows, BANDS) for z in (left, right))
            for i in range(len(s)):
                other = np.flatnonzero((y["component"] != x["component"][i])
                                       & (100 * np.minimum(y["n"], x["n"][i]) >= percent * np.maximum(y["n"], x["n"][i])))
                # Two strangers meet twice, and most pairs in several bands: each pair counts in its first one, once.
                other = other[(y["component"][other] == y["main"][other]) | (y["class"][other] > x["class"][i])]
                other = other[_agree(t[other], s[i]) >= _least_agreement(percent)]
                # Keys make the buckets, so they name the band: bytes of minima may agree where the minima don't.
                other = other[np.argmax(m[other] == k[i], axis=1) == x["band"][i]]
                out_a += [np.full(len(other), x["class"][i])]
                out_b += [y["class"][other]]
        a, b = (np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    return strangers.groupBy("key", "i", "j").cogroup(members.groupBy("key", "i", "j")).applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose sets of ``k``-word shingles are similar by ``percent`` or more.

    Words are [^\\x20\\x09-\\x0D]+ after A-Z become a-z. A link needs
    100 * intersection >= percent * union, confirmed on whole sets.

    Null and empty texts have no shingles and no links. Documents of fewer than
    ``k`` words have one shingle, all of them. A null id is never linked: its
    component is null and it is kept. Rows with one id are one document, linked
    by what any of them holds; n_shingles is each row's own. No rows give no
    rows; further columns are ignored.
    Columns: doc_id, n_shingles, component_id, kept.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    profiles = stored(_profiles(base, k), "profiles")
    full = profiles.filter("n > 0 AND doc_id IS NOT NULL")
    # A class of equal sets is known by its smallest id; a digest has one row for each task in the shuffle.
    least = full.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies"))
    least = stored(least.filter("copies > 1").select("digest", "class"), "copies")
    named = full.select("doc_id", "digest").join(least, "digest", "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class"), "digest")
    named = stored(named, "classes")
    first = named.filter("doc_id = class").select(F.col("class").alias("id"), "digest").distinct()
    # An id that stands for several sets lends its name to one of them; the others are known by a hash until the end.
    several = first.groupBy("id").agg(F.min("digest").alias("lead"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    others = stored(first.join(several, "id").filter("digest <> lead").select("id", "digest", F.xxhash64("id", "digest").alias("class")), "others")
    reps = full.withColumnRenamed("doc_id", "id").join(first, ["id", "digest"]).select("id", "digest", "n", "sign", "keys").dropDuplicates(["id", "digest"])
    reps = stored(reps.join(small(others, IDS), ["id", "digest"], "left").withColumn("class", F.coalesce("class", "id")), "representatives")
    met = reps.select("class", F.posexplode("keys").alias("band", "key"))
    often = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(met.join(often, "key"), "buckets")
    meta = reps.select("class", "n", "sign", "keys")

    # The member that meets most others is in the middle of its bucket.
    score = buckets.groupBy("class").agg(F.sum("size").alias("score"))
    pivots = buckets.join(score, "class").groupBy("key").agg(
        F.max(F.struct("score", F.bitwise_not("class").alias("back"))).alias("best")).select("key", F.bitwise_not("best.back").alias("pivot"))
    pairs = buckets.join(pivots, "key").filter("class <> pivot").select(
        F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    touched = stored(reps.join(buckets.select("class").distinct(), "class", "left_semi").select("id", "digest", "class"), "touched")
    sets = _sets(_only(base, touched.select("id").distinct()), k).dropDuplicates(["id", "digest"])
    sets = stored(sets.join(touched, ["id", "digest"]).select(F.col("class").alias("id"), "members"), "sets")

    def checked(candidates: DataFrame, name: str) -> DataFrame:
        one, two = (meta.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"s_{x}")) for x in "ab")
        x = candidates.join(one, "a").join(two, "b")
        x = x.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        x = x.select("a", "b", "s_a", "s_b").mapInArrow(_likely(percent), "a long, b long")
        return stored(_verified(x, sets, percent), name)

    links = checked(stored(pairs, "pairs"), "links-of-pivots")
    components = stored(connected_components(links), "components")

    # Buckets that still hold several components: all but the most frequent one are strangers there.
    here = stored(_with_component(buckets.filter("size > 2"), components), "members")
    by = here.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = by.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = here.join(main.select("key", F.col("m.component").alias("main")), "key").join(meta, "class")
    open_ = stored(open_, "open")
    alien = open_.filter("component <> main")
    n_of = alien.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("rows"))
    part = lambda n: F.pmod(F.xxhash64("class", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = F.ceil(F.col("size") / CHUNK).cast("int")
    columns = ("key", "i", "j", "band", "class", "component", "main", "n", "sign", "keys")
    strangers = alien.join(n_of, "key").withColumn("cols", cols).select("*", part("rows").alias("i"), every("cols").alias("j")).select(*columns).toDF(*columns)
    members = open_.join(n_of, "key").withColumn("cols", cols).select("*", part("cols").alias("j"), every("rows").alias("i")).select(*columns).toDF(*columns)
    rest = stored(_chunks(strangers, members, percent).join(pairs, ["a", "b"], "left_anti"), "rest")
    more = stored(_verified(rest, sets, percent), "links-of-strangers")

    # Rows of one id may hold different sets: the id links their classes.
    own = named.filter("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    everything = _by_id(links.unionByName(more), others).unionByName(own)
    final = connected_components(everything).select(F.col("id").alias("doc_id"), "component")
    out = profiles.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _by_id(links: DataFrame, others: DataFrame) -> DataFrame:
    """Links between classes as links between the ids that stand for them."""
    for end in "ab":
        known = small(others.select(F.col("class").alias(end), "id"), IDS)
        links = links.join(known, end, "left").withColumn(end, F.coalesce("id", end)).drop("id")
    return links.select("a", "b")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids. The ids travel if they are few enough, else both sides meet in a shuffle."""
    ids = stored(ids.select(F.col("id").alias("doc_id")), "touched-ids")
    return docs.join(small(ids, IDS), "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents whose id isn't in ``ids`` (doc_id); those without an id stay."""
    gone, = unused(docs, "gone")
    ids = stored(ids.select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(small(ids, IDS), F.col(doc_id) == F.col(gone), "left_anti")

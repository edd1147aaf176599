"""Substring deduplication with automata of repeated phrases.

Two copies of a passage of ``window`` words share a run of ``window`` words, and
in that run the same short phrase has the smallest hash: so it is enough to
count those chosen phrases, about one for every six words. Phrases that come
more than once are confirmed; for each block of documents the ones it holds are
compiled into an Aho-Corasick automaton over words, and every document of the
block is streamed through it. A window that holds no confirmed phrase occurs
once. The others are compared by a 96-bit hash of their words, first within
the block, then, one row per block and window, with all other blocks.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.llm.common import NO_ID, Words, blocked, loaded, mixed, pack, packed, pieces_of, stored, unpacked

WINDOW = 20
#: Bytes of text that a block holds on average. All documents of a block meet in one task.
BLOCK_BYTES = 4_000_000


def _sizes(window: int) -> tuple[int, int]:
    """(words of a phrase, how many neighbouring phrases one is chosen from): together a window."""
    phrase = max(1, window // 2)
    return phrase, window - phrase + 1


def chosen(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the phrases with the smallest hash of some window; of equal ones all."""
    phrase, among = _sizes(window)
    at, h = words.runs(phrase, seed=3)
    if not len(at):
        return at, h
    n = len(h) - among + 1
    if n <= 0:
        return at[:0], h[:0]
    least = _sliding_min(h, among)
    whole = words.room()[at[:n]] >= window  # all of them in one text
    pick = np.zeros(len(h), bool)
    for i in range(among):
        pick[i:i + n] |= (h[i:i + n] == least) & whole
    return at[pick], h[pick]


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minima of all runs of ``k``, by doubling."""
    out, span = h, 1
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = k - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _phrases(docs: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Chosen phrases, each once per block and flush of a task, packed by bucket of their hash."""
    def gather(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            blocks, h, n = _unique(held)
            bucket = (h >> np.uint64(40)) % np.uint64(n_buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=bucket[by[:1]] + 1))
            for part in np.split(by, cuts[1:]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[part[0]])], pa.int32()), pa.array([packed(h[part])], pa.binary()),
                    pa.array([packed(blocks[part].astype(np.int32))], pa.binary()),
                    pa.array([packed(np.minimum(n[part], 2).astype(np.uint8))], pa.binary())],
                    names=["bucket", "h", "block", "n"])

        for batch in batches:
            block = np.asarray(batch.column(0)).astype(np.int64)
            for piece, blocks in _cut(batch, block):
                words = Words(piece)
                at, h = chosen(words, window)
                if len(at):
                    owner = np.searchsorted(words.first, at, "right") - 1
                    held.append((blocks[owner], h))
                    size += len(h)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select("block", "text").mapInArrow(gather, "bucket int, h binary, block binary, n binary")


def _cut(batch: pa.RecordBatch, *arrays: np.ndarray):
    """(text column, the arrays' part) of a batch in pieces of a few MB."""
    row = 0
    for piece in pieces_of([batch]):
        yield (piece.column(piece.schema.get_field_index("text")), *[a[row:row + piece.num_rows] for a in arrays])
        row += piece.num_rows


def _unique(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of block and hash with their counts, in their order."""
    blocks, h = (np.concatenate(x) for x in zip(*held))
    by = np.lexsort((h, blocks))
    blocks, h = blocks[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (blocks[1:] != blocks[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return blocks[at], h[at], np.diff(at, append=len(h))


def _confirmed(rows):
    """Of one bucket, the phrases that come at least twice, packed for each block that holds them."""
    h, block, n = loaded(rows, "h", np.uint64), loaded(rows, "block", np.int32), loaded(rows, "n", np.uint8)
    by = np.argsort(h, kind="stable")
    h, block, n = h[by], block[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(n.astype(np.int64), first) if len(first) else first
    often = np.repeat(total >= 2, np.diff(first, append=len(h)))
    h, block = h[often], block[often]
    by = np.lexsort((h, block))
    h, block = h[by], block[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    out = [(int(b[0]), packed(np.unique(x))) for x, b in zip(np.split(h, cuts), np.split(block, cuts)) if len(x)]
    blocks, keys = zip(*out) if out else ((), ())
    return pa.table([pa.array(blocks, pa.int32()), pa.array(keys, pa.binary())], names=["block", "h"])


def _found(words: Words, keys: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that hold a confirmed phrase, as an automaton over words finds them."""
    phrase, among = _sizes(window)
    at, h = words.runs(phrase, seed=3)
    if not len(keys) or not len(at):
        return np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    seen = keys[near] == h
    if not seen.any():
        return np.zeros(0, np.int64)
    _, one = np.unique(h[seen], return_index=True)
    starts = at[seen][one]
    # Nodes of the automaton search their children one by one. So a word is two letters of a small alphabet each, the
    # second from a range of its own; words of no phrase share a letter that leads nowhere, as does the end of a text.
    known = np.unique(words.hash[(starts[:, None] + np.arange(phrase)).ravel()])
    near = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    inside = known[near] == words.hash
    wide = int(np.ceil(np.sqrt(len(known))))
    letters = np.stack([near // wide, near % wide + wide], axis=1)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for start in starts.tolist():
        automaton.add_word(tuple(letters[start:start + phrase].ravel().tolist()), True)
    automaton.make_automaton()
    # Each word in its text, then one letter for its end.
    nowhere = 2 * wide
    letters[~inside] = nowhere
    last = np.zeros(len(words), bool)
    last[words.first[1:][words.counts() > 0] - 1] = True
    used = np.stack([np.ones(len(words), bool), inside, last], axis=1)
    stream = np.concatenate([letters, np.full((len(words), 1), nowhere)], axis=1)[used]
    word_of = np.repeat(np.arange(len(words)), used.sum(axis=1))
    ends = np.fromiter((end for end, _ in automaton.iter(tuple(stream.tolist()))), np.int64)
    hit = np.zeros(len(words) + 1, np.int64)
    hit[word_of[ends] - (phrase - 1)] = 1
    total = np.concatenate(([0], np.cumsum(hit)))
    start, _ = words.runs(window, seed=5)
    return start[total[np.minimum(start + among, len(words))] > total[start]]


def _windows(words: Words, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each of the windows."""
    out = []
    for factor in (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)):
        total = np.zeros(len(start), np.uint64)
        for i in range(window):
            total = total * factor + words.hash[start + i]
        out.append(mixed(total))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _texts(words: Words):
    """The bytes of each text. Their split() cuts at the same white space."""
    for a, b in zip(words.offsets[:-1], words.offsets[1:]):
        yield words.data[a:b].tobytes()


OUT = "kind int, block int, seq int, doc_id long, n_words long, kept_sha256 string, text string, starts binary, h1 binary, h2 binary, ids binary"


def _locate(window: int, n_buckets: int):
    """Streams a block: a row per document, and the first of each window that may also be elsewhere, by bucket."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()),
                        ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()),
                        ("starts", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.binary())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = docs.column("block")[0].as_py()
        docs = pa.Table.from_batches(unpacked(docs.column("body"))).sort_by("doc_id")
        text = docs.column("text").combine_chunks()
        keys = np.unique(loaded(found, "h", np.uint64))
        words = Words(text)
        starts = _found(words, keys, window)
        h1, h2 = _windows(words, starts, window)
        ids = np.asarray(pa.compute.fill_null(docs.column("doc_id").combine_chunks(), NO_ID), np.int64)
        owner = np.searchsorted(words.first, starts, "right") - 1
        place = starts - words.first[owner]
        by = np.lexsort((place, ids[owner], h2, h1))
        a, b = h1[by], h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        # Within the block: whatever starts later than the first of its kind is a later copy.
        least = by[head][np.cumsum(new) - 1]
        later = (ids[owner[by]] > ids[owner[least]]) | (place[by] > place[least])
        first = by[~later]  # more than one for an id that repeats
        local: dict[int, list[int]] = {}
        for i in by[later]:
            local.setdefault(int(owner[i]), []).append(int(place[i]))
        candidates = set(np.unique(owner).tolist())
        counts = words.counts()
        plain = [None if t in candidates else _sha(x.split()) for t, x in enumerate(_texts(words))]
        texts = [x.as_py() if t in candidates else None for t, x in enumerate(text)]
        marks = [packed(np.array(sorted(local.get(t, [])), np.int32)) if t in candidates else None for t in range(len(text))]
        n = len(text)
        none = pa.nulls(n, pa.binary())
        rows = [pa.table([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                          docs.column("doc_id").combine_chunks(), pa.array(counts.astype(np.int64)), pa.array(plain, pa.string()),
                          pa.array(texts, pa.string()), pa.array(marks, pa.binary()), none, none, none], schema=schema)]
        # To the other blocks go the firsts alone, each to the bucket of its hash.
        one = np.sort(first)
        bucket = _bucket(h1[one], n_buckets)
        order = np.argsort(bucket, kind="stable")
        one, bucket = one[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part, its in zip(np.split(one, cuts), np.split(bucket, cuts)):
            if len(part):
                rows.append(pa.table([
                    pa.array([1], pa.int32()), pa.array([block], pa.int32()), pa.array([int(its[0])], pa.int32()), pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                    pa.array([packed(np.stack([owner[part], place[part]]).astype(np.int32))], pa.binary()),
                    pa.array([packed(h1[part])], pa.binary()), pa.array([packed(h2[part])], pa.binary()),
                    pa.array([packed(ids[owner[part]])], pa.binary())], schema=schema))
        return pa.concat_tables(rows)

    return run


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _later(rows):
    """Of one bucket, the windows whose words also start earlier in another block, packed by block."""
    h1, h2, ids = loaded(rows, "h1", np.uint64), loaded(rows, "h2", np.uint32), loaded(rows, "ids", np.int64)
    pairs = [np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in rows.column("starts")]
    seq, place = (np.concatenate(x) for x in zip(*pairs))
    block = np.repeat(np.asarray(rows.column("block")), [p.shape[1] for p in pairs])
    by = np.lexsort((place, ids, h2, h1))
    a, b = h1[by], h2[by]
    new = np.ones(len(by), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = by[(ids[by] > ids[least]) | (place[by] > place[least])]
    late = late[np.lexsort((place[late], seq[late], block[late]))]
    cuts = np.flatnonzero(np.diff(block[late])) + 1
    out = [(int(block[p[0]]), packed(np.stack([seq[p], place[p]]).astype(np.int32))) for p in np.split(late, cuts) if len(p)]
    blocks, marks = zip(*out) if out else ((), ())
    return pa.table([pa.array(blocks, pa.int32()), pa.array(marks, pa.binary())], names=["block", "marks"])


def _removed(window: int, with_text: bool):
    """Takes the covered words out of the documents of a block that have any candidate."""
    def run(docs: pa.Table, late: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in late.column("marks")]
        seq, place = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int32),) * 2
        by = np.argsort(seq, kind="stable")
        seq, place = seq[by], place[by]
        text = docs.column("text").combine_chunks()
        words = Words(text)
        gone = np.zeros(len(words) + 1, np.int64)
        for t, (own, marks) in enumerate(zip(docs.column("seq").to_pylist(), docs.column("starts"))):
            i, j = np.searchsorted(seq, [own, own + 1])
            starts = np.concatenate((place[i:j], np.frombuffer(marks.as_buffer(), np.int32))).astype(np.int64) + words.first[t]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)  # a window ends within its document
        keep = np.cumsum(gone)[:-1] == 0
        count = np.concatenate(([0], np.cumsum(~keep)))
        n_removed = count[words.first[1:]] - count[words.first[:-1]]
        kept = [list(compress(x.split(), keep[a:b])) for x, a, b in zip(_texts(words), words.first[:-1], words.first[1:])]
        sha = [_sha(x) for x in kept]
        out = {"doc_id": docs.column("doc_id").combine_chunks(), "n_words": docs.column("n_words").combine_chunks(),
               "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            out["text"] = pa.array([b" ".join(x).decode() for x in kept], pa.string())
        return pa.table(out)

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                      with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes each word covered by a run of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same document and an earlier word; runs
    are judged on the given texts. Words are [^\\x20\\x09-\\x0D]+, unchanged.

    A null text has no words. A null id is the last of all. Rows with one id
    are one place in the order: words at the same place of two such rows do not
    make each other late. Texts shorter than a window lose nothing. No rows
    give no rows; further columns are ignored. Columns: doc_id, n_words,
    n_removed, kept_sha256 (kept words joined by a space), and with
    ``with_text`` text: the kept words, null where nothing was taken out.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base, n_blocks = blocked(base, block_bytes)
    phrases = _phrases(base, window, n_blocks)
    keys = stored(phrases.groupBy("bucket").applyInArrow(_confirmed, "block int, h binary"), "phrases")
    located = stored(pack(base).groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(_locate(window, max(1, n_blocks // 4)), OUT), "located")
    late = located.filter("kind = 1").groupBy("seq").applyInArrow(_later, "block int, marks binary")
    open_docs = located.filter("kind = 0 AND kept_sha256 IS NULL").select("block", "seq", "doc_id", "n_words", "text", "starts")
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    judged = open_docs.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(_removed(window, with_text), columns)
    untouched = located.filter("kind = 0 AND kept_sha256 IS NOT NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        *([F.lit(None).cast("string").alias("text")] if with_text else []))
    return untouched.unionByName(judged)

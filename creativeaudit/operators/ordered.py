"""Rules whose answer for a row depends on the answers for earlier rows.

A sliding limit counts only admitted hits, a frame is compared with kept frames
only: neither is a window aggregate. The rows of a key are therefore read in
order by a task that keeps nothing but the rule's own small state (at most
``limit`` instants, or the kept frames).

A key with very many rows does not go to one task. Where a pause makes a rule
forget all that came before, the key falls into pieces that are keys of their
own. What is still too long is cut into
blocks of about ``max_rows`` rows. First only the state at the end of each
block (blocks may end within an instant) is worked out, all blocks at once, as if nothing came before them; then
each block whose true starting state differs from the assumed one is folded
again, until nothing differs. Blocks after a quiet period are right the first
time. The first block is right from the start and each round settles at least
the next one, so the loop ends with the exact sequential states. With them, one
more parallel pass gives the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creativeaudit.operators.sizing import small_side
from creativeaudit.session import checkpoint, fresh_path

MAX_ROWS = 10_000_000

# step(state, columns of consecutive rows of one key) -> (new columns, state)
Step = Callable[[object, dict[str, np.ndarray]], tuple[dict[str, np.ndarray], object]]


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of each run of equal keys in a batch of sorted rows."""
    values = [pdf[k].to_numpy() for k in keys]
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    bounds = [*np.flatnonzero(change), len(pdf)]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        yield tuple(v[lo] for v in values), lo, hi


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in pdf.columns if c != "_carry"}


def _rows(keys: Sequence[str], outputs: Sequence[str], names: Sequence[str], step: Step, start):
    """Every row with the rule's answers. A head row brings a block's starting state and is dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf, cols = pdf.reset_index(drop=True), _columns(pdf)
            parts: dict[str, list] = {name: [] for name in outputs}
            for here, lo, hi in _runs(pdf, keys):
                if here != key:
                    key, state = here, start(None)
                if "_head" in cols and cols["_head"][lo]:
                    state = start(json.loads(pdf["_carry"].iat[lo]))
                    for name in outputs:
                        parts[name].append(np.array([None], dtype=object))
                    lo += 1
                if lo < hi:
                    made, state = step(state, {c: v[lo:hi] for c, v in cols.items()})
                    for name in outputs:
                        parts[name].append(made[name])
            for name in outputs:
                pdf[name] = pd.Series(np.concatenate(parts[name]), dtype=object)
            yield (pdf[~pdf["_head"].astype(bool)] if "_head" in cols else pdf)[list(names)]

    return run


def _ends(keys: Sequence[str], step: Step, start, finish):
    """One row per block: its first instant and the state after its last row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, first = None, None, None

        def row() -> dict:
            return {**dict(zip(keys, key)), "_first": first, "_state": finish(state)}

        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf, cols, done = pdf.reset_index(drop=True), _columns(pdf), []
            for here, lo, hi in _runs(pdf, keys):
                if here != key:
                    if key is not None:
                        done.append(row())
                    key, state, first = here, start(None), None
                if cols["_head"][lo]:
                    state = start(json.loads(pdf["_carry"].iat[lo]))
                    lo += 1
                if lo < hi:
                    first = int(cols["_at"][lo]) if first is None else first
                    _, state = step(state, {c: v[lo:hi] for c, v in cols.items()})
            if done:
                yield pd.DataFrame(done)
        if key is not None:
            yield pd.DataFrame([row()])

    return run


def fold(df: DataFrame, keys: Sequence[str], at: Column, order: Sequence[str],
         outputs: dict[str, T.DataType], step: Step, start, finish, state_type: T.DataType, *,
         still_matters: Callable[[Column, Column], Column], max_rows: int = MAX_ROWS,
         forgets_after: int | None = None) -> DataFrame:
    """Run ``step`` over each key's rows in order of ``at`` (an integer) and ``order``.

    ``forgets_after``: a longer pause than this leaves no state.

    ``still_matters(state, first)`` reduces a carried state to what can affect
    a block starting at instant ``first``. Keys must not be NULL. Finding the
    heavy keys counts rows per key once when the plan is built.
    """
    keys = list(keys)
    rows = df.withColumn("_at", at.cast("bigint"))
    group = [*keys, "_block"]
    made = [T.StructField(n, t) for n, t in outputs.items()]

    def whole(part: DataFrame) -> DataFrame:
        """Every key in one go."""
        schema = T.StructType(rows.schema.fields + made)
        ordered = part.select(*rows.columns).repartition(*keys).sortWithinPartitions(*keys, "_at", *order)
        return ordered.mapInPandas(_rows(keys, list(outputs), schema.names, step, start), schema).drop("_at")

    heavy = rows.groupBy(*keys).count().filter(F.col("count") > max_rows).select(*keys)
    if heavy.isEmpty():
        return whole(rows)

    # At most one key in max_rows rows is heavy, so this list is short; small_side checks it.
    heavy = small_side(checkpoint(heavy))
    light = whole(rows.join(heavy, keys, "left_anti"))
    if forgets_after:
        pieces = _pieces(rows.join(heavy, keys, "left_semi"), keys, forgets_after).drop("_at")
        cut = fold(pieces, [*keys, "_piece"], at, order, outputs, step, start, finish, state_type,
                   still_matters=still_matters, max_rows=max_rows)
        return light.unionByName(cut.drop("_piece"))
    spark = df.sparkSession
    table = fresh_path(spark, "blocks")
    cut = _cut(rows.join(heavy, keys, "left_semi").select(*rows.columns), keys, order, max_rows)
    cut.write.partitionBy("_block").parquet(table)
    blocks = spark.read.parquet(table).withColumn("_block", F.col("_block").cast("bigint"))
    blocks = blocks.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields], "_block")

    def headed(part: DataFrame, carries: DataFrame) -> DataFrame:
        """Blocks in order, each behind a head row with its starting state."""
        body = part.withColumn("_head", F.lit(False)).withColumn("_carry", F.lit(None).cast("string"))
        # As text: a mostly NULL array column is slow to turn into pandas.
        heads = carries.select(*group, F.to_json("_carry").alias("_carry")).withColumn("_head", F.lit(True))
        both = body.unionByName(heads, allowMissingColumns=True)
        return both.repartition(*group).sortWithinPartitions(*group, F.desc("_head"), "_at", *order)

    nothing = F.array().cast(state_type)
    key_fields = [f for f in rows.schema.fields if f.name in keys] + [T.StructField("_block", T.LongType())]
    key_fields.sort(key=lambda f: group.index(f.name))
    end_schema = T.StructType(key_fields + [T.StructField("_first", T.LongType()), T.StructField("_state", state_type)])

    def ends_of(part: DataFrame, carries: DataFrame) -> DataFrame:
        found = headed(part, carries).mapInPandas(_ends(group, step, start, finish), end_schema)
        return found.join(carries.select(*group, "_carry"), group)

    empty = blocks.select(*group).distinct().withColumn("_carry", nothing)
    ends = checkpoint(ends_of(blocks, empty))
    while True:
        before = F.lag("_state").over(Window.partitionBy(*keys).orderBy("_block"))
        true_carry = F.coalesce(still_matters(F.col("_before"), F.col("_first")), nothing)
        wrong = ends.withColumn("_before", before).withColumn("_true", true_carry).filter(
            ~F.col("_true").eqNullSafe(F.col("_carry"))).select(*group, F.col("_true").alias("_carry"))
        wrong = checkpoint(wrong)
        if wrong.isEmpty():
            break
        again = ends_of(blocks.join(wrong.select(*group), group, "left_semi"), wrong)
        ends = checkpoint(ends.join(wrong.select(*group), group, "left_anti").select(*again.columns).unionByName(again))
    schema = T.StructType(rows.schema.fields + made)
    result = headed(blocks, ends).mapInPandas(_rows(group, list(outputs), schema.names, step, start), schema)
    return light.unionByName(result.drop("_at"))


def _pieces(rows: DataFrame, keys: list[str], pause: int) -> DataFrame:
    """Rows with the number of their piece: a piece ends where a slice as long as the pause has no rows.

    Slices are counted with a map-side combine; the window sees one row per slice.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("_at") / pause))
    order = Window.partitionBy(*keys).orderBy("_slice")
    slices = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    new = F.coalesce((F.col("_slice") - F.lag("_slice").over(order) > 1).cast("bigint"), F.lit(0))
    slices = slices.withColumn("_new", new).withColumn("_piece", F.sum("_new").over(order))
    return sliced.join(checkpoint(slices.select(*keys, "_slice", "_piece")), [*keys, "_slice"]).drop("_slice")


def _cut(rows: DataFrame, keys: list[str], order: Sequence[str], max_rows: int, slices: int = 1_000_000) -> DataFrame:
    """Number the blocks: fine time slices are counted, then grouped up to ``max_rows``.

    Slices are fine so that a burst is spread over many of them. What is still
    too much is cut at quantiles of its instants, and a single instant at quantiles of the
    first column of ``order``: a rule's state may be carried on within an instant as well.
    """
    span = rows.groupBy(*keys).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    span = span.withColumn("_w", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / slices)))
    cut = rows.join(small_side(checkpoint(span.select(*keys, "_lo", "_w"))), keys).withColumn(
        "_slice", F.floor((F.col("_at") - F.col("_lo")) / F.col("_w")))
    cut = _finer(cut, [*keys, "_slice"], "_at", "_part", max_rows)
    cut = _finer(cut, [*keys, "_slice", "_part"], order[0], "_piece_of", max_rows) if order else cut.withColumn("_piece_of", F.lit(0))
    place = ["_slice", "_part", "_piece_of"]
    per = cut.groupBy(*keys, *place).count()
    upto = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_block", F.floor(F.coalesce(F.sum("count").over(upto), F.lit(0)) / max_rows))
    return (cut.join(per.select(*keys, *place, "_block"), [*keys, *place])
            .select(*rows.columns, F.col("_block").cast("bigint").alias("_block")))


def _finer(rows: DataFrame, group: list[str], column: str, name: str, max_rows: int) -> DataFrame:
    """Cuts groups of more than ``max_rows`` rows at approximate quantiles of a column; sketches combine before the shuffle.

    Columns without quantiles (text) leave their groups whole.
    """
    whole = rows.withColumn(name, F.lit(0))
    if not isinstance(rows.schema[column].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return whole
    big = checkpoint(rows.groupBy(*group).count().filter(F.col("count") > max_rows))
    most = big.agg(F.max("count")).first()[0]
    if most is None:
        return whole
    n = 2 * -(-most // max_rows)
    cuts = rows.join(small_side(big.select(*group)), group, "left_semi").groupBy(*group).agg(
        F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("_cuts"))
    cut = rows.join(small_side(checkpoint(cuts)), group, "left")
    nth = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    return cut.withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(nth)).drop("_cuts")


# ------------------------------------------------------------------ limiters


def sliding_step(limit: int, span: int):
    """The sliding limit over sorted instants; ``span`` in the unit of ``_at``."""
    def step(live: list[int], cols):
        at = cols["_at"]
        admitted = np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            now = int(at[i])
            while live and now - live[0] > span:
                live.pop(0)
            if len(live) < limit:
                admitted[i] = True
                live.append(now)
                i += 1
            else:
                # Nothing can be admitted before the oldest hit expires.
                i = int(np.searchsorted(at, live[0] + span, side="right")) if limit else len(at)
        return {"admitted": admitted}, live

    return step


def _live_after(span: int):
    return lambda state, first: F.filter(state, lambda t: t >= first - span)


def sliding_admission(hits: DataFrame, limit: int, span_s: float, identity: str = "identity",
                      order: Sequence[str] = ("id",), max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``limit`` admitted hits per identity in any ``span_s``; an age of exactly the span counts.

    ``hits``: identity, ts and the columns in ``order`` that break ties. Refused
    hits leave no trace, which a range window cannot express.
    """
    span = int(span_s * 1_000_000)
    return fold(hits, [identity], F.unix_micros("ts"), order, {"admitted": T.BooleanType()},
                sliding_step(limit, span), _as_list, list, T.ArrayType(T.LongType()),
                still_matters=_live_after(span), max_rows=max_rows, forgets_after=max(1, span))


def _lockout_step(limit: int, span: int):
    def step(failures: list[int], cols):
        at, success = cols["_at"], cols["success"]
        locked = np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            now = int(at[i])
            while failures and now - failures[0] > span:
                failures.pop(0)
            if len(failures) >= limit:
                j = int(np.searchsorted(at, failures[0] + span, side="right"))
                locked[i:j] = True
                i = j
                continue
            if success[i]:
                failures.clear()
            else:
                failures.append(now)
            i += 1
        return {"locked": locked}, failures

    return step


def login_lockout(attempts: DataFrame, limit: int, span_s: float, identity: str = "identity",
                  order: Sequence[str] = ("id",), max_rows: int = MAX_ROWS) -> DataFrame:
    """Locked once ``limit`` failures are live; success forgets them; locked attempts are not recorded.

    ``attempts``: identity, ts, success and the columns in ``order``.
    """
    span = int(span_s * 1_000_000)
    return fold(attempts, [identity], F.unix_micros("ts"), order, {"locked": T.BooleanType()},
                _lockout_step(limit, span), _as_list, list, T.ArrayType(T.LongType()),
                still_matters=_live_after(span), max_rows=max_rows, forgets_after=max(1, span))


def _as_list(carry) -> list[int]:
    return [] if carry is None else [int(t) for t in carry]


# ------------------------------------------------------------------ frames


#: Parts of a signature whose sums are compared before the signature itself.
SEGMENTS = 8


def _sums(signature: np.ndarray) -> np.ndarray:
    """Sums of up to SEGMENTS parts. Two signatures differ at least as much as the sums of their parts do."""
    n = len(signature)
    out = np.zeros(SEGMENTS)
    if n:
        parts = min(SEGMENTS, n)
        out[:parts] = np.add.reduceat(signature, np.arange(parts) * n // parts)
    return out


class _Kept:
    """The frames kept so far: instants, ids, and per signature length a growing matrix with the sums of parts of its rows."""

    def __init__(self) -> None:
        self.at: list[float] = []
        self.ids: list[int] = []
        self.signatures: list[np.ndarray] = []
        self.by_length: dict[int, list] = {}

    def add(self, at: float, frame_id: int, signature: np.ndarray) -> None:
        held = self.by_length.setdefault(len(signature), [np.empty((8, len(signature))), np.empty((8, SEGMENTS)), [], 0])
        matrix, sums, places, n = held
        if n == len(sums):
            held[0], held[1] = np.concatenate((matrix, matrix)), np.concatenate((sums, sums))
        held[0][n], held[1][n] = signature, _sums(signature)
        places.append(len(self.ids))
        held[3] = n + 1
        self.at.append(at)
        self.ids.append(frame_id)
        self.signatures.append(signature)

    def first_alike(self, signature: np.ndarray, max_mad: float) -> tuple[int, float] | None:
        """(place, difference) of the earliest kept frame within ``max_mad``."""
        if not len(signature) or len(signature) not in self.by_length:
            return None
        matrix, sums, places, n = self.by_length[len(signature)]
        own = _sums(signature)
        most = max_mad * len(signature) + 1e-9 * (1 + np.abs(signature).sum())
        near = np.arange(n)
        for parts in (1, 2, SEGMENTS):  # few columns first, the others for what they leave
            near = near[np.abs(sums[near, :parts] - own[:parts]).sum(axis=1) <= most]
        for i in range(0, len(near), 256):
            part = near[i:i + 256]
            mad = np.abs(matrix[part] - signature).sum(axis=1) / len(signature)
            hit = np.flatnonzero(mad <= max_mad)
            if len(hit):
                return places[part[hit[0]]], float(mad[hit[0]])
        return None


def _select_step(gap_s: float, max_mad: float):
    def step(state: _Kept, cols):
        keep = np.zeros(len(cols["_at"]), bool)
        same_as, mads = np.full(len(keep), None, dtype=object), np.full(len(keep), None, dtype=object)
        for i, at in enumerate(cols["timestamp_s"]):
            if state.at and at - state.at[-1] < gap_s:
                continue
            sig = np.asarray(cols["signature"][i], dtype=np.float64)
            hit = state.first_alike(sig, max_mad)
            if hit:
                same_as[i], mads[i] = state.ids[hit[0]], hit[1]
            else:
                keep[i] = True
                state.add(float(at), int(cols["frame_id"][i]), sig)
        return {"kept": keep, "same_as": same_as, "mad": mads}, state

    return step


def _open_frames(carry):
    state = _Kept()
    for r in [] if carry is None else list(carry):
        state.add(float(r["at"]), int(r["frame_id"]), np.asarray(r["signature"], dtype=np.float64))
    return state


def _close_frames(state: _Kept):
    return [{"at": a, "signature": s.tolist(), "frame_id": f} for a, s, f in zip(state.at, state.signatures, state.ids)]


def mark_frames(frames: DataFrame, gap_s: float, max_mad: float, max_rows: int = MAX_ROWS) -> DataFrame:
    """Greedy pass over each creative's frames in time order.

    Adds ``kept`` and, for frames that repeat a kept one, its id as
    ``same_as`` and the mean absolute difference as ``mad``. ``frames``: creative_id, frame_id, timestamp_s, signature.
    With at most 60 seconds and a gap of 0.35 a creative keeps at most 172 frames.
    """
    state = T.ArrayType(T.StructType([
        T.StructField("at", T.DoubleType()), T.StructField("signature", T.ArrayType(T.DoubleType())),
        T.StructField("frame_id", T.LongType())]))
    micros = F.round(F.col("timestamp_s") * 1_000_000)
    return fold(frames, ["creative_id"], micros, ["frame_id"],
                {"kept": T.BooleanType(), "same_as": T.LongType(), "mad": T.DoubleType()},
                _select_step(gap_s, max_mad), _open_frames, _close_frames, state,
                still_matters=lambda kept, first: kept, max_rows=max_rows)

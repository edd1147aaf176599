"""Applying an ordered batch of edits to catalogs.

Edits of different slugs touch each other only through the cap. As long as a
catalog stays below it, whether an edit is accepted depends on its own slug
alone: on when it was first created, and on the last change of its status
before. Those are aggregates, and the count of active tags is a running sum, so
such a log is judged in a few jobs however long it is. Only catalogs that would
go over their cap are folded in order.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creativeaudit import constants as C
from creativeaudit.functions import text as X
from creativeaudit.functions.numbering import running
from creativeaudit.operators.ordered import MAX_ROWS, fold
from creativeaudit.operators.sizing import small_side
from creativeaudit.session import checkpoint

_SLUG = re.compile(C.SLUG_PATTERN)
_ENTRY = T.StructType([T.StructField("slug", T.StringType()), T.StructField("active", T.BooleanType()),
                       T.StructField("sort_order", T.LongType())])


def _judge(op: str, slug: str, label: str, entries: dict, active: int, cap: int) -> str | None:
    entry = entries.get(slug)
    if op == "create":
        if not _SLUG.fullmatch(slug):
            return "bad slug"
        if entry is not None:
            return "slug in use" if entry[0] else "slug retired"
        if active >= cap:
            return "catalog full"
        return None if label else "label required"
    if entry is None:
        return "no such tag"
    if op == "update":
        return None if label else "label required"
    if op == "restore":
        if entry[0]:
            return "already active"
        return "catalog full" if active >= cap else None
    return None if op == "retire" else "unknown operation"


def _step(cap: int):
    def step(state, cols):
        entries, top = state
        active = sum(e[0] for e in entries.values())
        reasons = np.full(len(cols["op"]), None, dtype=object)
        orders = np.zeros(len(reasons), np.int64)
        for i, (op, slug, label) in enumerate(zip(cols["op"], cols["slug"], cols["label"])):
            if op == "load":
                entries[slug] = [bool(cols["was_active"][i]), int(cols["sort_order"][i])]
                active += entries[slug][0]
                top = max(top, entries[slug][1])
            else:
                reasons[i] = _judge(op, slug, label, entries, active, cap)
                if reasons[i] is None:
                    if op == "create":
                        top += 1
                        entries[slug] = [True, top]
                        active += 1
                    elif op in ("retire", "restore"):
                        active += (op == "restore") - entries[slug][0] * (op == "retire")
                        entries[slug][0] = op == "restore"
            orders[i] = entries[slug][1] if slug in entries else 0
        return {"reject_reason": reasons, "new_order": orders}, (entries, top)

    return step


def _open(carry):
    rows = [] if carry is None else list(carry)
    entries = {r["slug"]: [bool(r["active"]), int(r["sort_order"])] for r in rows}
    return entries, max((e[1] for e in entries.values()), default=0)


def _close(state):
    return [{"slug": s, "active": bool(a), "sort_order": int(o)} for s, (a, o) in sorted(state[0].items())]


#: Slices of a log's sequence numbers; a window sees the rows of one slug in one slice.
SLICES = 4096


def _last_status(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``last``: the newest ``status`` of the slug before each row. Per slice, and from slice to slice by a small table."""
    slug = [key, "slug"]
    within = Window.partitionBy(*slug, "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("status IS NOT NULL").groupBy(*slug, "slice").agg(F.max_by("status", "seq").alias("end"))
    # Slices of a slug that hold no status get none; the row's own look-up goes to the newest slice before.
    seen = rows.select(*slug, "slice").distinct().join(ends, [*slug, "slice"], "left")
    before = Window.partitionBy(*slug).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("earlier", F.last("end", ignorenulls=True).over(before)).drop("end")
    here = rows.withColumn("here", F.last("status", ignorenulls=True).over(within))
    return here.join(seen, [*slug, "slice"]).withColumn("last", F.coalesce("here", "earlier")).drop("here", "earlier")


def _judged_apart(load: DataFrame, log: DataFrame, key: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(all rows judged as if the cap did not bind, catalogs in which it does)."""
    rows = load.unionByName(log)
    good = (F.col("op") == "create") & F.rlike("slug", F.lit(f"^(?:{C.SLUG_PATTERN})$")) & (F.col("label") != "")
    born = rows.groupBy(key, "slug").agg(F.min(F.when((F.col("op") == "load") | good, F.col("seq"))).alias("born"))
    ends = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // SLICES)
    rows = rows.join(born, [key, "slug"]).withColumn("slice", F.floor(F.col("seq") / width))
    op, there = F.coalesce("op", F.lit("")), F.coalesce(F.col("born") < F.col("seq"), F.lit(False))
    made = (op == "create") & F.coalesce(F.col("born") == F.col("seq"), F.lit(False))
    status = (F.when(op == "load", F.col("was_active")).when(made, True).when(there & op.isin("restore", "retire"), op == "restore"))
    rows = _last_status(rows.withColumn("status", status), key)
    active = there & F.coalesce("last", F.lit(False))
    delta = F.when(op == "load", F.col("was_active").cast("long")).when(made | ((op == "restore") & there & ~active), 1).when((op == "retire") & active, -1).otherwise(0)
    rows = rows.withColumns({"active": active, "there": there, "delta": delta.cast("long"), "made": made.cast("long")})
    starts = load.groupBy(key).agg(F.count_if("was_active").alias("n_start"), F.max("sort_order").alias("top"))
    edits = running(rows.filter("op IS DISTINCT FROM 'load'"), [key], [F.col("seq")], F.col("slice"), amount=F.col("delta"), name="n_after")
    edits = running(edits, [key], [F.col("seq")], F.col("slice"), amount=F.col("made"), name="n_made")
    edits = edits.join(small_side(starts), key, "left")
    n_before = F.coalesce("n_start", F.lit(0)) + F.col("n_after") - F.col("delta")
    full, unlabelled = n_before >= cap, F.when(F.col("label") == "", "label required")
    create = (F.when(~F.rlike("slug", F.lit(f"^(?:{C.SLUG_PATTERN})$")), "bad slug").when(F.col("there"), F.when(F.col("active"), "slug in use").otherwise("slug retired"))
              .when(full, "catalog full").otherwise(unlabelled))
    reason = (F.when(op == "create", create).when(~F.col("there"), "no such tag").when(op == "update", unlabelled)
              .when(op == "restore", F.when(F.col("active"), "already active").when(full, "catalog full"))
              .when(op != "retire", "unknown operation"))
    edits = edits.withColumns({"full": full, "reject_reason": reason, "new_order": F.when(F.col("made") == 1, F.coalesce(F.greatest("top", F.lit(0)), F.lit(0)) + F.col("n_made")).otherwise(0)})
    edits = checkpoint(edits)  # read three times
    over = edits.filter((F.col("delta") == 1) & F.col("full")).select(key).distinct()
    loaded = load.withColumns({"reject_reason": F.lit(None).cast("string"), "new_order": F.col("sort_order")})
    return loaded.unionByName(edits.select(*loaded.columns)), over


def catalog_changes(catalog: DataFrame, changes: DataFrame, cap: int = C.CATALOG_CAP,
                    by: str | None = None, max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejected changes).

    ``changes``: seq (unique order), op (create, update, retire, restore), slug,
    label, description, actor, at. ``by`` names the catalog a row belongs to
    when there are several. Sequence numbers aren't negative. In a catalog that reaches its cap whether a change is accepted
    depends on all earlier ones, so its log is folded in order; the state is
    the list of known slugs. Other logs are judged slug by slug. Texts are taken from the last accepted edit by an
    aggregate and never pass through the fold.
    """
    key = by or "_catalog"
    if by is None:
        catalog, changes = catalog.withColumn(key, F.lit(0)), changes.withColumn(key, F.lit(0))
    empty = F.lit("")
    log = changes.select(
        F.col(key), F.col("seq").cast("bigint").alias("seq"), "op",
        X.fold_case(X.trim_space(F.coalesce("slug", empty))).alias("slug"),
        X.trim_space(F.coalesce("label", empty)).alias("label"),
        X.trim_space(F.coalesce("description", empty)).alias("description"), "actor", "at",
        F.lit(None).cast("boolean").alias("was_active"), F.lit(None).cast("bigint").alias("sort_order"))
    load = catalog.select(
        F.col(key), F.lit(-1).cast("bigint").alias("seq"), F.lit("load").alias("op"), "slug", "label", "description",
        F.lit(None).cast("string").alias("actor"), F.lit(None).cast("timestamp").alias("at"),
        (F.col("status") == "active").alias("was_active"), F.col("sort_order").cast("bigint").alias("sort_order"))
    judged, over = _judged_apart(load, log, key, cap)
    over = checkpoint(over)
    if not over.isEmpty():
        over = small_side(over)
        rows = load.unionByName(log).join(over, key, "left_semi")
        folded = fold(rows, [key], F.col("seq"), ["slug"], {"reject_reason": T.StringType(), "new_order": T.LongType()}, _step(cap), _open, _close,
                      T.ArrayType(_ENTRY), still_matters=lambda s, first: s, max_rows=max_rows)
        judged = judged.join(over, key, "left_anti").unionByName(folded.select(*judged.columns))
    accepted = judged.filter(F.col("reject_reason").isNull())
    texts = F.col("op").isin("load", "create", "update")
    state = (F.when(F.col("op") == "load", F.when(F.col("was_active"), "active").otherwise("retired"))
             .when(F.col("op") == "retire", "retired").when(F.col("op").isin("create", "restore"), "active"))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("seq")))
    snapshot = accepted.groupBy(key, "slug").agg(
        last(F.col("label"), texts).alias("label"), last(F.col("description"), texts).alias("description"),
        last(state, state.isNotNull()).alias("status"), F.max("new_order").alias("sort_order"),
        F.max_by("actor", "seq").alias("updated_by"), F.max_by("at", "seq").alias("updated_at"))
    rejected = judged.filter(F.col("reject_reason").isNotNull()).select(key, "seq", "op", "slug", "reject_reason")
    if by is None:
        return snapshot.drop(key), rejected.drop(key)
    return snapshot, rejected

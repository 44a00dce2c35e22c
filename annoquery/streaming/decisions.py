"""Human decisions applied one by one to a frozen worklist, as a batch and as a stream.

The worklist (image_path, image_sha256) does not change. A decision (image_path, event_id, ts, image_sha256, status, regions, weak, reason, screened_by, notes) is accepted
if its image is in the worklist with the same digest and its evidence fits its status; ``pending`` takes earlier evidence back, whatever it brings along.
A refused decision leaves an image as it was. Every decision gives one outcome with the status before and after, so progress
after any of them is the worklist's plus the sum of the outcomes until then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

# The regions of an image, weak labels and the region whose count bounds each.
REGIONS = ["collar", "cuff", "hem", "pocket", "shoulder", "waist", "pattern", "decoration"]
WEAK_REGION = {"zipper": "decoration", "rivet": "decoration", "neckline": "collar", "pocket": "pocket"}

EVIDENCE = "regions map<string,int>, weak map<string,int>, reason string, screened_by string, notes string"
OUTCOME = StructType(
    [StructField("image_path", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampType())]
    + [StructField(c, StringType()) for c in ("fault", "before", "after")]
)


def evidence_fault(status: Column, regions: Column, weak: Column, reason: Column, by: Column, notes: Column) -> Column:
    """Why evidence does not fit its status, else null; the first rule that is broken."""
    empty = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0)) <= 0
    blank = lambda c: c.isNotNull() & (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")
    low = lambda m: F.coalesce(F.exists(F.map_values(m), lambda n: n.isNull() | (n < 1)), F.lit(False))
    other = lambda m, names: F.coalesce(F.exists(F.map_keys(m), lambda k: ~k.isin(names)), F.lit(False))
    bound = F.create_map(*[F.lit(x) for pair in WEAK_REGION.items() for x in pair])
    over = F.coalesce(F.exists(F.map_entries(weak), lambda e: e["value"] > F.coalesce(F.try_element_at(regions, F.try_element_at(bound, e["key"])), F.lit(0))), F.lit(False))
    rules = [
        ("status", ~F.coalesce(status.isin("pending", "eligible", "rejected"), F.lit(False))),
        ("pending", status == "pending"),  # passes: evidence is dropped
        ("blank_text", blank(reason) | blank(by) | blank(notes)),
        ("count", low(regions) | low(weak)),
        ("name", other(regions, REGIONS) | other(weak, list(WEAK_REGION))),
        ("reviewer", by.isNull()),
        ("no_region", (status == "eligible") & empty(regions)),
        ("reason_given", (status == "eligible") & reason.isNotNull()),
        ("weak_over_region", (status == "eligible") & over),
        ("no_reason", (status == "rejected") & reason.isNull()),
        ("counts_kept", (status == "rejected") & ~(empty(regions) & empty(weak))),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, rule in rules:
        out = out.when(rule, F.lit(None if name == "pending" else name))
    return out


def _checked(decisions: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("status", "regions", "weak", "reason", "screened_by", "notes")]
    return decisions.select("image_path", "event_id", "ts", "image_sha256", "status", evidence_fault(*columns).alias("fault"))


def outcomes(worklist: DataFrame, decisions: DataFrame) -> DataFrame:
    """(image_path, event_id, ts, fault, before, after) of all decisions of a batch, in order of time, then id."""
    known = worklist.select("image_path", F.col("image_sha256").alias("sha"))
    rows = _checked(decisions).join(known, "image_path", "left")
    fault = F.when(F.col("sha").isNull(), "unknown_image").when(~F.col("sha").eqNullSafe(F.col("image_sha256")), "identity").otherwise(F.col("fault"))
    order = Window.partitionBy("image_path").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)  # an image's decisions
    rows = rows.withColumn("fault", fault).withColumn("good", F.when(F.col("fault").isNull(), F.col("status")))
    before = F.when(F.col("sha").isNotNull(), F.coalesce(F.last("good", ignorenulls=True).over(order), F.lit("pending")))
    return rows.withColumn("before", before).select("image_path", "event_id", "ts", "fault", "before", F.coalesce("good", "before").alias("after"))


def progress(worklist: DataFrame, made: DataFrame) -> DataFrame:
    """(status, n): how many images have each status after the outcomes."""
    start = worklist.select(F.lit("pending").alias("status"), F.lit(1).alias("n"))
    change = F.explode(F.array(F.struct(F.col("before").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("after").alias("status"), F.lit(1).alias("n"))))
    return start.unionAll(made.where("before <> after").select(change.alias("c")).select("c.*")).groupBy("status").agg(F.sum("n").alias("n")).where("n <> 0")


class _Screening(StatefulProcessor):
    """State of an image: the digest that the worklist has, and the status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", StructType([StructField("sha", StringType()), StructField("status", StringType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.image.update((initialState["image_sha256"].iloc[0], "pending"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sha, status = self.image.get() if self.image.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():  # an image's decisions of one batch
            fault = "unknown_image" if sha is None else "identity" if r.image_sha256 != sha else r.fault if isinstance(r.fault, str) else None
            after = status if fault else r.status
            out.append((key[0], r.event_id, r.ts, fault, status, after))
            status = after
        if sha is not None:
            self.image.update((sha, status))
        yield pd.DataFrame(out, columns=OUTCOME.names)

    def close(self) -> None:
        pass


#: Keyed state of this kind needs the RocksDB store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def outcome_stream(worklist: DataFrame, decisions: DataFrame) -> DataFrame:
    """``outcomes`` as a stream: the worklist is the initial state, an image's digest and status are kept by key. The session needs the settings in ``STORE``."""
    start = worklist.select("image_path", "image_sha256").groupBy("image_path")
    return _checked(decisions).groupBy("image_path").transformWithStateInPandas(_Screening(), OUTCOME, "Append", "None", initialState=start)

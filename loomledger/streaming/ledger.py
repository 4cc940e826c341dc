"""Structured Streaming forms: ledger ingest, idempotent reports, pace, leases, screens, running status, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomledger.operators.ledger import SOURCE_KINDS
from loomledger.operators.text import screen_state
from loomledger.operators.urls import canonicalize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys of lines that are no address: they have no state, and are spread so that they don't meet in one task.
_REJECT, _SPREAD = "reject:", 64


class _Ingest(StatefulProcessor):
    """Per canonical address: whether the ledger has it, and its sources."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "domain string")
        self.sources = handle.getMapState("sources", "source_kind string, source_value string", "seen boolean")

    def _add(self, rows: pd.DataFrame) -> list[tuple[str, str]]:
        new = []
        for pair in rows[["source_kind", "source_value"]].drop_duplicates().itertuples(index=False, name=None):
            if not self.sources.containsKey(pair):
                self.sources.updateValue(pair, (True,))
                new.append(pair)
        return new

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.item.update((initialState["domain"].iloc[0],))
        self._add(initialState[initialState["source_kind"].notna()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        columns = ["canonical_url", "domain", "source_kind", "source_value", "received", "added", "rejected"]
        if key[0].startswith(_REJECT):
            yield pd.DataFrame([(None, None, None, None, len(rows), 0, len(rows))], columns=columns)
            return
        added, domain = not self.item.exists(), rows["domain"].iloc[0]
        if added:
            self.item.update((domain,))
        new = self._add(rows) or [(None, None)]
        # What the batch brought stands in the first row.
        yield pd.DataFrame([(key[0], domain, kind, value, len(rows) * (i == 0), int(added and i == 0), 0) for i, (kind, value) in enumerate(new)], columns=columns)

    def close(self) -> None:
        pass


def stream_new_urls(records: DataFrame, items: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """What every micro-batch brings to the ledger: canonical_url, domain, source_kind and source_value of each new provenance, and the numbers received, added and rejected.

    records: url, source_kind, source_value. items (canonical_url, domain) and sources (canonical_url, source_kind, source_value): the ledger at the
    start; it is read once, into the state of its addresses. After that a batch costs what its own addresses cost, however large the
    ledger has become. Needs the RocksDB state store."""
    found = canonicalize(records)
    keyed = found.select(
        F.coalesce("canonical_url", F.concat(F.lit(_REJECT), F.pmod(F.xxhash64("url"), F.lit(_SPREAD)).cast("string"))).alias("canonical_url"), "domain", "source_kind", "source_value"
    ).groupBy("canonical_url")
    initial = None
    if items is not None:
        held = items.select("canonical_url", "domain")
        known = sources.select("canonical_url", "source_kind", "source_value") if sources is not None else None
        held = held.join(known, "canonical_url", "left") if known is not None else held.withColumns({c: F.lit(None).cast("string") for c in ("source_kind", "source_value")})
        initial = held.groupBy("canonical_url")
    schema = "canonical_url string, domain string, source_kind string, source_value string, received long, added long, rejected long"
    return keyed.transformWithStateInPandas(_Ingest(), schema, "append", "none", initial)


def stream_add_urls(stream: DataFrame, ledger_path: str, kind: str, value: str, checkpoint: str, items: DataFrame | None = None, sources: DataFrame | None = None):
    """Start ingesting URL records (column url) into a ledger of Parquet: each micro-batch writes its new items, its new provenance and its counts.

    items, sources: what another ledger holds already. A batch that is run again after a failure overwrites its own folders, so it counts once."""
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind: {kind}")
    new = stream_new_urls(stream.select("url", F.lit(kind).alias("source_kind"), F.lit(value).alias("source_value")), items, sources)

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("added = 1").select("canonical_url", "domain").write.mode("overwrite").parquet(f"{ledger_path}/items/batch={number}")
        batch.where("source_kind is not null").select("canonical_url", "source_kind", "source_value").write.mode("overwrite").parquet(f"{ledger_path}/sources/batch={number}")
        total = batch.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "added", "rejected")), F.count("source_kind").alias("sources_added"))
        total.select("received", "added", (F.col("received") - F.col("added") - F.col("rejected")).alias("duplicates"), "rejected", "sources_added").write.mode("overwrite").parquet(f"{ledger_path}/counts/batch={number}")
        batch.unpersist()

    return new.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reports(stream: DataFrame, key: str = "report_key", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Reports, each key once within the watermark's delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class _Pace(StatefulProcessor):
    """Per domain: when the next request may go, and how many failures came in a row."""

    def __init__(self, min_ms: int, queue_ms: int, base_ms: int, most_ms: int):
        self.min_ms, self.queue_ms, self.base_ms, self.most_ms = min_ms, queue_ms, base_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pace", "next long, slot long, fails long, asleep long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_, slot, fails, asleep = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["now_ms", "id"]).itertuples(index=False):
            if r.kind == "ok":
                fails = 0
            elif r.kind in ("failed", "blocked"):
                fails += 1
                next_ = max(next_, r.now_ms + min(self.base_ms * 2 ** (fails - 1), self.most_ms))
            elif r.kind == "sleep":
                asleep = max(asleep, r.now_ms + int(r.gap_ms))
            elif r.now_ms < asleep:
                out.append((key[0], r.id, None, "domain_sleeping"))
            elif max(next_, r.now_ms) - r.now_ms > self.queue_ms:
                out.append((key[0], r.id, None, "queue_too_long"))
            else:
                slot += 1
                allowed = max(next_, r.now_ms)
                next_ = allowed + max(self.min_ms, int(r.gap_ms))
                out.append((key[0], r.id, allowed, None))
        self.state.update((int(next_), int(slot), int(fails), int(asleep)))
        if out:
            frame = pd.DataFrame(out, columns=["domain", "id", "allowed_at", "reason"])
            yield frame.astype({"id": "int64", "allowed_at": "Int64"})

    def close(self) -> None:
        pass


def stream_pace(events: DataFrame, min_ms: int = 0, queue_ms: int = 600_000, base_ms: int = 1000, most_ms: int = 300_000) -> DataFrame:
    """domain, id, allowed_at or reason (domain_sleeping, queue_too_long) of every request; results (ok, failed, blocked) and sleeps move the domain's clock.

    events: domain, id, kind (request, ok, failed, blocked, sleep), now_ms, gap_ms. Needs the RocksDB state store."""
    return events.groupBy("domain").transformWithStateInPandas(_Pace(min_ms, queue_ms, base_ms, most_ms), "domain string, id long, allowed_at long, reason string", "append", "none")


class _Lease(StatefulProcessor):
    """Per item: the current lease; a timer gives the item back, a report under another lease is stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "lease string, until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("at_ms").itertuples(index=False):
            lease, until = self.state.get() if self.state.exists() else (None, 0)
            if lease is not None and r.at_ms >= until:
                out.append((key[0], lease, int(until), "expired"))
                self.state.clear()
                lease = None
            if r.kind == "lease":
                self.state.update((r.lease, int(r.until_ms)))
                self.handle.registerTimer(int(r.until_ms))
                out.append((key[0], r.lease, int(r.at_ms), "leased"))
            elif r.lease == lease:
                out.append((key[0], r.lease, int(r.at_ms), "reported"))
                self.state.clear()
            else:
                out.append((key[0], r.lease, int(r.at_ms), "stale"))
        if out:
            yield pd.DataFrame(out, columns=["item_id", "lease", "at_ms", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            lease, until = self.state.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield pd.DataFrame([(key[0], lease, int(until), "expired")], columns=["item_id", "lease", "at_ms", "outcome"])

    def close(self) -> None:
        pass


def stream_leases(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """item_id, lease, at_ms and outcome (leased, reported, expired, stale). events: item_id, kind (lease, report), lease, at (timestamp), at_ms, until_ms. Needs the RocksDB state store."""
    return events.withWatermark("at", delay).groupBy("item_id").transformWithStateInPandas(_Lease(), "item_id long, lease string, at_ms long, outcome string", "append", "eventTime")


class _Screen(StatefulProcessor):
    """Per surface: the reading before, how many empty ones came in a row, and when its silence is over."""

    def __init__(self, empty: int, silent_ms: int | None):
        self.empty, self.silent_ms = empty, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("screen", "text string, empties int, last long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, empties, last, until = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("at_ms").itertuples(index=False):
            if not (r.text or "").strip():
                empties += 1
                state = "no_panel" if empties >= self.empty else "empty"
            else:
                empties = 0
                state = "stalled" if r.state == "working" and text == r.text else r.state
                text = r.text
            last = int(r.at_ms)
            out.append((key[0], last, state))
        if self.silent_ms is not None:
            if until:
                self.handle.deleteTimer(until)
            until = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
            self.handle.registerTimer(until)
        self.state.update((text, int(empties), last, int(until)))
        yield pd.DataFrame(out, columns=["surface", "at_ms", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, empties, last, until = self.state.get()
        if until == expiredTimerInfo.getExpiryTimeInMs():
            # Said once: the next reading sets another timer.
            self.state.update((text, empties, last, 0))
            yield pd.DataFrame([(key[0], last, "timeout")], columns=["surface", "at_ms", "state"])

    def close(self) -> None:
        pass


def stream_screens(readings: DataFrame, empty: int = 3, silent_ms: int | None = None) -> DataFrame:
    """surface, at_ms and state of every reading: a screen that says working without changing is stalled, three empty ones are no panel. readings: surface, at_ms, text.

    silent_ms: a surface without a reading for so long is reported once as timeout, with the time of its last reading, and again only after
    another reading. The silence is measured by the clock of the cluster, so the query has to go on running."""
    known = readings.withColumn("state", screen_state(F.coalesce("text", F.lit(""))))
    mode = "none" if silent_ms is None else "processingTime"
    return known.groupBy("surface").transformWithStateInPandas(_Screen(empty, silent_ms), "surface string, at_ms long, state string", "append", mode)


def stream_status(attempts: DataFrame) -> DataFrame:
    """Running counts of results and error codes; for update or complete mode."""
    return attempts.groupBy("result", F.coalesce("error_code", F.lit("-")).alias("error_code")).agg(F.count(F.lit(1)).alias("n"))


def stream_problems(attempts: DataFrame) -> DataFrame:
    """kind (result, error, warning), stage, name, n and sample, the latest attempt of the group: running numbers, one row a group, for complete mode.

    attempts: attempt_id, started_at, result, error_stage, error_code, warning_codes. An attempt counts once for its result, once for its
    error and once for each warning. Groups are added up before the exchange, so a code that most attempts have is no hot key."""
    row = lambda kind, stage, name: F.struct(F.lit(kind).alias("kind"), stage.alias("stage"), name.alias("name"))
    unknown, none = F.lit("unknown"), F.lit(None).cast("string")
    failed = F.when(F.col("result") == "failed", F.array(row("error", F.coalesce("error_stage", unknown), F.coalesce("error_code", unknown))))
    warned = F.transform("warning_codes", lambda w: row("warning", none, w))
    nothing = F.array().cast("array<struct<kind: string, stage: string, name: string>>")
    groups = F.concat(F.array(row("result", none, F.col("result"))), F.coalesce(failed, nothing), F.coalesce(warned, nothing))
    counted = attempts.select("attempt_id", "started_at", F.explode(groups).alias("g")).groupBy("g.kind", "g.stage", "g.name")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.max_by("attempt_id", F.struct("started_at", "attempt_id")).alias("sample"))


def top_of(problems: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent errors and the n most frequent warnings of stream_problems' groups, and all results."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name", "stage"))
    return problems.withColumn("place", place).where((F.col("place") <= n) | (F.col("kind") == "result"))


class _Moves(StatefulProcessor):
    """Per item: the state that it is in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("work_state", "work_state string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, since = self.state.get() if self.state.exists() else (None, None)
        rows = pd.concat(list(rows))
        last = rows.sort_values(["at_ms", "work_state"]).iloc[-1]
        if since is not None and (last.at_ms, last.work_state) < (since, before):
            return  # late: a newer state is known
        self.state.update((last.work_state, int(last.at_ms)))
        if before != last.work_state:
            yield pd.DataFrame([(last.work_state, 1)] + ([(before, -1)] if before is not None else []), columns=["work_state", "change"])

    def close(self) -> None:
        pass


def stream_status_report(attempts: DataFrame, changes: DataFrame, path: str, checkpoint: str, n: int = 5) -> tuple:
    """Start two queries that keep a ledger's status up to date: under path/problems/batch=k the top errors and warnings and the results (kind, stage, name, n, sample,
    place) of all attempts so far, under path/states/batch=k the number of items in each state (work_state, items).

    changes: item_id, work_state, at_ms. An item's move is two numbers, one less and one more, so a batch costs what moved in it. A batch that is run again
    overwrites its own folder. Needs the RocksDB state store."""

    def problems(batch: DataFrame, number: int) -> None:
        top_of(batch, n).write.mode("overwrite").parquet(f"{path}/problems/batch={number}")

    def states(batch: DataFrame, number: int) -> None:
        moved = batch.groupBy("work_state").agg(F.sum("change").alias("items"))
        if number:
            moved = batch.sparkSession.read.parquet(f"{path}/states/batch={number - 1}").unionByName(moved).groupBy("work_state").agg(F.sum("items").alias("items"))
        moved.coalesce(1).write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    moves = changes.groupBy("item_id").transformWithStateInPandas(_Moves(), "work_state string, change long", "append", "none")
    start = lambda df, mode, each, name: df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return start(stream_problems(attempts), "complete", problems, "problems"), start(moves, "append", states, "states")


def retain_last(batch: DataFrame, kept: DataFrame, key: str, order: str, n: int = 200) -> DataFrame:
    """The last n rows of each key of what was kept and a new micro-batch, for foreachBatch."""
    rank = Window.partitionBy(key).orderBy(F.desc(order))
    return kept.unionByName(batch).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")

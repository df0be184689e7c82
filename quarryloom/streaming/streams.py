"""Streaming jobs: counts, sessions, audits, running mastery, limits, breakers, expiring caches and ingestion. Windows are
given out once the watermark has passed them, and their state is freed then; the source ends with a row that lifts the
watermark over all others, so that none is left out. Answers wait in buckets of time until the watermark has passed these.
Entries and uses of a cache are two streams, joined within a bound of time or met by the last store. Other state is one small row per key, which a
timer frees where it may expire."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarryloom.operators import bm25
from quarryloom.operators.chunking import split_window
from quarryloom.operators.evidence import HIGH_RISK, INJECTIONS, MEDIUM_RISK, SECRETS, filter_injection, redact, risk
from quarryloom.operators.learner import GAIN, LOSS, ORACLE as LEARNER_SQL
from quarryloom.operators.retrieval import TERMS_SQL
from quarryloom.sources.shared import exists, new_path
from quarryloom.streaming.runs import closed, drained, source

RATE, BURST = 20 / 60, 20
#: The users at hand call about once a day, so their limit is met at two calls in two days.
RATE_HERE, BURST_HERE = 1 / 86400, 2
FAILURES, OPEN_SECONDS, TTL_SECONDS = 5, 30, 3600


def events(spark, d, files_per_trigger: int | None = None) -> DataFrame:
    return source(spark, d, "events", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def all_events(spark, d) -> DataFrame:
    """The events, and the row after them."""
    return closed(events(spark, d), spark, d, "events", "ts")


def counters(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", "1 hour").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stream_counters(spark, d):
    return drained(counters(all_events(spark, d), "1 hour"), "counters", "append").select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def stream_sliding(spark, d):
    return drained(counters(all_events(spark, d), "1 hour", "30 minutes"), "sliding", "append").select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def stream_sessions(spark, d):
    s = all_events(spark, d).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return drained(s, "sessions", "append").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


def stream_audit(spark, d):
    text = filter_injection(redact(F.col("text")))
    s = source(spark, d, "conversations").select("conv_id", "turn", risk(F.col("text")).alias("risk"), F.md5(text.cast("binary")).alias("digest"))
    return drained(s, "audit", "append")


def _in_order(pdfs, by: list[str]) -> pd.DataFrame:
    """The rows of a key in one batch, in order of time; a batch's rows of a key are what arrived together."""
    return pd.concat(list(pdfs)).sort_values(by)


#: Answers wait for the watermark in buckets of so many milliseconds.
BUCKET_MS = 15 * 60 * 1000
#: So many answers of a key wait together, without buckets.
FEW_ANSWERS = 4096
_ANSWER = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("ok", "?")])


class RunningMastery(StatefulProcessor):
    """Mastery of one learner and concept, folded in order of time however the answers arrive.

    A value holds the folded state, a list the outcomes of the last answers. Answers that the watermark has not passed yet
    wait in a second value while they are few, as each call of the state costs more than many answers; of a key that has
    more they go to a map, by bucket of time. Frames of a key are taken one by one and none is kept, and buckets that the
    watermark has passed are folded in order and removed. A timer at the end of the
    first bucket left does the same when no more answers come, so what is held of a key are the answers of the watermark's
    delay, and in memory those of one bucket, and the few."""

    LAST = 5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "m double, days int, n int, right int")
        self.few = handle.getValueState("few", "answers binary, more boolean")
        self.waiting = handle.getMapState("waiting", "bucket long", "answers binary")
        self.outcomes = handle.getListState("outcomes", "ok boolean")

    def handleInputRows(self, key, rows, timerValues):
        few, more = self._few()
        for pdf in rows:
            pdf = pdf[pdf.event_id.notna()]
            if not len(pdf):  # the row that closes the source
                continue
            new = np.zeros(len(pdf), _ANSWER)
            new["us"], new["event_id"], new["ok"] = pdf.us, pdf.event_id, pdf.correct.astype(bool)
            few = np.concatenate([few, new])
            if len(few) > FEW_ANSWERS:
                self._to_buckets(few)
                few, more = few[:0], True
        yield from self._fold(key, timerValues, few, more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._fold(key, timerValues, *self._few())

    def _few(self):
        answers, more = self.few.get() if self.few.exists() else (b"", False)
        return np.frombuffer(bytes(answers), _ANSWER), more

    def _to_buckets(self, new):
        bucket = new["us"] // (BUCKET_MS * 1000)
        for b in np.unique(bucket):
            at = (int(b),)
            held = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else b""
            self.waiting.updateValue(at, (bytes(held) + new[bucket == b].tobytes(),))

    def _due(self, few, bucket, filled, due):
        """The answers that are due, in order of time; of those in buckets, one bucket at a time."""
        for b in due if filled else due[:1]:
            answers = few[bucket == b] if filled else few[bucket <= due[-1]]
            if b in filled:
                answers = np.concatenate([np.frombuffer(self.waiting.getValue((b,))[0], _ANSWER), answers])
                self.waiting.removeKey((b,))
            yield np.sort(answers, order=["us", "event_id"])

    def _fold(self, key, timers, few, more):
        passed, bucket = timers.getCurrentWatermarkInMs(), few["us"] // (BUCKET_MS * 1000)
        filled = {k[0] for k in self.waiting.keys()} if more else set()
        buckets = sorted(filled | set(bucket.tolist()))
        if not buckets:
            return
        due = [b for b in buckets if (b + 1) * BUCKET_MS <= passed]
        left = buckets[len(due) :]
        if left:
            self.handle.registerTimer((left[0] + 1) * BUCKET_MS)
            self.few.update((few[bucket >= left[0]].tobytes(), bool(filled.intersection(left))))
        else:
            self.few.clear()
        if not due:
            return
        m, days, n, right = self.folded.get() if self.folded.exists() else (0.0, 1, 0, 0)
        last = [r[0] for r in self.outcomes.get()] if self.outcomes.exists() else []
        for answers in self._due(few, bucket, filled, due):
            for ok in answers["ok"].tolist():
                m = round(min(1.0, m + GAIN) if ok else max(0.0, m - LOSS), 6)
                days = min(30, days * 2) if ok else max(1, days // 2)
            n, right = n + len(answers), right + int(answers["ok"].sum())
            last = (last + answers["ok"].tolist()[-self.LAST :])[-self.LAST :]
        self.folded.update((m, days, n, right))
        self.outcomes.put([(bool(x),) for x in last])
        yield pd.DataFrame({"user_id": [key[0]], "concept": [key[1]], "mastery": [m], "interval_days": [days], "quiz_count": [n], "correct_count": [right], "last_right": [sum(last)]})

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark):
    """State with several variables and timers needs the state store that keeps them apart."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def running_mastery(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """stream: event_id, user_id, concept, correct, ts. A key's row each time answers of it have been folded."""
    a = stream.withWatermark("ts", delay).select("ts", "event_id", "user_id", "concept", "correct", F.unix_micros("ts").alias("us"))
    out = "user_id long, concept string, mastery double, interval_days int, quiz_count int, correct_count int, last_right int"
    return a.groupBy("user_id", "concept").transformWithStateInPandas(RunningMastery(), out, "append", "EventTime")


def newest(rows: DataFrame) -> DataFrame:
    """Of the rows that a key has had, the one with the most answers."""
    r = F.max_by(F.struct("mastery", "interval_days", "quiz_count", "correct_count"), "quiz_count").alias("r")
    return rows.groupBy("user_id", "concept").agg(r).select("user_id", "concept", "r.*")


def graded(e: DataFrame) -> DataFrame:
    # The row after the events has a key of its own, and no answer.
    return e.select("event_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("event_type", F.lit("")).alias("concept"), (F.col("value") > 100).alias("correct"), "ts")


def stream_mastery(spark, d):
    with rocksdb(spark):
        return newest(drained(running_mastery(graded(all_events(spark, d))), "mastery", "append"))


def limiter(rate: float, burst: float):
    """A token bucket of `burst`, refilled by `rate` a second. A bucket that is full again is like a new one and goes."""

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), -1.0)
        pdf = _in_order(pdfs, ["at", "event_id"])
        allowed = []
        for at in pdf["at"]:
            tokens = min(float(burst), tokens + (at - last) * rate) if last >= 0 else tokens
            last = at
            ok = tokens >= 1
            tokens -= ok
            allowed.append(bool(ok))
        state.update((tokens, last))
        state.setTimeoutTimestamp(int(max((last + (burst - tokens) / rate) * 1000, state.getCurrentWatermarkMs()) + 1))
        yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "user_id": key[0], "allowed": allowed})

    return run


def stream_rate_limit(spark, d, rate: float = RATE, burst: float = BURST):
    a = events(spark, d).withWatermark("ts", "1 hour").select("ts", "event_id", "user_id", F.unix_timestamp("ts").cast("double").alias("at"))
    s = a.groupBy("user_id").applyInPandasWithState(limiter(rate, burst), "event_id long, user_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
    return drained(s, "limit", "append")


def breaker_state(key, pdfs, state):
    """closed; open after five failures in a row; after 30 seconds one probe is let through, and closes or opens again."""
    name, failures, since = state.get if state.exists else ("closed", 0, 0.0)
    pdf = _in_order(pdfs, ["at", "event_id"])
    out = []
    for at, bad in zip(pdf["at"], pdf.bad, strict=True):
        if name == "open" and at - since >= OPEN_SECONDS:
            name = "half_open"
        out.append(name)
        if name == "open":
            continue
        failures = failures + 1 if bad else 0
        if bad and (name == "half_open" or failures >= FAILURES):
            name, since = "open", at
        elif not bad:
            name = "closed"
    if (name, failures) == ("closed", 0):
        state.remove()  # as if there had been no call
    else:
        state.update((name, failures, since))
    yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "state": out})


def stream_breaker(spark, d):
    a = events(spark, d).select("event_id", "user_id", F.unix_timestamp("ts").cast("double").alias("at"), (F.col("value") < 60).alias("bad"))
    s = a.groupBy("user_id").applyInPandasWithState(breaker_state, "event_id long, state string", "name string, failures int, since double", "append", GroupStateTimeout.NoTimeout)
    return drained(s, "breaker", "append")


def cache_state(key, pdfs, state):
    """A use is a hit if the entry was stored at most an hour ago; else it is stored anew. An entry that has expired goes."""
    if state.hasTimedOut:
        state.remove()
        return
    (stored,) = state.get if state.exists else (-1.0,)
    pdf = _in_order(pdfs, ["at", "event_id"])
    hits = []
    for at in pdf["at"]:
        hit = stored >= 0 and at - stored <= TTL_SECONDS
        stored = stored if hit else at
        hits.append(hit)
    state.update((stored,))
    # A timer cannot be set before the watermark, where the entry has expired for all that may still come.
    state.setTimeoutTimestamp(int(max((stored + TTL_SECONDS) * 1000, state.getCurrentWatermarkMs()) + 1))
    yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "hit": hits})


def stream_cache_ttl(spark, d):
    a = events(spark, d).withWatermark("ts", "1 hour").select("ts", "event_id", F.floor("value").alias("entry"), F.unix_timestamp("ts").cast("double").alias("at"))
    s = a.groupBy("entry").applyInPandasWithState(cache_state, "event_id long, hit boolean", "stored double", "append", GroupStateTimeout.EventTimeTimeout)
    return drained(s, "cache", "append")


def cache_uses(stores: DataFrame, uses: DataFrame, ttl: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(use_id, used, stored): each use of an entry with each store of it at most `ttl` seconds before; a use without any
    has one row with null. stores: entry, stored; uses: use_id, entry, used. Both watermarks bound what the join holds:
    a store leaves it once no use within its time can come, a use once no store before it can."""
    s = stores.withWatermark("stored", delay).select(F.col("entry").alias("of"), "stored")
    u = uses.withWatermark("used", delay)
    fits = (F.col("entry") == F.col("of")) & (F.col("used") >= F.col("stored")) & (F.col("used") <= F.col("stored") + F.expr(f"INTERVAL {ttl} SECONDS"))
    return u.join(s, fits, "leftOuter").select("use_id", "used", "stored")


def _last_before(ttl: int):
    """(use_id, used, stored) from the rows of `last_stores`: the uses of all rows of a frame are placed among its stores at
    once."""

    def run(batches):
        for b in batches:
            held, carried = b.column("held"), np.asarray(pc.fill_null(b.column("carried"), -(1 << 62)), dtype=np.int64)
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(held)))
            us, uses, ids = (held.flatten().field(k) for k in range(3))
            us, use = np.asarray(us, dtype=np.int64), np.asarray(uses)
            # A store counts for the uses of its own time.
            order = np.lexsort((use, us, row))
            row, us, use, ids = row[order], us[order], use[order], ids.take(pa.array(order))
            latest = np.where(use, -1, np.arange(len(us)))
            latest = np.maximum.accumulate(latest) if len(us) else latest
            own = (latest >= 0) & (row[np.maximum(latest, 0)] == row)
            stored = np.where(own, us[np.maximum(latest, 0)], carried[row])
            stored = np.where(np.asarray(b.column("entry").is_null())[row], -(1 << 62), stored)
            old = us - stored > ttl * 1_000_000
            out = [ids.filter(pa.array(use)), pa.array(us[use], pa.timestamp("us", "UTC")), pa.array(stored[use], pa.timestamp("us", "UTC"), mask=old[use])]
            yield pa.RecordBatch.from_arrays(out, ["use_id", "used", "stored"])

    return run


def last_stores(stores: DataFrame, uses: DataFrame, ttl: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(use_id, used, stored): each use once, with the last store of its entry at most `ttl` seconds before; null if there is
    none, or no entry. stores: entry, stored; uses: use_id, entry, used. Time is cut into stretches of `ttl` seconds: a use
    needs the stores of its own stretch, and the last one of the stretch before, which is kept as a maximum. So no use meets
    more than one row for each store, and what is held are the rows of stretches that the watermarks have not passed."""
    us = lambda c: F.unix_micros(c).alias("us")
    nothing = F.lit(None).cast("long")
    # Carried stores are ahead of their time by a stretch, so the watermark of the stores waits a stretch longer.
    late = f"{delay} {ttl} seconds"
    ahead = F.explode(F.array(F.lit(0), F.lit(ttl)))
    s = stores.where("entry IS NOT NULL").select("entry", "stored", ahead.alias("by"))
    s = s.select((F.col("stored") + F.make_dt_interval(secs=F.col("by"))).alias("at"), "entry", us(F.col("stored")), nothing.alias("use_id"), F.lit(False).alias("use"), (F.col("by") > 0).alias("carry")).withWatermark("at", late)
    u = uses.select(F.col("used").alias("at"), "entry", us(F.col("used")), "use_id", F.lit(True).alias("use"), F.lit(False).alias("carry")).withWatermark("at", delay)
    both = s.unionByName(u).groupBy(F.window("at", f"{ttl} seconds"), "entry")
    held = both.agg(F.collect_list(F.when(~F.col("carry"), F.struct("us", "use", "use_id"))).alias("held"), F.max(F.when(F.col("carry"), F.col("us"))).alias("carried"))
    return held.select("entry", "held", "carried").mapInArrow(_last_before(ttl), "use_id long, used timestamp, stored timestamp")


def stream_cache_join(spark, d):
    """One event in four stores the entry that its value names, the others use one; a use is a hit if the entry was stored
    in the hour before. Of several stores the last counts."""
    e = all_events(spark, d).withColumn("entry", F.floor("value"))
    # The row after the events lifts both watermarks: it stores an entry of its own, and its use has no id.
    closing = F.coalesce("entry", F.when(F.col("event_id").isNull(), F.lit(-1)))
    stores = e.where("event_id % 4 = 0 OR event_id IS NULL").select(closing.alias("entry"), F.col("ts").alias("stored"))
    uses = e.where("event_id % 4 <> 0 OR event_id IS NULL").select(F.col("event_id").alias("use_id"), "entry", F.col("ts").alias("used"))
    found = drained(last_stores(stores, uses), "cache", "append").where("use_id IS NOT NULL")
    return found.groupBy("use_id").agg(F.max("stored").alias("stored")).select(F.col("use_id").alias("event_id"), F.col("stored").isNotNull().alias("hit"), F.date_format("stored", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stored"))


#: A file that comes again within this time is known; beyond it, it counts as new.
KNOWN_FOR = "365 days"


def ingest(files: DataFrame, index: str, path: str | None = None, known_for: str = KNOWN_FOR, progress: list | None = None, after=None) -> DataFrame:
    """New files once each: of those with one hash and language the first that comes is stored with its chunks and added to
    the index at `index`. What has been seen is bounded state, keyed by hash and language, that goes once the watermark is
    `known_for` past it; no table of earlier batches is read. The checkpoint goes with `path`: a run that was stopped goes
    on there, and a batch that is run again overwrites its own rows and replaces its own documents in the index. Files
    later than the watermark are dropped, and counted in `progress`. files: doc_id, text, lang, arrived. after(batch) is
    called when a batch has been stored."""
    s = files.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), "lang", "arrived")
    s = s.withWatermark("arrived", known_for).dropDuplicatesWithinWatermark(["file_hash", "lang"])

    def write(batch, n, path):
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/table=files/batch={n}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/table=files/batch={n}")
        split_window(new).withColumn("arrived", F.lit(None).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/table=chunks/batch={n}")
        if not new.isEmpty():
            (bm25.add if exists(spark, f"{index}/documents") else bm25.create)(new.select("doc_id", "text"), index)
        if after:
            after(n)

    return drained(s, "ingest", "append", write, path, progress)


def late_rows(progress: list) -> int:
    """Rows that came after the watermark had passed them, as a query reports them."""
    return sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)


def stream_ingest(spark, d):
    index = new_path(spark, "stream-index")
    files = source(spark, d, "documents", 2).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000)))
    out = ingest(files, index)
    files = out.where("table = 'files'").groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("file_hash").alias("hashes"))
    of = out.where("table = 'files'").select("doc_id", "lang")
    pieces = out.where("table = 'chunks'").select("doc_id").join(of, "doc_id").groupBy("lang").agg(F.count("*").alias("chunks"))
    posted = bm25.load(spark, index).join(of, "doc_id").groupBy("lang").agg(F.sum(F.size("terms")).alias("postings"))
    return files.join(pieces, "lang").join(posted, "lang")


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_sessions": stream_sessions,
    "stream_counters": stream_counters,
    "stream_sliding_counters": stream_sliding,
    "stream_rate_limit": lambda s, d: stream_rate_limit(s, d, RATE_HERE, BURST_HERE),
    "stream_breaker": stream_breaker,
    "stream_mastery": stream_mastery,
    "stream_cache_ttl": stream_cache_ttl,
    "stream_cache_join": stream_cache_join,
    "stream_audit": stream_audit,
}
_RED = "text"
for _p in SECRETS:
    _RED = f"regexp_replace({_RED}, '{_p}', '[REDACTED]', 'g')"
_RED = f"substr({_RED}, 1, 2000)"
for _p in INJECTIONS:
    _RED = f"regexp_replace({_RED}, '{_p}', '[FILTERED]', 'gi')"
ORACLE = {
    "stream_ingest": f"""WITH f AS (SELECT sha256(text) AS file_hash, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL), t AS (SELECT f.lang, f.doc_id, text, file_hash FROM f JOIN documents d ON d.doc_id = f.doc_id)
SELECT lang, count(*) AS documents, count(DISTINCT file_hash) AS hashes, sum(len(generate_series(0, greatest(length(text) - 1, 0), 800)))::BIGINT AS chunks, sum(len(list_distinct({TERMS_SQL})))::BIGINT AS postings FROM t GROUP BY lang""",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY user_id, k",
    "stream_counters": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding_counters": "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, value FROM events, (VALUES (0), (1)) v(k)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY w.start, event_type",
    "stream_cache_join": f"SELECT u.event_id, max(s.ts) IS NOT NULL AS hit, strftime(max(s.ts), '%Y-%m-%d %H:%M:%S.%f') AS stored FROM events u LEFT JOIN (SELECT * FROM events WHERE event_id % 4 = 0) s ON floor(s.value) = floor(u.value) AND s.ts <= u.ts AND s.ts >= u.ts - INTERVAL {TTL_SECONDS} SECOND WHERE u.event_id % 4 <> 0 GROUP BY u.event_id",
    "stream_mastery": LEARNER_SQL["mastery_update"],
    "stream_audit": f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i){'|'.join(HIGH_RISK)}') THEN 'high' WHEN regexp_matches(text, '(?i){MEDIUM_RISK}') THEN 'medium' ELSE 'low' END AS risk, md5({_RED}) AS digest FROM conversations",
}

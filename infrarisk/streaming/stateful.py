"""Keyed stateful processors with event-time timers: labels, as-of matches and trailing counts on streams.

All three take one stream that unions questions (telemetry) and facts (incidents, observations, events), with one
watermark.  A question waits in its key's state until the watermark has passed the time it needs to know about; a timer
wakes the key then.  So answers are exact whatever the order of arrival within the watermark, and equal the batch
operators'.  The last questions of a stream are answered only when time goes on: ``ends`` is a stream of (at) rows that does
nothing but move the watermark.

A key is one of ``slots`` slots (and a bucket of hours), not a city: calls of the state store, timers and the parts that
rows are cut into cost by the key, so a key a city would cost more than the rows do.  State is kept in lists of many rows.

State, by processor:

=====================  ==========================  =====================================================================
processor              key                         held until
=====================  ==========================  =====================================================================
``live_labels``        slot, hours of the question questions: all targets matched, or t + horizon; facts: as long
``live_weather``       slot                        questions: the hour's end; observations: the newest of a city at or before
                                                   the watermark and later ones (all within ``max_age`` if that is given)
``live_counts``        slot                        questions: the hour's end; events: days of the widest window
=====================  ==========================  =====================================================================

A hot city is spread over its hours (labels) or over ``shards`` slots (its questions are dealt by hash, its facts, which are
few against questions, go to every one of them).  More rows an hour take more slots; their number is fixed when a stream is
first started.  The state store has to be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import HOUR_US, epoch_us
from ..operators.labels import DAY_US, incident_groups
from ..operators.weather import city_key
from ..schema import TARGET_COLUMNS

ALL = (1 << len(TARGET_COLUMNS)) - 1
ASK, FACT, CLOSE = 0, 1, 2


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
SLOTS = 64


def _name(city) -> Column:
    """A city's name in state; no city is the empty text, which no city has."""
    return F.coalesce(F.concat(F.lit("="), city), F.lit(""))


def _slot(slots: int, shard=None) -> Column:
    """The slot of ``k_city``; ``shard`` slots of one city lie side by side, so none is met twice."""
    h = F.xxhash64("k_city") if shard is None else F.pmod(F.xxhash64("k_city"), F.lit(slots)) + shard
    return F.pmod(h, F.lit(slots)).cast("int")


def _asked(telemetry: DataFrame) -> DataFrame:
    """(k_city, at, kind, fact, row) of a stream of telemetry; ``row`` is all of it as text."""
    row = F.to_json(F.struct(*telemetry.columns), {"ignoreNullFields": "false", "timestampFormat": _MICROS})
    return telemetry.select(F.col("city").alias("k_city"), F.col("timestamp").alias("at"), F.lit(ASK).alias("kind"), F.array().cast("array<double>").alias("fact"), row.alias("row"))


def _ends(ends: DataFrame) -> DataFrame:
    return ends.select(F.lit("").alias("k_city"), "at", F.lit(CLOSE).alias("kind"), F.array().cast("array<double>").alias("fact"), F.lit(None).cast("string").alias("row"))


def _given(out: DataFrame, telemetry: DataFrame, names: list[str]) -> DataFrame:
    """The telemetry columns of ``row`` and the named ones."""
    row = F.from_json("row", T.StructType(telemetry.schema.fields), {"timestampFormat": _MICROS})
    return out.select(row.alias("row"), *names).select("row.*", *names)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(kind, city, t, fact, row) of each row."""
    for b in batches:
        yield from zip(*[b[c].tolist() for c in ("kind", "k_city", "t", "fact", "row")], strict=True)


def _columns(rows: list[tuple], width: int) -> tuple[list, ...]:
    """Rows as one list a column: what a value of the state holds."""
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * width


def _by_city(facts: Iterable[tuple]) -> dict[str, list[tuple]]:
    """Facts (city, ...) as sorted lists a city."""
    out: dict[str, list[tuple]] = {}
    for city, *fact in facts:
        out.setdefault(city, []).append(tuple(fact))
    for own in out.values():
        own.sort()
    return out


# Labels --------------------------------------------------------------------------------------------------------------
class Labeller(StatefulProcessor):
    """Questions of one (slot, bucket of hours): a bit a target, set by the first incident of the city within the horizon."""

    def __init__(self, horizon_us: int, bucket_us: int):
        self.horizon, self.bucket = horizon_us, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asks = handle.getValueState("asks", "city array<string>, row array<string>, t array<long>, mask array<int>")
        self.facts = handle.getValueState("facts", "city array<string>, t array<long>, mask array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old_asks, old_facts = self.asks.get(), self.facts.get()
        asks = list(zip(*old_asks, strict=True)) if old_asks else []
        held = set(zip(*old_facts, strict=True)) if old_facts else set()
        new_asks, new_facts = [], set()
        for kind, city, t, fact, row in _rows(rows):
            if kind == ASK:
                new_asks.append((city, row, int(t), 0))
            elif kind == FACT:
                new_facts.add((city, int(t), int(fact[0])))
        new_facts -= held
        if not (asks or held) and (new_asks or new_facts):
            self.handle.registerTimer(((int(key[1]) + 1) * self.bucket + self.horizon) // 1000 + 1)
        done, wait = [], []
        # questions that stand have met the facts that stand
        for some, facts in ((asks, _by_city(new_facts)), (new_asks, _by_city(held | new_facts))):
            for city, row, t, mask in some:
                own = facts.get(city, ())
                for k in range(bisect.bisect_left(own, (t,)), len(own)):
                    if own[k][0] > t + self.horizon or mask == ALL:
                        break
                    mask |= own[k][1]
                (done if mask == ALL else wait).append((city, row, t, mask))
        if new_asks or len(wait) < len(asks) or (new_facts and asks):
            self.asks.update(_columns(wait, 4)) if wait else self.asks.clear()
        if new_facts:
            self.facts.update(_columns(sorted(held | new_facts), 3))
        if done:
            yield self.answer([a[1] for a in done], [a[3] for a in done])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asks = self.asks.get()
        self.asks.clear()
        self.facts.clear()
        if asks:
            yield self.answer(asks[1], asks[3])

    @staticmethod
    def answer(rows, masks) -> pd.DataFrame:
        return pd.DataFrame({"row": list(rows), "mask": list(masks)})

    def close(self) -> None:
        pass


def live_labels(telemetry: DataFrame, incidents: DataFrame, horizon_hours: int = 72, watermark: str = "1 hour", ends: DataFrame | None = None, bucket_hours: int = 6, slots: int = SLOTS) -> DataFrame:
    """Telemetry with the five 0/1 labels, one output row a telemetry row.

    A row is answered when all its targets have matched, else when its bucket of hours is ``horizon_hours`` old.  Incidents
    go to the buckets that they can label, so no (telemetry, incident) pairs are made.  A null city labels nothing.
    """
    horizon, bucket = horizon_hours * HOUR_US, bucket_hours * HOUR_US
    mask = F.lit(0)
    for k, t in enumerate(TARGET_COLUMNS):
        mask = mask.bitwiseOR(F.when(F.col(t), F.lit(1 << k)).otherwise(F.lit(0)))
    asks = _asked(telemetry).withColumn("bucket", F.floor(epoch_us("at") / F.lit(bucket)))
    facts = incident_groups(incidents).where("city IS NOT NULL").select(
        F.col("city").alias("k_city"), F.timestamp_micros("__ti").alias("at"), F.lit(FACT).alias("kind"), F.array(mask.cast("double")).alias("fact"), F.lit(None).cast("string").alias("row"),
        F.explode(F.sequence(F.floor((F.col("__ti") - horizon) / F.lit(bucket)), F.floor(F.col("__ti") / F.lit(bucket)))).alias("bucket"))
    line = asks.unionByName(facts)
    if ends is not None:
        line = line.unionByName(_ends(ends).withColumn("bucket", F.lit(0).cast("long")))
    line = line.withColumn("slot", _slot(slots)).withColumn("k_city", _name(F.col("k_city")))
    line = line.withWatermark("at", watermark).withColumn("t", epoch_us("at"))
    out = line.groupBy("slot", "bucket").transformWithStateInPandas(Labeller(horizon, bucket), "row string, mask int", "Append", "EventTime")
    return _given(out, telemetry, ["mask"]).select(*telemetry.columns, *[F.col("mask").bitwiseAND(1 << k).cast("boolean").cast("int").alias(t) for k, t in enumerate(TARGET_COLUMNS)])


# Answers in event-time order -----------------------------------------------------------------------------------------
class InOrder(StatefulProcessor):
    """Holds questions by their hour until the watermark has passed its end; then ``reply`` sees all that are due.

    Facts are held by day; ``fact_schema`` is one array a column, the city first, then the time.
    """

    fact_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asks = handle.getMapState("asks", "hour long", "city array<string>, row array<string>, t array<long>")
        self.facts = handle.getMapState("facts", "day long", self.fact_schema)
        self.width = self.fact_schema.count("array<")

    @staticmethod
    def add(state, key: tuple, rows: list[tuple], width: int) -> None:
        old = state.getValue(key) if state.containsKey(key) else ([],) * width
        state.updateValue(key, tuple(list(a) + b for a, b in zip(old, _columns(rows, width), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asks, facts = {}, {}
        for kind, city, t, fact, row in _rows(rows):
            if kind == ASK:
                asks.setdefault(int(t) // HOUR_US, []).append((city, row, int(t)))
            elif kind == FACT:
                facts.setdefault(int(t) // DAY_US, []).append((city, int(t), *map(self.kept, fact)))
        for day, own in facts.items():
            self.add(self.facts, (day,), own, self.width)
        for hour, own in asks.items():
            self.add(self.asks, (hour,), own, 3)
            self.handle.registerTimer((hour + 1) * HOUR_US // 1000 + 1)  # a timer that stands already stays one
        return iter(())

    @staticmethod
    def kept(x):
        return x

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The first of the timers that are due answers for all of them, so that facts are read once."""
        fired = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // HOUR_US - 1
        if not self.asks.containsKey((fired,)):
            return
        until = max(fired + 1, (timerValues.getCurrentWatermarkInMs() - 1) * 1000 // HOUR_US)
        due = []
        for hour in sorted(int(h[0]) for h in self.asks.keys()):
            if hour < until:
                due += zip(*self.asks.getValue((hour,)), strict=True)
                self.asks.removeKey((hour,))
        facts = {int(day[0]): list(zip(*held, strict=True)) for day, held in self.facts.iterator()}
        yield self.reply(due, facts)
        self.forget(facts, until * HOUR_US)

    def close(self) -> None:
        pass


class Newest(InOrder):
    """As-of matches: the newest observation at or before the question; of equal times the largest id.

    The newest ones of days that have gone by move to the day ``BASE``.
    """

    BASE = -(1 << 40)
    fact_schema = "city array<string>, t array<long>, id array<double>, a array<double>, b array<double>, c array<double>"

    def __init__(self, max_age_us: int | None):
        self.max_age = max_age_us

    @staticmethod
    def kept(x):
        return None if x is None or x != x else x  # pandas has NaN for null

    @staticmethod
    def place(fact: tuple) -> tuple:
        """Order of a city's (t, id, ...): no id comes first."""
        return fact[0], fact[1] is not None, fact[1] or 0

    def reply(self, due: list[tuple], facts: dict[int, list]) -> pd.DataFrame:
        cities: dict[str, list] = {}
        for f in itertools.chain.from_iterable(facts.values()):
            cities.setdefault(f[0], []).append(f[1:])
        for own in cities.values():
            own.sort(key=self.place)
        times = {c: [f[0] for f in own] for c, own in cities.items()}
        out = []
        for city, row, t in due:
            own = times.get(city, ())
            k = bisect.bisect_right(own, t) - 1
            f = cities[city][k] if k >= 0 and (self.max_age is None or t - own[k] <= self.max_age) else (None,) * 5
            out.append((row, *f))
        return pd.DataFrame(out, columns=["row", "o_t", "o_id", "o_a", "o_b", "o_c"]).astype({"o_t": "Int64"})

    def forget(self, facts: dict[int, list], until: int) -> None:
        past = [day for day in facts if day == self.BASE or (day + 1) * DAY_US <= until]
        if not any(day != self.BASE for day in past):
            return
        newest: dict[str, tuple] = {}
        for f in itertools.chain.from_iterable(facts[day] for day in past):
            if (f[0] not in newest or self.place(newest[f[0]][1:]) < self.place(f[1:])) and (self.max_age is None or f[1] >= until - self.max_age):
                newest[f[0]] = f
        for day in past:
            self.facts.removeKey((day,))
        if newest:
            self.facts.updateValue((self.BASE,), _columns(list(newest.values()), self.width))


class Trailing(InOrder):
    """Trailing counts: event times by kind and city; a count is the events up to the question less those before the window."""

    fact_schema = "city array<string>, t array<long>, kind array<int>"

    def __init__(self, days: list[int]):
        self.days = days

    @staticmethod
    def kept(x):
        return int(x)

    def reply(self, due: list[tuple], facts: dict[int, list]) -> pd.DataFrame:
        times: dict[tuple, list] = {}
        for city, t, kind in itertools.chain.from_iterable(facts.values()):
            times.setdefault((kind, city), []).append(t)
        for own in times.values():
            own.sort()
        out = {"row": [row for _, row, _ in due]}
        for k, days in enumerate(self.days):
            own = [times.get((k, city), ()) for city, _, _ in due]
            out[f"n{k}"] = [bisect.bisect_right(at, t) - bisect.bisect_left(at, t - days * DAY_US) for at, (_, _, t) in zip(own, due, strict=True)]
        return pd.DataFrame(out)

    def forget(self, facts: dict[int, list], until: int) -> None:
        for day in facts:
            if (day + 1) * DAY_US <= until - max(self.days) * DAY_US:
                self.facts.removeKey((day,))


def _ordered(telemetry: DataFrame, key, facts: DataFrame, processor: InOrder, made: str, shards: int, watermark: str, ends: DataFrame | None, slots: int) -> DataFrame:
    """Telemetry and the processor's columns; ``facts`` is (k_city, at, fact)."""
    shards = min(shards, slots)
    asks = _asked(telemetry).withColumn("k_city", key).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    line = asks.unionByName(facts.withColumns({"kind": F.lit(FACT), "row": F.lit(None).cast("string"), "shard": F.explode(F.lit(list(range(shards))))}))
    if ends is not None:
        line = line.unionByName(_ends(ends).withColumn("shard", F.lit(0)))
    line = line.withColumn("slot", _slot(slots, F.col("shard"))).withColumn("k_city", _name(F.col("k_city")))
    line = line.withWatermark("at", watermark).withColumn("t", epoch_us("at"))
    out = line.groupBy("slot").transformWithStateInPandas(processor, f"row string, {made}", "Append", "EventTime")
    return _given(out, telemetry, [c for c in out.columns if c != "row"])


def live_weather(telemetry: DataFrame, obs: DataFrame, max_age_hours: float | None = None, shards: int = 4, watermark: str = "1 hour", ends: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """J2 on streams: telemetry with the columns of ``weather.asof_weather`` (``obs_id`` is exact up to 2**53)."""
    facts = obs.where(F.col("city").isNotNull()).select(city_key("city").alias("k_city"), F.col("observed_at").alias("at"), F.array(
        *[F.col(c).cast("double") for c in ("obs_id", "external_temperature_c", "external_precipitation_mm", "external_wind_speed_kmh")]).alias("fact"))
    age = None if max_age_hours is None else int(max_age_hours * HOUR_US)
    out = _ordered(telemetry, city_key("k_city"), facts, Newest(age), "o_t long, o_id double, o_a double, o_b double, o_c double", shards, watermark, ends, slots)
    return out.select(*telemetry.columns, F.col("o_id").cast("long").alias("obs_id"), F.timestamp_micros("o_t").alias("observed_at"), F.col("o_a").alias("external_temperature_c"),
                      F.col("o_b").alias("external_precipitation_mm"), F.col("o_c").alias("external_wind_speed_kmh"))


def live_counts(telemetry: DataFrame, wanted: dict[str, tuple[DataFrame, int]], shards: int = 4, watermark: str = "1 hour", ends: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """Exact trailing counts; ``wanted`` as in ``labels.trailing_counts``, of streams."""
    facts = None
    for k, (events, _) in enumerate(wanted.values()):
        own = events.where(F.col("city").isNotNull()).select(F.col("city").alias("k_city"), F.col("timestamp").alias("at"), F.array(F.lit(float(k))).alias("fact"))
        facts = own if facts is None else facts.unionByName(own)
    days = [d for _, d in wanted.values()]
    out = _ordered(telemetry, F.col("k_city"), facts, Trailing(days), ", ".join(f"n{k} int" for k in range(len(days))), shards, watermark, ends, slots)
    return out.select(*telemetry.columns, *[F.col(f"n{k}").alias(n) for k, n in enumerate(wanted)])

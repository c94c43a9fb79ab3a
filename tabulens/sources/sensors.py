"""Synthetic sensor readings: sine plus noise, with injected anomalies and missing values, one reading per given id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import row_hash, unit_hash
from tabulens.plans.order_stats import kth_values

# Fixed values of the two demo machines.
MACHINES = {
    "first": {"start": "2024-01-01", "temperature": (70.0, 5.0, 4.0, 1.0), "pressure": (101.3, 0.5), "vibration": 0.5,
              "humidity": (55.0, 3.0), "current": (5.0, 0.3, 6.0, 0.2), "jump": 20.0, "shake": (5.0, 10.0), "surge": 3.0,
              "anomaly_share": 0.08, "missing_share": 0.01},
    "second": {"start": "2024-01-04", "temperature": (68.0, 4.0, 3.0, 1.2), "pressure": (100.8, 0.6), "vibration": 0.45,
               "humidity": (52.0, 4.0), "current": (4.8, 0.25, 5.0, 0.18), "jump": 18.0, "shake": (4.0, 9.0), "surge": 0.0,
               "anomaly_share": 1 / 15, "missing_share": 0.0},
}
MINUTES = 10
HUMIDITY_RANGE = (20.0, 90.0)


def normal(key: Column, seed: int) -> Column:
    """Standard normal number from two repeatable uniform ones (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(unit_hash(key, seed))) * F.cos(F.lit(2 * math.pi) * unit_hash(key, seed + 1))


def _chosen(df: DataFrame, key: Column, seeds: dict[str, int], shares: dict[str, float], n: int) -> dict[str, Column]:
    """Per name a flag that holds for exactly round(share * n) ids, those with the smallest hashes."""
    wanted = {name: round(shares[name] * n) for name in seeds}
    limits = kth_values(df, {m: (row_hash(key, seeds[m]), k, n) for m, k in wanted.items() if k})
    return {m: row_hash(key, seeds[m]) <= F.lit(limits[m][0]) if m in limits else F.lit(False) for m in seeds}


def sensor_readings(ids: DataFrame, key: str = "id", machine: str = "first") -> DataFrame:
    """Readings for ids 0..n-1 below 2^32 (the id is the position in time)."""
    m, k, n = MACHINES[machine], F.col(key), ids.count()
    phase = k / F.lit(float(max(n - 1, 1)))
    seeds = {"anomaly": 1, "temperature": 2, "pressure": 3, "humidity": 4}
    shares = {"anomaly": m["anomaly_share"], **{c: m["missing_share"] for c in ("temperature", "pressure", "humidity")}}
    hit = _chosen(ids, k, seeds, shares, n)
    bad = hit["anomaly"]

    def wave(spec, seed):
        base, height, half_turns, noise = spec
        return F.lit(base) + F.lit(height) * F.sin(F.lit(half_turns * math.pi) * phase) + F.lit(noise) * normal(k, seed)

    def sign(seed):
        return F.when(unit_hash(k, seed) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))

    low, high = m["shake"]
    temperature = wave(m["temperature"], 10) + F.when(bad, F.lit(m["jump"]) * sign(20)).otherwise(0.0)
    pressure = F.lit(m["pressure"][0]) + F.lit(m["pressure"][1]) * normal(k, 12)
    vibration = F.lit(-m["vibration"]) * F.log(unit_hash(k, 14)) + F.when(bad, F.lit(low) + F.lit(high - low) * unit_hash(k, 21)).otherwise(0.0)
    humidity = F.greatest(F.lit(HUMIDITY_RANGE[0]), F.least(F.lit(HUMIDITY_RANGE[1]), F.lit(m["humidity"][0]) + F.lit(m["humidity"][1]) * normal(k, 15)))
    current = wave(m["current"], 17) + F.when(bad, F.lit(m["surge"]) * sign(22)).otherwise(0.0)
    per_day = 24 * 60 // MINUTES
    day = F.timestamp_add("DAY", F.floor(k / F.lit(per_day)).cast("int"), F.lit(m["start"]).cast("timestamp_ntz"))
    when = F.timestamp_add("MINUTE", (F.pmod(k, F.lit(per_day)) * F.lit(MINUTES)).cast("int"), day)
    return ids.select(
        k,
        when.alias("timestamp"),
        F.when(~hit["temperature"], F.round(temperature, 2)).alias("temperature"),
        F.when(~hit["pressure"], F.round(pressure, 3)).alias("pressure"),
        F.round(vibration, 4).alias("vibration"),
        F.when(~hit["humidity"], F.round(humidity, 1)).alias("humidity"),
        F.round(current, 3).alias("current"),
        bad.cast("int").alias("anomaly"),
    )

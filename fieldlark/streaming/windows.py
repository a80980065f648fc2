"""Streaming twins: eight-day windows with a watermark, sessions, and a water balance that settles late days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def start_time(start: date, days: int = 8) -> str:
    """Offset that makes epoch-aligned windows begin at ``start``."""
    return f"{(start - date(1970, 1, 1)).days % days} days"


def eight_day(stream: DataFrame, keys: list[str], value: str, start: date, ts: str = "ts", late: str = "16 days", days: int = 8) -> DataFrame:
    """Median and count per key and window; data later than the watermark is left out, and so bounds the state."""
    held = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = held.groupBy(*keys, F.window(ts, f"{days} days", startTime=start_time(start, days)).alias("w")).agg(F.median(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.to_date("w.start").alias("window_start"), value, "n")


def sessions(df: DataFrame, keys: list[str], gap: str = "30 minutes", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of each key: first and last event's time and the number of events."""
    held = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        held = held.withWatermark(ts, late)
    return held.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


#: Days that the streaming balance keeps of each field, counted from its newest: one that comes later than that isn't settled.
KEEP = 60


def _ks(dr: float, taw: float, p: float) -> float:
    share = min(max(p, 0.0), 0.999999)
    return 1.0 if taw <= 0 or dr <= share * taw else min(max((taw - dr) / ((1 - share) * taw), 0.0), 1.0)


class Balance(StatefulProcessor):
    """Carries each field's last days from batch to batch; rows (field_id, date, et0, kc, rain, irrigation, taw, p).

    The state is the deficit before the oldest kept day and, of each kept day, its
    input and result. A day that comes late, or again with other values, takes its place among
    them; it and those after it are computed anew, and what has changed is handed
    out as a further revision. Days beyond ``keep`` are folded into the deficit
    and forgotten; a day as old as those is handed out unsettled, marked late.
    Missing rain and irrigation are none.
    """

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, read and written once a batch: each call is a round trip between Python and the JVM
        self.state = handle.getValueState("balance", "dr double, through int, days array<int>, held array<double>, revisions array<int>")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd  # only where it runs, as the driver can do without

        dr0, through, held = self._read()
        out, first = [], None
        for r in pd.concat(list(rows)).itertuples():
            if through is not None and r.date <= through:
                out.append((key[0], r.date, None, None, None, True))
                continue
            none = lambda x: 0.0 if pd.isna(x) else float(x)
            given = [float(r.et0), float(r.kc), max(none(r.rain), 0.0), none(r.irrigation), float(r.taw), float(r.p)]
            if r.date not in held or held[r.date][:6] != given:
                held[r.date] = [*given, None, None, held[r.date][8] if r.date in held else -1]
                first = r.date if first is None else min(first, r.date)
        order = sorted(held)
        if first is not None:
            at = order.index(first)
            dr = held[order[at - 1]][6] if at else dr0
            for day in order[at:]:
                et0, kc, rain, irrigation, taw, p, old_dr, old_ks, revision = held[day]
                ks = _ks(dr, taw, p)
                before = dr - rain - irrigation + ks * (kc * et0)
                dr = min(before + max(-before, 0.0), taw)
                if (dr, ks) != (old_dr, old_ks):
                    held[day] = [et0, kc, rain, irrigation, taw, p, dr, ks, revision + 1]
                    out.append((key[0], day, dr, ks, revision + 1, False))
        gone = [d for d in order if (order[-1] - d).days >= self.keep]
        if gone:
            dr0, through = held[gone[-1]][6], gone[-1]
        self._write(float(dr0), through, {d: held[d] for d in order[len(gone) :]})
        yield pd.DataFrame(out, columns=["field_id", "date", "dr", "ks", "revision", "late"]).astype({"revision": "Int32"})

    def _read(self):
        if not self.state.exists():
            return 0.0, None, {}
        dr0, through, days, held, revisions = self.state.get()
        day = date.fromordinal
        return dr0, None if through is None else day(through), {day(d): [*held[8 * i : 8 * i + 8], revisions[i]] for i, d in enumerate(days)}

    def _write(self, dr0: float, through: date | None, held: dict) -> None:
        flat = [float(x) for v in held.values() for x in v[:8]]
        self.state.update((dr0, None if through is None else through.toordinal(), [d.toordinal() for d in held], flat, [int(v[8]) for v in held.values()]))

    def close(self) -> None:
        pass


def water_balance(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """(field_id, date, dr, ks, revision, late) of each day as it comes, and of those that a late day changes.

    The last revision of a day holds. The session's state store has to be RocksDB's.
    """
    kind = stream.schema["field_id"].dataType.simpleString()
    if "irrigation" not in stream.columns:
        stream = stream.withColumn("irrigation", F.lit(0.0))
    return stream.groupBy("field_id").transformWithStateInPandas(Balance(keep), f"field_id {kind}, date date, dr double, ks double, revision int, late boolean", "append", "none")

"""Timestamps of many formats, precisions and zones as one instant in UTC.

A value is read into a wall-clock time and, if it has one, a zone. A stated offset, abbreviation
or zone gives the instant; a value without zone is aligned with the offset histories that its account may have:
of all offsets a history has around that time, the ones are kept whose instant shows the same wall-clock time again. One
instant left over all histories is a result; none (skipped by a clock change) or two (repeated by one, or histories
that disagree) are not.

An account with a zone has one history. For the others :func:`estimate_histories` aligns all values of the account with
each known history and counts its violations: wall-clock times that the history skips, instants after the row was received, neighbours
in a sequence that change places, and stated offsets that the history doesn't have at that instant. The histories with the fewest
violations are kept, and a value is converted where they agree, so two zones with one history need not be told apart.

Defined results: null, blank, impossible and incomplete values, dates alone, times alone, unknown zones and
instants outside the range give null; seconds left out are 0; digits finer than microseconds are rounded half up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from colloquy.operators import nested

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LOW = int(datetime(2015, 1, 1, tzinfo=timezone.utc).timestamp()) * 10**6
HIGH = int(datetime(2036, 1, 1, tzinfo=timezone.utc).timestamp()) * 10**6

# Zone abbreviations with their usual European, North American or Japanese meaning, minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540,
}

MONTHS = {
    name: month
    for month, names in enumerate(
        (
            "january jan januar janvier janv enero ene jänner", "february feb februar février févr fevrier febrero", "march mar märz mrz mär maerz mars marzo",
            "april apr avril avr abril abr", "may mai mayo", "june jun juni juin junio", "july jul juli juillet juil julio",
            "august aug août aout agosto ago", "september sep sept septembre septiembre", "october oct oktober okt octobre octubre",
            "november nov novembre noviembre", "december dec dezember dez décembre déc decembre diciembre dic",
        ),
        1,
    )
    for name in names.split()
}

CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?\s?[Mm]\.?(?![A-Za-z]))?"
ZONE = r"\s*(?P<z>[Zz]|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?(?:\s*\[[^\]]+\])?|\[?[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+\]?|\(?[A-Za-z]{1,5}\)?)?"
DAY = r"(?:[^\W\d]+\.?,?\s+)?"
FORMS = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[Tt_]|,?\s+){CLOCK}{ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt ](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<ap>)?{ZONE}",
        rf"{DAY}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er)?[\s-]+(?:de\s+)?(?P<mon>[^\W\d]+)\.?,?[\s-]+(?:de\s+)?(?P<y>\d{{4}}),?\s+(?:at\s+|um\s+|à\s+|a las\s+)?{CLOCK}{ZONE}",
        rf"{DAY}(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{CLOCK}{ZONE}",
        rf"(?P<a>\d{{1,2}})[/.\-](?P<b>\d{{1,2}})[/.\-](?P<y>\d{{4}}),?\s+{CLOCK}{ZONE}",
    )
]
NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


@lru_cache(maxsize=1024)
def zone_named(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def micros(t: datetime) -> int:
    """Microseconds since 1970 of a time with zone, without a float on the way."""
    return (t - EPOCH) // timedelta(microseconds=1)


@lru_cache(maxsize=65536)
def day_offsets(name: str, ordinal: int) -> tuple[int, ...]:
    """All offsets, in seconds, that a zone has within two days around a day."""
    zone = zone_named(name)
    noon = datetime.fromordinal(ordinal).replace(hour=12, tzinfo=timezone.utc)
    seen = {int((noon + timedelta(hours=h)).astimezone(zone).utcoffset().total_seconds()) for h in range(-40, 41, 4)}
    return tuple(sorted(seen))


def aligned(wall: datetime, name: str) -> list[int]:
    """The instants, in microseconds, at which clocks of the zone show ``wall``."""
    zone = zone_named(name)
    if zone is None:
        return []
    offsets, at = day_offsets(name, wall.toordinal()), micros(wall.replace(tzinfo=timezone.utc))
    if len(offsets) == 1:
        return [at - offsets[0] * 10**6]
    found = []
    for o in offsets:
        instant = wall.replace(tzinfo=timezone.utc) - timedelta(seconds=o)
        if instant.astimezone(zone).utcoffset() == timedelta(seconds=o):
            found.append(at - o * 10**6)
    return found


def number_micros(digits: str) -> int | None:
    """A bare number as seconds, milliseconds or microseconds, whichever lands in the range."""
    try:
        value = Decimal(digits)
    except ArithmeticError:
        return None
    if not value.is_finite():
        return None
    for power in (6, 3, 0):
        scaled = value.scaleb(power)
        if LOW <= scaled < HIGH:
            return int(scaled.to_integral_value(ROUND_HALF_UP))
    return None


def wall_clock(text: str, order: str | None) -> tuple[list[datetime], int, str | None] | None:
    """The wall-clock times that a text can mean (to the second), microseconds to add, and the zone's text."""
    m = None
    for form in FORMS:
        if m := form.fullmatch(text):
            break
    if m is None:
        return None
    g = m.groupdict()
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half in "Pp")
    year, days = int(g["y"]), []
    if "a" in g:
        a, b = int(g["a"]), int(g["b"])
        days = [(b, a)] if order == "dmy" else [(a, b)] if order == "mdy" else sorted({(a, b), (b, a)})
    elif "mon" in g:
        month = MONTHS.get(g["mon"].lower())
        if month is None:
            return None
        days = [(month, int(g["d"]))]
    else:
        days = [(int(g["m"]), int(g["d"]))]
    extra = int(Decimal(f"0.{g['f']}").scaleb(6).to_integral_value(ROUND_HALF_UP)) if g.get("f") else 0
    midnight = hour == 24 and not minute and not second and not extra and not half
    walls = []
    for month, day in days:
        try:
            walls.append(datetime(year, month, day, 0 if midnight else hour, minute, second) + timedelta(days=midnight))
        except (ValueError, OverflowError):
            pass
    return walls, extra, g["z"]


OFFSET = re.compile(r"(?:UTC|GMT)?([+\-−])(\d{1,2})(?::?(\d{2}))?(?:\s*\[([^\]]+)\])?")


def instants(wall: datetime, zone: str | None, histories: Sequence[str]) -> list[int]:
    """The instants, to the second in microseconds, that a wall-clock time and a zone's text can mean."""
    at = micros(wall.replace(tzinfo=timezone.utc))
    if not zone:
        return sorted({i for name in histories for i in aligned(wall, name)})
    if m := OFFSET.fullmatch(zone):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return []
        instant = at - (1 if m[1] == "+" else -1) * (hours * 60 + minutes) * 60 * 10**6
        if m[4]:  # an offset beside a zone picks one of the zone's instants
            return [instant] if instant in aligned(wall, m[4]) else []
        return [instant]
    name = zone.strip("[]()")
    if name.upper() in ABBREVIATIONS:
        return [at - ABBREVIATIONS[name.upper()] * 60 * 10**6]
    return aligned(wall, name) if "/" in name else []


def skipped_by_any(walls: Sequence[datetime], histories: Sequence[str]) -> bool:
    return any(not aligned(w, name) for w in walls for name in histories)


def utc_micros(text: str | None, histories: str | Sequence[str] | None = None, order: str | None = None) -> int | None:
    """The one instant that a value names, or None; ``histories`` are the zones that its account may have."""
    if text is None:
        return None
    text = " ".join(text.split())
    if NUMBER.fullmatch(text):
        return number_micros(text)
    read = wall_clock(text, order)
    if read is None:
        return None
    walls, extra, zone = read
    names = [histories] if isinstance(histories, str) else list(histories or ())
    if not zone and len(names) > 1 and skipped_by_any(walls, names):
        return None
    found = {i + extra for wall in walls for i in instants(wall, zone, names)}
    found = {i for i in found if LOW <= i < HIGH} if len(found) > 1 else found
    instant = found.pop() if len(found) == 1 else None
    return instant if instant is not None and LOW <= instant < HIGH else None


@F.pandas_udf(LongType())
def utc_micros_udf(text: pd.Series, histories: pd.Series, order: pd.Series) -> pd.Series:
    none = lambda x: x if isinstance(x, str) else None
    return pd.Series([utc_micros(none(t), [] if h is None else [x for x in h if x], none(o)) for t, h, o in zip(text, histories, order)], dtype="Int64")


def export_times(exports: DataFrame) -> DataFrame:
    """uuid, account and created_at of each chat record, as their literals, with the time of receipt of its file."""
    rows = nested.objects(exports, wanted=r"(?:^|[.\]])(?:uuid|account\.user_id|created_at)$").where("table_path = ''")
    leaf = lambda name: F.col("leaves")[name]
    return rows.select("path", F.col("conv_uuid").alias("rec_key"), leaf("account.user_id").alias("user"), leaf("created_at").alias("value"))


def stated_histories(accounts: DataFrame) -> DataFrame:
    """account_id, histories and date order: the one zone of each account that has one. accounts is one row per account."""
    zone = F.trim("tz_name")
    return accounts.select("account_id", F.when(zone != "", F.array(zone)).alias("histories"), F.lower(F.trim("date_order")).alias("date_order")).dropDuplicates(["account_id"])


def converted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: src, rec_key, account_id, value; known: account_id, histories, date_order. Adds utc_us, null where there is no one instant.

    ``known`` has one row per account; Spark broadcasts it only while its measured size is below the session's threshold.
    """
    return rows.join(known, "account_id", "left").withColumn("utc_us", utc_micros_udf("value", "histories", "date_order"))


def snapshot_times(headers: DataFrame) -> DataFrame:
    """src, rec_key, account_id, value of the headers' updates, which are bare numbers."""
    return headers.select(F.lit("snapshot").alias("src"), F.col("conv_id").cast("string").alias("rec_key"), F.lit(None).cast("bigint").alias("account_id"), plain_double("updated_at").alias("value"))


def snapshots(headers: DataFrame) -> DataFrame:
    """What :func:`found` finds in headers alone; bare numbers need no account."""
    none = F.array().cast("array<string>")
    rows = snapshot_times(headers).where("rec_key is not null and value is not null").distinct()
    return rows.withColumn("utc_us", utc_micros_udf("value", none, F.lit(None).cast("string"))).where("utc_us is not null").select("src", "rec_key", "utc_us").distinct()


def gather(exports: DataFrame, activity: DataFrame, headers: DataFrame) -> DataFrame:
    """The timestamps of the three sources as src, rec_key, account_id, value; repeated records once."""
    claude = export_times(exports).select(F.lit("claude").alias("src"), "rec_key", F.expr("try_cast(trim(user) as bigint)").alias("account_id"), "value")
    gemini = activity.select(F.lit("gemini").alias("src"), F.col("activity_id").cast("string").alias("rec_key"), "account_id", F.col("time_text").alias("value"))
    rows = claude.unionByName(gemini).unionByName(snapshot_times(headers))
    return rows.where(F.col("rec_key").isNotNull() & F.col("value").isNotNull()).distinct()


def plain_double(name: str) -> Column:
    """A double as the shortest digits that read back the same."""
    return F.col(name).cast("string")


def found(exports: DataFrame, activity: DataFrame, headers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Records whose value names one instant; an account without a stated zone has no history here, so its zoneless values name none."""
    rows = converted(gather(exports, activity, headers), stated_histories(accounts))
    return rows.where("utc_us is not null").select("src", "rec_key", "utc_us").distinct()


# ---- accounts without a zone


def observed(exports: DataFrame, activity: DataFrame) -> DataFrame:
    """account_id, value, received_us of the records that have an account, once each."""
    files = exports.select("path", F.unix_micros(F.to_timestamp("received_at")).alias("received_us"))
    claude = export_times(exports).join(files, "path").select(F.lit("claude").alias("src"), "rec_key", F.expr("try_cast(trim(user) as bigint)").alias("account_id"), "value", "received_us")
    gemini = activity.select(F.lit("gemini").alias("src"), F.col("activity_id").cast("string").alias("rec_key"), "account_id", F.col("time_text").alias("value"), F.unix_micros(F.to_timestamp("received_at")).alias("received_us"))
    rows = claude.unionByName(gemini).where("rec_key is not null and account_id is not null and value is not null")
    return rows.groupBy("src", "rec_key", "account_id", "value").agg(F.min("received_us").alias("received_us"))


def offset_stated(wall: datetime, zone: str) -> tuple[int, int] | None:
    """Instant (microseconds) and offset (seconds) of a value with an offset or abbreviation; None for UTC, which servers write for any zone."""
    at = micros(wall.replace(tzinfo=timezone.utc))
    got = instants(wall, zone, ())
    if len(got) != 1 or got[0] == at:
        return None
    return got[0], (at - got[0]) // 10**6


def offset_at(instant: int, name: str) -> int:
    return int((EPOCH + timedelta(microseconds=instant)).astimezone(zone_named(name)).utcoffset().total_seconds())


def violations(text: str, order: str | None, received: int | None, before: str | None, names: Sequence[str]) -> list[int] | None:
    """What a value has against each history; None if it says nothing. ``before``: the value that precedes it in a sequence."""
    read = wall_clock(" ".join(text.split()), order)
    if read is None or not read[0]:
        return None
    walls, extra, zone = read
    if zone:
        stated = offset_stated(walls[0], zone)
        return [int(offset_at(stated[0], n) != stated[1]) for n in names] if stated and len(walls) == 1 else None
    out = []
    for name in names:
        own = [i for w in walls for i in aligned(w, name)]
        bad = int(not own or received is not None and min(own) + extra > received)
        if before is not None and len(own) == 1:
            earlier = utc_micros(before, name, order)
            bad += int(earlier is not None and earlier > own[0] + extra)
        out.append(bad)
    return out


def estimate_histories(rows: DataFrame, accounts: DataFrame, sequence: str | None = None) -> DataFrame:
    """account_id, histories (those with the fewest violations), violations, values_seen, date_order of each account without a zone.

    rows: account_id, value, received_us and, if ``sequence`` names one, a column in whose order the instants of an account should rise.
    The candidates are the zones of ``accounts``, of which there are no more than zones in the world. Violations are
    summed by account and history in each task before anything is exchanged, so a hot account costs one row per history and task; only a
    sequence brings the values of an account together, sorted.
    """
    zone = F.trim("tz_name")
    names = accounts.where(zone != "").agg(F.array_sort(F.collect_set(zone)).alias("zones"))
    unknown = accounts.where(F.coalesce(zone, F.lit("")) == "").select("account_id", F.lower(F.trim("date_order")).alias("date_order")).dropDuplicates(["account_id"])
    before = F.lag("value").over(Window.partitionBy("account_id").orderBy(sequence)) if sequence else F.lit(None).cast("string")
    seen = rows.join(unknown, "account_id").select("account_id", "value", "date_order", "received_us", before.alias("before"), names.scalar().alias("zones"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total: dict[int, list] = {}
            for account, text, order, received, earlier, zones in frame.itertuples(index=False):
                zones = [z for z in zones if zone_named(z)] if zones is not None else []
                bad = violations(text, order if isinstance(order, str) else None, None if pd.isna(received) else int(received), earlier if isinstance(earlier, str) else None, zones)
                if bad is None or not zones:
                    continue
                if account in total:
                    t = total[account]
                    t[0] += 1
                    t[1] = [x + y for x, y in zip(t[1], bad)]
                else:
                    total[account] = [1, bad, zones]
            yield pd.DataFrame([(a, z, n, b) for a, (n, bad, zones) in total.items() for z, b in zip(zones, bad)], columns=["account_id", "zone", "n", "bad"])

    scored = seen.mapInPandas(run, "account_id long, zone string, n long, bad long").groupBy("account_id", "zone").agg(F.sum("n").alias("values_seen"), F.sum("bad").alias("violations"))
    by_score = scored.groupBy("account_id", "violations").agg(F.array_sort(F.collect_list("zone")).alias("histories"), F.max("values_seen").alias("values_seen"))
    best = by_score.groupBy("account_id").agg(F.min(F.struct("violations", "histories", "values_seen")).alias("b"))
    return best.join(unknown, "account_id").select("account_id", "b.histories", "b.violations", "b.values_seen", "date_order")


def estimated(exports: DataFrame, activity: DataFrame, headers: DataFrame, accounts: DataFrame) -> DataFrame:
    """src, rec_key, utc_us of the zoneless values of accounts without a zone that all best histories put at one instant."""
    known = estimate_histories(observed(exports, activity), accounts).select("account_id", "histories", "date_order")
    none = F.array().cast("array<string>")
    rows = gather(exports, activity, headers).join(known, "account_id").withColumn("utc_us", utc_micros_udf("value", "histories", "date_order")).withColumn("stated", utc_micros_udf("value", none, "date_order"))
    return rows.where("utc_us is not null and stated is null").select("src", "rec_key", "utc_us").distinct()

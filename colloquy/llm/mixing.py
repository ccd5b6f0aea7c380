"""Mixing sources to target weights.

Unless a size is asked for, the mix is as large as the scarcest source allows: with shares ``w`` of the usable sources, supplies ``s`` and caps
``r`` on repeats it has ``min(r * s / w)`` tokens, so each source gets its share and no document more than its cap of uses. With a size, each
source gets its share of it as far as its supply and cap reach, and the shortfall is reported. A source
is laid out as its documents in hash order, pass after pass, and used up to its target; the last document is taken if at least half of it fits.

The order of the mix is a Pfair schedule. Each source's layout is cut into blocks of equal size; block ``j`` of a source with share ``w`` is released
at ``floor(j / w)`` and due at ``ceil((j + 1) / w)``; in each slot the released block with the earliest deadline runs. After any number of
slots each source is less than one block away from its share. There are at least ``BLOCKS`` slots, and so many that the smallest share gets
one, up to ``MOST_BLOCKS``; this depends on the weights alone, so the schedule is made on the driver. A source with a share below one in ``MOST_BLOCKS``
may get none; it has all its uses in the last slot.

Running totals within a source are taken in two levels, within hash buckets and over the buckets' sums, so a source with
a third of all documents is spread over ``BUCKETS`` groups.

Defined results: sources without documents or tokens, without weight, with a weight of 0 or less, or a cap below 1 get nothing, and the other weights
make up the whole; documents of unlisted or null sources aren't used; a null cap is 1; a source listed twice counts with its largest weight;
empty and null texts have no tokens and aren't used.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.common import checkpointed
from colloquy.llm import tokenizer

BUCKETS = 1024
BLOCKS = 10_000
#: The schedule never has more slots; it is broadcast.
MOST_BLOCKS = 1_000_000
#: At most so many sources are brought to the driver.
SOURCE_BOUND = 10_000


def schedule(weights: dict[str, Fraction], slots: int) -> list[tuple[str, int]]:
    """Source and block of each slot: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    share = {s: w / total for s, w in weights.items() if w > 0}
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((j + 1) / share[s]), s, j))
        if not ready:
            break
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        heapq.heappush(waiting, (max(t + 1, math.floor((j + 1) / share[s])), s, j + 1))
    return out


def supplies(counts: DataFrame, targets: DataFrame) -> list[dict]:
    """weight, cap, tokens and documents of each listed source."""
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    have = counts.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = listed.join(have, "source", "left").limit(SOURCE_BOUND + 1).collect()
    if len(rows) > SOURCE_BOUND:
        raise ValueError(f"more than {SOURCE_BOUND} sources")
    return sorted((r.asDict() for r in rows), key=lambda r: r["source"])


def plan(sources: list[dict], wanted: int | None = None) -> list[dict]:
    """Adds share, target and shortfall (in tokens) to each source; all 0 where it can't be used. ``wanted``: the size of the mix."""
    usable = [s for s in sources if s["tokens"] and s["weight"] and s["weight"] > 0 and not math.isinf(s["weight"]) and s["cap"] >= 1]
    total = sum(Fraction(s["weight"]) for s in usable)
    for s in sources:
        s["share"] = Fraction(s["weight"]) / total if s in usable else Fraction(0)
    size = Fraction(wanted) if wanted is not None else min((s["cap"] * s["tokens"] / s["share"] for s in usable), default=Fraction(0))
    for s in sources:
        s["target"] = min(s["share"] * size, Fraction(s["cap"] * s["tokens"])) if s in usable else Fraction(0)
        s["shortfall"] = s["share"] * size - s["target"]
    return sources


def slots_for(sources: list[dict]) -> int:
    """So many that every source gets one, within the bounds."""
    least = min((s["target"] for s in sources if s["target"] > 0), default=None)
    return BLOCKS if least is None else min(MOST_BLOCKS, max(BLOCKS, math.ceil(sum(s["target"] for s in sources) / least)))


def laid_out(counts: DataFrame) -> DataFrame:
    """source, doc_id, tokens and the tokens before it in its source, in hash order."""
    rows = counts.where("tokens > 0 and source is not null").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("base"))
    rows = rows.withColumn("upto", F.sum("tokens").over(inside)).join(sums, ["source", "bucket"])
    return rows.select("source", "doc_id", "tokens", (F.col("base") + F.col("upto") - F.col("tokens")).alias("start"))


def counted(documents: DataFrame) -> DataFrame:
    """source, doc_id and tokens of each document, written once."""
    return checkpointed(tokenizer.counted(documents, ["doc_id", "source"]))


def mixed(documents: DataFrame, targets: DataFrame, blocks: int | None = None, wanted: int | None = None) -> tuple[DataFrame, list[dict]]:
    """The uses of documents in the mix, with the slot of each, and the plan."""
    counts = counted(documents)
    planned = plan(supplies(counts, targets), wanted)
    blocks = blocks or slots_for(planned)
    used = [s for s in planned if s["target"] > 0]
    spark = documents.sparkSession
    size = float(sum(s["target"] for s in used)) / blocks if used else 1.0
    slots = schedule({s["source"]: s["target"] for s in used}, blocks)
    last: dict[str, int] = {}
    for s, j in slots:
        last[s] = max(j, last.get(s, 0))
    # both frames are bounded by the parameters, not by the data: SOURCE_BOUND rows and at most MOST_BLOCKS rows
    bounds = spark.createDataFrame([(s["source"], int(s["tokens"]), float(s["target"]), int(s["cap"]), last.get(s["source"], 0)) for s in used], "source string, supply long, target double, cap int, last_block int")
    times = spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(slots)], "source string, block int, slot int")
    rows = laid_out(counts).join(F.broadcast(bounds), "source")
    fits = F.floor((F.col("target") - F.col("start") - F.col("tokens") / 2) / F.col("supply")) + 1
    rows = rows.withColumn("copies", F.greatest(F.lit(0), F.least(fits, F.col("cap"))).cast("int")).where("copies > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    at = F.col("start") + (F.col("copy") - 1) * F.col("supply")
    rows = rows.withColumn("at", at).withColumn("block", F.least(F.floor(F.col("at") / F.lit(size)), F.col("last_block")).cast("int"))
    rows = rows.join(F.broadcast(times), ["source", "block"], "left").withColumn("slot", F.coalesce("slot", F.lit(blocks - 1)))
    return rows.select("slot", "source", "at", "doc_id", "copy", "tokens"), planned


def mix(documents: DataFrame, targets: DataFrame, wanted: int | None = None) -> DataFrame:
    """slot, source, at (place in the source's layout), doc_id, copy, tokens; the order of the mix is slot, source, at."""
    return mixed(documents, targets, wanted=wanted)[0]


def shares(documents: DataFrame, targets: DataFrame, wanted: int | None = None) -> DataFrame:
    """The share each listed source was to get and has got, its supply, and the tokens it lacks of its share of the wanted size."""
    rows, planned = mixed(documents, targets, wanted=wanted)
    got = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"), F.max("copy").alias("most_uses"))
    wanted = rows.sparkSession.createDataFrame([(s["source"], s["weight"], s["cap"], float(s["share"]), int(s["tokens"] or 0), int(s["shortfall"])) for s in planned], "source string, target_weight double, max_repeats int, target_share double, supply_tokens long, shortfall_tokens long")
    total = Window.partitionBy(F.lit(1))  # over the listed sources
    out = wanted.join(got, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    return out.withColumn("actual_share", F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(total)))


def invariants(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each listed source: no document is used more often than its cap, all used documents are its own, and its tokens are within one document of the target."""
    rows, planned = mixed(documents, targets)
    owners = documents.select("doc_id", F.col("source").alias("owner")).distinct()
    own = rows.join(owners, "doc_id").groupBy("source").agg(F.bool_and(F.col("owner").eqNullSafe(F.col("source"))).alias("own_documents"))
    got = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.max("copy").alias("most"))
    wanted = rows.sparkSession.createDataFrame([(s["source"], s["cap"], float(s["target"])) for s in planned], "source string, cap int, target double")
    out = wanted.join(got, "source", "left").join(own, "source", "left").fillna(0, ["tokens", "largest", "most"]).fillna(True, ["own_documents"])
    return out.select("source", (F.col("most") <= F.greatest("cap", F.lit(0))).alias("within_cap"), "own_documents", (F.abs(F.col("tokens") - F.col("target")) <= F.col("largest")).alias("target_kept"))

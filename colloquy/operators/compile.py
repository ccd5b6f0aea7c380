"""Compiling conversations to a final note by an injected text function: map over chunks, merge in rounds, finish, shorten once if need be.

A backend is a function ``complete(model, system, user, stage) -> str``, registered by name once. Chunks are rows, so the map stage is one pass over all
conversations; each round of merging groups the notes of all conversations at once. Nothing is called over a network here.

Work goes on where an earlier run stopped: its state is the hashes it has read and the notes it has made, and a conversation whose hashes
are a prefix of the present ones keeps its notes and maps only the messages behind them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from colloquy.common import checkpointed
from colloquy.functions import text as T
from colloquy.operators import chunking, folds, integrity
from colloquy.operators.counters import CharacterCounter

Backend = Callable[[str, str, str, str], str]
_backends: dict[str, Backend] = {}
JOINER = "\n\n"
# What a backend is told at each stage, in our own words.
SYSTEM = {
    "map": "You read one part of a longer conversation and note what somebody who carries on needs: aims, decisions, facts, open points.",
    "merge": "You merge notes on successive parts of one conversation into a shorter note. Keep their order and lose no open point.",
    "final": "You write one text from which a new assistant can carry on the conversation that the notes are about.",
    "budget": "You shorten a text to a given size. Drop background first, open points last.",
}


def register(name: str, backend: Backend) -> None:
    """A name is lower case letters, digits, ``-`` and ``_``, and is registered once."""
    if not re.fullmatch(r"[a-z][a-z0-9_-]{0,63}", name):
        raise ValueError("unsafe backend name")
    if name in _backends:
        raise ValueError("backend registered already")
    _backends[name] = backend


def backend(name: str) -> Backend:
    if name not in _backends:
        raise ValueError("unknown backend")
    return _backends[name]


def model_name(name: object, longest: int = 256) -> str:
    """A model's name as it stands; ValueError if it is empty, too long or has white space or control characters."""
    if not isinstance(name, str) or not 0 < len(name) <= longest or re.search(r"[\s\x00-\x1f\x7f]", name):
        raise ValueError("unusable model name")
    return name


def service_base(url: object) -> str:
    """The base address of a service without a slash at its end; ValueError unless it is plain http or https without user, query, fragment or steps upwards."""
    try:
        parts = urlsplit(url) if isinstance(url, str) and not re.search(r"[\s\\\x00-\x1f\x7f]", unquote(unquote(url))) else None
        sound = parts is not None and parts.scheme in ("http", "https") and parts.hostname and parts.username is None and parts.password is None and not parts.query and not parts.fragment and (parts.port or True)
    except ValueError:
        sound = False
    if not sound or {".", ".."} & set(unquote(unquote(parts.path)).split("/")) or "%25" in parts.path:
        raise ValueError("unusable address")
    return urlunsplit((parts.scheme, parts.netloc, parts.path.rstrip("/"), "", ""))


def outline(model: str, system: str, user: str, stage: str) -> str:
    """A deterministic stand-in for a model: the stage, the length and the last line."""
    return f"{stage}:{len(user)}:{user.strip().rpartition(chr(10))[2][:60]}"


register("outline", outline)


def completed(rows: DataFrame, name: str, model: str, stage: str) -> DataFrame:
    """conv_id, part, text with each text replaced by the backend's answer."""
    call, system = backend(name), SYSTEM[stage]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [call(model, system, t, stage) for t in batch.column(2).to_pylist()]
            if any(not isinstance(a, str) for a in answers):
                raise TypeError("a backend gives text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.string())], ["conv_id", "part", "text"])

    return rows.select("conv_id", F.col("part").cast("long").alias("part"), "text").mapInArrow(run, "conv_id long, part long, text string")


def joined(rows: DataFrame, group: str, order: str, separator: str) -> DataFrame:
    """The texts of each conversation and group in order; a group is bounded by the size it was made for, or is one text."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.groupBy("conv_id", group).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text")).withColumnRenamed(group, "part")


def mapped(canon: DataFrame, name: str, model: str = "", chunk_chars: int = 120_000, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """conv_id, part, text: the notes on the chunks of each conversation, those of an earlier run first.

    state: the hashes (conv_id, idx, hash) and notes (conv_id, part, text) of the earlier run.
    """
    rows = canon.select("conv_id", "idx", T.message_block("idx", "role", "text").alias("text"))
    kept = None
    if state is not None:
        hashes = integrity.hashed(canon).select("conv_id", "idx", "hash")
        start = chunking.resume(state[0], hashes).select("conv_id", "start", "resumed")
        known = state[1].groupBy("conv_id").agg((F.max("part") + 1).alias("first_part"))
        start = start.join(known, "conv_id", "left").select("conv_id", "start", F.when(F.col("resumed"), F.coalesce("first_part", F.lit(0))).otherwise(0).alias("first_part"), "resumed")
        rows = rows.join(start, "conv_id").where("idx >= start").drop("start", "resumed")
        kept = state[1].join(start.where("resumed").select("conv_id"), "conv_id", "left_semi").select("conv_id", F.col("part").cast("long").alias("part"), "text")
    else:
        rows = rows.withColumn("first_part", F.lit(0))
    rows = folds.running(rows.withColumn("size", F.length("text").cast("bigint")), "conv_id", ["idx"], "size", chunking.greedy(chunk_chars), "chunk")
    chunks = joined(rows.withColumn("chunk", F.col("chunk") + F.col("first_part")), "chunk", "idx", "")
    of = Window.partitionBy("conv_id")
    label = F.concat(F.lit("Part "), (F.col("part") - F.min("part").over(of) + 1).cast("string"), F.lit(" of "), F.count("*").over(of).cast("string"), F.lit(" of a conversation.\n"))
    notes = completed(chunks.withColumn("text", F.concat(label, "text")), name, model, "map")
    return notes if kept is None else kept.unionByName(notes)


def merged(notes: DataFrame, name: str, model: str, reduce_chars: int) -> DataFrame:
    """The notes, merged in rounds until those of each conversation fit together; ``stalled`` where a round made them neither fewer nor shorter."""
    notes = checkpointed(notes.withColumn("stalled", F.lit(False)))
    while True:
        sizes = notes.groupBy("conv_id").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + len(JOINER) * (F.count("*") - 1)).alias("chars"), F.bool_or("stalled").alias("stopped"))
        large = sizes.where(f"n > 1 and chars > {reduce_chars} and not stopped").select("conv_id", "n", "chars")
        if large.isEmpty():
            return notes
        sized = notes.drop("stalled").join(large.select("conv_id"), "conv_id").withColumn("size", F.length("text").cast("bigint"))
        grouped = folds.running(sized, "conv_id", ["part"], "size", chunking.greedy(reduce_chars), "bundle")
        bundles = joined(grouped.drop("size"), "bundle", "part", JOINER).withColumn("text", F.concat(F.lit("Notes in their order:\n\n"), "text"))
        after = completed(bundles, name, model, "merge")
        now = after.groupBy("conv_id").agg(F.count("*").alias("n2"), (F.sum(F.length("text")) + len(JOINER) * (F.count("*") - 1)).alias("chars2"))
        stalled = large.join(now, "conv_id").select("conv_id", ((F.col("n2") >= F.col("n")) & (F.col("chars2") >= F.col("chars"))).alias("stalled"))
        notes = checkpointed(notes.join(large, "conv_id", "left_anti").unionByName(after.join(stalled, "conv_id").select("conv_id", "part", "text", "stalled")))


def counted(text: Column, counter) -> Column:
    """Tokens of a text: in the JVM by characters, otherwise by the counter."""
    if isinstance(counter, CharacterCounter):
        return T.token_estimate(F.length(text), counter.per_token)
    count = F.pandas_udf(lambda texts: texts.map(counter.count).astype("int64"), "long")
    return count(text)


def compiled(
    canon: DataFrame, name: str, titles: DataFrame | None = None, map_model: str = "", final_model: str = "", chunk_chars: int = 120_000, reduce_chars: int = 180_000, budget_tokens: int | None = None, profile: str | None = None,
    counter=CharacterCounter(), state: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The final text of each conversation and its report; texts over the budget are shortened once and reported, never cut. titles: conv_id, title."""
    if budget_tokens is not None and profile is not None:
        raise ValueError("give a budget or a profile")
    if profile is not None and profile not in T.PROFILES:
        raise ValueError("unknown profile")
    budget = T.PROFILES[profile] if profile else budget_tokens
    if budget is not None and budget <= 0:
        raise ValueError("a budget is positive")
    notes = merged(mapped(canon, name, map_model, chunk_chars, state), name, map_model, reduce_chars)
    counts = notes.groupBy("conv_id").agg(F.count("*").alias("notes"), F.bool_or("stalled").alias("merge_stalled"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")).cast("string")
    numbered = notes.select("conv_id", "part", F.concat(F.lit("## Note "), number, F.lit("\n"), "text").alias("text"), F.lit(0).alias("all"))
    task = "Write the text from these notes.\n\n" if budget is None else f"Write the text from these notes, in at most {budget} tokens as counted by {counter.name}.\n\n"
    final = completed(joined(numbered, "all", "part", JOINER).withColumn("text", F.concat(F.lit(task), "text")), name, final_model, "final").select("conv_id", "text", F.lit(False).alias("shortened"))
    final = final.withColumn("tokens", counted(F.col("text"), counter))
    if budget is not None:
        final = checkpointed(final)
        longer = final.where(F.col("tokens") > budget)
        head = F.concat(F.lit(f"At most {budget} tokens as counted by {counter.name}; now there are "), F.col("tokens").cast("string"), F.lit(".\n\n"))
        shorter = completed(longer.select("conv_id", F.lit(0).alias("part"), F.concat(head, "text").alias("text")), name, final_model, "budget")
        final = final.where(F.col("tokens") <= budget).unionByName(shorter.select("conv_id", "text", F.lit(True).alias("shortened"), counted(F.col("text"), counter).alias("tokens")))
    chars = canon.groupBy("conv_id").agg(F.sum(T.block_length("idx", "role", "text")).alias("chars"))
    if titles is not None:
        chars = chars.join(titles, "conv_id", "left").withColumn("chars", F.col("chars") + F.when(F.coalesce("title", F.lit("")) != "", F.length("title") + 3).otherwise(0)).drop("title")
    source = T.token_estimate("chars", counter.per_token) if isinstance(counter, CharacterCounter) else F.lit(None).cast("bigint")
    over = F.greatest(F.lit(0), F.col("tokens") - F.lit(budget)) if budget is not None else F.lit(0)
    met = (over == 0) if budget is not None else F.lit(None).cast(BooleanType())
    return final.join(counts, "conv_id").join(chars, "conv_id").select(
        "conv_id", "notes", "text", F.lit(counter.name).alias("tokenizer"), F.lit(counter.exact).alias("tokenizer_exact"), F.lit(profile).cast("string").alias("profile"), F.lit(budget).cast("int").alias("budget_tokens"),
        source.alias("source_token_estimate"), F.col("tokens").alias("output_token_estimate"), F.try_divide(F.col("tokens"), source).alias("compression_ratio"), over.cast("bigint").alias("budget_overrun_tokens"), met.alias("budget_met"),
        F.col("shortened").alias("budget_reduction_applied"), "merge_stalled",
    )

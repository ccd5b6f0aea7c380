"""Rebuilt conversations against a plain loop over random event logs, with blocks small enough to matter."""

import random
from datetime import datetime, timedelta

from colloquy.llm import conversations as X

SCHEMA = "row_id long, conv_id long, msg_index int, role string, sender string, text string, received_at timestamp_ntz, pos int"


def who(x):
    x = (x or "").strip().lower()
    return "user" if x == "human" else x if x in ("", "user", "assistant", "system", "tool") else "?"


def brute(rows):
    out = set()
    for conv in {r[1] for r in rows} - {None}:
        own = [r for r in rows if r[1] == conv]
        if any(r[2] is None for r in own):
            continue
        held = {}
        for r in own:
            if r[2] not in held or (r[6], r[0]) > (held[r[2]][6], held[r[2]][0]):
                held[r[2]] = r
        at = sorted(held)
        said = {i: who(held[i][3]) or who(held[i][4]) for i in at}
        clear = all(said[i] not in ("", "?") and (not who(held[i][3]) or not who(held[i][4]) or who(held[i][3]) == who(held[i][4])) for i in at)
        turns = [i for i in at if said[i] in ("user", "assistant")]
        if at[0] not in (0, 1) or at != list(range(at[0], at[0] + len(at))) or not clear or not turns or len(turns) % 2:
            continue
        if any(said[i] != ("user", "assistant")[k % 2] for k, i in enumerate(turns)) or any(not (held[i][5] or "").strip() for i in turns):
            continue
        out |= {(conv, k, said[i], held[i][0]) for k, i in enumerate(turns)}
    return out


def test_random_logs(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BITS", 1)
    rng, rows, start = random.Random(7), [], datetime(2025, 1, 1)
    for conv in range(400):
        n, first, p = rng.randint(1, 9), rng.choice([0, 0, 1, 2]) if rng.random() < 0.3 else 0, rng.choice([0, 0, 0.08])
        k = 0
        for i in range(first, first + n):
            name = "system" if rng.random() < 0.1 else ("user", "assistant")[k % 2]
            k += name != "system"
            for _ in range(rng.choice([1, 1, 2])):
                role, sender = rng.choice([(name, None), (None, name.title()), (f" {name.upper()} ", name), (name, "human" if name == "user" else name)])
                if rng.random() < p:
                    role, sender = rng.choice([("bot", None), (None, None), ("user", "assistant"), ("", " ")])
                text = rng.choice(["", None, " \n"]) if rng.random() < p else "text"
                rows.append((len(rows), conv, None if rng.random() < p / 4 else i, role, sender, text, start + timedelta(seconds=rng.randint(0, 3)), 0))
    rows.append((10**6, None, 0, "user", None, "lost", start, 0))
    got = {tuple(r) for r in X.rebuilt(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len({g[0] for g in got}) > 50


def test_empty_table_and_hot_conversation(spark):
    assert X.rebuilt(spark.createDataFrame([], SCHEMA)).count() == 0
    start = datetime(2025, 1, 1)
    rows = [(i, 1, i, ("user", "assistant")[i % 2], None, "t", start, 0) for i in range(20_000)]
    got = X.rebuilt(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.pos for r in got) == list(range(20_000))


def test_the_log_is_read_and_folded_once(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as row_id", "id div 4 as conv_id", "cast(id % 4 as int) as msg_index", "if(id % 2 = 0, 'user', 'assistant') as role", "'' as sender", "'x' as text", "timestamp_ntz'2025-01-01 00:00:00' as received_at")
    rows.write.parquet(str(tmp_path / "rows"))
    frame = X.rebuilt(spark.read.parquet(str(tmp_path / "rows")))
    assert len(frame.collect()) == 1000
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1

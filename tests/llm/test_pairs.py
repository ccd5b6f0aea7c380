"""Broken pairs on made-up cases of each defect and of what resembles it."""

import random

import pytest

from colloquy.llm import alignment, endings, refusals
from colloquy.llm import pairs as X

Q = "How do I restart the staging database before lunch?"
GOOD = "Start by checking whether the cache is cold, because that is the most common cause."


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        (Q, GOOD, None),
        *((Q, a, "empty") for a in (None, "", "  \n", "​", "﻿", " ", "...", "…", "-", "—", "N/A", "null", "(empty)", "<empty>", "[no response]")),
        *((Q, a, None) for a in ("No.", "Yes.", "42", "Version 3.8.", "`tool --list`", "About 30 minutes.")),
        *((Q, a, "copy") for a in (Q, Q.upper(), f'"{Q}"', f"User: {Q}", Q + "\n" + Q, Q.replace(" ", " "), "how do i restart staging database before lunch")),
        (Q, f"> {Q}\n\n{GOOD} Then compare the counts with last week and write a note for the team.", None),
        *((Q, a, "refusal") for a in ("I'm sorry, but I can't help with that.", "I must decline this one. Is there something else I can look at?", "Hmm. To be frank, this is a topic I am not allowed to go into, since it may cause harm.")),
        ("Wie geht das mit dem Dienst?", "Ich muss diese Bitte ablehnen. Gibt es etwas anderes?", "refusal"),
        ("Comment faire avec le service ?", "Je ne suis pas en mesure de répondre à cette demande.", "refusal"),
        ("如果网络断开会怎样？", "对不起，这个问题我不能回答。", "refusal"),
        (Q, "Unfortunately the service cannot reconnect by itself, but there is a fix. " + GOOD, None),
        (Q, "I can't stress enough how useful a backup is here. " + GOOD, None),
        *((Q, GOOD + t, "truncated") for t in (" Ask the office whether the;", " Then split the …", " Both files must carry the", "\n1. wait until lunch\n2. **", "\n1. wait until lunch\n2.", "\n\n```python\ndef f(x):\n    return", " In most setups (")),
        (Q, GOOD + "\n1. wait until lunch\n2. write a note for the team", None),
        (Q, GOOD + "\n\n```python\ndef f(x):\n    return x\n```", None),
        (Q, "Frag im Büro nach, ob die Platte fast voll ist. Danach bist du fertig.", "language"),
        ("Please answer in German: how do I restart it?", "Frag im Büro nach, ob die Platte fast voll ist. Danach bist du fertig.", None),
        (None, GOOD, None),
        ("", GOOD, None),
    ],
)
def test_defect(question, answer, want):
    assert X.defect(question, answer) == want


def test_common_subsequence_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert alignment.common_subsequence(a, b) == t[-1][-1]


def test_very_long_texts_take_no_square_time():
    words = " ".join(f"w{i}" for i in range(60_000))
    assert X.defect(words, words + " end.") == "copy"
    assert X.defect(words, GOOD) is None


def test_length_decides_neither_refusal_nor_emptiness():
    courtesy = " Thank you for your patience and for writing to us at such length about this matter." * 8
    assert X.defect(Q, "I'm sorry, but I can't help with that." + courtesy) == "refusal"
    assert X.defect(Q, "I'm sorry, but I can't help with that." + courtesy + " " + GOOD) is None
    assert all(X.defect(Q, a) == "empty" for a in ("N/A" + " " * 80, "\n" * 90 + "[no response]", "-" * 100))


# Refusals, answers and endings in words that the training module hasn't.
REFUSED = """
I refuse to answer.|Sorry, no can do.|That request is one I have to turn down.|Das mache ich nicht, tut mir leid.|I'm sorry, I won't be helping with that one.|Apologies, we are unable to discuss this subject.|Unfortunately I cannot give advice on this.|That is not a topic I'm comfortable with, so I'll pass.
Es tut mir leid, aber dabei kann ich Ihnen nicht weiterhelfen.|Zu diesem Thema gebe ich keine Auskunft.|Je regrette, il m'est impossible de répondre à cela.|Désolé, je ne peux pas donner suite à cette demande.|Lo lamento, no puedo hablar de ese tema.|Debo declinar esta solicitud.|抱歉，我无法讨论这个问题。|很遗憾，我不能完成这个要求。
""".strip()
ANSWERED = """
I can't recommend that brand, but the tool restarts the service within a minute and the logs stay where they are.|The database refused the connection because the port was closed.|Don't restart it by hand.|You cannot skip the second step.|This does not change the result.|It isn't supported since version four.
Der Server lehnt die Verbindung ab.|Das Kabel passt nicht.|Le serveur n'accepte pas la connexion.|No lo cambies antes del viernes.|端口没有打开。|I would not answer the phone while driving, and I never do.|She declined the invitation.|Nothing else depends on it.
""".strip()
ENDED = r"""
Red\nBlue\nYellow|An old silent pond\nA frog jumps into the pond\nSplash! Silence again|Lisbon|3.14|Dear all,\n\nthe room is free again.\n\nYours,\nMaria|1. soap\n2. towels\n3. bread|Winter comes softly\nSnow on the window and roof\nThe garden is still|Peak: 40 kW\nMean: 12 kW|Go to https://tool.test/docs|Yes, of course!|The order is: first red, then blue.|Alpha\n\nBeta\n\nGamma
""".strip()
BROKEN_OFF = r"""
The quickest way is to ask the|Open the lid. Then turn the red wheel until it|We need three things: flour, milk and|1. wash the rice\n2. boil the|1. wash the rice\n2. **|Both of them said that the house was old, but|Der Schlüssel liegt unter der|La clé se trouve dans le|La llave está debajo de la|The cause is simple: the fan (|Water the plants in the morning. If the soil is dry, ...|```\nfor i in x:\n  y
""".strip()


def pieces(block):
    return [p.replace("\\n", "\n") for line in block.split("\n") for p in line.split("|")]


def test_held_out_refusals_and_endings():
    for judge, yes, no in ((refusals.is_refusal, REFUSED, ANSWERED), (endings.is_truncated, BROKEN_OFF, ENDED)):
        missed, wrong = [s for s in pieces(yes) if not judge(s)], [s for s in pieces(no) if judge(s)]
        found = len(pieces(yes)) - len(missed)
        print(missed, wrong)
        assert found >= 0.9 * len(pieces(yes)) and found >= 0.9 * (found + len(wrong)), (missed, wrong)


def test_a_refusal_of_any_length_is_found():
    courtesy = " Thank you for your patience and for writing to us at such length about this matter." * 60
    assert len(courtesy) > 5000 and X.defect(Q, "I'm sorry, but I can't help with that." + courtesy) == "refusal"
    assert not refusals.is_refusal("I am not able " * 15_000)


@pytest.mark.parametrize(
    ("answer", "want"),
    [("Prima di tutto controlla che il servizio sia attivo e poi riavvia il database come sempre.", "language"), ("Controleer eerst of het niet aan de kabel ligt en start dan de dienst opnieuw.", "language"), ("Сначала проверьте кабель.", "language"), (GOOD, None), ("`systemctl restart db`", None)],
)
def test_other_languages(answer, want):
    assert X.defect(Q, answer) == want


def test_copy_any_number_of_times():
    assert all(X.defect(q, " ".join([q] * n)) == "copy" for q in ("Is the cache warm?", Q) for n in (1, 2, 4, 6, 9, 40))
    assert X.defect("Is the cache warm?", "Is the cache warm? " + GOOD * 3) is None


def test_pairs_of_dirty_rows(spark):
    schema = "msg_id long, conv_id long, idx int, role string, text string, question string, at string"
    rows = [(1, 1, 0, "user", Q), (2, 1, 1, "assistant", None), (2, 1, 1, "assistant", None), (3, 1, 3, "assistant", None), (4, 2, 0, "user", None), (5, 2, 1, "assistant", "..."), (6, None, 1, "assistant", ""), (7, 3, 0, "user", Q), (8, 3, 1, "user", Q), (9, 3, 2, "assistant", GOOD), (10, 4, 0, "assistant", ""), (11, 5, None, "user", Q)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    assert {(r.msg_id, r.defect) for r in X.found(frame).collect()} == {(2, "empty"), (5, "empty")}
    assert X.found(spark.createDataFrame([], schema)).count() == 0


def test_one_exchange_and_ties(spark, tmp_path):
    rows = [(1, 1, 0, "user", "first"), (2, 1, 0, "user", Q), (3, 1, 1, "assistant", Q), (4, 1, 1, "assistant", GOOD), (3, 1, 1, "assistant", Q)]
    spark.createDataFrame(rows, "msg_id long, conv_id long, idx int, role string, text string").write.parquet(str(tmp_path / "m"))
    frame = X.pairs(spark.read.parquet(str(tmp_path / "m")))
    assert sorted(tuple(r) for r in frame.collect()) == [(3, Q, Q), (4, Q, GOOD)]
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1

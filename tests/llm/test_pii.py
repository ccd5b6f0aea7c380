"""Personal information: every form found, every look-alike left, the choice optimal."""

import itertools
import math
import random
import re

import pytest

from colloquy.llm import crf, weights
from colloquy.llm import pii as X

NAMES = X.Names.learn([(f"{s}{v}{e}", k) for k, s_, e_ in (("given", ("Odal", "Brin", "Tal"), ("wen", "ric", "mar")), ("family", ("Garr", "Kepp", "Zor"), ("bach", "mann", "ski"))) for s in s_ for v in "aeo" for e in e_ if (s, v, e) not in {("Tal", "o", "mar"), ("Zor", "a", "ski")}] + [(None, "given"), ("odd", None)])
F = X.Finder(NAMES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail odal.garr+x1@mail.example-labs.test, please.", [("email", "odal.garr+x1@mail.example-labs.test")]),
        ("Mail tal_kepp [at] post [dot] example now", [("email", "tal_kepp [at] post [dot] example")]),
        ("Mail tal_kepp (at) post.example; thanks", [("email", "tal_kepp (at) post.example")]),
        ("Install pack@3.8.5 and mention @some_team here", []),
        *((f"Call me on {p}.", [("phone", p)]) for p in ("+1 (555) 555-0146", "(555) 555 0164", "555-555-0197", "1.555.555.0198", "07700 900 266", "+44 7700 900939", "0044 1632 960445", "+49 30 23125 764", "030/23125714", "+33 1 99 00 90 96", "01.99.00.92.58", "+15555550185")),
        ("Row 1 200 373 of 9 000 000 failed. SKU 121-90-4895. Build 887.77.77.887 passed. The order number is 4471-841-0343. Checksum 2316327923163279 matches.", []),
        ("The timer fired at 2025-03-16 10:05:16. The run took 402 555 ms.", []),
        *((t.format(v), [("idnum", v)]) for t, v in (("My social security number is {}.", "953 17 2688"), ("Social: {}", "909-22-8544"), ("My NI number, {}, was rejected.", "QQ 82 13 56 C"), ("Passport {} expires soon.", "X44K47999"), ("Meine Steuer-ID lautet {}.", "62396757475"), ("El NIF de mi madre es {}.", "51.574.748-P"), ("N° sécu : {}", "1 33 05 99 737 786 26"), ("Ausweisnummer: {}", "XA 1269274"), ("tax id {} belongs to my father", "91 655 086 770"))),
        *((f"I live at {a}. What now?", [("address", a)]) for a in ("Flat 12, 179 Stelerhaven Close, Dunowick", "65c Halofeld Terrace, Lindenwick 54546", "70 Merarmouth Ave in Wyninmouth", "27c Quilloford Rd., Thornabury 91298", "83 bis rue Quillawick, 61416 Quillarmouth", "104 place du Halerhaven 46734 VARRENVALE", "Dunendorfallee 107, 95093 Gravadorf", "27053 Ostenford, Wynerholmgasse 55", "Avda. Lindarford 72, 55148 Graverdorf", "Paseo Halenmont 188, 2.º B, 66559 Quillerfeld", "Plaza Gravofeld 31, Halerholm (62764)")),
        ("Ship it to 28 Merinvale Close\nSteloholm 21548. Thanks", [("address", "28 Merinvale Close Steloholm 21548")]),
        ("The Ostawick road was closed for 85 days.", []),
        *((f"{a}{n}{b}", [("name", n)]) for a, n, b in (("My name is ", "Odalwen Garrabach".replace("lw", "law"), "."), ("I promised ", "Keppamann, Odalawen", " an answer."), ("Please cc Mr ", "Garroski", " on it."), ("done by Prof. ", "Talaric Zoromann", "."), ("ask ", "odalawen garrabach", " about it"), ("My name is ", "Odalawen M. Garrabach", "."), ("Regards,\n", "O. Garrabach", ""), ("Bitte setze Frau ", "Zoraski", " in Kopie."), ("cc ", "Talomar Zoraski", " now"))),
        ("Merci de mettre M. Garrabach en copie.", [("name", "Garrabach")]),
        ("The Garrabach valve needs oil. Odalawen knows.", []),
        ("", []),
        (None, []),
    ],
)
def test_values(text, want):
    assert F.values(text) == want


def test_inside_another_value_is_no_case():
    assert F.values("Contact odalawen.garrabach@x.test or 12 Garrabach Street, Keppaford") == [("email", "odalawen.garrabach@x.test"), ("address", "12 Garrabach Street, Keppaford")]


def test_choice_is_the_best_of_all():
    """Decoding against every set of candidates that fit, with transitions of either sign."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("a ,.") for _ in range(24))
        spans = [crf.Candidate(s, s + rng.randint(1, 6), rng.choice("ab"), (str(i),)) for i, s in enumerate(rng.randint(0, 16) for _ in range(rng.randint(1, 7)))]
        table = {f"{c.label} {i}": rng.uniform(-2, 5) for i, c in enumerate(spans)} | {f"{x} > {y}": rng.uniform(-4, 4) for x in "ab" for y in "ab"}

        def worth(chosen):
            return sum(crf.value(c, table) for c in chosen) + sum(table[t] for x, y in zip(chosen, chosen[1:]) if (t := crf.transition(text, x, y)))

        ordered = [sorted(c) for k in range(len(spans) + 1) for c in itertools.combinations(spans, k)]
        best = max(worth(c) for c in ordered if all(x.end <= y.start for x, y in zip(c, c[1:])))
        got = crf.decode(text, spans, table)
        assert all(x.end <= y.start for x, y in zip(got, got[1:])) and worth(got) == pytest.approx(best)


def test_expectations_equal_those_over_all_labellings():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("a ,") for _ in range(20))
        spans = sorted((crf.Candidate(s, s + rng.randint(1, 5), rng.choice("ab"), (str(i),)) for i, s in enumerate(rng.randint(0, 14) for _ in range(5))), key=lambda c: (c.end, c.start))
        table = {f"{c.label} {i}": rng.uniform(-2, 2) for i, c in enumerate(spans)} | {f"{x} > {y}": rng.uniform(-1, 1) for x in "ab" for y in "ab"}
        sums, z = {}, 0.0
        for k in range(6):
            for c in itertools.combinations(spans, k):
                c = sorted(c)
                if all(x.end <= y.start for x, y in zip(c, c[1:])):
                    keys = [f"{x.label} {f}" for x in c for f in x.features] + [t for x, y in zip(c, c[1:]) if (t := crf.transition(text, x, y))]
                    w = math.exp(sum(table.get(key, 0.0) for key in keys))
                    z += w
                    for key in keys:
                        sums[key] = sums.get(key, 0.0) + w
        got = crf.expected(text, spans, table)
        assert set(got) == set(sums) and all(got[key] == pytest.approx(sums[key] / z) for key in sums)


def test_weights_are_the_fitted_ones():
    from colloquy.llm import pii_train

    names, rows = pii_train.samples(count=400)
    finder = X.Finder(names, {})
    table = crf.fit([(t, finder.candidates(t), true) for t, true in rows], epochs=3)
    assert set(table) <= set(weights.PII) | {k for k in table if ">" in k} and table["name title"] > 0 > table["idnum against"]


# Sentences, names and forms that the training module hasn't; values in braces, the type by the first letter.
HELD_OUT = """
My name is {n:Priya Raghunathan}.|Contact Mr {n:Nakamura} today.|Herr {n:Yilmaz} wohnt hier.|Could you forward this to Mrs {n:Oyelaran}?|Dr. {n:Szymanska} will see you at noon.|Mi nombre es {n:Xiomara Etxeberria} y vivo en Bilbao.
Je suis suivie par Mme {n:Guillemot} depuis mars.|Signed by {n:Tobias Aldersgate}|Prof. {n:Achterberg} signed the form.|I spoke with {n:Odalawen Garrabach} on Monday.|{n:Garromann, Brinoric} has left the company.|the notes of {n:T. Keppobach} are gone
My doctor, Ms {n:Featherstonehaugh}, was kind.|Der Antrag von Frau {n:Kowalczyk} fehlt noch.|Ich heiße {n:Friedrun Ostwald}.|La Sra. {n:Iturralde} no contesta.|mail: {e:friedrun.ostwald@posteo.example}|Please write to {e:xi_etx99@correo.uni.test} about it.
My address for invoices is {e:accounts+eu@tobias-alder.org}.|you can write me under {e:tobias (at) alder (dot) example}|Her mobile is {p:+1 (415) 555-2671}.|My number is {p:020 7946 0018}.|Phone: {p:(212) 555-7788}|Tel. {p:+49 89 636 48018}|Llama al {p:+34 912 345 678} por la tarde.|Appelez le {p:01 42 68 53 00}.
Fax {p:+81 3 1234 5678}|my social security number: {i:078-05-1120}|Passport number {i:C01X00T47} was stolen.|Meine Ausweisnummer lautet {i:L01X00T471}.|Mi DNI: {i:12345678-Z}|Mon numéro de sécu : n° sécu {i:1 85 05 78 006 084 36}|tax id: {i:12 345 678 903}|My national insurance number is {i:AB 12 34 56 C}.
Send the keys to {a:221b Baker Street, London}.|Wir wohnen in der {a:Schillerstraße 12a, 80336 München}.|Elle habite {a:12 rue Lafayette, 75009 Paris} depuis peu.|Mi casa está en {a:Calle Alcalá 45, 28014 Madrid}.|Deliver to {a:1600 Pennsylvania Avenue in Washington}.|Office: {a:Flat 3, 9 Hanover Square, London}
The parcel 1Z 999 AA1 012 345 6784 is late.|Invoice 2024-000-1177 was paid.|The Garrabach bridge is closed.|Error 404 555 1212 appeared in row 77.|Meet at noon on Baker Street.|Version 10.15.7 of the Odalawen driver works.|He is the best doctor in town.|SKU 078-05-1120 is sold out.|The meter reads 00123456.|We had 3 lanes and 20 cars.
""".strip()


def test_held_out_sentences():
    kinds = {"n": "name", "e": "email", "p": "phone", "i": "idnum", "a": "address"}
    true, found = set(), set()
    for i, line in enumerate(x for row in HELD_OUT.split("\n") for x in row.split("|")):
        true |= {(i, kinds[k], v) for k, v in re.findall(r"\{(\w):([^}]*)\}", line)}
        found |= {(i, k, v) for k, v in F.values(re.sub(r"\{\w:([^}]*)\}", r"\1", line))}
    both = len(true & found)
    print(sorted(true - found), sorted(found - true))
    assert both >= 0.9 * len(true) and both >= 0.9 * len(found), (sorted(true - found), sorted(found - true))


def test_length_is_no_bound():
    street = " ".join(["Longstreet"] * 40)
    assert F.values(f"I live at 12 {street} Street, Dunowick.") == [("address", f"12 {street} Street, Dunowick")]
    assert F.values("ask Odalawen Brinoric Talamar Odalaric Brinawen Garrabach about it") == [("name", "Odalawen Brinoric Talamar Odalaric Brinawen Garrabach")]
    host = ".".join(["verylonglabel"] * 30)
    assert F.values(f"Mail me at someone@{host}.test please") == [("email", f"someone@{host}.test")]
    assert not F.values("x" * 100_000 + " Odalawen " + "y" * 100_000)


def test_redaction_keeps_the_rest_as_it_is():
    assert F.redacted("a\r\nMail a.b@c.test\r\n\r\n\r\nb\rMr Garrabach\r") == "a\r\nMail [EMAIL]\r\n\r\n\r\nb\rMr [NAME]\r"


def test_visible_text_of_markup():
    assert X.visible("<style>.x{}</style><p>Qu<em>orer</em>ck&nbsp;&amp; co</p><p>a<br/>b</p><script>var x='y@z.test'</script>").split() == ["Quorerck", "&", "co", "a", "b"]
    assert X.visible("12 Merin Street<br />\nOstenmont 35311").split("\n")[0].strip() == "12 Merin Street"
    assert X.visible(None) == ""


def test_frames(spark):
    messages = spark.createDataFrame([(1, "mail a.b@c.test and a.b@c.test", "x"), (1, "mail a.b@c.test and a.b@c.test", "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 300_000, "x")], "msg_id long, text string, found string")
    activity = spark.createDataFrame([(9, [("<p>ring <a href='tel:1'>555-<b>555</b>-0111</a> after six</p>",), None, (None,)]), (10, None)], "activity_id long, safehtmlitem array<struct<html string>>")
    names = spark.createDataFrame([("Odalawen", "given")], "name string, kind string")
    assert {tuple(r) for r in X.found(messages, activity, names).collect()} == {("message", 1, "email", "a.b@c.test"), ("activity", 9, "phone", "555-555-0111")}
    rows = X.redacted(messages, activity, names).collect()
    text = {(r.src, r.rec_id): r.text for r in rows}
    assert len(rows) == len(text)
    assert text["message", 1] == "mail [EMAIL] and [EMAIL]" and text["activity", 9].strip() == "ring [PHONE] after six"
    assert X.found(messages.where("msg_id > 99"), activity.where("activity_id > 99"), names.where("name = ''")).count() == 0

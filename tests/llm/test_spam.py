"""Spam pages of each kind against records that resemble them."""

import pytest

from colloquy.llm import spam as X

SPAM = [
    "\n".join(f"https://shop.acme{i}.example/wool-socks?id={i}" for i in range(8)),
    " ".join(f'<a href="https://x{i}.example/p">buy poker bonus</a>' for i in range(6)),
    "\n".join(f"running shoes XL SKU{3000 + i} {i}88.99" for i in range(8)),
    "Next page > buy > diet tea > sale > online > garden hose > phone case > wool socks > free > sale > buy > diet tea",
    "#best-led-lamp, #onlineloanoffer, #buyrunningshoes, #cheapphonecase, #sale-oak-desk",
    "used tyres sale top used tyres cheap used tyres free used tyres near me used tyres online led lamp used tyres best led lamp",
    "r00f r3pair sal3 r00f repair ne@r m3 roof r3p@ir buy roof r3p@ir best r00f rep@ir",
    "Cheap loan offer, free loan offer, loan offer in Town. Buy loan offer because loan offer is the best loan offer for loan offer lovers. " * 3,
    "wool socks Lindenholm ; wool socks Quillavale ; tax software Stelindorf ; roof repair Ostamouth ; phone case Graverdorf ; wool socks Meradorf",
]
RECORD = [
    "Mr President, I thank the rapporteur for the careful work. That is not a plan but a wish. (Applause)",
    "Division No. 282\nAyes: 6\n" + ", ".join(f"{g} {f}" for g, f in zip("Odala Peri Hanina Tala Elie Joro".split(), "Keppo Quorer Garren Winti Fjell Zoro".split())),
    "\n".join(f"Amendment {i} to Article {i + 30} (HP, Fjelleley)" for i in range(9)),
    "\n".join(f"{i}. Question time ............... {i + 12}" for i in range(1, 7)),
    "\n".join(f"Doc. {i}/21: Budget statement 2005 (laid by Pellotier)" for i in range(8)),
    "\n".join(f"Varrarvale{i}\t5274\t9,9 %" for i in range(8)),
    "Order! " * 10 + "The amendment is agreed to.",
    "We must have a second bridge. We must have night trains. We must have public lidos. We must have dental care.",
    "The sitting was opened at 9.043 a.m.\nThe question is put. All those in favour?",
]


# Pages in words that the training module hasn't.
HELD_OUT_SPAM = [
    "buy cheap shoes online now for sale. best cheap shoes. buy shoes online.",
    "hotel paris, cheap hotel paris, hotel paris center, best hotel paris, hotel in paris, paris hotel deals",
    "https://a.co/x https://b.co/y https://c.co/z",
    "Shop now: blue lamp $9.99\nred lamp $8.99\ngreen lamp $7.50",
    "Home | Sofas | Beds | Chairs | Sale | Login | Cart | Sofas | Beds | Sale | Help",
    "#sofa #cheapsofa #sofasale #buysofa #sofa2024 #bestsofa",
    "plumber leeds plumber york plumber hull emergency plumber leeds cheap plumber york plumber near me plumber hull",
    "[watch free](http://v1.stream.xyz/a) [watch online](http://v2.stream.xyz/b) [download](http://v3.stream.xyz/c)",
    "Günstige Brille kaufen. Brille online kaufen. Brille günstig, Brille billig, Brille Angebot.",
    "zapatos baratos comprar zapatos zapatos oferta zapatos mujer zapatos hombre zapatos baratos online",
]
HELD_OUT_RECORD = [
    "Red apples\nGreen pears\nBlue plums\nYellow lemons",
    "Roses are red\nViolets are blue\nSugar is sweet\nAnd so are you",
    "Members present: Mr Smith, Mrs Jones, Dr Brown, Ms Miller, Mr Davis, Mrs Wilson",
    "Agenda\n1. Opening\n2. Minutes\n3. Budget\n4. Any other business",
    "The chair opened the meeting at nine. The clerk read the minutes, which were approved. The meeting closed at noon.",
    "Never again shall we wait. Never again shall we beg. Never again shall we be silent.",
    "Silence, please! The Member for Harwick has the floor. Please conclude. The Member for Lindau has the floor. (Laughter)",
    "Paragraph 1 was deleted.\nParagraph 2 was renumbered.\nParagraph 3 was adopted.\nParagraph 4 was adopted.",
    "Je vous remercie, Monsieur le Président. La séance est levée à midi.",
    "Year\tIncome\tCost\n2019\t120\t80\n2020\t140\t95\n2021\t150\t99",
    "See the report (https://record.parliament.test/doc/77) on page four. The minister will answer in writing before the recess.",
]
JUDGE = X.Judge()


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert JUDGE.is_spam(text), X.shapes(text)


@pytest.mark.parametrize("text", RECORD)
def test_record(text):
    assert not JUDGE.is_spam(text), X.shapes(text)


def test_held_out_pages():
    missed, wrong = [t for t in HELD_OUT_SPAM if not JUDGE.is_spam(t)], [t for t in HELD_OUT_RECORD if JUDGE.is_spam(t)]
    print(missed, wrong)
    found = len(HELD_OUT_SPAM) - len(missed)
    assert found >= 0.9 * len(HELD_OUT_SPAM) and found >= 0.9 * (found + len(wrong)), (missed, wrong)


def test_few_shapes_dominate(monkeypatch):
    assert JUDGE.is_spam(SPAM[4])
    monkeypatch.setattr(X, "FEW", 0)
    assert not JUDGE.is_spam(SPAM[4]) and JUDGE.spam_share(SPAM[4]) > 0.5


def test_the_greater_part_decides():
    speech = "Mr President, I thank the rapporteur for the careful work on this report. "
    assert JUDGE.spam_share(speech * 20 + "\n" + SPAM[0]) < 0.5 < JUDGE.spam_share(speech + "\n" + SPAM[0])


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SPAM[:2], RECORD[0], None, "", " \n", "a" * 300_000])] + [(0, SPAM[0], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(r.doc_id for r in X.found(frame.where("doc_id > 0")).collect()) == [1]
    assert X.found(frame.where("doc_id > 99")).count() == 0

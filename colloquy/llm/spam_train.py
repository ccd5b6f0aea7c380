"""Fits the weights of shapes: ``python -m colloquy.llm.spam_train DOCUMENTS.parquet`` prints ``weights.PIECE``.

The spam is made up here (``PAGES`` pages of each kind, from words of its own); the records are made up too, beside at most ``RECORDS`` pages of a table of documents, nearly
all of which are records. Pages of the table that a first fit finds mostly spam are left out of the second.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Callable

from colloquy.llm import logistic, spam

PAGES, RECORDS = 150, 2500
GOODS = "coffee maker,yoga mat,leather wallet,winter tyres,dog food,hair dryer,gaming chair,Kaffeemaschine,Hundefutter,Winterreifen,Yogamatte,machine à café,tapis de yoga,pneus hiver,cafetera,esterilla de yoga,comida para perros,solar panel,tent,mortgage,slot games,Staubsauger,Gartenstuhl,Matratze,Versicherung,Fahrrad,Zahnarzt,fauteuil,matelas,colchón,bicicleta".split(",")
PUSH = "cheap,best,buy,order,deal,offer,discount,top,online,free,2024,near me,review,price,billig,beste,kaufen,gratis,günstig,Angebot,Test,Vergleich,Preis,pas cher,acheter,meilleur,promo,barato,comprar,mejor,oferta".split(",")
MENU = "Home,Contact,Login,Cart,About,News,Products,Imprint,Start,Kontakt,Warenkorb,Accueil,Panier,Inicio,Carrito,Next,Previous,More,Help,FAQ".split(",")
TOWNS = "Ashbourne,Kestrel Bay,Lindau,Montreux,Segovia,Tilburg,Harwick,Oberdorf".split(",")
NAME_STARTS, NAME_MIDDLES, NAME_ENDS = "An Bru Cla Da El Fe Gre Hu I Jo Ka Le Ma Ni Os Pa".split(), "ma lo ri de na ve so ti".split(), "n r s la ra to ck berg son".split()
SENTENCES = """
The committee will meet again on Thursday to hear the minister.|I thank the honourable member for the question and for her patience.|We must build more homes. We must repair the roads. We must listen to the farmers.|Is the minister aware that the bridge has been closed for a year?|The cost of the scheme has risen by nine per cent since last spring.
Das Haus hat gestern über den Antrag beraten und ihn angenommen.|Ich frage die Regierung, wann die Schule endlich gebaut wird.|Wir brauchen keine neuen Ausreden, wir brauchen Züge, die fahren.|Le ministre a répondu que les travaux seraient finis avant l'été.|Je voudrais savoir pourquoi la gare de notre ville est fermée le dimanche.|Nous avons besoin de médecins, pas de promesses.
La comisión aprobó el informe por doce votos contra tres.|¿Cuándo piensa el Gobierno abrir el nuevo hospital de la comarca?|No se trata de un plan, sino de un deseo.|When nobody answers, the office says that nobody has called.|He said, and I quote: "the money is gone".|(Applause)|(Beifall)|Order! Order!|Hear, hear!|The amendment was agreed to.|The sitting was suspended at noon.
""".strip()


def makers() -> tuple[list[Callable[[random.Random], str]], list[Callable[[random.Random], str]]]:
    host = lambda r: f"{r.choice(['www.', 'shop.', ''])}{r.choice(GOODS).replace(' ', '-').lower()}{r.randint(1, 99)}.{r.choice(['com', 'net', 'shop', 'xyz', 'online', 'example', 'info'])}"
    url = lambda r: f"{r.choice(['http://', 'https://', ''])}{host(r)}/{r.choice(GOODS).replace(' ', '-')}{r.choice(['', '.html', '?id=7'])}"
    phrase = lambda r: f"{r.choice(PUSH)} {r.choice(GOODS)}"

    def links(r):
        form = r.choice([lambda: url(r), lambda: f'<a href="{url(r)}">{phrase(r)}</a>', lambda: f"[{phrase(r)}]({url(r)})", lambda: f"{phrase(r)} {url(r)}", lambda: f"<li><a href=//{host(r)}>{phrase(r)}</a></li>"])
        return r.choice(["\n", " ", ", "]).join(form() for _ in range(r.randint(4, 30)))

    def tags(r):
        mark, glue = r.choice("#+"), r.choice(["-", "_", ""])
        return r.choice(["\n", " ", ", "]).join(mark + phrase(r).replace(" ", glue) for _ in range(r.randint(5, 40)))

    def goods(r):
        form = r.choice([lambda: f"{r.choice(GOODS)} {r.choice(['S', 'XL', 'blue', '20cm'])} SKU{r.randint(100, 99999)} {r.randint(5, 400)}.99", lambda: f"{r.choice(GOODS)} {r.randint(5, 400)},90 €", lambda: f"${r.randint(5, 99)}.50 {r.choice(GOODS)}"])
        return "\n".join(form() for _ in range(r.randint(4, 40)))

    def menu(r):
        own = [r.choice([r.choice(MENU), r.choice(MENU), r.choice(GOODS), r.choice(PUSH)]) for _ in range(r.randint(12, 80))]
        return r.choice([" | ", " > ", " / ", " · ", "\n", " ; "]).join(own)

    def keywords(r):
        own = r.sample(GOODS, r.randint(1, 4))
        return r.choice([" ", " ", "\n", ", "]).join(r.choice([f"{r.choice(PUSH)} {r.choice(own)}", r.choice(own), f"the new {r.choice(own)}", f"la nueva {r.choice(own)}", f"{r.choice(own)} {r.choice(PUSH)}"]) for _ in range(r.randint(10, 60)))

    def towns(r):
        thing = r.choice(GOODS)
        return r.choice([" ; ", ", ", "\n"]).join(f"{r.choice([thing, thing, r.choice(GOODS)])} {r.choice(TOWNS)}" for _ in range(r.randint(8, 40)))

    nouns = [g for g in GOODS if g[0].isupper()]  # languages that write nouns with capitals

    def noun_towns(r):
        own = r.sample(nouns, r.randint(3, 6))
        return r.choice([" ; ", ", ", " | ", "\n"]).join(f"{r.choice(own)} {r.choice(TOWNS)[:4]}{r.choice(NAME_ENDS)}{r.choice(['ford', 'holm', 'wick', 'bury'])}" for _ in range(r.randint(8, 40)))

    def noun_keywords(r):
        own = r.sample(nouns, r.randint(1, 4))
        return " ".join(r.choice([f"{r.choice(['kaufen', 'gratis', 'günstig', 'Angebot', 'Test', 'Vergleich', 'beste', 'online'])} {r.choice(own)}", r.choice(own)]) for _ in range(r.randint(8, 60)))

    def leet(r):
        return "".join(c if r.random() < 0.7 else {"o": "0", "e": "3", "a": "@"}.get(c, c) for c in r.choice([keywords, noun_keywords])(r))

    def stuffed(r):
        g, p = r.choice(GOODS), PUSH
        forms = [f"Looking for {g}? {g} here, {g} now, {g} today.", f"Order {g} because {g} is the best {g} for fans of {g}.", f"{r.choice(p)} {g}, {r.choice(p)} {g}, {g} in {r.choice(TOWNS)}.", f"{g} kaufen, weil {g} das beste {g} für Freunde von {g} ist.", f"Our {g} shop sells {g} and more {g}.", f"{r.choice(p)} {g} {r.choice(p)} {g}.", f"¿Buscas {g}? {g} aquí, {g} hoy.", f"Compra {g} porque {g} es el mejor {g} de la zona.", f"{g} en {r.choice(TOWNS)}, {g} barato, {g} hoy.", f"{g} à {r.choice(TOWNS)}, {g} en ligne, {g} pas cher.", f"Achetez {g}, car {g} est le meilleur {g}.", f"buy {g} online now for sale. best {g}.", f"{g} pas cher, {g} en promo, {g} pour amateurs de {g}."]
        return " ".join(r.choice(forms) for _ in range(r.randint(3, 20)))

    def mixed(r):
        tag = lambda: "#" + r.choice(GOODS).replace(" ", "")
        return " ".join(r.choice([lambda: phrase(r), lambda: f"{r.choice(GOODS)} {r.choice(TOWNS)},", tag, lambda: url(r), lambda: f"the new {r.choice(GOODS)}", lambda: f"die neue {r.choice(GOODS)}"])() for _ in range(r.randint(4, 25)))

    said = [s for line in SENTENCES.split("\n") for s in line.split("|")]
    word = lambda r: r.choice(NAME_STARTS) + r.choice(NAME_MIDDLES) + r.choice(NAME_ENDS)
    name = lambda r: f"{word(r)} {word(r)}"

    def speech(r):
        return r.choice([" ", "\n\n", "\n"]).join(r.choice(said) for _ in range(r.randint(3, 20)))

    def roll(r):
        return f"Division No. {r.randint(1, 99)}\nAyes: {r.randint(1, 90)}\n" + r.choice([", ", "\n", "; "]).join(name(r) for _ in range(r.randint(6, 60)))

    def agenda(r):
        return "\n".join(f"{i}. {r.choice(said).rstrip('.?!')} {'.' * r.randint(4, 20)} {i + 10}" for i in range(1, r.randint(4, 20)))

    def papers(r):
        return "\n".join(f"{r.choice(['Doc.', 'Nr.', 'Paper', 'Amendment'])} {i}/{r.randint(1, 30)}: {r.choice(['Report on roads', 'Budget statement', 'Bericht zur Lage', 'Rapport annuel'])} ({name(r)})" for i in range(r.randint(4, 20)))

    def table(r):
        return "\n".join("\t".join([r.choice(TOWNS), str(r.randint(1, 9999)), f"{r.randint(0, 99)},{r.randint(0, 9)} %"]) for _ in range(r.randint(4, 30)))

    def short_list(r):
        nouns = r.sample("apples pears plums lemons chairs tables bridges schools trains ferries roads lamps".split(), r.randint(3, 8))
        return "\n".join(f"{r.choice(['Red', 'Green', 'New', 'Old', 'Small', 'Large'])} {n}" for n in nouns)

    def verse(r):
        lines = "An old silent pond|The frog jumps into the water|Winter is near and the garden is still|Snow on the window and the roof|The river runs slowly to the sea|Nobody walks along the road|Der Mond ist aufgegangen über dem Wald|Les feuilles tombent dans la cour|La noche llega sobre el mar".split("|")
        return "\n".join(r.choice(lines) for _ in range(r.randint(3, 12)))

    def noise(r):
        return f"{r.choice(said)}{r.choice([' ', chr(10)])}{{}}{r.choice([' ', chr(10)])}{r.choice(said)}".format(r.choice([r.choice("x-=.") * r.randint(50, 900), "".join(r.choice("abcdef0123456789") for _ in range(r.randint(60, 900)))]))

    return [links, tags, goods, menu, keywords, noun_keywords, towns, towns, noun_towns, leet, leet, stuffed, mixed, mixed], [speech, speech, roll, agenda, papers, table, short_list, verse, noise, noise]


def piece_rows(texts: list[str], label: bool, importance: float) -> list[tuple[dict[str, float], bool, float]]:
    """A row per shape of each page; a page counts alike however long it is."""
    rows = []
    for text in texts:
        by = spam.shapes(text)
        total = sum(by.values())
        rows += [(spam.features(s), label, importance * n / total) for s, n in by.items() if n > 0.02 * total]
    return rows


def fitted(records: list[str], seed: int = 1) -> dict[str, float]:
    rng = random.Random(seed)
    bad, good = makers()
    made = piece_rows([m(rng) for m in bad for _ in range(PAGES)], True, 1.0) + piece_rows([m(rng) for m in good for _ in range(PAGES)], False, 1.0)
    first = logistic.fit(made + piece_rows(records, False, 0.5), epochs=6)
    judge = spam.Judge(first)
    kept = [t for t in records if judge.spam_share(t) <= 0.5]
    return logistic.fit(made + piece_rows(kept, False, 0.5), epochs=15)


def main(path: str) -> None:
    import pyarrow.parquet as pq

    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist() if r["text"] and r["text"].strip())
    print("PIECE: dict[str, float] = {\n" + "".join(f'    "{k}": {v},\n' for k, v in fitted([t for _, t in rows[:RECORDS]]).items()) + "}")


if __name__ == "__main__":
    main(sys.argv[1])

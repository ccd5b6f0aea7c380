"""Fits the weights of personal information: ``python -m colloquy.llm.pii_train`` prints the table ``weights.PII``.

The sample is bounded by ``SAMPLES``: sentences of the five kinds of values and of what resembles them, with made-up values planted at known
places. Names come from a list of which the finder knows ``LISTED`` only, so it learns what names of each degree of likeness are worth.
"""

from __future__ import annotations

import random
import re

from colloquy.llm import crf, pii

SAMPLES = 6000
LISTED = 0.6

GIVEN = "Anjali Mateo Anneke Solveig Bartholomew Ingrid Kenji Amélie Joaquín Wanjiru Ludovica Farouk Marisol Dietlinde Oskar Thibault Rosalind Henrike Esteban Gwendolyn Casimir Philippa Leonora Anselm Beatrix".split()
FAMILY = "Venkataraman Okonkwo Villanueva Hammerschmidt Lindqvist Beaumarchais Castellanos Nakagawa Pemberton Zwingmann Delacroix Ferreira Gutzeit Holloway Izquierdo Jankowski Kaltenbrunner Larsson Mbeki Navarro Ottinger Poirier Quesada Rautenberg Schreiner".split()
STARTS, VOWELS = "Bram Cald Dorv Ervin Farl Ghent Holv Imbr Jask Kord Lorv Morv".split(), "a e i o".split()
GIVEN_ENDS, FAMILY_ENDS = "lin dor wyn ta mir".split(), "berg sen well quist aux".split()
PLACES = "Norvale Brackmouth Eastfield Kirchdorf Montclair Valdeora Sandhaven Altenheim".split()
STREETS = "Millbrook Harrow Kastanien Tilleul Olivar Granary Orchard Beacon".split()

TRUE = """
Mail {email}, please.|You can reach me at {email}.|E-Mail: {email}|contact={email}; lang=en|<{email}> is on copy|Schreib an {email} bis morgen.|Écris à {email}.|Escribe a {email} hoy.|{name} | {email}|{name}, {phone}, {email}
Call me on {phone}.|Tel: {phone}|Tel.: {phone}|My number is {phone}.|Ruf mich unter {phone} an.|Meine Nummer: {phone}.|Mon numéro est le {phone}.|Llámame al {phone}.|ring {phone} after six|You can text {phone} any time.|{phone} is the landline|{phone}|{email} / {phone}|{name}; {phone}; {email}|fax {phone}
My social security number is {id_ssn}.|Social: {id_ssn}|My NI number, {id_nino}, was rejected.|Passport {id_document} expires soon.|passport no {id_document} please|Die Passnummer ist {id_document}.|Meine Steuer-ID lautet {id_tax}.|The tax number {id_tax} is mine.|tax id {id_tax} belongs to my father|El NIF de mi madre es {id_nif}.|Mi DNI es {id_nif}.|N° sécu : {id_nir}|Pièce d'identité : {id_document}|Ausweisnummer: {id_document}|El pasaporte {id_document} caduca pronto.|{id_document} is my passport number|My driving licence is {id_other}.|Her social security no. was {id_ssn}.|My ID card number is {id_other}.
I live at {address}.|Ship it to {address}. Thanks|Home address: {address}|{name}\n{address}|Anschrift: {address}|Bitte liefern an: {address}|J'habite {address}.|Vivo en {address}.|Envíalo a {address}.|Contact card: {name} / {address} / {phone}|We moved to {address} in spring.|Recipient: {any}\n{address}|{name} / {address}|Best wishes\n{name} / {address}|Empfänger: {any} / {address} / {phone}|Tel.: {phone}\n{name} / {address} / {phone} / {email}
My name is {name}.|My name is {any}.|Je m'appelle {any}.|Ich heiße {any}.|Me llamo {any}.|Mein Name ist {any}.|Regards,\n{name}|Please cc {title} {family} on it.|Please cc {title} {stranger} on it.|Contact {title} {stranger} today.|{title} {stranger} wohnt hier.|Frag {title} {any} danach.|The review was done by {title} {name}.|ask {lower} about it|frag doch {lower} danach|I promised {comma} an answer.|{name} from billing already knows.|{initials} has the key.|Signed: {name}|Recipient: {any}|Empfänger: {any}|Contact card: {name} / {phone}|Merci de mettre M. {family} en copie.|Bitte setze Frau {family} in Kopie.|Viele Grüße\n{name}|{reversed} already knows.|{after} is on leave.|Pon en copia a {title} {stranger}.|{title} {initials} agreed.|Merci de mettre Me {name} en copie.|Cordialement,\nMe {family}|Je m'appelle Me {name}.|Don {name} firma hoy.|Miss {family} has left.|Sir {name} spoke.
""".strip()
FALSE = """
Row 1 {n3} {n3} of 9 000 000 failed.|SKU {id_ssn}|The order number is {n4}-{n3}-{n4}.|Build {n3}.{n2}.{n2}.{n3} passed.|Checksum {n8}{n8} matches.|The run took {n3} {n3} ms.|The timer fired at 2025-0{d}-1{d} 10:0{d}:1{d}.|Order {id_ssn} was sent.|Ticket {n4}{n4} is open.|invoice {n3} {n3} {n4}|Version {d}.{n2}.{n4}|ISBN 978 {d} {n4} {n4} {d}|The total is {n3},{n3}.{n2} today.|It has {n8} rows and {n4}{n3} columns.|{n2}.{n2}.{n4}|Seite {n3} 555 {n4}|{n8}|{n3} {n3} {n3}|id {n4}{n4}|Rechnung {n4} {n4}|page {n4}-{n4}|The batch {document} is ready.|Model {document} sold out.|Serial {document}|Part {id_nino} is missing.|{n3} {n2} {n4}
The {street} road was closed for {n2} days.|We counted {n2} {street} trees in {place}.|Install pack@3.8.5 and mention @some_team here|See room {n2}, level 3, in the {place} building.|There are {n2} lanes and {d} squares.|a@b|Chapter {n2} Street Life
The {family} valve needs oil.|{given} knows.|Der {family} Test läuft.|Le {family} est froid.|In {place} it rains.|The {place} office is closed.|it is easy to miss. {place} {d}.{n2} changed the default.|The run took 33 ms. {place} is fine.|The {lfamily} valve needs oil.|My {lgiven} is new.|{Family}|We met in {place} and {place}.|Don {d} Street|QUE ME CONSEILLES-TU ?|REMIND ME HOW WE DID IT|Contact card: none|Recipient: all teams|Signed: yes|Miss {d} of them|{given} or the {family} pump|the drill bit from {family}|Ask Me Anything|Don Quixote lives on.|My name is long.|See Prof. in room {n2}.|Dr. in charge|the {given} {lfamily} pump
""".strip()


def number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


class Maker:
    """Makes sentences with values at known places."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.given = GIVEN + [s + v + e for s in STARTS for v in VOWELS for e in GIVEN_ENDS]
        self.family = FAMILY + [s + v + e for s in STARTS for v in VOWELS for e in FAMILY_ENDS]
        listed = lambda names: rng.sample(names, int(LISTED * len(names)))
        self.names = pii.Names.learn([(n, "given") for n in listed(self.given)] + [(n, "family") for n in listed(self.family)])
        self.likely = [[n for n in names if self.names.like(n) & bit] for bit, names in ((1, self.given), (2, self.family))]

    def person(self, known: bool = True) -> tuple[str, str]:
        given, family = self.likely if known else (self.given, self.family)
        return self.rng.choice(given), self.rng.choice(family)

    def value(self, field: str) -> tuple[str, str | None]:
        """A text for a field and its type, None if it is no value."""
        rng, n = self.rng, lambda k: number(self.rng, k)
        given, family = self.person()
        street, place, house = rng.choice(STREETS), rng.choice(PLACES), str(rng.randint(1, 180)) + rng.choice(["", "", "", "b"])
        match field:
            case "email":
                user, host = f"{given}{rng.choice('._-')}{family}".lower(), f"{place.lower()}.{rng.choice(['example', 'test', 'org'])}"
                return rng.choice([f"{user}@{host}", f"{user}{n(2)}@mail.{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host}", f"{user} at {host.replace('.', ' dot ')}", f"{user}+news@{host}".upper()]), "email"
            case "phone":
                return rng.choice([f"+1 ({n(3)}) {n(3)}-{n(4)}", f"(2{n(2)}) {n(3)} {n(4)}", f"2{n(2)}-{n(3)}-{n(4)}", f"1.2{n(2)}.{n(3)}.{n(4)}", f"07{n(3)} {n(3)} {n(3)}", f"+44 7{n(3)} {n(6)}", f"0044 1{n(3)} {n(6)}", f"+49 30 {n(5)} {n(3)}", f"030/{n(8)}", f"+33 1 {n(2)} {n(2)} {n(2)} {n(2)}", f"01.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"+1{n(10)}", f"+34 6{n(2)} {n(3)} {n(3)}", f"6{n(2)} {n(2)} {n(2)} {n(2)}"]), "phone"
            case "id_ssn":
                return rng.choice(["{}-{}-{}", "{} {} {}", "{}{}{}"]).format(n(3), n(2), n(4)), "idnum"
            case "id_nino":
                return rng.choice(["QQ {} {} {} C", "QQ{}{}{}C"]).format(n(2), n(2), n(2)), "idnum"
            case "id_document" | "document":
                return rng.choice([f"XA {n(7)}", f"X{n(8)}", f"F{n(8)}", f"X{n(2)}K{n(5)}", f"C01X{n(2)}J{n(2)}"]), "idnum" if field != "document" else None
            case "id_tax":
                return rng.choice(["{} {} {} {}", "{}{}{}{}", "{}/{}/{}/{}"]).format(n(2), n(3), n(3), n(3)), "idnum"
            case "id_nif":
                return rng.choice([f"{n(8)}-X", f"{n(2)}.{n(3)}.{n(3)}-T", f"{n(8)}F", f"X{n(7)}L"]), "idnum"
            case "id_nir":
                return rng.choice([f"1 {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", f"2{n(2)}{n(2)}{n(2)}{n(3)}{n(3)}{n(2)}"]), "idnum"
            case "id_other":
                return rng.choice([n(9), n(10), f"AB{n(8)}"]), "idnum"
            case "address":
                code = n(5)
                return rng.choice([f"{house} {street} {rng.choice(['Street', 'Road', 'Lane', 'Close', 'Ave', 'Terrace'])}", f"{house} {street} Street, {place} {code}", f"Flat {rng.randint(1, 20)}, {house} {street} Road, {place}", f"{house} {street} Lane in {place}", f"{street}straße {house}, {code} {place}", f"{street}weg {house} in {place}", f"{street}allee {house}", f"{house} chemin {street}", f"Calle {street} {house}", f"{house}, rue {street}, {code} {place}", f"{house} bis rue du {street} {code} {place}", f"Calle {street} {house}, 2.º B, {code} {place}", f"Plaza {street} {house} en {place}", f"{house} {street} Terrace\n{place} {code}"]), "address"
            case "name":
                return rng.choice([f"{given} {family}", f"{given} {family}", f"{given} {rng.choice('ABM')}. {family}", f"{given[0]}. {family}", f"{given} {self.person()[0]} {family}"]), "name"
            case "any":
                given, family = self.person(known=rng.random() < 0.5)
                return f"{given} {family}", "name"
            case "stranger":
                return rng.choice([x for x in self.family if not self.names.like(x) & 2] or self.family), "name"
            case "family" | "given" | "Family" | "lfamily" | "lgiven":
                word = given if field.endswith("given") else family
                return word.lower() if field[0] == "l" else word, "name" if field == "family" and self.titled else None
            case "initials":
                return f"{given[0]}.{rng.choice(['', ' '])}{rng.choice(['', 'K. '])}{family}", "name"
            case "lower":
                return f"{given} {family}".lower(), "name"
            case "comma":
                return f"{family}, {given}", "name"
            case "reversed":
                return f"{family} {given}", "name"
            case "after":
                return f"{family}, {given[0]}.", "name"
            case "title":
                return rng.choice("Mr Mr. Mrs Ms Dr. Prof. Herr Frau Mme Sr. Sra. Señora Dr Herrn".split()), None
            case "street" | "place":
                return street if field == "street" else place, None
            case "d":
                return str(rng.randint(1, 9)), None
        return n(int(field[1:])), None

    def sentence(self, template: str) -> tuple[str, set[tuple[int, int, str]]]:
        self.titled = bool(re.search(r"(?:\{title\}|M\.|Frau|Me|Miss) \{family\}", template))
        text, true = "", set()
        for i, part in enumerate(re.split(r"\{(\w+)\}", template.replace("\\n", "\n"))):
            value, kind = self.value(part) if i % 2 else (part, None)
            if kind:
                true.add((len(text), len(text) + len(value), kind))
            text += value
        return text, true


def samples(seed: int = 1, count: int = SAMPLES) -> tuple[pii.Names, list[tuple[str, set[tuple[int, int, str]]]]]:
    """The names that the finder may know, and texts of one to three sentences with their true segments."""
    rng = random.Random(seed)
    maker = Maker(rng)
    pools = [[t for line in block.split("\n") for t in line.split("|")] for block in (TRUE, FALSE)]
    out = []
    for _ in range(count):
        text, true = "", set()
        for k in range(rng.randint(1, 3)):
            kind = rng.random() < 0.5
            own, spans = maker.sentence(rng.choice(pools[kind]))
            spans = set() if kind else spans
            text += ("" if not k else rng.choice([" ", "\n", "\n\n", " "]))
            true |= {(s + len(text), e + len(text), kind) for s, e, kind in spans}
            text += own
        out.append((text, true))
    return maker.names, out


def main() -> None:
    names, rows = samples()
    finder = pii.Finder(names, {})
    data = [(text, finder.candidates(text), true) for text, true in rows]
    missing = [(t, text[s:e], kind) for t, (text, found, true) in enumerate(data) for s, e, kind in true if (s, e, kind) not in {c[:3] for c in found}]
    table = crf.fit(data)
    print(f"# {len(missing)} of {sum(len(t) for _, _, t in data)} planted values have no candidate, such as {[(rows[t][0], v, k) for t, v, k in missing[:8]]}")
    print("PII: dict[str, float] = {\n" + "".join(f'    "{k}": {v},\n' for k, v in table.items()) + "}")


if __name__ == "__main__":
    main()

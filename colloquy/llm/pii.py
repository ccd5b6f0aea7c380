"""Personal information in free text.

A semi-Markov conditional random field over whole spans (:mod:`colloquy.llm.crf`). Candidate segments of the five types are laid over a text;
each is scored by features of the whole span: its form, the cues in its sentence that lead to it or follow it, the likeness of its words
to listed names, and what speaks against it. Candidates that look wrong stay in the lattice; only the weights decide, and decoding
chooses boundaries and types jointly, so a name inside an address or an e-mail address gives way to it.

The weights are fitted by ``python -m colloquy.llm.pii_train`` on a bounded sample of sentences with planted values and look-alikes
(``pii_train.SAMPLES`` of them); they are the table :data:`colloquy.llm.weights.PII`. The likeness of a word to given and
family names is learned from the name list, by the beginnings and endings that several listed names share. Spans without any evidence
(no form, no title, no introduction, no likeness) aren't built: the bias of their label alone is below every transition.

HTML is read as it shows: scripts, styles, comments and attributes are left out, inline markup joins, line-break and block tags
part, and character references are decoded.

Defined results: null and empty texts have no values; a value that occurs twice in a record is one row; records delivered twice give their rows once;
white space in a value is one blank; an empty name list leaves the names that follow a title or an introduction; neither values nor names have a greatest length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.common import python_partitions
from colloquy.llm import crf, weights
from colloquy.llm.crf import Candidate

#: Letters that may stand between a shared beginning and a shared ending; one after a beginning of three letters.
LINK = 2
#: Words whose likeness a worker remembers; more only cost time.
MEMORY = 300_000

# ---- visible text of markup

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
LINE_BREAK = re.compile(r"<br\b[^>]*>", re.I)
BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|tr|td|th|table|tbody|thead|section|article|blockquote|pre|h[1-6]|hr|header|footer|dl|dt|dd|figure|form|main|nav|aside)\b[^>]*>", re.I)
MARKUP = re.compile(r"</?[a-zA-Z!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
SPACE = re.compile(r"\s+")


def visible(markup: str | None) -> str:
    """The text that a reader sees; a line break is one line end, a block two."""
    if not markup:
        return ""
    text = SPACE.sub(" ", HIDDEN.sub(" ", markup) if "<" in markup else markup)
    if "<" in text:
        text = MARKUP.sub("", BLOCK.sub("\x00", LINE_BREAK.sub("\x01", text)))
    text = html.unescape(text) if "&" in text else text
    return text.replace("\xa0", " ").replace("\x01", "\n").replace("\x00", "\n\n")


# ---- likeness to names


@dataclass(frozen=True)
class Names:
    """Listed names, and the beginnings and endings that at least ``SHARED`` of them have."""

    given: frozenset[str]
    family: frozenset[str]
    parts: dict[str, tuple[frozenset[str], frozenset[str]]]
    longest: int

    SHARED = 3

    @staticmethod
    def learn(rows: Iterable[tuple[str | None, str | None]]) -> Names:
        by: dict[str, set[str]] = {"given": set(), "family": set()}
        for name, kind in rows:
            if name and kind in by:
                by[kind].update(w for w in name.lower().split() if len(w) >= 3)
        parts = {}
        for kind, names in by.items():
            starts, ends = Counter(), Counter()
            for n in names:
                starts.update(n[:i] for i in range(3, len(n) - 1))
                ends.update(n[i:] for i in range(3, len(n) - 1))
            parts[kind] = (frozenset(s for s, k in starts.items() if k >= Names.SHARED), frozenset(e for e, k in ends.items() if k >= Names.SHARED))
        longest = max((len(x) for pair in parts.values() for side in pair for x in side), default=0)
        return Names(frozenset(by["given"]), frozenset(by["family"]), parts, longest)

    def like(self, word: str) -> int:
        """1 for a given name, 2 for a family name, 3 for both; listed, or composed of shared parts."""
        w = word.lower()
        bits = (w in self.given) | (w in self.family) << 1
        if bits or len(w) < 5:
            return bits
        for bit, kind in ((1, "given"), (2, "family")):
            starts, ends = self.parts[kind]
            if any(w[:i] in starts and any(w[i + k :] in ends for k in range(min(LINK, i - 2) + 1)) for i in range(3, min(len(w) - 1, self.longest + 1))):
                bits |= bit
        return bits


# ---- candidate segments

S = r"(?:[^\S\n]+)"
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
TOWN = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
ZIP = r"(?:(?:[A-Z]{1,2}-)?\d{5}(?:-\d{4})?|\d{4}|[A-Z]{1,2}\d[\dA-Z]?\s?\d[A-Z]{2})(?!\w)"
AT, DOT = r"(?:@|\s*[\[({]\s*at\s*[\])}]\s*)", r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9](?:[\w.%+-]*[\w])?{AT}(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{DOT})+[A-Za-z]{{2,24}}(?![\w@])", re.I)
SPOKEN_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.%+-]*{S}at{S}(?:[A-Za-z0-9-]+{S}dot{S})+[A-Za-z]{{2,24}}(?!\w)", re.I)

PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d[ ,])(?:(?P<intl>(?:\+|00)[1-9]\d{0,2})[ .\-/]?)?(?P<rest>(?:\(0?\d{1,5}\)[ .\-/]?)?\d{2,}+(?:[ .\-/]?\d{2,}+)*+|(?:\(0?\d{1,5}\)[ .\-/]?)\d++(?:[ .\-/]?\d++)*+|\d(?:[ .\-/]\d{2,}+)++)(?![\w]|[.,]\d|[-/]\w)"
)
PHONE_FORMS = [
    re.compile(p)
    for p in (
        r"(?:1[ .\-])?\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}",  # North America
        r"0\d{1,4}[ /\-]\d{5,8}|0\d{1,4}[ /\-]\d{2,5}(?:[ \-]\d{2,4}){1,3}|\(0\d{1,4}\)[ /\-]?\d{2,}(?:[ \-]?\d{2,}){0,3}",  # Germany
        r"0[1-9](?:[ .\-]?\d{2}){4}",  # France
        r"07\d{3}[ ]?\d{3}[ ]?\d{3}|0\d{3,4} \d{3} ?\d{3,4}|0\d{2} \d{4} \d{4}",  # United Kingdom
        r"[6789]\d{2}[ .\-]\d{3}[ .\-]\d{3}|[6789]\d{2}[ .\-]\d{2}[ .\-]\d{2}[ .\-]\d{2}",  # Spain
    )
]
PHONE_CUE = re.compile(
    r"\b(?:tel|tél|téléphone|teléfono|telefon\w*|phone|mobile|móvil|portable|handy|cell|fax|call|ring|text|reach|whatsapp|landline|llám\w+|appel\w*|ruf\w*|anruf\w*)\b|\b(?:my|meine|mi|mon) (?:number|nummer|número|numéro)|手机|电话", re.I
)
PHONE_AFTER = re.compile(r"[^\n]{0,4}(?:is the (?:landline|mobile|number)|after six|any time)", re.I)
AGAINST = re.compile(
    r"\b(?:sku|order(?: (?:number|no\.?))?|row|rows|of|build|checksum|ticket|version|invoice|run took|took|id|ids|isbn|issn|ean|asin|article|item|serial|part|batch|record|page|line|port|bestellung|bestellnummer|auftrag\w*|rechnung\w*|commande|facture|pedido|factura|referencia|ref)\b[\s.:#=n°º-]*(?:is|ist|lautet|est|es|number|no\.?|nr\.?)?[\s.:#=-]*",
    re.I,
)

IDNUMS = {
    "ssn": re.compile(r"(?<![\w-])\d{3}([ -]?)\d{2}\1\d{4}(?![\w-]|[.,]\d)"),
    "nino": re.compile(r"(?<!\w)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)"),
    "document": re.compile(r"(?<!\w)[A-Z]{1,3}[ -]?\d{6,9}(?!\w)|(?<!\w)[A-Z]\d[\dA-Z]{7,8}(?!\w)|(?<!\w)\d{2}[A-Z]{2}\d{5}(?!\w)"),
    "tax": re.compile(r"(?<!\w)\d{2}([ /-]?)\d{3}\1\d{3}\1\d{3}(?!\w|[.,]\d)"),
    "nif": re.compile(r"(?<!\w)(?:\d{2}\.?\d{3}\.?\d{3}|[XYZ]-?\d{7})[ -]?[A-Z](?!\w)"),
    "nir": re.compile(r"(?<!\w)[12]\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d{2})?(?!\w)"),
    "other": re.compile(r"(?<!\w)(?:\d{17}[\dXx]|\d{7,12}|[A-Z0-9]{2,4}-?[A-Z0-9]*\d[A-Z0-9]{5,12})(?!\w|[.,]\d)"),
}
ID_CUE = re.compile(
    r"social security|\bsocial\b|\bssn\b|national insurance|\bni(?: number| no\.?)|\bnino\b|passport|passeport|pasaporte|(?:reise)?pass(?:nummer|-?nr\.?)|reisepass|\btax(?:payer)?[ -]?(?:id|no\.?|number|file)|\btin\b|\bid (?:card|number|no)|identity (?:card|number)"
    r"|driv\w+ licen[cs]e|steuer-?\s?id\w*|steuernummer|\bidnr|\b(?:personal)?ausweis\w*|führerschein\w*|sozialversicherung\w*|rentenversicherung\w*|carte (?:nationale )?d['’]identité|pièce d['’]identité|\bcni\b|sécurité sociale|n[°ºo]\.? ?(?:de )?sécu\w*|\bsécu\b|numéro fiscal"
    r"|\bn\.?i\.?f\b|\bd\.?n\.?i\b|\bn\.?i\.?e\b|documento (?:nacional|de identidad)|seguridad social|身份证|护照|税号|社保",
    re.I,
)
ID_AFTER = re.compile(r"\s*[,:]?\s*(?:is|ist|es|est) (?:my|mein\w*|mi|mon) (?:passport|tax|social|id\b|pasaporte|ausweis)", re.I)

SUFFIX = r"(?:Street|Road|Lane|Avenue|Close|Terrace|Drive|Court|Square|Way|Place|Boulevard|Crescent|Gardens|Hill|Row|Walk|Mews|Grove|Parkway|Rd\.?|(?:St|Ave|Ln|Dr|Ct|Sq|Pl|Blvd)(?:\.(?=,|[^\S\n]+in\b|\s*\n))?)(?!\w)"
UNIT = rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor){S}?#?\w{{1,4}}"
DE_WAY = r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|chaussee|steig)"
FR_WAY = r"(?:rue|avenue|av\.|place|boulevard|bd\.?|chemin|impasse|allée|quai|cours|route|square|passage)"
ES_WAY = r"(?:Calle|C/|Plaza|Pza\.?|Avenida|Avda\.?|Av\.|Paseo|Camino|Ronda|Carretera|Travesía)"
ADDRESSES = [
    # English
    re.compile(
        rf"(?<![\w.,-])(?:{UNIT},{S})?\d{{1,5}}[a-zA-Z]?,?{S}(?:{CAP}{S})+?{SUFFIX}(?:,{S}{UNIT})?"
        rf"(?:(?:,{S}|{S}in{S}){TOWN}(?:,?{S}{ZIP})?|,?\s*\n\s*{TOWN},?{S}{ZIP}|,?{S}{TOWN}{S}{ZIP}|,{S}{ZIP}{S}{TOWN})?"
    ),
    # French
    re.compile(
        rf"(?<![\w.,-])\d{{1,4}}(?:{S}?(?:bis|ter|quater)\b|[a-zA-Z]\b)?,?{S}(?i:{FR_WAY}){S}(?:(?:de{S}la|de{S}l['’]|du|des|de|d['’]){S}?)?{CAP}(?:,{S}(?i:bât\.?|bâtiment|appt\.?|apt\.?|appartement|esc\.?|escalier|étage){S}?\w{{1,4}})?"
        rf"(?:(?:,?{S}|,?\s*\n\s*|{S}à{S}){ZIP}{S}{TOWN}|(?:,{S}|{S}à{S}){TOWN}(?:{S}\(?{ZIP}\)?)?)?"
    ),
    # German
    re.compile(
        rf"(?<!\w)(?:{ZIP}{S}{TOWN},{S})?(?:[A-ZÄÖÜ][\wäöüß-]*{DE_WAY}|{CAP}{S}(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring|Damm)){S}\d{{1,4}}(?:{S}?[a-zA-Z](?!\w))?(?:,{S}(?:Whg\.?|Wohnung|App\.?|Apt\.?|\d{{1,2}}\.{S}(?:OG|Stock|Etage)|EG|Hinterhaus){S}?\w{{0,4}})?"
        rf"(?:(?:,{S}|{S}in{S}|,?\s*\n\s*){ZIP}{S}{TOWN}|(?:,{S}|{S}in{S}){TOWN}(?:{S}\(?{ZIP}\)?)?)?"
    ),
    # Spanish
    re.compile(
        rf"(?<!\w){ES_WAY}{S}(?:(?:de{S}la|del|de{S}los|de{S}las|de){S})?{CAP},?{S}(?:n\.?º{S}?)?\d{{1,4}}[a-zA-Z]?(?!\w)(?:,{S}\d{{1,2}}\.?[ºª°]{S}?(?:[A-Z]\b|(?:izq|dcha)\w*\.?)?)?(?:,{S}(?:esc\.|piso|puerta|bajo){S}?\w{{0,3}})?"
        rf"(?:(?:,{S}|{S}en{S}|,?\s*\n\s*){ZIP}{S}{TOWN}|(?:,{S}|{S}en{S}){TOWN}(?:{S}\({ZIP}\)|,?{S}{ZIP})?)?"
    ),
]
#: What a text must hold, in lower case, for an address of each kind.
STREET_HINTS = [
    tuple(f" {w}" for w in "street st road rd lane ln avenue ave close terrace drive dr court ct square sq way place pl boulevard blvd crescent gardens hill row walk mews grove parkway".split()),
    tuple("rue avenue av. place boulevard bd chemin impasse allée quai cours route square passage".split()),
    tuple("straße strasse str. weg allee gasse platz ring damm ufer chaussee steig".split()),
    tuple("calle c/ plaza pza avenida avda av. paseo camino ronda carretera travesía".split()),
]

TITLE = r"(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Herrn?|Frau|Fräulein|Hr|Mme|Mmes|Mlle|Monsieur|Madame|Mademoiselle|Me|Sr|Sra|Srta|Dña|Dra|Señora?|Señorita|Don|Doña|Ing|Lic)"
TITLES = re.compile(rf"(?<![\w.])(?:{TITLE}\b\.?\s+)+(?:(?:med|phil|jur|rer|nat|h\.c)\.\s+)*", re.I)
BEFORE_TITLE = re.compile(rf"(?:(?<![\w.])(?:{TITLE}\b\.?\s+))\Z", re.I)
FRENCH = re.compile(r"\b(?:est|de la|le|les|je|merci|mettre|en copie|pour|par|vous|nous|et|à|au)\b|[éèêàç]", re.I)
INITIALS = re.compile(r"(?<![\w.])(?:[A-ZÀ-Þ]\.[^\S\n]?-?)+\s*\Z")
INITIALS_AFTER = re.compile(r",?[^\S\n]+(?:[A-ZÀ-Þ]\.(?:[^\S\n]?-?[A-ZÀ-Þ]\.)*)(?!\w)")
WORDS = re.compile(r"[^\W\d_]{3,}(?:[-'’][^\W\d_]{2,})*")
INTRODUCED = re.compile(
    r"(?:\b[Mm]y name is|\bI am called|\bSigned:|\bsigned by|\b[Jj]e m['’]appelle|\b[Mm]e llamo|\b[Mm]i nombre es|\b[Ii]ch heiße|\b[Mm]ein Name ist|\bRecipient:|\bContact card:|\bDestinataire\s?:|\bEmpfänger:|\bDestinatario:)\s+"
    rf"(?:(?:{TITLE})\b\.?\s+)*((?:[A-ZÀ-Þ]\.[^\S\n]?)*{CAP}(?:,?[^\S\n]+(?:[A-ZÀ-Þ]\.[^\S\n]?)*{CAP}|(?:[^\S\n]+[A-ZÀ-Þ]\.)+[^\S\n]+{CAP}))"
)

#: Characters in which what touches a span is looked for: white space, initials, a title.
NEAREST = 40
GAP, GAP_END = re.compile(r"\s+\Z"), re.compile(r"\s*\Z")
COMMA = re.compile(r"(,?)\s+")
LATER_INITIALS = re.compile(r"(?:[^\S\n]+[A-ZÀ-Þ]\.)+(?!\w)")
AFTER_TITLE_ONE = re.compile(rf"(?:[A-ZÀ-Þ]\.[^\S\n]?)*{CAP}")
AFTER_TITLE_MORE = re.compile(rf"(?:[A-ZÀ-Þ]\.[^\S\n]?)*{CAP}(?:[^\S\n]+{CAP})+")
ADDRESS_CODE = re.compile(ZIP)
ADDRESS_TOWN = re.compile(rf"(?:,|\bin|\ben|\bà|\n)\s*(?:{ZIP}\s+)?{TOWN}")

#: What a text must hold for a phone number, an identity number and an address.
LONG_NUMBER = re.compile(r"\d[\d ().\-/\xa0]{5,}\d")
ID_NUMBER = re.compile(r"\d(?:[ .\-/\xa0]?[\dA-Z]){5}")
HOUSE_NUMBER = re.compile(r"(?<![\w.])\d{1,5}(?:[ \xa0]?[a-z]\w{0,3})?(?![\w.]\d)")

BREAK = re.compile(r"\n|(?<!\b[Nn][Oo])(?<!\b[Nn][Rr])[.!?]\s+(?=\S*[A-Z])")
RUN = re.compile(r"\d{4}")
LEADS = re.compile(r"(?:^|[\n/;|(\"])[^\S\n]*\Z")
FOLLOWS = re.compile(r"\s*(?:\Z|[\n/;|)\"])")
ARTICLE = re.compile(r"\b(?:the|der|die|das|den|dem|le|la|les|el|los|las|an?|eine?|une?|un)\s+\Z", re.I)
#: A text that has none of these has no title, and no introduction.
TITLE_HINTS = tuple("Mr Ms Miss Mx Dr DR MR MS Prof Sir Dame Herr HERR Frau FRAU Fräulein Hr Mme Mlle Monsieur Madame Mademoiselle Me Sr Dña Señor Don Doña Ing Lic".split())
INTRODUCED_HINTS = ("name is", "am called", "igned", "appelle", "llamo", "nombre es", "heiße", "Name ist", "Recipient:", "Contact card:", "Destinat", "Empfänger:")
WEAK_TITLES = frozenset("me don dame sir ing lic miss".split())
INTRODUCED_WEAKLY = re.compile(r"Recipient|Contact|Destinat|Empf")

Segment = tuple[int, int, str]


class Context:
    """What surrounds the candidates of a text: sentence breaks, cues and numbers, found once."""

    def __init__(self, text: str):
        self.text = text
        self.breaks = [m.end() for m in BREAK.finditer(text)]
        self.cues: dict[re.Pattern, list[int]] = {}

    def sentence(self, at: int) -> int:
        """Where the sentence of a place begins."""
        i = bisect_right(self.breaks, at)
        return self.breaks[i - 1] if i else 0

    def ends(self, pattern: re.Pattern) -> list[int]:
        if pattern not in self.cues:
            self.cues[pattern] = [m.end() for m in pattern.finditer(self.text)]
        return self.cues[pattern]

    def led(self, at: int, cue: re.Pattern) -> str | None:
        """``cue`` or ``far cue`` if the sentence has the cue before the place, ``used cue`` if a number stands between."""
        ends = self.ends(cue)
        i = bisect_right(ends, at)
        if not i or ends[i - 1] < self.sentence(at):
            return None
        runs = self.ends(RUN)
        j = bisect_right(runs, at)
        if j and runs[j - 1] > ends[i - 1]:
            return "used cue"
        return "cue" if at - ends[i - 1] <= 24 else "far cue"

    def against(self, at: int) -> bool:
        ends = self.ends(AGAINST)
        i = bisect_right(ends, at)
        return bool(i) and ends[i - 1] == at


class Finder:
    """Finds the segments of a text."""

    def __init__(self, names: Names, table: Mapping[str, float] = weights.PII):
        self.names, self.weights = names, table
        self.known: dict[str, int] = {}

    def like(self, word: str) -> int:
        bits = self.known.get(word)
        if bits is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            bits = 0
            for part in re.split(r"[-'’]", word):
                bits |= self.names.like(part)
            self.known[word] = bits
        return bits

    def emails(self, text: str) -> Iterator[Candidate]:
        low = text.lower()
        if "@" in text or re.search(r"[\[({]\s*at\s*[\])}]", low):
            for m in EMAIL.finditer(text):
                yield Candidate(m.start(), m.end(), "email", ("bias", "at" if "@" in m[0] else "bracketed at", "numeric end" if m[0][-1].isdigit() else "end"))
        if " at " in low and " dot " in low:
            for m in SPOKEN_EMAIL.finditer(text):
                yield Candidate(m.start(), m.end(), "email", ("bias", "spoken"))

    def phones(self, text: str, around: Context) -> Iterator[Candidate]:
        for m in PHONE.finditer(text):
            value = SPACE.sub(" ", m[0])
            digits = sum(map(str.isdigit, value))
            if not 7 <= digits <= 15:  # no telephone number has fewer or more
                continue
            start, end = m.span()
            features = ["bias"]
            if m["intl"]:
                features.append("short international" if digits < 10 else "international")
            elif digits < 9:
                features.append("short")
            if "(" in value:
                features.append("bracketed")
            if any(f.fullmatch(value) for f in PHONE_FORMS):
                features.append("national form")
            elif not m["intl"]:
                features.append("no form")
            if PHONE_AFTER.match(text, end):
                features.append("cue")
            elif led := around.led(start, PHONE_CUE):
                features.append(led)
            if LEADS.search(text, max(0, start - NEAREST), start) and FOLLOWS.match(text, end):
                features.append("alone")
            if around.against(start):
                features.append("against")
            if around.led(start, ID_CUE) in ("cue", "far cue"):
                features.append("identity cue")
            yield Candidate(start, end, "phone", tuple(features))

    def idnums(self, text: str, around: Context) -> Iterator[Candidate]:
        seen: set[tuple[int, int]] = set()
        for name, form in IDNUMS.items():
            for m in form.finditer(text):
                if m.span() in seen:
                    continue
                seen.add(m.span())
                features = ["bias", f"form {name}" if name != "other" else "other form"]
                led = around.led(m.start(), ID_CUE)
                if ID_AFTER.match(text, m.end()):
                    features.append("cue")
                elif led:
                    features.append(led)
                if around.against(m.start()) and led != "cue":
                    features.append("against")
                yield Candidate(*m.span(), "idnum", tuple(features))

    def addresses(self, text: str) -> Iterator[Candidate]:
        low = text.lower()
        for form, hints in zip(ADDRESSES, STREET_HINTS):
            if not any(h in low for h in hints):
                continue
            for m in form.finditer(text):
                features = ["bias"]
                if ADDRESS_CODE.search(m[0]):
                    features.append("postcode")
                if ADDRESS_TOWN.search(m[0]):
                    features.append("town")
                yield Candidate(*m.span(), "address", tuple(features))

    def persons(self, text: str) -> Iterator[Candidate]:
        like, known = self.like, self.known
        if any(known[w] if w in known else like(w) for w in WORDS.findall(text)):
            hits = [(m.start(), m.end(), bits) for m in WORDS.finditer(text) if (bits := like(m[0]))]
            yield from self.composed(text, hits)
        if any(h in text for h in TITLE_HINTS):
            yield from self.titled(text)
        if any(h in text for h in INTRODUCED_HINTS):
            for m in INTRODUCED.finditer(text):
                words = WORDS.findall(m[1])
                n = sum(map(bool, map(like, words)))
                kind = "introduced weakly" if INTRODUCED_WEAKLY.match(m[0]) else "introduced"
                yield Candidate(*m.span(1), "name", ("bias", "upper", kind, "all known" if n == len(words) else "some known" if n else "none known"))

    def composed(self, text: str, hits: list[tuple[int, int, int]]) -> Iterator[Candidate]:
        """Given names and initials before or after a word like a family name."""
        at = {s: (e, b) for s, e, b in hits}
        ends = {e: (s, b) for s, e, b in hits}
        for start, end, bits in hits:
            if not bits & 2:
                continue
            upper = text[start].isupper()
            case = "upper" if upper else "lower"
            left, features = start, []
            while True:
                gap = GAP.search(text, max(0, left - NEAREST), left)
                if gap and (h := ends.get(gap.start())) and h[1] & 1 and "\n\n" not in gap[0]:
                    left = h[0]
                    features.append("given")
                elif upper and (i := INITIALS.search(text, max(0, left - NEAREST), left)) and "\n" not in i[0]:
                    if not features and i[0].strip() == "M.":
                        french = bool(FRENCH.search(text[max(0, left - 120) : left + 120])) and not re.search(r"\bmy|the|from\b", text[max(0, left - 40) : left])
                        before = ends.get(len(text[: i.start()].rstrip()) if i.start() < NEAREST else i.start() - len(GAP_END.search(text, max(0, i.start() - NEAREST), i.start())[0]), (0, 0))
                        if french and not before[1] & 1:
                            yield Candidate(start, end, "name", ("bias", case, "family", "title"))
                            features.append("monsieur")
                    left = i.start()
                    features.append("initials")
                else:
                    break
            title = BEFORE_TITLE.search(text, max(0, left - NEAREST), left)
            if title:
                word = title[0].strip(" .\t\xa0\n").lower()
                features.append("lower title" if title[0].strip()[0].islower() else "weak title" if word in WEAK_TITLES else "title")
            if features:
                yield Candidate(left, end, "name", ("bias", case, "family", *dict.fromkeys(features)))
            comma = COMMA.match(text, end)
            if comma and (h := at.get(comma.end())) and h[1] & 1 and (not h[1] & 2 or comma[1]) and "\n" not in comma[0].strip(" ") and text[comma.end()].isupper() == upper:
                stop = h[0]
                if i := LATER_INITIALS.match(text, stop):
                    stop = i.end()
                yield Candidate(start, stop, "name", ("bias", case, "family", "given", "comma" if comma[1] else "reversed"))
            elif upper and (i := INITIALS_AFTER.match(text, end)):
                yield Candidate(start, i.end(), "name", ("bias", case, "family", "initials after"))

    def titled(self, text: str) -> Iterator[Candidate]:
        """One or more capitalised words after a title."""
        for m in TITLES.finditer(text):
            if not m[0].strip()[0].isupper():
                continue
            word = re.split(r"[\s.]+", m[0].strip(" .\t\xa0\n"))[-1].lower()
            kind = "weak title" if word in WEAK_TITLES else "title"
            for form in (AFTER_TITLE_ONE, AFTER_TITLE_MORE):
                if t := form.match(text, m.end()):
                    words = WORDS.findall(t[0])
                    if not words:
                        continue
                    last = self.like(words[-1])
                    if last & 2 and len(words) == 1:
                        continue  # composed already
                    first = self.like(words[0])
                    features = ["bias", "upper", kind, "family" if last & 2 else "capitals" if words[-1].isupper() and len(words[-1]) > 1 else "unknown"]
                    if len(words) > 1:
                        features.append("given" if first & 1 else "second unknown" if not last & 2 else "first unknown")
                    yield Candidate(*t.span(), "name", tuple(features))

    def candidates(self, text: str) -> list[Candidate]:
        out = list(self.emails(text))
        numbers = LONG_NUMBER.search(text), ID_NUMBER.search(text)
        if any(numbers):
            around = Context(text)
            if numbers[0]:
                out.extend(self.phones(text, around))
            if numbers[1]:
                out.extend(self.idnums(text, around))
        if HOUSE_NUMBER.search(text):
            out.extend(self.addresses(text))
        out.extend(self.persons(text))
        return out

    def segments(self, text: str | None) -> list[Segment]:
        """The labelling with the highest score, in order. Line ends of any kind are read as LF, at their places."""
        text = text and text.replace("\r\n", " \n").replace("\r", "\n")
        found = self.candidates(text) if text else []
        return [c[:3] for c in crf.decode(text, found, self.weights)] if found else []

    def values(self, text: str | None) -> list[tuple[str, str]]:
        return [(kind, SPACE.sub(" ", text[s:e]).strip()) for s, e, kind in self.segments(text)]

    def redacted(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e, kind in self.segments(text):
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join(out) + text[at:]


#: More listed names than there are in the world's registers (some 20 MB); a longer list is taken for a mistake and refused before anything is shipped.
NAME_BOUND = 1_000_000


def learned(name_list: DataFrame) -> Names:
    """The names learned from the list. A list of names is a vocabulary, as a tokenizer's is: it doesn't grow with the texts."""
    rows = name_list.select(F.trim("name").alias("name"), F.lower(F.trim("kind")).alias("kind")).where("name is not null").distinct().limit(NAME_BOUND + 1).collect()
    if len(rows) > NAME_BOUND:
        raise ValueError(f"the name list has more than {NAME_BOUND} names")
    return Names.learn((r["name"], r["kind"]) for r in rows)


def texts(messages: DataFrame, activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, rec_id and the text or the pieces of markup of each record."""
    own = messages.where("text is not null and msg_id is not null").select(F.lit("message").alias("src"), F.col("msg_id").alias("rec_id"), F.array("text").alias("texts"))
    shown = activity.where("safehtmlitem is not null and activity_id is not null").select(F.lit("activity").alias("src"), F.col("activity_id").alias("rec_id"), F.col("safehtmlitem.html").alias("texts"))
    return own, shown


def read(parts: list[str | None] | None, markup: bool) -> str:
    """The visible text of markup; a message as it stands."""
    parts = [p for p in parts or [] if p]
    return "\n\n".join(map(visible, parts)) if markup else "\n\n".join(parts)


def mapped(messages: DataFrame, activity: DataFrame, name_list: DataFrame, redact: bool) -> DataFrame:
    shared = messages.sparkSession.sparkContext.broadcast(learned(name_list))
    columns = ["text"] if redact else ["pii_type", "found"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for src, rec, parts in zip(*(c.to_pylist() for c in batch.columns)):
                text = read(parts, src == "activity")
                if redact:
                    out.append((src, rec, own.redacted(text)))
                else:
                    out.extend((src, rec, kind, value) for kind, value in dict.fromkeys(own.values(text)))
            arrays = list(zip(*out)) if out else [()] * (2 + len(columns))
            types = [pa.string(), pa.int64(), *[pa.string()] * len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], ["src", "rec_id", *columns])

    schema = "src string, rec_id long, " + ", ".join(f"{c} string" for c in columns)
    own, shown = texts(messages, activity)
    if redact:  # each record once, before the work
        own, shown = own.dropDuplicates(["rec_id"]), shown.dropDuplicates(["rec_id"])
    return python_partitions(own).mapInArrow(run, schema).unionByName(python_partitions(shown).mapInArrow(run, schema))


def found(messages: DataFrame, activity: DataFrame, name_list: DataFrame) -> DataFrame:
    """Each value of each record once; only the values are exchanged, never the texts."""
    return mapped(messages, activity, name_list, redact=False).distinct()


def redacted(messages: DataFrame, activity: DataFrame, name_list: DataFrame) -> DataFrame:
    """The text of each record, once, with a typed placeholder for each value; the rest, line ends too, as it stands."""
    return mapped(messages, activity, name_list, redact=True)

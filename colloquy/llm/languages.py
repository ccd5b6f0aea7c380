"""Which language a text is mainly in, by its script and its function words."""

from __future__ import annotations

import re

# Function words of the languages that the other operators of this package read as well.
FUNCTION_WORDS = {
    "en": "the and is are was were of to in that it you your for with on as at be this have has had not but they we my our from or an will would can could should there their what which who how if when where why before after then than about into them all do does did its while since every any i me so because please hello thanks",
    "de": "der die das und ist sind war waren zu den dem des ein eine einen einem einer nicht mit auf für von im am es du dein ich wir ihr sie er uns mir mich dir dich wie was wer wenn ob oder aber auch noch nur nach bei aus zum zur bis seit sich so wird werden wurde kann kannst können soll muss hat habe haben dass daß weil dann als vor über unter durch gegen ohne schon sehr mehr hier dort danach zuerst alles nichts beim vom keine kein meistens etwa dies diese dieser in an so me hallo danke bitte heute gestern gleichzeitig",
    "fr": "le les et est sont était du au aux un une dans que qui ce cette ces il elle nous vous je tu ne pas plus pour par sur avec sans sous mais ou où si quand comment pourquoi quel quelle mon ma mes ton ta tes son sa ses leur leurs être avoir fait peut peux dois doit ai as ont avez avons cela ça rien tout tous très puis ensuite après avant jusqu depuis dès moi toi lui dont chez en des à qu environ la de se me te lo es son si aucun car donc chaque encore toujours peu alors voici même bonjour merci salut svp",
    "es": "el los las y está están era del al un una unos unas en que quien este esta estos estas él ella nosotros yo tú no más por para sobre con sin pero o si cuando cómo qué cuál dónde quién mi mis tu tus su sus ser estar ha han hay he has puede puedo puedes debo debe tengo tiene todo nada muy luego después antes hasta desde me te se lo le les es son de la como porque cada entre ese esa eso esto hola gracias ahora",
}
# Function words of further languages, of which only those count that none of the lists above holds.
FURTHER_WORDS = {
    "it": "il che non per è sono della questo anche come gli nel alla delle dei di da ma più perché quando dove chi cosa essere ho ha hai abbiamo prima dopo poi ogni senza con una un loro suo mio",
    "pt": "não uma com para os são foi mais mas ao dos das pelo pela isso isto também você eu ele nós seu sua quando onde porque então depois antes até muito já está estão tem ou em no na",
    "nl": "het een van dat niet met zijn voor aan maar ook bij naar uit dan nog wel geen deze wij zij je mijn hebben wordt worden moet kunnen omdat waar wanneer eerst daarna",
    "sv": "och att det som är inte på av för med den till har jag vi du om men så från när eller efter innan också bara kan ska måste mycket här där",
    "da": "og at det som er ikke på af for med den til har jeg vi du om men så fra når eller efter inden også kun kan skal meget her der blev",
    "pl": "nie się jest na że do jak ale czy to ten ta są był była przez po dla przed który która gdy kiedy gdzie już tylko może można jeszcze bardzo oraz",
    "cs": "je že se na není ale jak který která když kde pro před po jsou byl byla být už jen může také nebo velmi tento tato protože",
    "tr": "bir ve bu için ile değil ne çok daha olarak var yok ama gibi sonra önce her nasıl neden kadar olan",
    "fi": "ja on ei se että hän ovat oli mutta kun jos niin myös tai mitä missä miten ennen jälkeen vain kaikki voi",
    "ro": "și este nu în la cu pentru din sunt care mai dar sau când unde cum după înainte foarte trebuie poate fi",
}
#: Scripts that stand for a language of their own.
SCRIPTS = {"ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "ko": "가-힯", "hi": "ऀ-ॿ", "th": "฀-๿"}
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())


def unique_words() -> dict[str, str]:
    """Words to the one language that has them."""
    seen: dict[str, list[str]] = {}
    for language, words in FUNCTION_WORDS.items():
        for w in words.split():
            seen.setdefault(w, []).append(language)
    out = {w: of[0] for w, of in seen.items() if len(of) == 1}
    further: dict[str, list[str]] = {}
    for language, words in FURTHER_WORDS.items():
        for w in words.split():
            further.setdefault(w, []).append(language)
    return out | {w: of[0] for w, of in further.items() if w not in seen}


LANGUAGE_OF = unique_words()
HAN, KANA = re.compile(r"[㐀-鿿]+"), re.compile(r"[぀-ヿ]+")
FOREIGN = re.compile("[" + "".join(SCRIPTS.values()) + "]")
BY_SCRIPT = {language: re.compile(f"[{span}]+") for language, span in SCRIPTS.items()}
LATIN = re.compile(r"[^\W\d_]+")
ELIDED = re.compile(r"\b(?:[cdjlmnst]|qu)['’](?=[aàâeéèêiîoôuyh])", re.I)
NOISE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|[A-Za-z0-9+/=_-]{25,}", re.S)
ACCENTS = {"ß": "de", "ä": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "ê": "fr", "è": "fr", "œ": "fr", "ł": "pl", "ř": "cs", "ů": "cs", "ã": "pt", "ğ": "tr", "ş": "tr", "å": "sv", "ò": "it"}
WITH_ACCENT = re.compile("[" + "".join(ACCENTS) + "]")


def scores(text: str) -> dict[str, float]:
    """Evidence for each language: function words, elisions, letters and script; code and long strings count for nothing."""
    text = NOISE.sub(" ", text) if "`" in text or len(text) > 24 else text
    out = dict.fromkeys(FUNCTION_WORDS, 0.0)
    get = LANGUAGE_OF.get
    for word in LATIN.findall(text.lower()):
        if of := get(word):
            out[of] = out.get(of, 0.0) + 1
    if "'" in text or "’" in text:
        out["fr"] += len(ELIDED.findall(text))
    if not text.isascii():
        for letter in WITH_ACCENT.findall(text):
            of = ACCENTS[letter]
            out[of] = out.get(of, 0.0) + 0.5
        han, kana = (sum(map(len, p.findall(text))) / 2 for p in (HAN, KANA))
        out["ja" if 4 * kana > han else "zh"] = han + kana
        if FOREIGN.search(text):
            for language, pattern in BY_SCRIPT.items():
                out[language] = sum(map(len, pattern.findall(text))) / 2
    return out


def other(question: str, answer: str) -> bool:
    """Whether the answer is mainly in a language that the question hardly has."""
    own = scores(answer)
    best = max(own, key=own.__getitem__)
    if own[best] < 2 or own[best] <= 0.5 * sum(own.values()):
        return False
    asked = scores(question)
    most = max(asked, key=asked.__getitem__)
    little = asked.get(best, 0.0)
    return most != best and little < 0.5 * asked[most] and (asked[most] >= 1.5 or asked[most] >= 1 and not little and own[best] >= 4)

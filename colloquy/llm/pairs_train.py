"""Fits the weights of refusals and endings: ``python -m colloquy.llm.pairs_train TABLE.parquet`` prints ``weights.REFUSAL`` and ``weights.ENDING``.

Refusals are learned from the sentences below. Endings are learned from at most ``TEXTS`` answers of a table of messages, taken as whole, from copies of
them cut at chance places, and from the made-up endings below, which weigh more as they are few.
"""

from __future__ import annotations

import random
import re
import sys

from colloquy.llm import endings, logistic, refusals

TEXTS = 12_000

REFUSING = """
I can't help with that.|I cannot assist with this request.|I won't answer this question.|I'm not able to discuss this topic.|I am unable to provide that content.|I'd prefer not to talk about this.|I would rather not go into that.|I must decline this request.
I have to decline.|I refuse to do this.|I'm not allowed to share that.|I will not continue with this.|We cannot comply with this request.|I don't feel comfortable discussing this topic.|I do not have the ability to respond to this.|It's not something I can support.|That is a subject I can't go into.
This goes against my guidelines.|Your request violates our policies.|That would be against the rules I follow.|No comment on this.|This lies outside what I may do, so I won't go on.|I'll have to pass on this one.|I am not in a position to give advice on that.|That's beyond what I am able to help with.|I decline to answer that.|I can't do that for you.
Dabei kann ich leider nicht helfen.|Ich kann diese Frage nicht beantworten.|Das darf ich nicht tun.|Ich lehne diese Anfrage ab, ich muss sie ablehnen.|Ich möchte mich dazu nicht äußern.|Dazu gebe ich keine Auskunft.|Hier muss ich passen.|Das verstößt gegen meine Regeln.|Diese Bitte kann ich nicht erfüllen.|Darüber darf ich nicht sprechen, ich kann hier nicht helfen.|Ich bin nicht in der Lage, das zu beantworten.
Je ne peux pas répondre à cette demande.|Je ne suis pas en mesure de vous aider.|Je dois refuser.|Il m'est impossible de traiter ce sujet.|Je préfère ne pas répondre à cette question.|Cela va à l'encontre de mes règles.|Je ne donnerai pas de conseils sur ce point.|Je refuse de répondre à cela.|Je ne peux pas faire ça.
No puedo ayudarte con esto.|No me es posible contestar a eso.|Prefiero no hablar de este tema.|Debo rechazar la solicitud.|Eso va en contra de mis políticas.|No voy a responder a esa pregunta.|Me niego a responder a eso.|No puedo hacer eso.|Como modelo de lenguaje no puedo opinar sobre esto.
我不能回答这个问题。|我无法提供帮助。|我必须拒绝您的请求。|作为语言模型，我不能讨论这个话题。|这个请求我无法处理。|我不便回答。
""".strip()
ANSWERING = """
I can't find the file on the disk.|I would not rename the table before lunch.|You can't do that without a backup.|The service cannot reconnect by itself.|Do not share the password with anyone.|I can't stress this enough.|I haven't seen this error since the update.|It is not a problem.|This is not the case here.|No, that is the old version.|The tool refuses to start.|The request was rejected by the server.
The rule is simple: do not delete anything.|You should not answer that mail.|I don't think the order matters.|I don't know the exact date, but May is likely.|I can help with that.|I'd rather use the second option, because it is cheaper.|This may be against the warranty.|I would not worry about the logs.|They declined the offer in March.|We did not change the default.|If this does not help, restart the job.|Not all of the rows were copied.|I cannot recommend it highly enough: take the train.
Nobody has reported a problem so far.|The numbers will not be too low.|It cannot export more than ten rows.|I could not reproduce it on my machine.|Never run this as root.|You cannot pass a list here.|Do not go outside in a storm.|There is no comment in the header.|I won't be at the office on Friday.|It won't take long.
Das ist nicht der Grund.|Der Dienst kann die Datei nicht lesen.|Ich würde die Tabelle nicht umbenennen.|Das hilft nicht immer.|Die Anfrage wurde abgelehnt.|Das kann man nicht rückgängig machen.|Ich habe keine Warnung gesehen.|Du musst das nicht beantworten.|Danach passen die Zahlen.|Ohne Sicherung geht das nicht.
Ce n'est pas un problème.|Le service ne répond pas.|Vous ne pouvez pas annuler cette demande sans compte.|Je n'ai pas vu cette erreur.|La demande a été refusée par le serveur.|Il ne faut pas toucher à ce fichier.|Cela ne change rien.|Je ne le ferais pas avant vendredi.
No es un problema.|El servicio no responde.|No se puede deshacer ese cambio.|La solicitud fue rechazada ayer.|No hace falta responder a ese correo.|No necesitas nada más.|Yo no cambiaría la tabla hoy.
这不是问题。|服务无法连接。|请求被服务器拒绝了。|不能同时打开两个文件。|我没有看到这个错误。|不用回答这个问题。
""".strip()
# Endings of whole texts, parted by |; LF is written \n.
WHOLE = r"""
Red\nBlue\nYellow|Milk\nEggs\nFlour\nButter|An old silent pond\nA frog jumps into the pond\nSplash! Silence again|Paris|42|Yes|1. Berlin\n2. Paris\n3. Rome|- one\n- two\n- three|Kind regards,\nAnna|Best,\nTom|# Title\n\nShort text.\n\n## Next steps|Total: 12\nMean: 4\nMedian: 3|name,age\nann,3\nbob,4|See https://example.org/a/b|The door is open. 12|Call me on Monday. 7\n|Das reicht so. 31|Write to me at a@b.test|Version 3.2|He said "stop."|It works (mostly)|The answer is: 17|12:30|Good luck 🙂|Step one: open it\nStep two: close it|SELECT 1;|x = 3|a, b and c|Apples, pears, plums|The list follows below:\n* red apples\n* green pears|Rosen sind rot\nVeilchen sind blau|- alpha: first letter\n- beta: second letter|(see above)|Roses are red\nViolets are blue\nSugar is sweet\nAnd so are you
""".strip()
BROKEN = r"""
The first step is to open the|You should check whether the cable is (|It depends on two things: the size and|Then run the job and wait for|First, open the file. Then copy the second line into|1. open the box\n2. remove the|1. open the box\n2.|- alpha\n-|The result is,|The team said that "the|In short, we need more ...|Take the train to the north and then …|| a | b |\n\nAfter that the table must be sorted by|```python\nfor x in y:\n|Zuerst prüfst du die Leitung und|Die Zahl ist zu hoch, weil der|Ensuite il faut vérifier que le|Después copia la línea en el|This is the best plan of all. The cost is low. The next step would be to ask the people who know the
""".strip()


def listed(block: str) -> list[str]:
    return [s for line in block.split("\n") for s in line.split("|")]


def refusal_rows() -> list[tuple[dict[str, float], bool, float]]:
    return [(f, label, 1.0) for block, label in ((REFUSING, True), (ANSWERING, False)) for s in listed(block) if (f := refusals.features(s))]


def cut(text: str, rng: random.Random) -> str | None:
    """A copy broken off inside its second half, or behind the mark of a list item, not at the end of a sentence or a line; None if there is no such place."""
    items = [m.end() for m in re.finditer(r"\n\s*(?:[-*•]|\d+[.)])(?= )", text)]
    if items and rng.random() < 0.15:  # behind the mark of an item
        return text[: rng.choice(items)] + rng.choice(["", " ", " **"])
    for _ in range(5):
        at = rng.randint(max(1, len(text) // 2), len(text) - 1)
        if rng.random() < 0.7:
            at = text.rfind(" ", 0, at)
        head = text[:at].rstrip() if at > 20 else ""
        if head and not re.search(r"[.!?:。！？：`|)\"]$", head) and text[len(head) : len(head) + 1] not in "\n.!?。！？":
            return head + rng.choice(["", "", "", "", "", "", ",", " ...", "…", " (", ";", " \"", ", '", " «"])
    return None


def ending_rows(texts: list[str], seed: int = 1) -> list[tuple[dict[str, float], bool, float]]:
    rng = random.Random(seed)
    rows = []
    for text in texts[:TEXTS]:
        rows.append((endings.features(text), False, 1.0))
        if rng.random() < 0.3 and len(text) > 40 and (broken := cut(text, rng)):
            rows.append((endings.features(broken), True, 1.0))
    for block, label in ((WHOLE, False), (BROKEN, True)):
        rows += [(endings.features(s.replace("\\n", "\n")), label, 20.0) for s in block.split("|")] if label is False else [(endings.features(s.replace("\\n", "\n")), label, 20.0) for s in block.split("|") if s.strip()]
    return rows


def main(path: str) -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["msg_id", "role", "text"]).to_pylist()
    texts = sorted({r["msg_id"]: r["text"] for r in table if r["role"] == "assistant" and r["text"] and len(r["text"]) < 20_000 and endings.words(r["text"])}.items())
    for name, rows in (("REFUSAL", refusal_rows()), ("ENDING", ending_rows([t for _, t in texts]))):
        fitted = logistic.fit(rows)
        wrong = sum((sum(fitted.get(k, 0.0) * v for k, v in f.items()) > 0) != label for f, label, _ in rows)
        print(f"# {wrong} of {len(rows)} training rows of {name} are on the wrong side")
        print(f"{name}: dict[str, float] = {{\n" + "".join(f'    "{k}": {v},\n' for k, v in fitted.items()) + "}")


if __name__ == "__main__":
    main(sys.argv[1])

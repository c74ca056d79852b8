"""Sentences that decline to answer: a logistic model over character n-grams and words.

The declining class is fitted on turns written here, in seven languages, the other class
on sentences of the table's own questions and references and of labelled lines. Turns
that only share parts with the written ones are found by those parts.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from dataclasses import dataclass

import numpy as np

from textlathe.llm.bayes import GRAM_BUCKETS, LETTERS, gram_ids

#: Chance from which a sentence counts as declining, sentences of the other class, steps.
CUT, MOST, STEPS, RIDGE = 0.55, 4000, 150, 1e-4
#: Words that a sentence has at least to be told by the model.
LEAST_WORDS = 3
#: Buckets of words and pairs of words, beside those of character n-grams.
WORD_BUCKETS = 1 << 14

#: Written turns, beginnings and ends that go with each other, then whole sentences.
TURNS = {
    "en": (
        ["I can't", "I cannot", "I am unable to", "I'm not able to", "I am not allowed to", "I won't", "I will not", "I must decline to", "I have to refuse to", "I would rather not", "I don't feel able to", "We are not permitted to", "It isn't possible for me to", "My instructions do not let me", "My guidelines forbid me to", "I regret that I cannot", "Sorry, but I can't", "I apologise, but I am unable to", "As an AI model I can't", "As an assistant I am not able to", "I am not in a position to", "I choose not to", "Unfortunately I'm unable to"],
        ["answer that.", "answer this question.", "help with this.", "help you with that request.", "assist with that.", "discuss this topic.", "comment on this matter.", "give an answer here.", "provide this information.", "respond to this.", "say anything about that.", "fulfil this request.", "share that.", "talk about this subject.", "offer an opinion on it.", "do that for you."],
        ["This request goes against my guidelines.", "That goes against my policies.", "This topic is off limits for me.", "As an AI, this subject is off limits.", "That is a question best left to someone else.", "This is better answered by an expert.", "You had better ask somebody else about this.", "I'd prefer to leave that to others.", "That is not something I can speak to.", "This falls outside what I may talk about.", "It is beyond my scope to answer.", "I have no answer to give.", "I don't know the answer to that.", "I don't have that information.", "I have no information about this.", "The context does not say.", "The context doesn't contain the answer.", "The documents give no answer to this question.", "There is not enough information to answer.", "No answer can be given from the text.", "I don't have access to that.", "I'd rather not get into that.", "My apologies, I have to pass on this one.", "I'm afraid I must leave this unanswered.", "My apologies, this conflicts with my rules.", "I am not the right one to ask.", "This violates the policy that I follow.", "I was told not to discuss this."],
    ),
    "de": (
        ["Ich kann", "Leider kann ich", "Ich darf", "Ich möchte", "Ich werde", "Als KI kann ich", "Meine Richtlinien erlauben es nicht, ", "Es ist mir nicht möglich, ", "Ich sehe mich außerstande, "],
        ["das nicht beantworten.", "diese Frage nicht beantworten.", "dabei nicht helfen.", "dazu nichts sagen.", "dazu keine Auskunft geben.", "mich dazu nicht äußern.", "diese Anfrage nicht erfüllen.", "dazu keine Angaben machen."],
        ["Meine Regeln verbieten mir eine Antwort.", "Diese Bitte widerspricht meinen Richtlinien.", "Bitte fragen Sie jemand anderen danach.", "Diese Frage überlasse ich lieber anderen.", "Dazu habe ich keine Angaben.", "Dieses Thema ist für mich tabu.", "Der Text enthält dazu keine Informationen.", "Darauf weiß ich keine Antwort.", "Es tut mir leid, darüber darf ich nicht reden.", "Diese Bitte kann nicht erfüllt werden.", "Diese Anfrage verstößt gegen meine Richtlinien.", "Dazu liegen mir keine Informationen vor.", "Das weiß ich nicht.", "Diese Frage sollte jemand anders beantworten.", "Das lehne ich ab.", "Der Kontext enthält keine Antwort.", "Aus dem Text geht das nicht hervor.", "Darüber spreche ich nicht.", "Tut mir leid, da muss ich passen."],
    ),
    "fr": (
        ["Je ne peux pas", "Je ne suis pas en mesure de", "Je ne souhaite pas", "Il m'est impossible de", "Malheureusement, je ne peux pas", "En tant qu'IA, je ne peux pas", "Je dois refuser de", "Mes consignes m'interdisent de"],
        ["répondre à cette question.", "répondre à cela.", "vous aider.", "donner cette information.", "traiter cette demande.", "me prononcer là-dessus.", "en parler.", "commenter ce sujet."],
        ["Cette question va contre mes consignes.", "Mes règles m'interdisent de répondre.", "Il vaut mieux demander à un autre.", "Je laisse cette question à d'autres.", "Ce sujet est hors de ma portée.", "Le texte ne contient pas cette information.", "Je n'ai pas de réponse à donner.", "Désolé, je dois passer sur cette question.", "Il ne m'est pas permis d'en parler.", "Cette demande ne peut pas être traitée.", "Cette demande va à l'encontre de mes règles.", "Je n'ai pas cette information.", "Je ne sais pas.", "Mieux vaut poser la question à quelqu'un d'autre.", "Le contexte ne contient pas la réponse.", "Je préfère ne pas répondre.", "Ce sujet m'est interdit.", "Désolé, je passe mon tour."],
    ),
    "es": (
        ["No puedo", "Lo siento, no puedo", "No me es posible", "No estoy en condiciones de", "Debo negarme a", "Prefiero no", "Como IA no puedo", "Mis normas me impiden", "Lamentablemente no puedo"],
        ["responder a esa pregunta.", "responder a eso.", "ayudar con esto.", "dar esa información.", "atender esta petición.", "opinar sobre eso.", "hablar de ese tema.", "comentar este asunto."],
        ["Esta pregunta va en contra de mis reglas.", "Mis reglas no me dejan responder.", "Sería mejor que preguntara a otro.", "Dejo esa pregunta para otros.", "Ese asunto no me corresponde.", "El texto no contiene esa información.", "No tengo respuesta que dar.", "No sé la respuesta.", "No se me permite hablar de ello.", "Esta petición no se puede atender.", "Esta petición va contra mis normas.", "No tengo esa información.", "No lo sé.", "Es mejor preguntar a otra persona.", "El contexto no contiene la respuesta.", "Ese tema está fuera de mi alcance.", "No hay suficiente información para responder.", "De eso no hablo."],
    ),
    "it": (
        ["Non posso", "Mi dispiace, ma non posso", "Non sono in grado di", "Devo rifiutarmi di", "Preferisco non", "Purtroppo non posso", "Come IA non posso", "Le mie regole mi vietano di"],
        ["rispondere a questa domanda.", "rispondere.", "aiutare con questa richiesta.", "dare questa informazione.", "parlare di questo argomento.", "commentare.", "esprimermi su questo."],
        ["Questa domanda va contro le mie linee guida.", "Le mie regole non mi permettono di rispondere.", "Sarebbe meglio chiedere a un altro.", "Lascio questa domanda ad altri.", "Questo tema è fuori dal mio ambito.", "Il testo non contiene questa informazione.", "Non ho una risposta da dare.", "Non mi è permesso parlarne.", "Questa richiesta non può essere soddisfatta.", "Questa richiesta va contro le mie regole.", "Non ho questa informazione.", "Non lo so.", "È meglio chiedere a qualcun altro.", "Il contesto non contiene la risposta.", "Questo argomento è fuori dalla mia portata."],
    ),
    "pt": (
        ["Não posso", "Lamento, mas não posso", "Não consigo", "Não me é possível", "Prefiro não", "Infelizmente não posso"],
        ["responder a essa pergunta.", "responder.", "ajudar com isso.", "dar essa informação.", "falar sobre esse tema.", "atender a esse pedido."],
        ["Essa pergunta vai contra as minhas diretrizes.", "As minhas regras não me deixam responder.", "Seria melhor perguntar a outro.", "Deixo essa pergunta para outros.", "Esse tema está fora do meu alcance.", "O texto não contém essa informação.", "Não sei a resposta.", "Não me é permitido falar disso.", "Esse pedido vai contra as minhas regras.", "Não tenho essa informação.", "Não sei.", "É melhor perguntar a outra pessoa.", "O contexto não contém a resposta."],
    ),
    "nl": (
        ["Ik kan", "Helaas kan ik", "Ik mag", "Ik wil", "Als AI kan ik", "Sorry, ik kan"],
        ["dat niet beantwoorden.", "deze vraag niet beantwoorden.", "daar niet bij helpen.", "daar niets over zeggen.", "die informatie niet geven.", "dit verzoek niet uitvoeren."],
        ["Deze vraag gaat tegen mijn richtlijnen in.", "Mijn regels staan dat niet toe.", "Dat kun je beter aan een ander vragen.", "Die vraag laat ik aan anderen over.", "Dit onderwerp valt buiten mijn bereik.", "De tekst bevat die informatie niet.", "Ik weet het antwoord niet.", "Daar mag ik niet over praten.", "Dit verzoek gaat tegen mijn regels in.", "Die informatie heb ik niet.", "Dat weet ik niet.", "Vraag dat liever aan iemand anders.", "De context bevat geen antwoord."],
    ),
}


#: Answers that deny something without declining, fitted as the other class.
DENIALS = """No, it does not. No, it doesn't. No, they are not. No, never. No, not at all. Not in this version. Not yet, but soon. It does not change. It can't be changed. It cannot be larger than that. This is not possible with the default settings. Nothing is kept. Nothing is lost. None of them. There is no limit. There is no difference. The order does not change. You can't use both at once. It won't work without an index. The notes do not mention a limit. That was not measured. It is not known why.
Nein, gar nicht. Nein, das ist nicht nötig. Nicht in dieser Version. Die Reihenfolge bleibt gleich. Das geht nicht ohne Index. Nichts davon wird gespeichert. Es gibt keinen Unterschied. Das ändert sich nicht. Die Werte ändern sich dabei nicht. Der Index muss nicht neu gebaut werden. Das Ergebnis hängt nicht davon ab.
Non, jamais. Non, pas du tout. Pas dans cette version. Rien n'est gardé. Il n'y a pas de limite. L'ordre ne change pas. Cela ne marche pas sans index. Les valeurs ne changent pas. Le résultat n'en dépend pas.
No, nunca. No, en absoluto. No en esta versión. No se guarda nada. No hay límite. El orden no cambia. Esto no funciona sin índice. Los valores no cambian. El resultado no depende de ello.
No, mai. Non in questa versione. Non cambia nulla. Non c'è alcun limite. Não, nunca. Nada é guardado. A ordem não muda. Nee, nooit. De volgorde verandert niet. Er is geen verschil.
I'm sorry for the mistake in the last answer. Sorry for the long wait. Please answer in another language. Reply in German. I told you so. He won't come. She can't swim. I don't like it. I won't go there again.""".replace("\n", " ").split(". ")


def written() -> list[str]:
    """All written turns."""
    return [t for begin, end, whole in TURNS.values() for t in [*(f"{a} {b}" for a, b in itertools.product(begin, end)), *whole]]


def features(sentence: str) -> np.ndarray:
    """Distinct buckets of character n-grams, of words, and of neighbouring words."""
    words = LETTERS.findall(sentence.lower())
    near = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"{a} * {b}" for a, b in zip(words, words[2:]))]
    told = [GRAM_BUCKETS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in near]
    return np.concatenate([np.unique(gram_ids(sentence)), np.unique(np.array(told, np.int64))])


@dataclass
class Declining:
    weights: np.ndarray
    base: float

    def chance(self, sentence: str) -> float:
        at = features(sentence)
        if len(LETTERS.findall(sentence)) < LEAST_WORDS:
            return 0.0
        return float(1 / (1 + np.exp(-(self.base + self.weights[at].sum() / np.sqrt(max(1, len(at)))))))

    def __call__(self, sentence: str) -> bool:
        return self.chance(sentence) >= CUT


@functools.cache
def encoded(turns: tuple[str, ...]) -> list[np.ndarray]:
    return [features(t) for t in turns]


def fit_declining(others: list[str], turns: list[str] | None = None) -> Declining:
    """Fit on written turns against at most `MOST` other sentences; each class weighs the
    same, and rows are scaled to length one. Steps follow the gradient, each weight by
    its own past."""
    texts = sorted(set(turns if turns is not None else written()))
    rest = DENIALS * 3 + sorted(set(others), key=lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")))[:MOST]
    rows = encoded(tuple(texts)) + [features(t) for t in rest]
    size = np.array([max(1, len(r)) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = (1 / np.sqrt(size))[owner]
    y = np.concatenate([np.ones(len(texts)), np.zeros(len(rest))])
    share = np.where(y == 1, 0.5 / max(1, len(texts)), 0.5 / max(1, len(rest)))
    w, base, past = np.zeros(GRAM_BUCKETS + WORD_BUCKETS), 0.0, np.full(GRAM_BUCKETS + WORD_BUCKETS, 1e-12)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(base + np.bincount(owner, w[flat] * value, len(rows)))))
        miss = share * (y - p)
        g = np.bincount(flat, (miss[owner] * value), len(w)) - RIDGE * w
        past += g * g
        w += 0.5 * g / np.sqrt(past)
        base += 2.0 * miss.sum()
    return Declining(w.astype(np.float32), float(base))

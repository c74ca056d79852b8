"""Defects of prompt and response pairs: empty, copied, refused, in another language, cut off.

Languages come from a naive Bayes over character n-grams, fitted on a bounded sample of
labelled lines and refitted with the pairs' own texts. Whether a text may end where it
does comes from the likelihood of an end after its last characters, counted over every
response and reference of the table by a 64-bit key of each context.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlathe.functions.udfs import lcs_length
from textlathe.llm.batches import parts
from textlathe.llm.bayes import LETTERS, NaiveBayes, fit_bayes
from textlathe.llm.refusals import fit_declining
from textlathe.runtime import cut_lineage, spread

#: Labelled lines the language model may be fitted on, own texts it is refitted with.
SAMPLE, OWN = 8000, 4000
#: Length of lines and texts that the models may be fitted on.
FIT_CHARS = 4_000
#: Labelled lines among the sentences that don't decline.
OTHER_LINES = 3000
ORDERS = (28, 16, 8, 4)
#: 64-bit words of the filter that lets go of contexts nobody asks for before a shuffle.
FILTER_WORDS = 1 << 21
#: What a defect is called as long as only the likelihood of its end can tell.
OPEN = "open"
END_LIKELY, LANGUAGE_MARGIN, MIN_LETTERS = 0.25, 4.0, 12

#: Stand-ins for a missing answer, after markup and case are taken away.
STAND_INS = {"", "n/a", "na", "none", "null", "nil", "nan", "empty", "no answer", "no response", "blank", "tbd", "undefined", "answer", "a", "response", "antwort", "réponse", "respuesta", "keine antwort", "sans réponse", "sin respuesta", "ø"}

#: What languages are called in questions that ask for one.
LANGUAGE_WORDS = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch deutsche allemand alemán aleman",
    "fr": "french französisch franzosisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol castellano",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués portugues",
    "nl": "dutch niederländisch néerlandais neerlandés holandés",
    "sv": "swedish schwedisch suédois sueco",
    "pl": "polish polnisch polonais polaco",
    "ru": "russian russisch russe ruso",
    "uk": "ukrainian ukrainisch ukrainien ucraniano",
    "tr": "turkish türkisch turc turco",
}
ASKED = {w: c for c, words in LANGUAGE_WORDS.items() for w in words.split()}

#: Turns by which an answer is declined, in the questions' languages.
DECLINES = re.compile(
    r"""
    \b(?:i|we)(?:\s+(?:just|really|simply|unfortunately|regretfully))?\s*(?:can(?:no|['’]|\s+no)?t|can['’]t|am\s+(?:not\s+(?:able|allowed|permitted|in\s+a\s+position)|unable)|['’]m\s+(?:not\s+(?:able|allowed|permitted|in\s+a\s+position)|unable)|won['’]t|will\s+not|must\s+(?:decline|pass|refuse)|have\s+to\s+(?:decline|refuse|pass)|decline|refuse|(?:do\s+not|don['’]t)\s+(?:have\s+(?:the\s+ability|an\s+opinion|enough|any|access)|know|feel|comment|answer|judge|explain|discuss|help)|would\s+rather\s+not|['’]d\s+rather\s+not|prefer\s+not)
    |\bsomething\s+i\s+(?:don['’]t|do\s+not|can['’]t|cannot|won['’]t)\b
    |\bno\s+(?:answer|response|reply)\s+(?:can|could|is)\b|\bcan(?:no|\s+no)t\s+be\s+(?:answered|given|determined)\b
    |\b(?:is\s*n['’]t|is\s+not|are\s*n['’]t|are\s+not)\s+(?:enough|sufficient|possible\s+for\s+me)\b|\bno\s+way\s+for\s+me\b|\bnot\s+possible\s+for\s+me\b
    |\bprevents?\s+me\b|\boutside\s+(?:of\s+)?(?:what\s+i|my)\b|\bnot\s+allowed\s+to\b|\bunable\s+to\s+(?:answer|help|assist|respond|comment|provide)\b
    |\b(?:do|does)\s+not\s+(?:contain|say|mention|provide|allow|cover)\b
    |\b(?:kann|darf|werde|möchte|mag|will)\s+(?:ich\s+)?(?:\w+\s+){0,4}(?:nicht|keine?n?)\b|\bich\s+(?:\w+\s+){0,3}(?:nicht|keine)\b(?:\s+\w+){0,2}|\b(?:gebe|habe|erteile)\s+ich\s+(?:\w+\s+){0,2}kein|\bich\s+(?:muss|möchte)\s+(?:\w+\s+){0,4}(?:ablehnen|passen)|\bnicht\s+(?:beantworten|helfen|weiterhelfen|äußern)|\breicht\b.*\bnicht\b|\bkeine\s+(?:antwort|auskunft)\b|\bgeht\b.*\bnicht\s+hervor|\blehne\b.*\bab\b
    |\bje\s+(?:ne\s+(?:peux|puis|suis|veux|souhaite)\s+(?:pas)?|n['’](?:ai|y)\s+|(?:dois|préfère)\s+(?:\w+\s+)*(?:décliner|refuser|ne\s+pas|m['’]abstenir))|\bne\s+permet(?:tent)?\s+pas\b|\bpas\s+en\s+mesure\b|\bimpossible\s+de\s+répondre\b
    |\bno\s+(?:puedo|podemos|me\s+es\s+posible|tengo\s+(?:forma|manera|modo)|estoy\s+en\s+condiciones|permite[n]?|es\s+posible|quiero)\b|\b(?:debo|tengo\s+que|prefiero|quiero)\s+(?:\w+\s+){0,2}(?:rechazar|declinar|no\s+\w+|abstenerme)\b
    """,
    re.I | re.X,
)
#: Courtesies that are no answer of their own.
COURTESIES = re.compile(
    r"""^(?:\W*(?:h+m+|well|ok(?:ay)?|sorry|note|hinweis|remarque|nota|désolé|lo\s+siento|tut\s+mir\s+leid|entschuldigung|apologies|hello|hi)\W*
    |.*\b(?:thank\s+you|thanks|merci|danke|gracias)\b.*
    |.*\blet\s+me\s+know\b.*|.*\bplease\s+(?:consult|ask|contact|see|try|rephrase|provide)\b.*|.*\b(?:is\s+there|do\s+you\s+need|can\s+i\s+help)\b.*\b(?:else|other|more)\b.*\?
    |.*\b(?:feel\s+free|happy\s+to\s+help)\b.*|.*\b(?:wenden\s+sie\s+sich|fragen\s+sie|melden\s+sie\s+sich|kann\s+ich\s+sonst)\b.*|.*\b(?:n['’]hésitez\s+pas|veuillez\s+consulter|consultez|adressez-vous|puis-je\s+vous)\b.*|.*\b(?:consulte\s+a|no\s+dude\s+en|hay\s+algo\s+más|por\s+favor,?\s+consulte)\b.*)$""",
    re.I | re.X | re.S,
)
SENTENCES = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n+")
FENCED = re.compile(r"```.*?(?:```|$)|^\|.*$|https?://\S+|`[^`]*`", re.S | re.M)
QUOTED = re.compile(r"[\"“][^\"”\n]*[\"”]|\([^()\n]*\)")
INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­]")
MARKUP = re.compile(r"<[^<>]{0,80}>|```\w*|[*_#>`~|\[\](){}\"“”„«»]+")
#: A text that ends on a sign that something must follow, or on a quote that opens.
OPEN_END = re.compile(r"(?:[,;:(\[{=+&/–—]|(?:^|\s)[\"“„«‘'(*_]+|\s-)$")
OPEN_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•>#]+|\d+[.)])\s*$")
TERMINAL = re.compile(r"[.!?…。！？][\"'”’»)\]*_`]*$")


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())


# ---- languages


def fit_languages(lines: DataFrame, codes: DataFrame, pairs: DataFrame, sample: int = SAMPLE, own: int = OWN) -> NaiveBayes:
    """A model from at most `sample` labelled lines and `own` texts of the pairs.

    Lines are taken in order of a hash of their text, labels by the exact spelling in
    `codes`. Wrong labels are outvoted: the lines are relabelled once by a first fit.
    """
    one = codes.where("code is not null and lang is not null").groupBy("code").agg(F.min("lang").alias("lang"))
    labelled = lines.select(F.col("label").alias("code"), "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(one), "code")
    rows = labelled.orderBy(F.xxhash64("text"), "lang").limit(sample).collect()
    first = fit_bayes([r.text for r in rows], [r.lang for r in rows])
    kept = [(r.text, r.lang) for r in rows if first.langs[int(first.scores(r.text).argmax())] == r.lang]
    texts = pairs.select(F.explode(F.array("user_input", "reference")).alias("t")).where(F.length("t") <= FIT_CHARS).groupBy("t").count()
    told, own_texts = [], []
    for r in texts.orderBy(F.xxhash64("t")).limit(own).collect():
        own_texts.append(r.t)
        s = np.sort(first.scores(r.t))
        if len(s) > 1 and s[-1] - s[-2] > LANGUAGE_MARGIN:
            told.append((r.t, first.langs[int(first.scores(r.t).argmax())]))
    both = kept + told * 2
    model = fit_bayes([t for t, _ in both], [c for _, c in both]) if both else first
    model.declining = fit_declining([p for t in [*own_texts, *[r.text for r in rows[:OTHER_LINES]]] for p in said_in(t)])
    return model


# ---- ends of texts


def marked(text: str) -> str:
    """Digits as one sign, runs of blanks as one, a start sign in front."""
    t = INVISIBLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = re.sub(r"[^\S\n]+", " ", re.sub(r"\d+", "0", t))
    return "\x02" + re.sub(r" ?\n[\n ]*", "\n", t).strip()


def contexts(text: str, begins: list[int] | None = None) -> list[np.ndarray]:
    """For each order, a 64-bit key of the characters before each position from 1 on; a
    context never reaches over a line's or sentence's start. Several marked texts may
    come as one, with the places where each begins."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    starts = np.zeros(n + 1, np.int64)
    for m in re.finditer(r"\n|(?<=[.!?])\s(?=[^\W\d_]|[¿¡])", text):
        starts[m.end()] = m.end() - 1
    if begins:
        starts[np.array(begins) + 1] = begins
    starts = np.maximum.accumulate(starts)
    mul = np.uint64(0x9E3779B97F4A7C15)
    power = np.ones(n + 1, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(n, mul, np.uint64))
        inverse = np.uint64(pow(int(mul), -1, 1 << 64))
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.cumprod(np.full(n, inverse, np.uint64))
        total[1:] = np.cumsum(codes * power[:n])
        ends = np.arange(1, n + 1)
        out = []
        for k in ORDERS:
            begin = np.maximum(np.maximum(ends - k, starts[1:]), 0)
            h = (total[ends] - total[begin]) * back[begin] + np.uint64(k) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((h ^ (h >> np.uint64(32))).view(np.int64))
    return out


def end_keys(text: str) -> list[int]:
    """Keys of a text's last context for each order; none for a text without signs."""
    m = marked(text)
    return [int(c[-1]) for c in contexts(m)] if len(m) > 1 else []


def may_end(text: str) -> np.ndarray:
    """Whether the text may be over at each position from 1 on: before a stop, a line's
    end outside tables and code, or its own end."""
    n = len(text)
    out = np.zeros(n, bool)
    out[n - 1] = True
    fence = False
    at = 0
    for line in text.split("\n"):
        fence ^= line.lstrip().startswith("```")
        end = at + len(line)
        if end < n and end > 0 and not fence and not line.startswith("|"):
            out[end - 1] = True
        at = end + 1
    for m in re.finditer(r"[.!?](?=[\s\"'”’)]|$)", text):
        if m.start() > 0:
            out[m.start() - 1] = True
    return out


def end_counts(pairs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(h, cont, fin): how often a context goes on and may end, over all responses and
    references.

    With `asked`, a column `h` of keys, contexts outside a bit table of those keys are let
    go before the shuffle. The table drops no key that is asked for; the few others that
    pass it are left to a join.
    """
    texts = pairs.select(F.explode(F.array("response", "reference")).alias("t")).where("t is not null")
    given = None
    if asked is not None:
        bits = asked.groupBy(F.shiftright("h", 6).bitwiseAND(FILTER_WORDS - 1).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toPandas()
        words = np.zeros(FILTER_WORDS, np.int64)
        words[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64)
        given = pairs.sparkSession.sparkContext.broadcast(words)

    def run(frames):
        words = given.value if given else None
        for frame in frames:
            for rows in parts(frame["t"].tolist(), 2000, 1_000_000):
                texts = [m for m in map(marked, frame["t"].iloc[rows]) if len(m) > 1]
                if not texts:
                    continue
                ends = np.concatenate([may_end(m) for m in texts])
                begins = np.concatenate([[0], np.cumsum([len(m) for m in texts])[:-1]]).tolist()
                for c in contexts("".join(texts), begins):
                    kept = slice(None) if words is None else (words[(c >> 6) & (FILTER_WORDS - 1)] >> (c & 63) & 1).astype(bool)
                    keys, place = np.unique(c[kept], return_inverse=True)
                    n, fin = np.bincount(place, minlength=len(keys)), np.bincount(place[ends[kept]], minlength=len(keys))
                    yield pd.DataFrame({"h": keys, "cont": n - fin, "fin": fin})

    return spread(texts, 1).mapInPandas(run, "h bigint, cont bigint, fin bigint").groupBy("h").agg(F.sum("cont").alias("cont"), F.sum("fin").alias("fin"))


def end_table(pairs: DataFrame) -> dict[int, tuple[int, int]]:
    """All counts of a small table at hand, to judge single texts; `flag_pairs` joins."""
    return {r.h: (r.cont, r.fin) for r in end_counts(pairs).collect()}


def end_likelihood(text: str, table: dict[int, tuple[int, int]], own: int = 1) -> float:
    """Likelihood that a text ends here, by the longest context others have too; `own` is
    the number of rows with this very question and text, whose ends say nothing about it."""
    keys = end_keys(text)
    if not keys:
        return 1.0
    for h in keys:
        cont, fin = table.get(h, (0, 0))
        fin = max(0, fin - own)
        if cont + fin >= 2:
            return (fin + 0.1) / (cont + fin + 0.2)
    return 0.5


def unlikely_ends(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(text): those of `asked` (text, a hash of question and response; keys, a column of `end_keys`; own) after
    which no end is likely, by the same rule as `end_likelihood`."""
    one = asked.select("text", "own", F.posexplode("keys").alias("k", "h"))
    fin = F.greatest(F.col("fin") - F.col("own"), F.lit(0))
    told = one.join(end_counts(pairs, one.select("h").distinct()), "h").withColumn("n", F.col("cont") + fin).where("n >= 2")
    return told.groupBy("text").agg(F.min_by((fin + 0.1) / (F.col("n") + 0.2), "k").alias("like")).where(F.col("like") < END_LIKELY).select("text")


# ---- defects


def bare(text: str) -> str:
    return re.sub(r"\s+", " ", MARKUP.sub(" ", INVISIBLE.sub("", text))).strip()


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    text = INVISIBLE.sub("", response).strip()
    core = re.sub(r"^[\W_]+|[\W_]+$", "", bare(text)).casefold()
    inner = re.sub(r"[<>\[\]{}()]", "", text).strip().casefold()
    if not re.search(r"\w", text):
        return True
    return core in STAND_INS and (core != "a" or text.rstrip().endswith(":")) or (not core and inner in STAND_INS)


def is_copy(question: str, response: str) -> bool:
    """Nothing but the question, perhaps twice, introduced or with a word changed."""
    q, r = words_of(bare(question)), words_of(bare(response))
    if not q or not r:
        return False
    twice = round(len(r) / len(q)) if len(r) > 1.5 * len(q) else 1
    target = q * max(1, min(twice, 4))
    if abs(len(r) - len(target)) > max(2, 0.25 * len(target)):
        return False
    if r == target:
        return True
    least = max(0.75 * len(target), len(r) - max(2, 0.2 * len(r)))
    if (Counter(target) & Counter(r)).total() < least:  # no more words can be in order than are in both
        return False
    return lcs_length(target, r) >= least


def said_in(text: str) -> list[str]:
    return [p for p in (re.sub(r"^\W+", "", bare(s)) for s in SENTENCES.split(text)) if re.search(r"\w", p)]


def is_refusal(question: str, response: str, declining=None) -> bool:
    """At least one sentence declines, and no other is more than courtesy or the question.
    A sentence declines by its turn, or by the fitted model of such sentences."""
    said = said_in(response)
    asked = words_of(question)
    declined = False
    for p in said:
        if words_of(p) and " ".join(words_of(p)) in " ".join(asked):
            continue
        if DECLINES.search(p) or (not COURTESIES.match(p) and declining and declining(p)):
            if re.search(r"[“\"][^”\"]*$|\b(?:but|yet|aber|mais|pero)\b(?!\s+(?:i|this|it|there|we|das|ich|je|no)\b)", p, re.I) and not re.match(r"(?:i['’]m\s+)?sorry|unfortunately|thanks?|désolé|lo siento|tut mir", p, re.I):
                return False
            declined = True
        elif not COURTESIES.match(p):
            return False
    return declined


def asked_language(question: str) -> str | None:
    found = [ASKED[w] for w in words_of(question) if w in ASKED]
    return found[-1] if found else None


def other_language(question: str, response: str, model: NaiveBayes, spoken=None) -> str | None:
    """The response's language if it is neither the question's nor one it asks for.
    `spoken` may tell a question's language from memory."""
    text = FENCED.sub(" ", response)
    plain = QUOTED.sub(" ", text)
    if sum(map(len, LETTERS.findall(plain))) >= MIN_LETTERS:  # quoted and bracketed terms may be in any language
        text = plain
    if min(sum(map(len, LETTERS.findall(x))) for x in (text, question)) < MIN_LETTERS:
        return None
    s = model.scores(text)
    allowed = {spoken(question) if spoken else model.best(question), asked_language(question)}
    best = int(s.argmax())
    if model.langs[best] in allowed:
        return None
    held = max((s[k] for k, c in enumerate(model.langs) if c in allowed), default=-np.inf)
    return model.langs[best] if s[best] - held > LANGUAGE_MARGIN else None


def is_cut(response: str) -> bool | None:
    """Whether a response is cut off by its signs; None where they can't tell."""
    text = INVISIBLE.sub("", response).rstrip()
    if text.count("```") % 2 or OPEN_ITEM.search(text) or OPEN_END.search(text):
        return True
    if TERMINAL.search(text) or text.endswith("```"):
        return False
    rows = text.split("\n")
    if rows[-1].startswith("|"):  # a table's row with fewer cells than the one above it
        above = rows[-2].count("|") if len(rows) > 1 and rows[-2].startswith("|") else 0
        if rows[-1].count("|") < above or not rows[-1].endswith("|"):
            return True
    return None


def first_defect(question: str | None, response: str | None, model: NaiveBayes, spoken=None) -> str | None:
    """The defect, `OPEN` where only the likelihood of the response's end can tell."""
    question = question or ""
    if is_empty(response):
        return "empty"
    if is_copy(question, response):
        return "copied_question"
    if is_refusal(question, response, model.declining):
        return "refusal"
    if other_language(question, response, model, spoken):
        return "other_language"
    return {True: "truncated", False: None, None: OPEN}[is_cut(response)]


def defect_of(question: str | None, response: str | None, model: NaiveBayes, table: dict[int, tuple[int, int]], spoken=None, own: int = 1) -> str | None:
    found = first_defect(question, response, model, spoken)
    if found != OPEN:
        return found
    return "truncated" if end_likelihood(response, table, own) < END_LIKELY else None


def flag_pairs(pairs: DataFrame, lines: DataFrame, codes: DataFrame, model: NaiveBayes | None = None) -> DataFrame:
    """(response_id, defect) of each defective row of `pairs`.

    A null, blank or markup-only response is `empty`; a null question is an empty one
    and can be neither copied nor contradicted in language; null references count for
    nothing; repeated rows are judged each; extra columns are ignored; an empty table
    gives an empty result. No row has two defects: the first in the order empty,
    copied_question, refusal, other_language, truncated counts.
    """
    model = model or fit_languages(lines, codes, pairs)
    given = pairs.sparkSession.sparkContext.broadcast(model)
    picked = pairs.select("response_id", "user_input", "response")

    def run(frames):
        model = given.value
        spoken = functools.lru_cache(10_000)(model.best)
        for frame in frames:
            found = [first_defect(q if isinstance(q, str) else None, r if isinstance(r, str) else None, model, spoken) for q, r in zip(frame["user_input"], frame["response"])]
            keys = [end_keys(r) if d == OPEN else None for d, r in zip(found, frame["response"])]
            out = pd.DataFrame({"response_id": frame["response_id"], "defect": found, "text": frame["text"], "keys": pd.Series(keys, frame.index, object)})
            yield out[out["defect"].notna()]

    # the narrow rows are read for the contexts asked for and for the result
    judged = cut_lineage(spread(picked.withColumn("text", F.xxhash64("user_input", "response"))).mapInPandas(run, "response_id bigint, defect string, text bigint, keys array<bigint>"))
    still = judged.where((F.col("defect") == OPEN) & (F.size("keys") > 0))
    asked = still.groupBy("text").agg(F.count("*").alias("own"), F.first("keys").alias("keys"))
    cut = still.select("response_id", "text").join(unlikely_ends(pairs, asked), "text", "left_semi")
    return judged.where(F.col("defect") != OPEN).select("response_id", "defect").unionByName(cut.select("response_id", F.lit("truncated").alias("defect")))

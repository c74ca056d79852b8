"""Personal information in free text: candidate spans, boosted trees, calibrated cuts.

Generators with high recall propose spans around anchors (number runs, address signs,
name words, titles, cues); spans of several types may overlap. A tree ensemble for each
type scores a span by its format and context; the best spans above the calibrated cuts
are taken, none overlapping. The ensembles are fitted on lines written by `pii_lines`,
whose spans are known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlathe.llm.batches import parts
from textlathe.llm.boosting import BoostedTrees
from textlathe.runtime import spread

TYPES = ("email", "phone", "id_number", "address", "name")

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
#: A name word: capitalised, with an O' or hyphenated parts; a genitive ending stays out.
CAP = rf"[{UP}](?:['’][{UP}])?[^\W\d_]*(?:-[{UP}][^\W\d_]*)*"
PARTICLES = {"von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "la", "le", "du", "zu", "zum", "ten", "ter", "bin", "al", "af", "av"}
#: Titles, cues before or after spans.
TITLES = {"mr", "mrs", "ms", "miss", "mme", "mlle", "herr", "herrn", "frau", "dr", "prof", "professor", "señor", "señora", "sr", "sra", "sir", "madame", "monsieur", "signor", "signora", "pan", "pani"}
PHONE_CUES = {"tel", "telephone", "telefon", "telefono", "teléfono", "phone", "mobile", "cell", "fax", "call", "ring", "line", "dial", "number", "on", "al", "au", "unter", "did", "ask", "llame", "rappeler", "or", "hotline", "whatsapp", "rückruf", "appeler", "llamar"}
ID_CUES = {"id", "ssn", "passport", "tax", "national", "identity", "steuernummer", "steuer", "identidad", "documento", "dni", "nie", "nif", "nino", "social", "security", "personalausweis", "ausweis", "pass", "insurance", "identification", "pasaporte", "passeport", "securite", "sécurité", "fiscal", "identité", "identite", "pièce", "carte", "ausweisnummer"}
OTHER_CUES = {"isbn", "serial", "part", "order", "ticket", "buffer", "version", "commit", "server", "ip", "table", "section", "note", "paper", "arxiv", "doi", "row", "rows", "seed", "issue", "board", "no", "ran", "gpu", "port", "build", "invoice", "sku", "roughly", "counted", "only", "has", "over", "batch", "step", "price", "score", "figure", "chapter", "volume", "level", "page", "run", "epoch", "model", "phase", "task"}
NAME_CUES = {"contact", "reviewer", "author", "from", "name", "ask", "to", "thanks", "regards", "by", "hi", "hello", "dear", "is", "corrections", "listed", "an", "à", "a", "von", "nombre", "card", "call", "rappeler", "llame", "écrivez", "signed", "editor", "cc"}
MODEL_WORDS = {"dataset", "benchmark", "checkpoint", "splits", "split", "model", "corpus", "tokenizer", "family", "weights", "set", "score", "paper", "and", "release", "suite", "leaderboard"}
COMMON = {"hi", "hello", "dear", "ask", "thanks", "author", "reviewer", "contact", "from", "the", "tel", "id", "line", "national", "best", "regards", "please", "write", "corrections", "llame", "fragen", "documento", "steuernummer", "leaked", "ssn", "clone", "call", "see", "follow", "to", "adresse", "anschrift", "address", "und", "and", "a", "an", "in", "on", "or"}
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Square|Sq\.?|Close|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Way|Place|Boulevard|Blvd\.?|Terrace|Row|Crescent|Hill)"

FORM = re.compile(r"\d+")
ADDRESS_SIGN = re.compile(rf"\b(?:[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|\d{{5}}(?:-\d{{4}})?)\b|[,\n]\s*(?:[A-Z]{{1,2}}-)?\d{{4}} [{UP}]")
SPELLED = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+)"
DOT_WORD = r"(?:\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s+dot\s+)"
DOTTED = rf"(?:\.|{DOT_WORD})"
BEFORE = re.compile(rf"[\w+%-]{DOT_WORD}$", re.I)
EMAIL = re.compile(rf"(?:[\w.+%-]+{DOT_WORD})*[\w.+%-]*[\w+%](?:{SPELLED})[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOTTED}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", re.I)

#: Signs that addresses are made of.
STRETCH = re.compile(r"[\w ,.'’º°/ª\-\r\n\t\xa0]+")
TOWN = rf"[{UP}][^\W\d_]+(?:[ -](?:[{UP}][^\W\d_]+))?"
GAP = r"(?:,\s*|\s*\n\s*|\s+)"
PLACE = rf"[{UP}][^\W\d_]+(?:[ -][{UP}][^\W\d_]+)?"
ADDRESSES = [
    re.compile(rf"\d{{1,5}}[a-zA-Z]?,? {PLACE} {STREETS}{GAP}(?:(?:Apt|Flat|Suite|Unit)\.? \w+{GAP})?{TOWN}{GAP}(?:[A-Z]{{2}} )?(?:[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|\d{{5}}(?:-\d{{4}})?)"),
    re.compile(rf"(?:{PLACE}(?:straße|strasse|gasse|weg|platz|allee|ring|damm|ufer|str\.)|[{UP}][^\W\d_]*(?:straße|strasse|gasse|weg|platz|allee|ring|damm|ufer|str\.)|(?:Am|An der|Im|Zum) {PLACE}) \d{{1,4}}[a-z]?{GAP}(?:D-)?\d{{5}} {TOWN}"),
    re.compile(rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|impasse|boulevard|chemin|place|allée|quai|cours|route) (?:de |du |des |d['’]|de la )?{PLACE}{GAP}\d{{5}} {TOWN}"),
    re.compile(rf"(?:\d{{1,5}}[a-zA-Z]?,? {PLACE}|{PLACE} \d{{1,4}}[a-z]?|(?:PO|P\.O\.|P\. O\.) Box \d{{1,6}}){GAP}(?:{TOWN}{GAP})?{TOWN}{GAP}[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}"),
    re.compile(rf"(?:\d{{1,4}}[a-z]?,? {PLACE}|{PLACE} \d{{1,4}}[a-z]?|(?:PO|P\.O\.|P\. O\.) Box \d{{1,6}}|Postfach \d{{1,6}})(?:,\s*|\s*\n\s*)(?:[A-Z]{{1,2}}-)?\d{{4,5}} {TOWN}"),
    re.compile(rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Via|Rua|Largo|C/)\.? (?:de |del |de la )?{PLACE},? \d{{1,4}}{GAP}(?:\d{{1,2}}\.?[ºª°o]\.? ?\w{{1,3}}{GAP})?\d{{4,5}} {TOWN}"),
]


#: Marks of a form: a given name, a family name, a listed word in capitals.
GIVEN, FAMILY, CAPITALS = 1, 2, 4


@dataclass
class Models:
    trees: dict[str, BoostedTrees]
    given: frozenset
    family: frozenset
    words: dict
    #: Of a name list that is too long for every task: its forms, see `forms_of`. `given`
    #: and `family` then hold particles and initials alone.
    listed: DataFrame | None = None

    def knowing(self, own: dict[str, int]) -> Models:
        """The models for a text whose listed forms, with their marks, are given."""
        return replace(
            self, given=self.given | {w for w, m in own.items() if m & GIVEN}, family=self.family | {w for w, m in own.items() if m & FAMILY}, words=self.words | dict.fromkeys(own, "n")
        )

#: Where spans may lie: capitalised words (looked up after), cues, number runs, address signs.
CAPITAL = re.compile(rf"[{UP}](?:\. (?=[{UP}])|[^\W\d_]+)")
NAME_CUE = re.compile(r'name(?:":|=| is)')
DIGITS = re.compile(r"[0-9](?:(?:[ \xa0.\-/]|\)[ -]?| ?\()?[0-9]){5,}")
#: A sign spelled by a bare word counts only before a host whose dots are spelled too.
MAIL_SIGN = re.compile(r"@|[\[({]\s?[Aa][Tt]\s?[\])}]|(?<=\s)[Aa][Tt](?=\s+[\w-]+\s+[Dd][Oo][Tt]\s+\w)")
LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+%-")
TITLE_WORDS = {"Mr", "Mrs", "Ms", "Miss", "Mme", "Mlle", "Herr", "Herrn", "Frau", "Dr", "Prof", "Professor", "Señor", "Señora", "Sr", "Sra", "Madame", "Monsieur"}
CUE_WORDS = {"From": ":", "Author": ":", "Reviewer": ":", "Contact": ":", "Best": " regards"}
LEAD = re.compile(r"[\s:\"',=]*")


def lookup(given: set[str], family: set[str]) -> dict[str, str]:
    """What each anchoring word is: a listed name (n), a title (t), a cue (c)."""
    names = {x: "n" for w in given | family for x in (w, w.upper())}
    return {w: "c" for w in CUE_WORDS} | {w: "t" for w in TITLE_WORDS} | names


def name_places(text: str, words: dict[str, str]):
    """Positions at which a name may stand."""
    for m in CAPITAL.finditer(text):
        word, at, end = m.group(), m.start(), m.end()
        kind = "i" if word[1:2] == "." else words.get(word)
        if kind is None or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            continue
        if kind in "ni":
            yield at
        elif kind == "t":
            end += text[end : end + 1] == "."
            if text[end : end + 1] == " ":
                yield end + 1
        elif text.startswith(CUE_WORDS[word], end):
            end += len(CUE_WORDS[word])
            yield LEAD.match(text, end, end + 6).end()
    for m in NAME_CUE.finditer(text):
        yield LEAD.match(text, m.end(), m.end() + 6).end()


#: What the name list is asked for: words that begin with a capital, in any text particles and initials.
ASKED = re.compile(rf"[{UP}](?:’[{UP}])?[^\W\d_]*")
ALWAYS = {x for w in PARTICLES for x in (w, w.capitalize())} | {f"{chr(c)}." for c in range(0x180) if re.match(f"[{UP}]", chr(c))}


def asked(text: str) -> set[str]:
    """All forms but `ALWAYS` that `candidates` may look up for a text."""
    found = set(ASKED.findall(text))
    found |= {x for w in found if "’" in w for x in w.split("’")}
    return found | {w.capitalize() for w in found}


def forms_of(names: DataFrame) -> DataFrame:
    """(form, marks), once for each listed word and each listed word in capitals."""

    def run(frames):
        for frame in frames:
            marks = np.where(frame["kind"] == "given", GIVEN, FAMILY)
            yield pd.DataFrame({"form": [*frame["word"], *(w.upper() for w in frame["word"])], "marks": [*marks, *[CAPITALS] * len(marks)]})

    return names.mapInPandas(run, "form string, marks int").groupBy("form").agg(F.bit_or("marks").alias("marks"))


def with_forms(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """`documents` with `forms` and `marks`: the listed forms among those that the text asks for.

    The texts' forms and the list meet in a join, so no task holds the list. Texts of one
    hash share their forms: what a form is doesn't depend on the text.
    """
    keyed = documents.withColumn("k", F.xxhash64("text"))

    def run(frames):
        for frame in frames:
            for at in parts(frame["text"].tolist(), 1000):
                found = [asked(t) for t in frame["text"].iloc[at]]
                yield pd.DataFrame([(k, w) for k, f in zip(frame["k"].iloc[at], found) for w in f], columns=["k", "form"])

    said = keyed.where("text is not null").select("k", "text").mapInPandas(run, "k bigint, form string")
    own = said.join(listed, "form").groupBy("k").agg(F.collect_set(F.struct("form", "marks")).alias("x"))
    return keyed.join(own.select("k", "x.form", "x.marks").withColumnRenamed("form", "forms"), "k", "left").drop("k")


def words_before(text: str, at: int, n: int = 40) -> list[str]:
    return re.findall(r"[^\W\d_]+", text[max(0, at - n) : at].lower())[-5:]


def flags(words: list[str], sets: tuple) -> list[float]:
    """For each set, how near to the span its last member stands (0: none)."""
    out = []
    for s in sets:
        out.append(float(next((len(words) - k for k in range(len(words)) if words[len(words) - 1 - k] in s), 0)))
    return out


# ---- candidates: (type, start, end, features)


def number_spans(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """The number run around a digit anchor, with prefix signs and letters or without."""
    while at > 0 and text[at - 1] in "+(" and end - at < 40:
        at -= 1
    out = [(at, end)]
    left = re.search(r"(?<![\w])[A-Z]{1,2} ?$", text[max(0, at - 4) : at])
    right = re.match(r"[ -]?[A-Z](?![\w-])", text[end : end + 3])
    a = at - len(left.group(0)) if left else at
    b = end + right.end() if right else end
    for s in {(a, end), (at, b), (a, b)}:
        if s != (at, end):
            out.append(s)
    return out


def number_features(text: str, a: int, b: int, widest: tuple[int, int]) -> list[float] | None:
    span = text[a:b]
    groups = FORM.findall(span)
    digits = sum(map(len, groups))
    if not 6 <= digits <= 15:
        return None
    sizes = [len(g) for g in groups][:5] + [0] * (5 - min(5, len(groups)))
    before, after = words_before(text, a), text[b : b + 12].lower()
    line = text[text.rfind("\n", 0, a) + 1 : (text.find("\n", b) + 1 or len(text) + 1) - 1]
    prev, nxt = text[a - 1 : a], text[b : b + 1]
    return [
        digits, len(groups), *sizes, span.count("-"), span.count(" "), span.count("."), span.count("/"), span.count("("),
        span[0] == "+", span[0] == "0", span[:2] == "00", span[0] == "(", span[0].isalpha(), span[:2].isalpha(), span[-1].isalpha(),
        span.count("(") != span.count(")"), (a, b) == widest, prev.isalnum() or prev in "@#$€.", nxt.isalnum() or nxt in "@%-",
        nxt == "." and text[b + 1 : b + 2].isdigit(), line.strip() == span, *flags(before, (PHONE_CUES, ID_CUES, OTHER_CUES)),
        before[-1:] == ["id"], prev == "=", " / " in after[:3], after.startswith(" times") or after.startswith(" rows"),
        len(before) > 0 and before[-1] in OTHER_CUES, len(before) > 0 and before[-1] in PHONE_CUES, len(before) > 0 and before[-1] in ID_CUES,
    ]


def email_features(text: str, a: int, b: int) -> list[float]:
    span = text[a:b]
    host = re.split(SPELLED, span, maxsplit=1, flags=re.I)[-1]
    last = re.split(DOTTED, host, flags=re.I)[-1]
    return [
        "@" in span, bool(re.search(r"[\[({]\s?at", span, re.I)), " at " in span.lower(), " " in span, len(span), span.split("@")[0].lower() == "git",
        text[b : b + 1] == ":", text[b : b + 1] == "/", any(c.isdigit() for c in host), last.isdigit(), last.isalpha(), len(last), host.count("."),
        "_" in span or "." in re.split(SPELLED, span, maxsplit=1, flags=re.I)[0], text[a - 1 : a] in "@/:#", *flags(words_before(text, a), ({"clone", "pin", "follow", "pip", "npm", "ssh"}, {"mail", "email", "mailto", "write", "contact"})),
    ]


def address_features(text: str, a: int, b: int) -> list[float]:
    span = text[a:b]
    return [
        len(span), span.count("\n"), span.count(","), sum(c.isdigit() for c in span), bool(ADDRESS_SIGN.search(span)), bool(re.search(STREETS, span)),
        bool(re.search(r"straße|strasse|gasse|weg|platz|allee", span)), bool(re.match(r"\d+,? (?:rue|avenue|impasse|boulevard|chemin|place)", span)),
        span.startswith("Calle"), re.search(r"[^\W\d_]+|$", span).group().lower() in OTHER_CUES | MODEL_WORDS, "Box " in span or "Postfach" in span, bool(re.search(r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$", span)), bool(re.search(r"[,\n]\s*(?:[A-Z]{1,2}-)?\d{4} \D+$", span)), bool(re.search(r"[,\n]\s*\d{5} \D+$", span)), text[a - 1 : a].isalnum(), text[b : b + 1].isalnum(), *flags(words_before(text, a), ({"at", "habite", "wohnt", "in", "vive", "en", "to", "anschrift", "adresse", "address", "reviewer"}, MODEL_WORDS)),
    ]


TOKEN = re.compile(rf"(?P<i>[{UP}]\.)|(?P<c>{CAP})|(?P<p>[a-zà-ÿ]{{2,5}})")
JOIN = re.compile(r"(, ?)|( )")


def name_run(text: str, at: int) -> list[tuple[int, int, str]]:
    """Name-like tokens in a row around a position, on its line: (start, end, kind). The
    stretch that is searched grows until the run ends within it."""
    first = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
    last = min(x for x in (text.find("\n", at), text.find("\r", at), len(text)) if x >= 0)
    width = 90
    while True:
        lo, hi = max(first, at - width), min(last, at + width)
        toks = name_tokens(text, lo, hi)
        run: list[tuple[int, int, str]] = []
        for t in toks:
            gap = text[run[-1][1] : t[0]] if run else ""
            if run and gap not in (" ", ", "):
                if run[0][0] <= at < run[-1][1] or run[0][0] >= at:
                    break
                run = []
            run.append(t)
        if not run or (lo == first or run[0] != toks[0]) and (hi == last or run[-1] != toks[-1]):
            return run if run and run[-1][1] > at else []
        width *= 2


def name_tokens(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    toks = []
    for m in TOKEN.finditer(text, lo, hi):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_@"):
            continue
        kind = "i" if m.group("i") else "c" if m.group("c") else "p"
        nxt = text[m.end() : m.end() + 2]
        if kind == "c" and nxt and (nxt[0] in "_@+" or nxt[0].isdigit() or (nxt[0] in ".-" and nxt[1:].isalnum())):
            continue  # the beginning of an address or a handle
        if kind == "p" and (m.group("p") not in PARTICLES or (m.end() < len(text) and (text[m.end()].isalnum()))):
            continue
        toks.append((m.start(), m.end(), kind))
    return toks


def after_title(text: str, at: int) -> bool:
    left = re.search(r"([^\W\d_]+)\.?\s$", text[max(0, at - 14) : at])
    return bool(left) and left.group(1).lower() in TITLES


def name_candidates(text: str, at: int, models: Models) -> list[tuple[int, int, list[float]]]:
    run = name_run(text, at)
    out = []
    for i in range(len(run)):
        if run[i][2] == "p" and not after_title(text, run[i][0]):
            continue
        for j in range(i, min(len(run), i + 5)):
            if run[j][2] != "c":
                continue
            toks = run[i : j + 1]
            commas = sum("," in text[toks[k][1] : toks[k + 1][0]] for k in range(len(toks) - 1))
            if commas > 1 or (commas and len(toks) > 3):
                continue
            f = name_features(text, run, i, j, commas, models)
            if f is not None:
                out.append((toks[0][0], toks[-1][1], f))
    return out


def name_features(text: str, run: list, i: int, j: int, commas: int, models: Models) -> list[float] | None:
    toks = [text[a:b] for a, b, _ in run[i : j + 1]]
    kinds = [k for _, _, k in run[i : j + 1]]
    low = [t.rstrip(".").lower() for t in toks]
    if low[0] in TITLES or any(t in TITLES for t, k in zip(low[1:], kinds[1:]) if k != "p"):
        return None
    before_tok = text[run[i - 1][0] : run[i - 1][1]].rstrip(".").lower() if i and text[run[i - 1][1] : run[i][0]] in (" ", ". ") else ""
    a, b = run[i][0], run[j][1]
    left = re.search(r"([^\W\d_]+)\.?\s$", text[max(0, a - 14) : a])
    titled = float(after_title(text, a) or before_tok in TITLES)
    caps = sum(k == "c" for k in kinds)
    if caps + kinds.count("i") < 2 and not titled:
        return None
    parts = [t.split("-")[0].replace("’", "'").split("'")[-1] for t in toks]
    given = [p in models.given or (p.isupper() and p.capitalize() in models.given) for p in parts]
    family = [p in models.family or (p.isupper() and p.capitalize() in models.family) for p in parts]
    cues = words_before(text, a)
    nxt = text[b : b + 12]
    after = re.match(r" ([^\W\d_]+)", nxt)
    follower = run[j + 1] if j + 1 < len(run) else None
    close = follower is not None and text[b : follower[0]] == " "
    comma_next = follower is not None and text[b : follower[0]].startswith(",")
    fol = text[follower[0] : follower[1]].split("-")[0].split("'")[-1] if follower else ""
    return [
        len(toks), caps, kinds.count("i"), kinds.count("p"), commas, titled, given[0], family[0], given[-1], family[-1], sum(given), sum(family),
        kinds[0] == "i", low[0] in COMMON, any(t in COMMON for t in low), sum(t.isupper() for t in toks if len(t) > 2), close, comma_next,
        float(fol in models.given or fol.capitalize() in models.given), float(fol in models.family or fol.capitalize() in models.family),
        before_tok != "" and not titled, before_tok in COMMON or before_tok == "", (left.group(1).lower() if left else "") == "the",
        (after.group(1).lower() if after else "") in MODEL_WORDS, nxt.startswith("'s") or nxt.startswith("’s"), nxt[:1] in ",;<(])\"\n" or nxt[:2] == " <" or nxt[:2] == " (" or nxt == "",
        text[a - 1 : a] in "=\"[/\n" or a == 0, *flags(cues, (NAME_CUES, OTHER_CUES)), len(cues) > 0 and cues[-1] in NAME_CUES, min(len(toks[-1]), 15), min(len(toks[0]), 15),
        "-" in toks[0] or "-" in toks[-1],
    ]


def address_stretches(text: str):
    """Each address pattern with each stretch of words, numbers and single line ends that
    holds a postcode; no address reaches over other signs, so none is cut."""
    if not ADDRESS_SIGN.search(text):
        return
    for m in STRETCH.finditer(text):
        if ADDRESS_SIGN.search(text, *m.span()):
            for rx in ADDRESSES:
                yield rx, *m.span()


def candidates(text: str, models: Models) -> list[tuple[str, int, int, list[float]]]:
    """All proposed spans of a text with their features; they may overlap."""
    out, seen = [], set()
    for m in MAIL_SIGN.finditer(text):
        a = m.start()
        while a and text[a - 1].isspace():
            a -= 1
        while True:
            while a and (text[a - 1] in LOCAL or text[a - 1].isalnum()):
                a -= 1
            dot = BEFORE.search(text[max(0, a - 24) : a])  # a spelled dot before it: the local part goes on
            if not dot:
                break
            a -= len(dot.group()) - 1
        e = EMAIL.match(text, a)
        if e and e.end() > m.start() and ("e", e.span()) not in seen:
            seen.add(("e", e.span()))
            out.append(("email", *e.span(), email_features(text, *e.span())))
    for m in DIGITS.finditer(text):
        spans = number_spans(text, *m.span())
        widest = max(spans, key=lambda s: s[1] - s[0])
        for s in spans:
            f = number_features(text, *s, widest)
            if f is not None:
                out.append(("phone", *s, f))
                out.append(("id_number", *s, f))
    for at in name_places(text, models.words):
        for a, b, f in name_candidates(text, at, models):
            if ("n", a, b) not in seen:
                seen.add(("n", a, b))
                out.append(("name", a, b, f))
    for rx, a, b in address_stretches(text):
        for e in rx.finditer(text, a, b):
            if ("a", e.span()) not in seen:
                seen.add(("a", e.span()))
                out.append(("address", *e.span(), address_features(text, *e.span())))
    return out


def choose(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Spans of highest chance, longer ones first among equals, none overlapping."""
    taken: list[tuple[str, int, int]] = []
    for kind, a, b, _ in sorted(found, key=lambda x: (-round(x[3], 2), x[1] - x[2], x[1], x[0])):
        if all(b <= c or a >= d for _, c, d in taken):
            taken.append((kind, a, b))
    return sorted(taken, key=lambda x: x[1])


def spans_of(texts: list[str], models: Models, listed: list[dict[str, int]] | None = None) -> list[list[tuple[str, int, int]]]:
    """The chosen spans of each text; features of all texts are scored at once by type.
    `listed` has each text's forms of a list that the models don't hold."""
    rows: dict[str, list] = {k: [] for k in TYPES}
    feats: dict[str, list] = {k: [] for k in TYPES}
    for n, t in enumerate(texts):
        for kind, a, b, f in candidates(t, models.knowing(listed[n]) if listed else models):
            rows[kind].append((n, a, b))
            feats[kind].append(f)
    kept: list[list] = [[] for _ in texts]
    for kind in TYPES:
        if feats[kind]:
            p = models.trees[kind].chance(np.array(feats[kind], float))
            for (n, a, b), x in zip(rows[kind], p):
                if x >= models.trees[kind].cut:
                    kept[n].append((kind, a, b, float(x)))
    return [choose(k) for k in kept]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


#: Words of the name list that every task holds; of a longer list each text gets its own
#: by a join, and training lines are written with so many, in order of a hash.
MOST_NAMES = 50_000


def fit_models(name_list: DataFrame, lines: int = 6000, **given_frames: list[str]) -> Models:
    """Fit the ensembles on `lines` written lines (`given_frames`: frames and blanks to write
    them from); all words of `name_list` count, however many there are."""
    from textlathe.llm.pii_lines import write_lines

    names = name_list.select("word", "kind").where("word != '' and kind in ('given', 'family')").distinct()
    rows, listed = names.orderBy("word", "kind").limit(MOST_NAMES + 1).collect(), None
    if len(rows) > MOST_NAMES:
        listed = forms_of(names)
        rows = [r for k in ("given", "family") for r in names.where(F.col("kind") == k).orderBy(F.xxhash64("word"), "word").limit(MOST_NAMES // 2).collect()]
    given, family = {r.word for r in rows if r.kind == "given"}, {r.word for r in rows if r.kind == "family"}
    written = list(write_lines(sorted(given), sorted(family), lines, **given_frames))
    models = Models({}, frozenset(given), frozenset(family), lookup(given, family))
    if listed is not None:
        forms = name_list.sparkSession.createDataFrame([(w,) for w in sorted(ALWAYS.union(*(asked(t) for t, _ in written)))], "form string")
        own = {r.form: r.marks for r in listed.join(F.broadcast(forms), "form", "left_semi").collect()}
        models = Models({}, frozenset(), frozenset(), lookup(set(), set()), listed).knowing({w: m for w, m in own.items() if w in ALWAYS})
    full = models if listed is None else models.knowing(own)
    x: dict[str, list] = {k: [] for k in TYPES}
    y: dict[str, list] = {k: [] for k in TYPES}
    for text, gold in written:
        for kind, a, b, f in candidates(text, full):
            x[kind].append(f)
            y[kind].append((kind, a, b) in gold)
    for kind in TYPES:
        models.trees[kind] = BoostedTrees().fit(np.array(x[kind], float), np.array(y[kind], float))
    return models


def find_pii(documents: DataFrame, models: Models, redact: bool = False) -> DataFrame:
    """(doc_id, pii_type, pii_text), one row for each distinct string of a document; with
    `redact` (doc_id, text) with typed placeholders and all other text unchanged.

    Null texts give no finding and stay null, empty ones stay empty; long texts are read
    whole; repeated documents are searched each; other columns are ignored; an empty
    table gives an empty result.
    """
    given = documents.sparkSession.sparkContext.broadcast(replace(models, listed=None))
    picked = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    if models.listed is not None:
        picked = with_forms(picked, models.listed)

    def run(frames):
        models = given.value
        for frame in frames:
            for at in parts(frame["text"].tolist(), 1000):
                part = frame.iloc[at]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                own = [{} if f is None else dict(zip(f, m)) for f, m in zip(part["forms"], part["marks"])] if "forms" in part else None
                spans = spans_of(texts, models, own)
                if redact:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "text": [redacted(t, s) if isinstance(raw, str) else None for raw, t, s in zip(part["text"], texts, spans)]})
                else:
                    rows = [(d, k, s) for d, t, found in zip(part["doc_id"], texts, spans) for k, s in dict.fromkeys((k, t[a:b]) for k, a, b in found)]
                    yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text"])

    return picked.mapInPandas(run, "doc_id bigint, text string" if redact else "doc_id bigint, pii_type string, pii_text string")

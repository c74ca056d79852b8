"""Written training lines for the personal-information trees, with their spans.

All content is invented: names of random syllables or from the given list, reserved
numbers and hosts. A line is a frame with slots; a slot's text is a span or, in frames
that only look like personal information, none.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "ba dre fi go ku la mir no pel qua rin sto tu vel wes zan".split()
ENDS = "lard lsk ndon rd sk sn th ton n lth".split()
#: Frames with slots. {n} name, {t} titled name, {e} e-mail, {p} phone, {i} identity number, {a} address.
FRAMES = """Contact: {n}, {e}
Contact: {t}, {e}
From: {n} <{e}>
From: {x} {x} <{e}>
Author: {n}
Author: {x} {x}
Reviewer: {n}, {a}.
Reviewer: {t}, {a}.
Please send the card to {n}, {a}.
Tel. {p}, {n}
Tel. {p}, {t}
Tel. {p} / mail {e}
Line {p} is down.
Ask {n} on {p}.
Ask {t} on {p}.
Hi {n}, did {p} ever call back?
Hi {t}, did {p} ever call back?
ID {i} / {n}
ID {i} / {t}
National ID {i} was pasted into the prompt by {n}.
National ID {i} was pasted into the prompt by {t}.
{n}'s tax number, {i}, ended up in the test set.
{t}'s tax number, {i}, ended up in the test set.
Documento de identidad {i}, a nombre de {n}.
Documento de identidad {i}, a nombre de {t}.
Steuernummer {i}, gemeldet von {n}.
Numéro de pièce d'identité {i}, au nom de {n}.
Carte d'identité {i}, au nom de {t}.
Rückruf unter {p} an {n}.
Mail to {e}.
{w} {i}, {w} {w} {n}.
{w} {w} {p} {w}
{w} {w} {e} {w}
{w} {w} {a}.
{w} {w} {i} {w}
Steuernummer {i}, gemeldet von {t}.
The form listed {n}, SSN {i}, {a}.
The form listed {t}, SSN {i}, {a}.
user: my name is {n} and I live at {a}.
user: my name is {n}, my number is {p}, passport {i}.
user: my name is {t}, my number is {p}, passport {i}.
Leaked row: name={n};mail={e};phone={p};id={i}
Leaked row: name={t};mail={e};phone={p};id={i}
{{"name": "{n}", "email": "{e}"}}
{{"name": "{x} {x}", "email": "{e}"}}
[{n}](mailto:{e})
Thanks to {n} ({e}) for the logs.
Thanks to {t} ({e}) for the logs.
{n} found the bug and wrote to {e}.
{t} found the bug and wrote to {e}.
Corrections go to {n}.
Corrections go to {t}.
Write to {e} or ring {p}.
Fragen bitte an {n} ({e}).
Fragen bitte an {t} ({e}).
Écrivez à {n}, {e}.
Écrivez à {t}, {e}.
Rappeler {n} au {p}.
Llame a {n} al {p}.
Llame a {t} al {p}.
{n} habite {a}.
{t} habite {a}.
{n} wohnt in {a}.
{n} vive en {a}.
We shipped it to {a}.
Anschrift: {a}
Adresse : {a}
{n} / {p}
{n}: {p}
{p} ({n})
- {p}
{w} ({p}), {w}
{w} {w}; {p}
{n}; {i}
{p}
{e}
{n}""".split("\n") + ["Best regards,\n{n}\n{p}", "Best regards,\n{n}", "Best regards,\n{t}\n{e}"]
#: Frames that hold none. {g} given, {f} family word, {x} other capitalised word, 9 a digit.
BLANKS = """The {f} dataset was split 80-10-10.
The {g} checkpoint dates from 2026-01-11.
The {g} and {f} splits differ by 199 rows.
The {f} benchmark has 1,048,576 rows.
{f} is a tokenizer.
Is {x} a base model or a tune of {x}?
We swapped {x} for {x} and lost 99 points.
{x} and {x} agree on 99 of 999 questions.
The card for {x} lists 999B parameters; {x} lists none.
Order 00009999999 shipped late.
GPU serial 09999999-9X.
Board part no. 104-99-9999.
ISBN 000-0-999-9999-9.
Ticket INC-999-9999 is closed.
Ring buffer 9999-999 overflowed.
It ran 999.9.9999 times faster, or so the chart says.
The server at 192.0.2.99 timed out at 12:02:33.
The server at 192.0.2.199 timed out at 12:02:33.
Commit 4fd99999ab9999.
See Table 9, Section 999.9.
Paper 2699.99999 has it.
See note 2999.99999 for the setup.
See note 2999.999999 for the setup.
See note 29999.99999 for the setup.
We counted 99,999 pages and lost 99.
Only 99 of 99,999 answers were usable.
Call it 199.9B parameters, give or take.
Updated 2025-09-19. 99 pages changed.
{f}, 2024. Notes on {x}, 99 pages.
199 Road maps later, nothing changed.
99 Street views and 99 lane changes.
Pin it with langtools@9.99.9 and rebuild.
model@latest is not an address.
Clone git@forge.example:team/rank.git first.
Follow @treadmill_notes for more.
user: my name is not important here.
Author: staff
From: the archive <no address given>
the editors
Best regards,
Version 9.99.9 changed the defaults.
The price fell to $99.99 per million tokens.
Eine Million W\u00f6rter, Mein Nachbar und Unsere Gruppe.
Seed 9999999 gave run 99999999 again.
Paris Hilton {f} suite, Table Mountain corpus.
The {g} {x} model card is out.
We looked at example.org for the logs.
Stop at step dot nine and wait.
Model 9, 99999 Tokens kept.
{x} 99 scored 99999 Points.
Figure 9, 9999 Rows of {x} Data.
See https://notes.example/9999 at 99999 rows.""".replace("\\u00f6", "ö").split("\n")
#: Number forms that identify no one, and addresses' forms without a known kind of street.
PLAIN_NUMBERS = ["9999-999", "104-99-9999", "99999999", "999.9.9999", "99 999 999", "9999999999", "999-99-9999", "999-999-9999", "99999-99", "9 999 999", "0009999999", "99/99/9999", "9999.99999"]


def cue_frames() -> list[str]:
    """A frame for each cue of an identity number or a phone number, so that the trees
    learn the cues and not the frames."""
    from textlathe.llm.pii import ID_CUES, PHONE_CUES

    near = {"i": sorted(ID_CUES), "p": sorted(PHONE_CUES)}
    return [form.replace("CUE", c).replace("Cue", c.capitalize()).replace("SLOT", f"{{{k}}}") for k, cues in near.items() for c in cues for form in ("Cue SLOT", "{w} {w} CUE: SLOT, {w}", "{w} CUE SLOT {w}")]


def cue_blanks() -> list[str]:
    """The same for the words that tell other numbers."""
    from textlathe.llm.pii import OTHER_CUES

    return [f"{form}" for n, c in enumerate(sorted(OTHER_CUES)) for number in (PLAIN_NUMBERS[n % len(PLAIN_NUMBERS)], PLAIN_NUMBERS[(3 * n + 1) % len(PLAIN_NUMBERS)]) for form in (f"{c.capitalize()} {number}", f"{{w}} {{w}} {c} {number} {{w}}.", f"{{w}} {c}: {number}", f"{c.capitalize()} 9, 99999 {{x}}", f"{c.capitalize()} 99, 9999 {{x}} {{x}}")]


HOSTS = ["example.org", "example.com", "lab.example", "mail.example.net", "dept.uni.example", "post.example"]
TOWNS = ["Oberlinden", "Niederwalden", "Quillford", "Saint-Orlac", "Puerto Calado", "Tessel Bay", "Marrow Falls", "Valbrune", "Hexhollow", "Brackwater"]


class Writer:
    def __init__(self, given: list[str], family: list[str], seed: int, frames: list[str], blanks: list[str]):
        self.r = random.Random(seed)
        self.frames, self.blanks = frames, blanks
        self.given, self.family = given or ["Anira"], family or ["Brolund"]

    def coined(self) -> str:
        return ("".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 2, 2, 3)))) + self.r.choice(ENDS)).capitalize()

    def digits(self, form: str) -> str:
        return re.sub("9", lambda _: str(self.r.randrange(10)), form)

    def surname(self) -> str:
        r = self.r.random()
        own = self.r.choice(self.family)
        return own if r < 0.68 else self.coined() if r < 0.8 else f"{own}-{self.r.choice(self.family)}" if r < 0.88 else f"O'{own}" if r < 0.94 else f"{self.r.choice(('von', 'van', 'de', 'van der'))} {own}"

    def name(self) -> str:
        s, g, r = self.surname(), self.r.choice(self.given), self.r.random()
        full = f"{g} {s}" if r < 0.68 else f"{g[0]}. {s}" if r < 0.78 else f"{s}, {g}" if r < 0.88 and " " not in s else f"{g} {s}".upper() if r < 0.94 and " " not in s else f"{g} {self.coined()}"
        return full

    def titled(self) -> tuple[str, str]:
        who = self.r.choice((self.r.choice(self.family), self.surname(), f"{self.coined()} {self.coined()}", self.name()))
        return self.r.choice(("Mr", "Mrs", "Ms", "Mme", "Herr", "Frau", "Dr.", "Prof.", "Señora", "Señor", "Mr.", "Dr")) + " ", who

    def email(self) -> str:
        plain = lambda w: re.sub(r"[^a-z]", "", w.lower())
        local = plain(self.r.choice(self.given)) + self.r.choice(("", ".", "_", "-")) + plain(self.r.choice(self.family)) + self.r.choice(("", "", self.digits("99"))) + self.r.choice(("", "", "+list", "+rag"))
        host, r = self.r.choice(HOSTS), self.r.random()
        at, dot = self.r.choice((("(at)", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", ".")))
        out = f"{local}@{host}" if r < 0.7 else f"{local} @ {host}" if r < 0.8 else (local.replace(".", dot) if self.r.random() < 0.5 else local) + at + host.replace(".", dot)
        return out.upper() if self.r.random() < 0.12 else out

    def phone(self) -> str:
        return self.digits(self.r.choice(("07700 900 999", "+44 7700 900999", "020 7946 0999", "030 23125 999", "+49 (0)30 23125-999", "0049/30/23125999", "(999) 555-0199", "+1 999 555 0199", "+1-999-555-0199", "+19995550199", "999.555.0199", "01 99 00 99 99", "+33 1 99 00 99 99")))

    def identity(self) -> str:
        return self.digits(self.r.choice(("QQ999999A", "QQ999999C", "QQ 99 99 99 B", "XA9999999", "999-99-9999", "000 99 9999", "00 999 999 999", "00009999-O", "00009999-I")))

    def address(self) -> str:
        c, town, n = self.coined(), self.r.choice(TOWNS), self.r.randrange(1, 200)
        gap = self.r.choice((", ", ", ", "\n"))
        kind = self.r.randrange(8)
        if kind > 4:
            far = self.r.choice((f"{n} {c}{self.r.choice(('', ' ' + self.coined()))}", f"{c} {n}", f"PO Box {n}")) + gap
            end = self.r.choice(("uk", "near"))
            return far + (f"{self.r.choice((town, self.coined()))}{gap if gap != ', ' else ' '}{self.digits('QF9 9ZZ')}" if end == "uk" else f"{self.digits(self.r.choice(('00999', '9999')))} {self.coined()}")
        if kind == 0:
            return f"{n} {c} {self.r.choice(('Road', 'Lane', 'Square', 'Street', 'Close'))}{gap}{town}{gap if gap != ', ' else ' '}{self.digits('QF9 9ZZ')}"
        if kind == 1:
            return f"{n}{self.digits('9')} {c} {self.r.choice(('St.', 'Ave'))}{gap}Apt {self.digits('9')}A{gap}{town}, ZZ {self.digits('09999')}"
        if kind == 2:
            return f"{c}{self.r.choice(('straße', 'gasse', 'weg'))} {n}{gap}{self.digits('00999')} {town}"
        if kind == 3:
            return f"{n} {self.r.choice(('rue', 'avenue', 'impasse'))} de {c}{gap}{self.digits('00999')} {town}"
        return f"Calle {c} {n}{gap}3.º B{gap}{self.digits('00999')} {town}"

    def line(self) -> tuple[str, set]:
        if self.r.random() < 0.35:
            form = self.r.choice(self.blanks)
            form = re.sub("9+", lambda m: self.digits(m.group()), form)
            fill = {"g": lambda: self.r.choice(self.given), "f": lambda: self.r.choice(self.family), "x": self.coined, "w": lambda: self.coined().lower()}
            return re.sub(r"\{(\w)\}", lambda m: fill[m.group(1)](), form), set()
        form, out, gold, xs = self.r.choice(self.frames), "", set(), []
        for part in re.split(r"(\{\w\})", form.replace("{{", "\x01").replace("}}", "\x02")):
            key = part[1:2] if re.fullmatch(r"\{\w\}", part) else ""
            if key == "w":
                out += self.coined().lower()
                continue
            kind = {"n": "name", "t": "name", "e": "email", "p": "phone", "i": "id_number", "a": "address", "x": "x"}.get(key)
            if not kind:
                out += part
                continue
            lead, span = self.titled() if key == "t" else ("", {"n": self.name, "e": self.email, "p": self.phone, "i": self.identity, "a": self.address, "x": self.coined}[key]())
            out += lead
            if kind == "x":
                xs.append((len(out), len(out) + len(span)))
            else:
                gold.add((kind, len(out), len(out) + len(span)))
            out += span
        if xs:
            gold.add(("name", xs[0][0], xs[-1][1]))
        return out.replace("\x01", "{").replace("\x02", "}"), gold


def write_lines(given: list[str], family: list[str], n: int, seed: int = 11, frames: list[str] | None = None, blanks: list[str] | None = None):
    """`n` texts of one to three lines with their gold spans (type, start, end); from given
    frames, or two of three lines from the written and one from the cues' frames."""
    frames = FRAMES * (2 * len(cue_frames()) // len(FRAMES)) + cue_frames() if frames is None else frames
    blanks = BLANKS * (2 * len(cue_blanks()) // len(BLANKS)) + cue_blanks() if blanks is None else blanks
    w = Writer(given, family, seed, frames, blanks)
    for _ in range(n):
        text, gold = "", set()
        for _ in range(w.r.choice((1, 1, 2, 3))):
            line, spans = w.line()
            text += w.r.choice(("\n", " ")) if text and not text.endswith("\n") else ""
            gold |= {(k, a + len(text), b + len(text)) for k, a, b in spans}
            text += line
            if not text.endswith(("\n", ".", "!", "?")):
                text += "\n"
        yield text, gold

"""Personal data: fixed patterns, and a linear-chain conditional random field for names and street addresses.

A word has three features: the word itself if it is a known cue, its shape, and its place in a small lexicon (given and family
names, street words, titles); each counts at the place itself, before and after it. The field is trained on the driver by gradient
ascent on the log-likelihood (forward-backward, in batches of equal length) from a labelled table that is made by rule: frames in
four languages, filled with names of the lexicon, with invented ones where the frame says that a name follows, and with
invented words that are none. Its tables have a fixed, small size. Decoding is exact Viterbi over
sentences, in numpy batches of like length. An address needs a number.

Nulls: a null text counts as empty. Empty texts have no spans. Repeated rows give
repeated results. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, arrow_rows
from .secrets import clear_of, join

KINDS = ("email", "ip", "card", "phone", "name", "address")
#: Fixed patterns. The digit before an address is looked at only to skip starts that cannot match; no match changes.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]{2}")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
NOT_DIGITS = re.compile(r"[^0-9]")
TOKEN = re.compile(r"\S+")

#: What the decoder adds to the outside label at each place, so that a span needs clear evidence.
OUTSIDE_BIAS = 1.0

#: Labels of the field, in order: outside, begin and inside of a name, begin and inside of an address.
LABELS = ("O", "B-name", "I-name", "B-address", "I-address")

#: Score of what cannot be: an inside label follows its own kind only. Where a span can begin is up to the word (`can_begin`).
NEVER = 1e6
STRUCTURE = NEVER * np.array([[0, 0, 1, 0, 1], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 1]])

#: The lexicon. Given names that are also ordinary words are left out.
GIVEN = (
    "Anna Maria John Peter Laura Thomas Emily Paul Karen Hans David Susan Olivia James Julia Michael Sophie Carlos Linda Klaus Sabine Pierre Claire Miguel Carmen Sarah Erik Wei Mohammed Fatima Ahmed "
    "Aisha Raj Priya Yuki Hiroshi Ivan Olga Natalia Dmitri Giulia Marco Luca Francesca Lars Ingrid Sven Astrid Robert William George Elizabeth Margaret Charles Henry Alice Jane Emma Daniel Martin Stefan "
    "Andreas Katharina Ursula Wolfgang Jürgen Heike Petra Monika Jean François Camille Antoine Hélène Isabelle Philippe Nathalie José Juan Pedro Luis Lucía Elena Javier Pablo Rosa Sofía Diego Fernando "
    "Antonio Manuel Teresa Patrick Kevin Brian Sean Nina Hannah Ruth Simon Adam Samuel Joseph Rachel Rebecca Andrew Matthew Christopher Anthony Barbara Patricia Jennifer Jessica Nancy Helen Donald Kenneth "
    "Steven Edward Ronald Timothy Jason Jeffrey Ryan Nicholas Eric Stephen Jonathan Larry Scott Benjamin Gregory Raymond Alexander Dennis Aaron Tyler Oliver Lukas Felix Jonas Mia Lena"
).split()
FAMILY = (
    "Schmidt Miller Garcia Novak Rossi Weber Clark Johnson Anderson Lewis Becker Brown Taylor Wilson Carter Wagner Fischer Dubois Fernandez Meyer Koch Laurent Torres Ruiz Connor Larsson Zhang Wang Chen Liu "
    "Khan Hassan Patel Singh Tanaka Suzuki Ivanov Petrova Bianchi Romano Kowalski Nowak Hansen Nielsen Smith Jones Williams Davis Evans Roberts Walker Wright Müller Schneider Hoffmann Schäfer Moreau Lefebvre "
    "Fournier Lopez Martinez Gonzalez Perez Sanchez Ramirez Hauser Alvarez López García Martínez Petrov Yamamoto Nguyen Kim Okafor Silva Santos Costa"
).split()
TITLES = "mr mrs ms miss dr prof herr frau monsieur madame señor señora sr sra don doña".split()
STREET = "street st road rd avenue ave lane ln drive boulevard blvd court square terrace crescent highway".split()
STREET_BEFORE = "calle avenida plaza paseo camino carrera rue boulevard avenue chemin impasse quai allée".split()
#: Ends of German street words.
STREET_END = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "ufer", "damm")
LEXICON = {w.lower(): "given" for w in GIVEN} | {w.lower(): "family" for w in FAMILY} | dict.fromkeys(TITLES, "title") | dict.fromkeys(STREET_BEFORE, "before") | dict.fromkeys(STREET, "street")
PLACES = ("none", "given", "family", "title", "before", "street", "strasse")

#: Frames of the labelled table. {N}: a name, known or invented; {L}: one that begins with a known given name; {l}: such a one in lower
#: case; {F}: a family name, known or invented; {T}: a title; {A}, {D}, {S}, {R}: an address as in English, German, Spanish, French; {W}, {w}: an invented word, with a capital or not.
FRAMES = """
My name is {N}. | My name is {N} and I live in {W}. | my name is {l} and i live here | hello, my name is {l}, can you help | Please contact {N} for details. | Please contact {N} about the order.
Contact: {N} | Signed by {N} on Monday. | Yours sincerely, {N} | Kind regards, {N} | Best wishes, {N} | Dear Mr. {F}, thank you for your letter. | Dear Mrs. {F}, we have received it. | Dr. {F} will see you now.
Prof. {N} gave a talk on the topic. | Mr. {F} called yesterday. | Mrs. {N} lives next door. | Ms. {F} joined the team. | The report was written by Dr. {N} in May. | Patient name: {N} | Customer name: {N} | Full name: {N}
Name: {N} | Name: {l} | Mein Name ist {N}. | Herr {F} wohnt hier. | Frau {N} hat angerufen. | Mit freundlichen Grüßen, {N} | Sehr geehrter Herr {F}, vielen Dank. | Je m'appelle {N}. | Monsieur {F} est parti.
Madame {N} est absente. | Cordialement, {N} | Me llamo {N}. | El señor {F} no vive aquí. | Señora {N} ha llamado. | Atentamente, {N} | Mi nombre es {N}.
{L} met {L} at the station. | {L} and {L} went home. | The prize was given to {L} in May. | According to {L} the price was too high. | {L} said nothing about it. | We asked {L} about the plan. | A letter from {L} came today.
Gestern traf {L} den Bürgermeister. | Das Buch von {L} ist neu. | {L} und {L} kamen zu spät. | Hier {L} a écrit une lettre. | Le livre de {L} est sorti. | {L} et {L} sont partis. | Ayer {L} llegó tarde. | El libro de {L} es nuevo. | {L} y {L} viven aquí.
She lives at {A} in town. | Send it to {A} please. | Our office is at {A} near the park. | He moved to {A} last year. | Address: {A} | Home address: {A} | Visit us at {A} every day. | The shop at {A} is closed. | {A} is for sale.
Er wohnt in der {D} in {W}. | Unser Büro ist in der {D}. | Adresse: {D} | Anschrift: {D} | Das Haus in der {D} ist alt. | Vive en la {S} desde mayo. | Nuestra oficina está en {S}. | Dirección: {S} | Enviar a {S} por favor.
{T} {F} {w} {w} {w}. | Dear {T} {F}, {w} {w}. | {w} {w} {T} {F} {w} {w}. | {w} la señora {F} {w} | {W} {w} {T} {F}. | {w} {w} {A} {w} {w}. | {W} {w} {w} {S} {w} {w}. | {w} {w} {R} {w} {w}. | {W} {w} {D} {w} {w}.
He lives at {A} with us. | The way from {A} to {A} is short. | They have a flat at {A} and like it. | The house at {A} burnt down. | See {A} on the map. | Deliver to {A}, {W}
Write to {T} {F} about 12 boxes. | I spoke with {T} {N} about it. | {T} {F} and {T} {F} were there. | We met {T} {F}. | {T} {N} ist heute nicht da. | Ich sprach mit {T} {F} darüber. | J'ai vu {T} {F} hier. | He hablado con {T} {F} de ello.
{A} in {W} is where they live. | Er zog in die {D} in {W}. | {D} in {W} | Das Büro: {D}, {W} | {S} en {W} | Vive en {S} en {W}. | La tienda de {S} está cerrada. | La casa: {S}, {W} | {R} à {W} | Il habite {R} à {W}. | La maison du {R} est vieille. | Le bureau: {R}, {W}
Il habite au {R} depuis mai. | Notre bureau se trouve au {R}. | Adresse: {R} | Envoyez-le au {R} merci.
"""
#: Frames without spans. {K}: a known family name that stands for a word, as many of them are.
PLAIN = """
The {W} was closed on Monday. | In {W} the river is wide. | {W} is a town in the north. | They went to {W} and {W} last year. | The {W} {W} opened in 1990. | {W} {w} {w} {w}. | {W} {w} {W} {w} the {w}. | The {w} of {W} {w} in {W}.
Of {W} And {W} With {W}. | {W} {W} {W} | {W} {W} is {w}. | {W} said nothing. {W} {w} it. | By {W} the {w} was seen. | At {W} on {W} with {w}. | From {W}, {w} and {W}. | It was {W} who {w} the {w}. | A {W} is by the {w}.
Der {W} ist in der {W}. | Die {W} und das {W} sind alt. | In der {W} steht ein {W} mit {W}. | {W} {w} die {w} {W}. | Das {W} der {W} war {w}. | Le {W} est dans la {w}. | La {w} de {W} {w} le {w}. | {W} {w} les {w} des {w}.
El {W} está en la {w}. | Los {w} de {W} son {w}. | {W} {w} que {w} con la {w}. | y {W} {w} en el {w}.
Dear Mr. President, we write to you. | Dear Sir or Madam, we regret it. | Dear Mr. Chairman, dear guests. | Mr. Speaker, I rise to ask. | Madam Secretary said so. | Dear Customer, your order is late. | Dear all, the system will be down. | Frau Präsidentin, meine Damen und Herren.
Herr Präsident, ich danke Ihnen. | Señor Presidente, gracias. | Monsieur le Président, merci. | The doctor said that it was nothing. | Kind regards from the whole team. | Best wishes to you all. | Yours sincerely, the team
Please contact the office for details. | Please contact Customer Service for details. | Please send the report by Friday. | The name of the river is not known. | What is the name of this place? | Name the three largest rivers. | my name is not on the list | The file name is Index.
Licensed under the Apache License, Version 2.0. | Released under the MIT License in 2004. | The General Public License is long. | The United Nations met in New York. | Signed by the court on Monday. | The prize was given to them in May. | Contact: see below
Monday and Tuesday in January are free. | In March The Times wrote of it. | I am at home. | He is at work and She knows it. | We asked them about the plan. | A letter from home came today. | the mark on the wall | i will ask the bishop and the king
Address the problem before it grows. | The main street of the town was empty. | Main Street was empty. | We walked along the road. | Die Straße war leer. | Er ging auf dem Weg in den Wald. | La calle estaba vacía. | Dans la rue il fait froid. | The Road to {W} is long.
There were 12 apples and 7 pears on the table. | In 2019 The company sold 40 Units of it. | 40 {W} {w} were seen. | In 2020 12 {W} {w}. | On 5 May {W} {w}. | Chapter 3 Section 4 | 1 2 3 4 5 6 7 8 9 10 | The price was 250 and the weight 12 kg. | Call 5551234 or write to us. | {W} 12 {w} 7 {W}.
The {K} was old. | {K}. | {K} {w} the {w}. | {W} {w} {K}. {W} {w} | Der {K} {w} die {w}. | Le {K} est {w}. | {W}. {W}. {W} {w} | El {K} {w} la {w}.
{W} {w} 12 {w} {W}. | {w} rue {w} {w} 12. | la calle {w} {w} | {w} 7 calle {w} | {W} {w} Weg {w}. | der Weg {w} {W} {w} 12 {w}.
12 {W} {W} {w}. | 3 {W} {w} the {w}. | The train left at 9 and arrived at 12. | It is 5 pm. | Seite 12 {W} {w}. | {W} {w} 12. {W} {w} | página 7 {W} {w} | la {w} 5 {w} de {w}
"""


def invented(draw: random.Random, least: int = 2, most: int = 4) -> str:
    """A word that no lexicon holds, of common letters."""
    return "".join(draw.choice(["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "ch", "th", "tr", ""]) + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "s", "l", "t"]) for _ in range(draw.randint(least, most)))


def labelled_sentences(copies: int = 4, seed: int = 3) -> list[list[tuple[str, str]]]:
    """The labelled table: each frame filled so many times. Sentences of (word, label)."""
    draw = random.Random(seed)
    own = lambda known, share: draw.choice(known) if draw.random() < share else invented(draw, 1, 3).capitalize()
    family = lambda: own(FAMILY, 0.5) + ("-" + own(FAMILY, 0.5) if draw.random() < 0.1 else "")
    middle = lambda: [draw.choice("ABCEJKLMRST") + "."] if draw.random() < 0.15 else []
    proper = lambda: [invented(draw, 1, 3).capitalize() for _ in range(draw.choice([1, 1, 2]))]
    number = lambda: str(draw.randint(1, 300)) + draw.choice(["", "", "", "a", "B"])
    fill = {
        "N": lambda: [own(GIVEN, 0.7), *middle(), family()] if draw.random() < 0.85 else [own(GIVEN, 0.7)],
        "L": lambda: [draw.choice(GIVEN), *middle(), family()],
        "l": lambda: [draw.choice(GIVEN).lower(), *([draw.choice(FAMILY).lower()] if draw.random() < 0.8 else [])],
        "F": lambda: [family()],
        "K": lambda: [draw.choice(FAMILY)],
        "T": lambda: [(t := draw.choice(TITLES)).capitalize() + "." * (t in ("mr", "mrs", "ms", "dr", "prof", "sr", "sra") and draw.random() < 0.8)],
        "W": lambda: [invented(draw, 1, 4).capitalize()],
        "w": lambda: [invented(draw, 1, 4)],
        "A": lambda: [number(), *proper(), draw.choice([*STREET[:14], "St.", "Ave.", "Rd."]).capitalize()],
        "D": lambda: ([invented(draw, 1, 2).capitalize() + draw.choice(STREET_END)] if draw.random() < 0.7 else [invented(draw).capitalize() + "er", draw.choice(["Allee", "Straße", "Weg", "Platz"])]) + [number()],
        "S": lambda: [draw.choice(STREET_BEFORE[:6]).capitalize(), *draw.choice([[], [], ["de"], ["de", "la"], ["del"]]), *proper(), number()],
        "R": lambda: [number() + draw.choice(["", ","]), draw.choice(STREET_BEFORE[6:]), *draw.choice([[], [], ["de"], ["de", "la"], ["du"]]), *proper()],
    }
    out = []
    for table in (FRAMES, PLAIN):
        for frame in re.split(r"[|\n]", table):
            for _ in range(copies * bool(frame.strip())):
                words: list[tuple[str, str]] = []
                for part in frame.split():
                    if (m := re.fullmatch(r"\{(\w)\}(\W*)", part)) is None:
                        words.append((part, "O"))
                        continue
                    kind = {"N": "name", "L": "name", "l": "name", "F": "name", "W": "", "w": "", "K": "", "T": ""}.get(m[1], "address")
                    filled = fill[m[1]]()
                    filled[-1] += m[2]
                    words += [(w, f"{'B' if k == 0 else 'I'}-{kind}" if kind else "O") for k, w in enumerate(filled)]
                out.append(words)
    return out


def bare(word: str) -> str:
    return word.strip(".,:;!?()\"'") or word


def shape(word: str) -> str:
    """The shape of a word: capital, lower, digit or sign by kind, runs shortened to two."""
    out = []
    for c in bare(word):
        k = "X" if c.isupper() else "d" if c.isdigit() else "x" if c.isalpha() else c if c in ".,:;@-'" else "#"
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


def lexical(word: str) -> int:
    """Where the lexicon has a word, as a place in PLACES."""
    low = bare(word).lower()
    kind = LEXICON.get(low)
    if kind is None and "-" in low:
        kind = LEXICON.get(low.split("-")[0])
    if kind is None and len(low) > 5 and word[:1].isupper() and low.endswith(STREET_END):
        kind = "strasse"
    return PLACES.index(kind) if kind else 0


def can_begin(word: str) -> tuple[bool, bool]:
    """Whether a name, and an address, can begin with a word: a name with a capital (not an initial alone) or a known given name, an address with a capital, a number or a street word."""
    head, place = word.lstrip("(\"'")[:1], PLACES[lexical(word)]
    return (head.isupper() and len(bare(word)) > 1) or place == "given", head.isupper() or head.isdigit() or place == "before"


class Field:
    """Parameters and exact inference of the chain.

    A word maps to three feature classes: its (known) lower-case form, its shape and its place in the lexicon; each has a
    row of label scores for the place itself, the place after it and the place before it.
    """

    def __init__(self, words: dict[str, int], shapes: dict[str, int], score: np.ndarray, trans: np.ndarray):
        self.words, self.shapes, self.score, self.trans = words, shapes, score, trans

    def features(self, word: str) -> tuple[int, int, int]:
        """Rows of the score table."""
        n = len(self.words)
        return self.words.get(bare(word).lower(), 0), n + self.shapes.get(shape(word), 0), n + len(self.shapes) + lexical(word)

    @staticmethod
    def train(sentences: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.15, decay: float = 0.02, least: int = 4) -> Field:
        """Adam on the penalised log-likelihood. Only words seen outside of spans, or inside of addresses, `least` times are known by themselves: names are known by place, shape and lexicon."""
        outside: dict[str, int] = {}
        for s in sentences:
            for w, label in s:
                if label in ("O", "I-address") and not lexical(w):
                    outside[bare(w).lower()] = outside.get(bare(w).lower(), 0) + 1
        known = sorted(k for k, n in outside.items() if n >= least and not k.isdigit())
        words = {"<rare>": 0} | {k: i + 1 for i, k in enumerate(known)}
        shapes = {"<other>": 0} | {k: i + 1 for i, k in enumerate(sorted({shape(w) for s in sentences for w, _ in s}))}
        field = Field(words, shapes, np.zeros((len(words) + len(shapes) + len(PLACES), 3, len(LABELS))), np.zeros((len(LABELS) + 1, len(LABELS))))
        by_length: dict[int, list] = {}
        for s in sentences:
            by_length.setdefault(len(s), []).append(([field.features(w) for w, _ in s], [LABELS.index(x) for _, x in s]))
        data = [(np.array([x for x, _ in own]), np.array([y for _, y in own])) for own in by_length.values()]
        params, m, v = [field.score, field.trans], [0, 0], [0, 0]
        for step in range(1, steps + 1):
            grads = [-decay * field.score, -decay * field.trans]
            for x, y in data:
                field._gradient(x, y, grads)
            for k in range(2):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                params[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return field

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores (sequences, length, labels) of sequences of words given by their three features."""
        both = self.score[x].sum(axis=2)
        e = both[:, :, 0].copy()
        e[:, 1:] += both[:, :-1, 1]
        e[:, :-1] += both[:, 1:, 2]
        return e

    def _gradient(self, x: np.ndarray, y: np.ndarray, grads: list[np.ndarray]) -> None:
        (s, n), e, t, start = y.shape, self.emissions(x), self.trans[: len(LABELS)], self.trans[len(LABELS)]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + start
        for i in range(1, n):
            alpha[:, i] = e[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + t, axis=1)
        for i in range(n - 2, -1, -1):
            beta[:, i] = np.logaddexp.reduce(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)[:, None, None]
        p = -np.exp(alpha + beta - z)
        p[np.arange(s)[:, None], np.arange(n), y] += 1
        for k in range(x.shape[2]):
            np.add.at(grads[0], (x[:, :, k], 0), p)
            np.add.at(grads[0], (x[:, :-1, k], 1), p[:, 1:])
            np.add.at(grads[0], (x[:, 1:, k], 2), p[:, :-1])
        if n > 1:
            pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None])
            grads[1][: len(LABELS)] -= pair.sum(axis=(0, 1))
            np.add.at(grads[1], (y[:, :-1], y[:, 1:]), 1)
        grads[1][len(LABELS)] += p[:, 0].sum(axis=0)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels of a batch of sequences of one length: e is (sequences, length, labels)."""
        t, start = (self.trans - STRUCTURE)[: len(LABELS)], (self.trans - STRUCTURE)[len(LABELS)]
        n = e.shape[1]
        best, back = e[:, 0] + start, np.empty(e.shape, dtype=np.int8)
        for i in range(1, n):
            s = best[:, :, None] + t
            back[:, i] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, i]
        out = np.empty(e.shape[:2], dtype=np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(e))
        for i in range(n - 1, 0, -1):
            out[:, i - 1] = back[rows, i, out[:, i]]
        return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field.train(labelled_sentences())


class Finder:
    """Base spans of a text, and the field's spans of a batch of texts."""

    def __init__(self, field: Field):
        self.field = field
        self.memo: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.ends: list[bool] = []

    def word(self, w: str) -> int:
        """The class number of a word: its features, where spans can begin, and whether a sentence ends there."""
        low = w[:-1].lower()
        initial = len(w) == 2 and w[0].isupper()
        stop = w[-1] in ".!?" and len(w) > 1 and not initial and not (len(w) <= 5 and w[0].isupper() and (low in TITLES or low in STREET))
        key = (*self.field.features(w), *can_begin(w), stop)
        k = self.classes.get(key)
        if k is None:
            k = self.classes[key] = len(self.rows)
            row = self.field.score[list(key[:3])].sum(axis=0)
            row[0, 0] += OUTSIDE_BIAS
            row[0, 1] -= 0 if key[3] else NEVER
            row[0, 3] -= 0 if key[4] else NEVER
            self.rows.append(row)
            self.ends.append(stop)
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[w] = k
        return k

    def field_spans(self, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """By place in texts, the (start, kind number, end) that the field finds. Sentences are the sequences."""
        ids, lengths, get, word = [], [], self.memo.get, self.word
        for text in texts:
            words = text.split()
            lengths.append(len(words))
            ids += [k if (k := get(w)) is not None else word(w) for w in words]
        if not ids:
            return {}
        x, table = np.array(ids, dtype=np.int32), np.array(self.rows)
        stops = np.array(self.ends)[x]
        doc_ends = np.cumsum(lengths)
        stops[doc_ends[doc_ends > 0] - 1] = True
        ends = np.flatnonzero(stops) + 1
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        found: list[np.ndarray] = []
        for n in np.unique(size):
            at = starts[size == n]
            for k in range(0, len(at), step := max(1, 40_000 // int(n))):
                w = x[at[k : k + step, None] + np.arange(n)]
                e = table[w, 0]
                e[:, 1:] += table[w[:, :-1], 1]
                e[:, :-1] += table[w[:, 1:], 2]
                y = self.field.viterbi(e)
                r, c = np.nonzero(y)
                if len(r):
                    found.append(np.stack([at[k : k + step][r] + c, y[r, c]]))
        if not found:
            return {}
        places, labels = np.concatenate(found, axis=1)
        order = np.argsort(places)
        docs = np.searchsorted(doc_ends, places[order], side="right")
        out: dict[int, list[tuple[int, int, int]]] = {}
        hit: dict[int, list[tuple[int, int]]] = {}
        for d, p, y in zip(docs.tolist(), places[order].tolist(), labels[order].tolist()):
            hit.setdefault(d, []).append((p - int(doc_ends[d]) + lengths[d], y))
        for d, marks in hit.items():
            wanted = dict(marks)
            spans, last = [], -2
            for k, m in enumerate(TOKEN.finditer(texts[d])):
                if (y := wanted.get(k)) is None:
                    continue
                kind = 4 if y <= 2 else 5
                token = m[0].rstrip(".,:;!?)\"'")
                start, end = m.start(), m.start() + max(1, len(token))
                if spans and last == k - 1 and y in (2, 4) and spans[-1][1] == kind:
                    spans[-1] = (spans[-1][0], kind, end)
                else:
                    spans.append((start, kind, end))
                last = k
            out[d] = [x for x in spans if (DIGIT if x[1] == 5 else LETTERS).search(texts[d], x[0], x[2])]
        return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def local_start(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends at `at` begins, not before least. Looks back in growing steps."""
    step = 64
    while True:
        low = max(least, at - step)
        tail = text[low:at][::-1]
        n = LOCAL.match(tail).end()
        if n < len(tail) or low == least:
            return at - n
        step *= 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted by start, then kind."""
    spans, at, least = [], text.find("@"), 0
    while at >= 0:
        start = local_start(text, at, least)
        if start < at and (m := DOMAIN.match(text, at)):
            spans.append((start, 0, m.end()))
            least = m.end()
        at = text.find("@", max(at + 1, least))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def all_spans(finder: Finder, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and the added ones that overlap none of them."""
    more = finder.field_spans(texts)
    return [(b := base_spans(t), clear_of(more.get(k, []), b)) for k, t in enumerate(texts)]


def personal_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): counts by kind, the digest of the fixed patterns' spans, all spans.

    Returns doc_id, n_email, n_ip, n_card, n_phone, n_name, n_address, base_sha256, spans.
    """
    field = field or default_field()
    names = [f"n_{k}" for k in KINDS]

    def make():
        finder = Finder(field)

        def step(batch):
            out = {k: [] for k in [*names, "base_sha256", "spans"]}
            for base, more in all_spans(finder, [t or "" for t in batch.column(1).to_pylist()]):
                kinds = [k for _, k, _ in base + more]
                for k, name in enumerate(names):
                    out[name].append(kinds.count(k))
                joined = join(base, KINDS)
                out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["spans"].append(join(sorted(base + more), KINDS) if more else joined)
            return out | {"doc_id": batch.column(0)}

        return step

    return arrow_rows(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")


def mask_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every found span of text replaced by its kind in angle brackets; n_chars, where there is one, follows.

    Rows, their order of columns and all other columns stay. A null text stays null. The result waits in the shared folder.
    """
    field = field or default_field()
    columns = docs.columns
    at = columns.index("text")

    def make():
        finder = Finder(field)

        def step(batch):
            texts = batch.column(at).to_pylist()
            out = []
            for text, (base, more) in zip(texts, all_spans(finder, [t or "" for t in texts])):
                if text is None:
                    out.append(None)
                    continue
                parts, last = [], 0
                for s, k, e in sorted(base + more):
                    if e <= last:
                        continue
                    if s >= last:
                        parts += [text[last:s], f"<{KINDS[k]}>"]
                    last = e
                out.append("".join(parts) + text[last:] if parts else text)
            return {c: batch.column(k) for k, c in enumerate(columns)} | {"text": out}

        return step

    masked = arrow_rows(docs, make, docs.schema)
    masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else masked
    return Staged(masked, "masked").df

"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are second-order chains over the characters of the token alphabet, each interpolated with its first-order
chain, trained from labelled samples (label 1: random key material, label 0: ordinary identifiers, words, names and
compounds of several languages). A token is reported whole when the log-likelihood ratio of the two
models exceeds a threshold, so short or word-like tokens stay. Of other tokens, the stretches between
`/ _ - =` and those of the largest sums of the ratio are judged, so a key glued to a path or a name is found.
Random strings of fewer than MIN_TOKEN characters and rare words can't be told apart well enough (see the README's table); they are
left to the fixed patterns.

Nulls: a null text counts as empty. Empty texts have no spans. Repeated rows give repeated results.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows

#: Fixed patterns of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
#: Key words of ASSIGN in lower case, for a quick look before the pattern runs.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest token, and shortest stretch of one, that the models judge.
MIN_TOKEN = 16
PIECE = re.compile(r"[A-Za-z0-9+]{%d,}" % MIN_TOKEN)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
#: Log-likelihood ratio (nats) above which a token counts as random key material.
THRESHOLD = 14.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Ordinary words from which the labelled identifiers are composed.
WORDS = (
    "account action address average batch block buffer builder cache channel client cluster column command config connection content context counter "
    "current customer data date default delete document element error event example export factory field file filter format function global group handler "
    "header helper history image import index input instance internal iterator key label language length level library list loader local manager mapping "
    "message method model module month name network node number object offset operator option order output package page parameter parent parser path pattern "
    "payment process product profile project property query queue reader record region register release report request resource response result return "
    "schedule schema search section server service session setting source stage state status storage stream string system table target template test thread "
    "time title transaction transform type update upload user value version view warehouse window worker writer year "
    "wissenschaft entwicklung geschichte verantwortung gesellschaft zusammenarbeit moglichkeit einheitlich schreiben zwischen "
    "gouvernement developpement connaissance environnement traitement ensemble nouvelle question recherche toujours "
    "desarrollo conocimiento universidad investigacion informacion gobierno siempre trabajo tambien importante "
    "eaux beaux nouveaux travaux heureux jeux lieux mieux cheveux niveau bureau chateau oiseaux ailleurs maison jamais francaise monnaie raison semaine premier dernier cahier papier metier entier "
    "sentiment batiment pendant quelque unique politique musique bibliotheque lumiere matiere derriere maintenant ancienne soient auraient nation action reunion oreille soleil royaume aujourd "
    "gesundheit freiheit wahrheit einfach mensch deutsch zeichen sprechen kirche pflicht pferd kopf apfel knopf schutz platz jetzt setzen grosse strasse ungefahr bedeutung zeitung erfahrung verstehen "
    "ciudad verdad nombre hombre mujeres manana espanol pequeno corazon estacion pueblo iglesia guerra queso quien aunque agua lengua juego fuego amigas caballos trabajadores nosotros"
).split()
#: Names of persons and places of many languages, whose letters follow each other in other ways than those of words.
NAMES = (
    "kowalczyk wisniewski szymanska dabrowski przybylski grzegorz wojtkowiak czarnecki jankowska krzysztof zielinska lewandowski dvorak novotny svoboda prochazka jezkova hruska kovacs szabo nagy "
    "horvath vanderberg dijkstra hoogstraten schouten vandijk achterhuis oosterhuis hakkinen virtanen korhonen nieminen jarvinen lindqvist bergstrom sjoberg ostergaard kjeldsen thorvaldsen gudmundsson "
    "schwarzenbach pfeifer zimmermann kirchschlager knoblauch strauss rothschild schulz etxeberria goikoetxea ibarretxe agirre llewellyn gwynedd rhys mcdonald oconnor fitzgerald macgregor "
    "nguyen tran pham hoang ngoc yamaguchi watanabe nakamura kobayashi shinjuku fujiwara zhang xiong zhou qiang huang jiang krishnamurthy venkatesh subramaniam mukherjee chakraborty bhattacharya "
    "okonkwo adeyemi mwangi kipchoge nkrumah mbeki tshwane abdulrahman mohamed hussein alqahtani benjelloun papadopoulos georgiou stavros ioannidis popescu ionescu yilmaz ozturk "
    "edinburgh worcester reykjavik lodz bydgoszcz brno gyor wroclaw ljubljana zagreb tbilisi yerevan phoenix mississippi massachusetts xochimilco oaxaca guadalajara"
).split()


def labelled_samples(n: int = 12_000, seed: int = 7) -> list[tuple[str, int]]:
    """The labelled training table, built by rule: (token, 1 if random key material)."""
    draw = random.Random(seed)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62], ALPHABET[:64]]
    out = []
    for i in range(n):
        out.append(("".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(16, 64))), 1))
        words = [draw.choice(WORDS if draw.random() < 0.7 else NAMES) for _ in range(draw.randint(1, 5))]
        style = i % 7
        if style == 0:
            token = "_".join(words)
        elif style == 1:
            token = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            token = "-".join(words) + draw.choice(["", "-2", "-v3", "-2024-01-31"])
        elif style == 3:
            token = "".join(words)
        elif style == 4:
            token = "/".join(words) + draw.choice(["", "/2021/10/05", "/index"])
        elif style == 5:
            token = "".join(w.capitalize() for w in words)
        else:
            token = "_".join(words).upper()
        out.append((token, 0))
    return out


#: Weight of the second-order chain beside the first-order one grows with what was seen after the two characters: n / (n + SEEN).
SEEN = 20.0


def train(samples: list[tuple[str, int]]) -> np.ndarray:
    """The table of log-likelihood ratios: [character before the previous or start, previous or start, character]. The first order is smoothed by half a count."""
    at = {c: k for k, c in enumerate(ALPHABET)}
    n = len(ALPHABET)
    counts = np.zeros((2, n + 1, n + 1, n))
    for token, label in samples:
        first = prev = n
        for c in token:
            if (k := at.get(c)) is not None:
                counts[label, first, prev, k] += 1
                first, prev = prev, k
    one = counts.sum(axis=1) + 0.5
    one /= one.sum(axis=2, keepdims=True)
    seen = counts.sum(axis=3, keepdims=True)
    logs = np.log((counts + SEEN * one[:, None]) / (seen + SEEN))
    return logs[1] - logs[0]


def largest_sums(values: list[float], least: float) -> list[tuple[int, int]]:
    """Disjoint stretches whose sum exceeds `least`, each ending at its largest sum; a new one starts where the sum falls below 0 or by `least` from its top."""
    out, start, total, top, end = [], 0, 0.0, 0.0, 0
    for k, x in enumerate(values):
        total += x
        if total > top:
            top, end = total, k + 1
        if total <= 0 or total < top - least:
            if top > least:
                out.append((start, end))
            start, total, top = k + 1, 0.0, 0.0
    if top > least:
        out.append((start, end))
    return out


class Scanner:
    """Finds the spans of one text; positions are code points, ends exclusive."""

    def __init__(self, ratio: np.ndarray, threshold: float = THRESHOLD):
        self.codes = np.full(128, len(ALPHABET), dtype=np.int64)
        for k, c in enumerate(ALPHABET):
            self.codes[ord(c)] = k
        self.ratio, self.threshold = ratio, threshold
        self.memo: dict[str, tuple[tuple[int, int], ...]] = {}

    def ratios(self, token: str) -> np.ndarray:
        """What each character adds to the log-likelihood ratio of the token."""
        k = self.codes[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
        before = np.concatenate([[len(ALPHABET)] * 2, k])
        return self.ratio[before[:-2], before[1:-1], k]

    def is_random(self, token: str) -> bool:
        if token.isdigit():  # a number, not key material
            return False
        return float(self.ratios(token).sum()) > self.threshold

    def stretches(self, token: str) -> tuple[tuple[int, int], ...]:
        """(start, end) of the parts of a token that the models call random, sorted and disjoint."""
        known = self.memo.get(token)
        if known is None:
            if token.isdigit():
                known = ()
            elif self.is_random(token):
                known = ((0, len(token)),)
            else:
                parts = [m.span() for m in PIECE.finditer(token)] + largest_sums(self.ratios(token).tolist(), self.threshold)
                merged: list[tuple[int, int]] = []
                for a, b in sorted((a, b) for a, b in parts if b - a >= MIN_TOKEN and self.is_random(token[a:b])):
                    if merged and a < merged[-1][1]:
                        merged[-1] = merged[-1][0], max(b, merged[-1][1])
                    else:
                        merged.append((a, b))
                known = tuple(merged)
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(token) < 200:
                self.memo[token] = known
        return known

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the fixed patterns, sorted."""
        spans = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        spans.sort()
        return spans

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tokens, and stretches of tokens, that the models call random and that no base span overlaps."""
        out = [(m.start() + a, 3, m.start() + b) for m in CANDIDATE.finditer(text) for a, b in self.stretches(m[0])]
        return clear_of(out, base)


def clear_of(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the sorted, disjoint spans that overlap none of the sorted base spans; one sweep over both."""
    out, k, reach = [], 0, 0
    for x in spans:
        while k < len(base) and base[k][0] < x[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= x[0]:
            out.append(x)
    return out


def join(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): counts of the fixed patterns, their digest, all spans.

    Returns doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.
    """
    ratio = train(samples if samples is not None else labelled_samples())

    def make():
        scanner = Scanner(ratio, threshold)

        def step(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")}
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = scanner.base(text)
                more = scanner.added(text, base)
                kinds = [k for _, k, _ in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["n_markov"].append(len(more))
                joined = join(base, KINDS)
                out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["spans"].append(join(sorted(base + more), KINDS) if more else joined)
            return out | {"doc_id": batch.column(0)}

        return step

    return arrow_rows(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")

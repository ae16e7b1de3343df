"""The field for names and addresses: exact inference, hand-written held-out sentences, spans of the query against plain decoding."""

import itertools

import numpy as np
import pytest

from lexispark.llm import pii

#: Held out: written by hand, none of them a frame of the labelled table. [..] names, <..> addresses.
HELD_OUT = """
[Sarah Connor] met [Erik Larsson] in front of the old library.
my name is [maria lopez], could you look at this?
Later that week [Wei Zhang] flew back home.
The file was last changed by [Natalia Petrova] on Friday.
Could [Kevin Walker] send me the minutes?
As [Hiroshi Tanaka] wrote, the bridge is safe.
Sincerely yours, [Margaret Evans]
Dear Ms. [Kowalczyk], your parcel has arrived.
Yesterday Dr. [Achterberg] operated on three patients.
I talked to Mrs. [Delacroix-Stone] for an hour.
[Priya Patel] and her sister opened a shop.
The painting belongs to [George Hoffmann] now.
Nobody told [Emma Nielsen] about the change.
Ich habe [Stefan Becker] seit Jahren nicht gesehen.
Guten Tag, mein Name ist [Heike Brandstetter].
Frau [Lindenthal] kommt erst am Dienstag.
Nous avons parlé avec [Nathalie Moreau] du projet.
Monsieur [Bertillon] n'a pas répondu.
La casa de [Pablo Ramirez] es blanca.
Buenos días, me llamo [Lucía Fernandez].
Ayer vi a la señora [Quintanilla] en el mercado.
Contact: [Ahmed Khan], second floor
Patient name: [Olga Ivanov], admitted at noon
The parcel goes to <48 Birch Lane> before ten.
Their new office is <1200 Harbor Boulevard> in the old port.
We met at <9 King Square> and walked on.
Home address: <77 Willow Avenue>
Die Praxis liegt in der <Lindenstraße 14> im zweiten Stock.
Meine Adresse: <Bergweg 3>
Wir treffen uns in der <Schillerstrasse 101> um acht.
Mi tía vive en <Calle Alcalá 25> desde hace años.
El hotel está en <Avenida de la Libertad 8> cerca del río.
Nous habitons <14 rue Saint-Jacques> depuis dix ans.
Le cabinet est au <3 boulevard de la République> maintenant.
Dear Mr. President, honoured guests, welcome.
Dear Madam Chair, I have a question.
The United Kingdom and New Zealand signed the treaty in 1998.
Apple and Microsoft sold 400 million Units in March.
On Monday The Guardian wrote about the Amazon River.
Chapter 12 describes the Battle of Hastings in detail.
In May 1975 the Rolling Stones played in Paris and London.
The street was wide, and 30 people stood there.
Turn left after 200 metres and follow the road.
Her sister bought 12 red roses and 3 white lilies.
Route 66 runs from Chicago to Santa Monica.
The Supreme Court of Canada heard the case on Tuesday.
What is your name and address, please?
Please contact Technical Support or the Help Desk.
The name of the rose is a novel.
I will mark the page with a pen.
Der Vater ging mit dem Hund durch den Wald zur Schule.
Die Universität Heidelberg hat 30000 Studenten.
Im Jahr 1848 tagte die Versammlung in der Paulskirche.
Der Zug nach Hamburg fährt um 12 Uhr von Gleis 7.
Le Conseil de Paris a voté 12 millions pour les écoles.
La rue était vide et la Seine montait.
El Ministerio de Cultura abrió 5 museos en Sevilla.
La calle Mayor estaba llena de gente.
Los Reyes Magos llegan el 6 de enero.
Version 3 of the General Public License was published in 2007.
Chen
A Smith works with iron, a Miller with grain.
Page 7 of 20
Sent from my Phone at 5 pm
Terms of Use and Privacy Policy of This Site
"""


def marked(line):
    """A line without its marks, and the marked spans."""
    text, spans = "", []
    for c in line:
        if c in "[<":
            spans.append([len(text), 4 if c == "[" else 5, -1])
        elif c in "]>":
            spans[-1][2] = len(text)
        else:
            text += c
    return text, {tuple(x) for x in spans}


def test_held_out_precision_and_recall():
    finder = pii.Finder(pii.default_field())
    right = found = wanted = 0
    for line in HELD_OUT.strip().split("\n"):
        text, spans = marked(line)
        got = set(pii.all_spans(finder, [text])[0][1])
        if got != spans:
            print(line, [(pii.KINDS[k], text[s:e]) for s, k, e in sorted(got)])
        right, found, wanted = right + len(got & spans), found + len(got), wanted + len(spans)
    print(f"precision {right}/{found}, recall {right}/{wanted}")
    assert right >= 0.9 * found and right >= 0.85 * wanted


def test_field_is_exact():
    field = pii.default_field()
    e = np.random.default_rng(1).normal(size=(4, 5, len(pii.LABELS)))
    t, start = (field.trans - pii.STRUCTURE)[:-1], (field.trans - pii.STRUCTURE)[-1]
    for k, y in enumerate(field.viterbi(e)):
        value = lambda p: start[p[0]] + sum(e[k, i, c] for i, c in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert value(tuple(int(c) for c in y)) == pytest.approx(max(map(value, itertools.product(range(len(pii.LABELS)), repeat=5))))


def test_gradient_is_that_of_the_log_likelihood():
    field = pii.Field.train(pii.labelled_sentences(1)[:30], steps=3)
    s = next(x for x in pii.labelled_sentences(1) if len(x) == 5)
    x, y = np.array([[field.features(w) for w, _ in s]]), np.array([[pii.LABELS.index(b) for _, b in s]])

    def likelihood():
        e, t, start = field.emissions(x)[0], field.trans[:-1], field.trans[-1]
        value = lambda p: start[p[0]] + sum(e[i, c] for i, c in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))
        return value(y[0]) - np.logaddexp.reduce([value(p) for p in itertools.product(range(len(pii.LABELS)), repeat=5)])

    grads = [np.zeros_like(field.score), np.zeros_like(field.trans)]
    field._gradient(x, y, grads)
    for table, grad, at in [(field.score, grads[0], (x[0, 2, k], j, c)) for k in range(3) for j in range(3) for c in range(5)] + [(field.trans, grads[1], (a, b)) for a in range(6) for b in range(5)]:
        before, old = likelihood(), table[at]
        table[at] += 1e-6
        assert (likelihood() - before) / 1e-6 == pytest.approx(grad[at], abs=1e-4)
        table[at] = old


def test_spans_against_one_sentence_at_a_time():
    """The batched search against Viterbi of each sentence alone."""
    field = pii.default_field()
    finder = pii.Finder(field)
    texts = [marked(x)[0] for x in HELD_OUT.strip().split("\n")]
    texts = [" ".join(texts[k : k + n]) for k, n in ((0, 9), (9, 1), (10, 20), (30, 30))] + ["", "  ", "x" * 5000 + " Mr. Smith"]
    together = finder.field_spans(texts)
    for k, text in enumerate(texts):
        assert together.get(k, []) == pii.Finder(field).field_spans([text]).get(0, [])
    one = pii.Finder(field)
    for line in HELD_OUT.strip().split("\n"):
        text, _ = marked(line)
        words = text.split()
        e = field.emissions(np.array([[field.features(w) for w in words]]))
        e[:, :, 0] += pii.OUTSIDE_BIAS
        for i, w in enumerate(words):
            name, address = pii.can_begin(w)
            e[0, i, 1] -= 0 if name else pii.NEVER
            e[0, i, 3] -= 0 if address else pii.NEVER
        if not any(one.ends[one.word(w)] for w in words[:-1]):
            labels = field.viterbi(e)[0]
            names = sum(int(x) == 1 for x in labels)
            assert sum(k == 4 for _, k, _ in one.field_spans([text]).get(0, [])) == names

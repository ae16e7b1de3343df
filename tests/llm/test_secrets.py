"""The character models on data of no training: identifiers of Python's own library, names, and random keys by length."""

import importlib
import random

import pytest

from lexispark.llm import secrets

MODULES = "argparse ast asyncio base64 collections concurrent.futures csv datetime decimal difflib email.message functools heapq http.client inspect io itertools json logging multiprocessing os pathlib pickle random re shutil socket sqlite3 ssl statistics string struct subprocess tarfile tempfile threading typing unittest urllib.request uuid xml.dom.minidom zipfile"


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.train(secrets.labelled_samples()))


def identifiers():
    out = set()
    for name in MODULES.split():
        module = importlib.import_module(name)
        for a in dir(module):
            out |= {a, *dir(getattr(module, a))}
    return sorted(x for x in out if len(x) >= secrets.MIN_TOKEN and set(x) <= set(secrets.ALPHABET))


def test_errors_by_threshold(scanner):
    """README's table; the threshold in use must hold these bounds."""
    own, r = identifiers(), random.Random(5)
    assert len(own) > 1500
    sums = [float(scanner.ratios(x).sum()) for x in own]
    keys = {(n, k): [float(scanner.ratios("".join(r.choices(a, k=n))).sum()) for _ in range(400)] for n in (16, 20, 24, 32) for k, a in (("hex", "0123456789abcdef"), ("letters and digits", secrets.ALPHABET[:62]))}
    for t in (8, 10, 12, 14, 16, 20):
        print(t, f"identifiers called random {sum(x > t for x in sums)} of {len(sums)}", {k: sum(x > t for x in v) / len(v) for k, v in keys.items()})
    t = secrets.THRESHOLD
    assert sum(x > t for x in sums) <= 0.01 * len(sums)
    for v in keys.values():
        assert sum(x > t for x in v) >= 0.985 * len(v)


@pytest.mark.parametrize("word", ["krzysztofwojciechowski", "schwarzwaldklinik", "rechtsschutzversicherung", "hottentottententententoonstelling", "donaudampfschifffahrt", "constantinopolitan", "internationalization", "2024-01-31-12-00-00", "123456789012345678"])
def test_names_and_compounds_are_left(scanner, word):
    assert scanner.added(f"see {word} here", []) == []


def test_added_spans_against_whole_tokens(scanner):
    """Spans of a text are those of its tokens alone, shifted, and clear of base spans."""
    r = random.Random(2)
    tokens = ["".join(r.choices(secrets.ALPHABET[:62], k=r.randint(5, 40))) if r.random() < 0.3 else "-".join(r.choices(secrets.WORDS, k=3)) for _ in range(300)]
    text, want = "", []
    for t in tokens:
        want += [(len(text) + a, 3, len(text) + b) for a, b in secrets.Scanner(scanner.ratio).stretches(t) if len(t) >= secrets.MIN_TOKEN]
        text += t + r.choice([" ", ". ", "\n", "é"])
    assert scanner.added(text, []) == want and want
    base = [(want[0][0] + 2, 2, want[0][2])]
    assert scanner.added(text, base) == want[1:]

"""License texts wherever they stand, and runs of units against all runs."""

import random

import pytest

from cartwalk.llm import licenses

PROSE = ["The river was wide and slow that morning.", "Nobody had counted the boats!", "Was it the third of the month?",
         "Ten men carried the piano up the hill.", "She gave the letter to her brother.", "It rained."]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.default_templates())


def test_every_name_has_a_text():
    assert set(licenses.NAMES) == set(licenses.TEXTS)


@pytest.mark.parametrize("lic", sorted(licenses.TEXTS))
def test_text_inside_a_long_line(scanner, lic):
    before, after = " ".join(PROSE * 2) + " ", " " + " ".join(PROSE[::-1] * 2)
    for text in licenses.TEXTS[lic]:
        got = scanner.scan(before + text + after)
        assert [(m[2], m[3]) for m in got] == [(lic, 1.0)]
        # what is matched has the text's words
        assert licenses.tokens((before + text + after)[got[0][0]:got[0][1]]) == licenses.tokens(text)


@pytest.mark.parametrize("lic", ["MIT", "BSD-3-Clause", "GPL-3.0"])
def test_text_wrapped_over_lines_inside_prose(scanner, lic):
    words = licenses.TEXTS[lic][0].split(" ")
    wrapped = "\n".join(" * " + " ".join(words[i:i + 9]) for i in range(0, len(words), 9))
    text = " ".join(PROSE) + "\n\n" + wrapped + "\n" + " ".join(PROSE)
    best = max(scanner.scan(text), key=lambda m: m[3])
    assert best[2] == lic and best[3] > 0.97


def test_prose_and_repeats(scanner):
    assert scanner.scan(" ".join(PROSE * 50)) == []
    assert scanner.scan("of the " * 20000) == []
    assert scanner.scan("The software. " * 5000) == []


def test_against_all_runs(scanner):
    rnd = random.Random(5)
    sentences = [s for texts in licenses.TEXTS.values() for t in texts for s in licenses.SENTENCE.split(t)]
    for _ in range(40):
        text = "".join(rnd.choice(sentences if rnd.random() < 0.6 else PROSE) + rnd.choice([" ", "\n"]) for _ in range(8))
        units = list(scanner._units(text))
        want = []
        for i in range(len(units)):
            words = []
            for start, end, more in units[i:]:
                words += more
                hit = scanner.best(licenses.bigrams(words))
                if hit:
                    want.append((hit[0], hit[1]))
        got = [(m[3], m[2]) for m in scanner.scan(text)]
        assert max(got, default=None, key=lambda x: x[0]) == max(want, default=None, key=lambda x: x[0]) or \
            max(got)[0] == max(want)[0]

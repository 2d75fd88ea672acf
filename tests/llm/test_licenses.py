import random

from sluice.llm.licenses import TEMPLATES, Scanner, gate_words, densest, patience, scan_licenses, words


def filler(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["ther", "and", "re", "tion", "the", "ing", "of"]) + rng.choice(["on", "at", "is"]) for _ in range(n))


def test_patience_aligns_in_order():
    a, b = "a b c d e f g".split(), "x a b q d e z f g".split()
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs)
    assert len(pairs) == 6


def test_patience_recurses_into_repeats():
    text = "to be or not to be that is to be or not".split()
    assert [i for i, _ in patience(text, text)] == list(range(len(text)))
    assert patience([], text) == [] and patience(text, []) == []


def test_every_template_is_found_whole_and_damaged():
    scanner, rng = Scanner(), random.Random(3)
    for name, template in TEMPLATES.items():
        own = words(template)
        before = words(filler(300, 1))
        assert [f[0] for f in scanner.scan(before + own + before)] == [name]
        assert scanner.scan(before + own + before)[0][1:] == (1.0, 300, 300 + len(own))
        damaged = [w for w in own if rng.random() > 0.1] if len(own) > 20 else own
        found = scanner.scan(before + damaged)
        assert [f[0] for f in found] == [name] and found[0][1] >= 0.75


def test_gate_loses_nothing():
    for template in TEMPLATES.values():
        own = words(template)
        gate = gate_words(own)
        held = sum(w in gate for w in own)
        assert held > 0.25 * len(own)


def test_clean_text_has_none_and_two_are_both_found():
    scanner = Scanner()
    assert scanner.scan(words(filler(2000, 5))) == []
    both = words(filler(50, 6)) + words(TEMPLATES["MIT-notice"]) + words(filler(50, 7)) + words(TEMPLATES["CC-BY-NC-4.0-notice"]) + words(TEMPLATES["MIT-notice"])
    assert [f[0] for f in scanner.scan(both)] == ["MIT-notice", "CC-BY-NC-4.0-notice", "MIT-notice"]


def test_two_copies_of_every_template_are_both_found():
    scanner = Scanner()
    for name, template in TEMPLATES.items():
        own, before, between, after = words(template), words(filler(40, 8)), words(filler(30, 9)), words(filler(40, 10))
        found = scanner.scan(before + own + between + own + after)
        assert found == [(name, 1.0, 40, 40 + len(own)), (name, 1.0, 70 + len(own), 70 + 2 * len(own))]
        assert [f[0] for f in scanner.scan(before + own * 3 + after)] == [name] * 3


def test_two_damaged_copies_are_both_found():
    """Each lacks a part that the other has, so one alignment over both would take a half of each."""
    own = words(TEMPLATES["MIT"])
    text = words(filler(40, 8)) + own[: len(own) * 4 // 5] + words(filler(30, 9)) + own[len(own) // 5 :] + words(filler(40, 10))
    assert [f[0] for f in Scanner().scan(text)] == ["MIT", "MIT"]


def test_densest_against_brute_force():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        return row[-1]

    for seed in range(60):
        rng = random.Random(seed)
        a, b = ([rng.choice("abcdefgh") for _ in range(n)] for n in (8, 40))
        most = max(common(a, b[s : s + 13]) for s in range(len(b)))
        n, begin, end = densest(a, b, 13, 5)
        assert n == (most if most >= 5 else 0)
        assert not n or (end - begin <= 13 and common(a, b[begin:end]) == n)


def test_table(make_docs, odd_rows):
    rows = [*odd_rows, (20, "Intro.\n" + TEMPLATES["MIT"]), (20, "Intro.\n" + TEMPLATES["MIT"]), (21, filler(50, 2) + " " + TEMPLATES["GPL-3.0-notice"])]
    out = scan_licenses(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in out) == [(20, "MIT", 1.0), (20, "MIT", 1.0), (21, "GPL-3.0-notice", 1.0)]
    assert scan_licenses(make_docs([])).count() == 0


def test_near_misses_are_not_named_after_what_they_resemble():
    scanner = Scanner()
    near = {
        "Released under the BSD License.": [],
        "Released under the Apache License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0-notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0-notice"],
        "Licensed under CC BY-ND 3.0.": [],
    }
    for text, want in near.items():
        assert [f[0] for f in scanner.scan(words(filler(40, 1) + " " + text + " " + filler(40, 2)))] == want, text
    both = words("Licensed under the Apache License, Version 1.1. Licensed under the Apache License, Version 2.0.")
    assert [f[0] for f in scanner.scan(both)] == ["Apache-2.0-notice"]


def test_ten_copies_of_every_template_are_all_found():
    scanner = Scanner()
    for name, template in TEMPLATES.items():
        own = words(template)
        text = words(filler(40, 8))
        for k in range(10):
            text += own + words(filler(15 + k, 20 + k))
        assert [f[0] for f in scanner.scan(text)] == [name] * 10, name

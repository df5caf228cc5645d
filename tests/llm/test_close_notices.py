"""Copies of one notice that stand close are each found."""

from __future__ import annotations

import random

import pytest
from panolake.llm import license_scan

KNOWN = license_scan.Templates(license_scan.TEMPLATES, license_scan.LEAST)


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
@pytest.mark.parametrize("copies", [1, 2, 3, 7])
@pytest.mark.parametrize("between", [0, 3, 25, 150])
def test_whole_copies(name, copies, between):
    template = KNOWN.words[name]
    words = ["zu"] * 5
    want = []
    for _ in range(copies):
        want.append((1.0, len(words), len(words) + len(template) - 1))
        words += [*template, *(f"w{i}" for i in range(between))]
    assert [h[1:4] for h in KNOWN.found(" ".join(words)) if h[0] == name] == want


@pytest.mark.parametrize("name", ["MIT-text", "BSD", "ISC", "GPL-3.0-header", "Apache-2.0-header"])
@pytest.mark.parametrize("between", [3, 30])
def test_edited_copies(name, between):
    r = random.Random(name)
    for _ in range(20):
        words, places = [], []
        for _ in range(3):
            places.append(len(words))
            words += [w for w in KNOWN.words[name] if r.random() > 0.05]
            words += [r.choice(["copyright", "the", "software", "of", "zu", "1999"]) for _ in range(between)]
        hits = [h for h in KNOWN.found(" ".join(words)) if h[0] == name]
        assert len(hits) == 3
        assert all(p - between <= h[2] <= p + len(KNOWN.words[name]) // 2 for p, h in zip(places, hits, strict=True))

"""The licence classifier against a plain version, on licences it was never told of, and on held-out wordings."""

import numpy as np
import pytest

from fleetlens.llm import licences as L

LINES = ["plain words that name nothing in particular here", "der Text ist nur ein Beispiel ohne weiteren Inhalt"] * 20


@pytest.fixture(scope="module")
def model():
    return L.train(LINES)


def plain_probabilities(model, tokens):
    counts = L.grams(tokens)
    z = model.bias + sum((n * model.weights[model.grams[g]] for g, n in counts.items() if g in model.grams), np.zeros(len(model.bias)))
    e = np.exp(z / model.temperature - (z / model.temperature).max())
    return e / e.sum()


def test_sliding_parts_equal_a_plain_classifier(model):
    rng = np.random.default_rng(1)
    notices = [w for ts in L.TEMPLATES.values() for t in ts for w in L.words(t)]
    for _ in range(60):
        n = int(rng.integers(1, 150))
        at = int(rng.integers(0, len(notices)))
        tokens = [w if rng.random() < 0.9 else "filler" for w in (notices * 2)[at : at + n]]
        features = model.features(tokens)
        if not features[0]:
            continue
        part = int(rng.choice(L.PARTS))
        starts, p = model.predictions(features, part)
        known = {i for i in range(len(tokens) - 1) if " ".join(tokens[i : i + 2]) in model.grams}
        assert starts.tolist() == sorted(known)
        for s, got in zip(starts.tolist(), p):
            assert np.allclose(got, plain_probabilities(model, tokens[s : s + part]), atol=1e-5)


def test_parts_without_a_known_pair_are_unknown(model):
    assert plain_probabilities(model, []).argmax() == len(model.families)


@pytest.mark.parametrize("text", [
    "Apache License Version 1.1", "SPDX-License-Identifier: Sleepycat", "SPDX-License-Identifier: Ruby", "Intel Open Source License", "Nokia Public License Version 1.0",
    "W3C Software Notice and License", "X11 License", "Ricoh Source Code Public License", "Licensed under the Perl Artistic License", "This is not licensed under the MIT License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears",
    "The general public may read the Mozilla newsletter", "Redistribution of income and the use of public funds", "A free license to drive was granted to any person",
])
def test_other_licences_and_prose_are_unknown(model, text):
    assert model.scan(text)[0] == L.UNKNOWN


@pytest.mark.parametrize("family, text", [
    ("epl", "Eclipse Public License 2.0"), ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"), ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("cc_by_nd", "Creative Commons Attribution-NoDerivatives 4.0 International"), ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3"), ("lgpl", "Licensed under the LGPL v3."),
    ("apache", "you may choose: Licensed under the Apache License, Version 2.0 as said"), ("mit", "The code is released under the MIT License."),
])
def test_families_by_name(model, family, text):
    assert model.scan(text)[0] == family
    assert model.scan("some words before it " + text + " and some words behind it")[0] == family


def test_held_out_variants(model):
    rng = np.random.default_rng(7)
    filler = [w for p in LINES for w in L.words(p)]
    tried = [(f, model.scan(v)[0]) for f, ts in L.TEMPLATES.items() for t in ts for v in L.variants(rng, t, filler, 5)]
    assert sum(a == b for a, b in tried) >= 0.9 * len(tried)
    assert sum(b not in (a, L.UNKNOWN) for a, b in tried) <= 0.03 * len(tried)

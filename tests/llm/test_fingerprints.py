import hashlib
import random

import numpy as np
import pytest

from bindery.llm import fingerprints
from bindery.llm.fingerprints import (
    CLASSES, OCTAVES, PERIOD, SAMPLES, WALKS, Embedder, close_pairs, edit_fingerprints, likeness,
)

from .cases import frame, no_documents, odd_documents, odd_rows, prose

EMBED = Embedder()


def step_by_step(text):
    """The fingerprint from walks that take every step and toss every bit."""
    emitted = []
    for walk in range(WALKS):
        bits = np.random.default_rng(7_001 + walk).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        out, j = [], 0
        for c in text:
            mixed = ord(c) * 2654435761 % 2**32
            while True:
                out.append(f"{(mixed >> 15) % 15:x}")
                j += 1
                if bits[mixed >> 27, (j - 1) % PERIOD]:
                    break
        emitted.append(out)
    top = max(map(len, emitted)).bit_length() - 1
    digits = [f"{top + 1:02x}"]
    for out in emitted:
        for k in range(top - OCTAVES + 1, top + 1):
            for p in EMBED.positions[k] if k >= 0 else [0] * SAMPLES:
                digits.append(out[p] if k >= 0 and p < len(out) else "f")
    return "".join(digits)


def test_lookup_walk_is_the_stepwise_walk():
    for text in ("", "a", "ab", "école 日本", prose(1, 40), "x" * 500):
        assert EMBED.of(text) == step_by_step(text)


def test_few_edits_stay_near_and_other_texts_far():
    rng, near, far = random.Random(4), [], []
    for i in range(40):
        text = prose(i, 150, 10**6)
        edited = list(text)
        for _ in range(5):
            p = rng.randrange(len(edited))
            edited[p:p + rng.randrange(2)] = rng.choice("abcdef ")
        near.append(likeness(EMBED.of(text), EMBED.of("".join(edited))))
        far.append(likeness(EMBED.of(text), EMBED.of(prose(1000 + i, 150, 10**6)[::-1])))
    assert np.median(near) > 0.7 > 0.35 > np.quantile(far, 0.95)


def test_rows_are_those_of_a_plain_loop(spark):
    rows = [(i * 3, prose(i, i % 37)) for i in range(150)]
    got = {r["doc_id"]: tuple(r)[1:] for r in edit_fingerprints(frame(spark, rows[::-1])).collect()}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[:len(text) - k] + after[:k]
        own, changed = EMBED.of(text), EMBED.of(edited)
        assert got[doc_id] == (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
            likeness(own, changed), likeness(own, EMBED.of(after)),
        )


def test_odd_rows(spark):
    rows = edit_fingerprints(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert edit_fingerprints(no_documents(spark)).collect() == []
    one = edit_fingerprints(frame(spark, [(None, "only one")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    empty = [r for r in rows if r["n_chars"] == 0]
    assert len({r["fingerprint"] for r in empty}) == 1


def test_bands_find_edited_copies(spark):
    rows = [(i, prose(i, 60, 10**6)) for i in range(30)]
    rows += [(100 + i, t[:200] + "zz" + t[202:]) for i, t in rows[:10]] + [(None, "x"), (500, None)]
    df = frame(spark, rows)
    got = {(r["a"], r["b"]): r["edits"] for r in close_pairs(edit_fingerprints(df), df, most_edits=10).collect()}
    assert set(got) <= {(i, 100 + i) for i in range(10)} and len(got) >= 9 and set(got.values()) <= {1, 2}


@pytest.mark.parametrize("block", [1, 256])
def test_a_stranger_in_front_of_a_band_hides_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BAND_BLOCK", block)
    text = prose(5, 60, 10**6)
    texts = [(0, prose(6, 60, 10**6)), (1, text), (2, text[:200] + "z" + text[201:]), (3, text)]
    prints = [(0, EMBED.of(text))] + [(i, EMBED.of(t)) for i, t in texts[1:]]
    got = close_pairs(frame(spark, prints, "doc_id bigint, fingerprint string"), frame(spark, texts), most_edits=10)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (1, 3, 0)]

"""Records of one gram: strings shared with a smaller id, bounds, borders of ranges."""

import numpy as np
import pytest

from squelch.llm import suffix_dedup as sd


def group_of(seed, n):
    """Records with one gram and few letters, so that many share strings in part."""
    rng = np.random.default_rng(seed)
    gram = b"g" * sd.GRAM
    made = set()
    while len(made) < n:
        behind = int(rng.integers(sd.GRAM, sd.LENGTH + 1))
        size = int(rng.integers(max(sd.LENGTH - behind, 0), sd.BEFORE + 1))
        tail = bytes(rng.choice([97, 97, 97, 97, 98], behind - sd.GRAM).astype(np.uint8))
        front = bytes(rng.choice([99, 99, 99, 99, 100], size).astype(np.uint8))
        made.add((gram + tail).ljust(sd.LENGTH, b"\0") + front.ljust(sd.BEFORE, b"\0") + bytes([behind, size]))
    records = sorted(made)
    common = [0] + [sd._same_bytes(a, b) for a, b in zip(records[:-1], records[1:], strict=True)]
    ids = rng.integers(0, n // 2 + 1, n).tolist()
    return [(r, [(i, 0, 0)], c) for r, i, c in zip(records, ids, common, strict=True)]


def plain(group):
    strings = [(places[0][0], r[-1], sd._text(r)) for r, places, _ in group]
    least = {}
    for i, size, text in strings:
        for d in range(len(text) - sd.LENGTH + 1):
            key = (size - d, text[d : d + sd.LENGTH])
            least[key] = min(least.get(key, i), i)
    out = {}
    for at, (i, size, text) in enumerate(strings):
        gone = [d for d in range(len(text) - sd.LENGTH + 1) if least[size - d, text[d : d + sd.LENGTH]] < i]
        if gone:
            out[at] = (gone[0], gone[-1])
    return out


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("arrays_from", [2, 10_000])
def test_shared_strings_equal_brute_force(monkeypatch, seed, arrays_from):
    monkeypatch.setattr(sd, "ARRAY_RECORDS", arrays_from)
    group = group_of(seed, 2 + 3 * seed)
    assert {at: (low, high) for at, low, high in sd._shared_strings(group)} == plain(group)


def test_grams_too_different_are_left_at_once(monkeypatch):
    monkeypatch.setattr(sd, "_text", None)
    gram = b"g" * sd.GRAM
    a = (gram + b"a" * 30) + b"c" * 30 + bytes([50, 30])
    b = (gram + b"b" * 30) + b"d" * 30 + bytes([50, 30])
    assert list(sd._shared_strings([(a, [(1, 0, 0)], 0), (b, [(2, 0, 0)], 20)])) == []


def test_borders_split_only_grams_that_were_picked_twice():
    one, two, three = (c * sd.GRAM for c in (b"a", b"b", b"c"))
    records = {one + b"x" * 62, two + b"x" * 62, two + b"y" * 62, three + b"z" * 62}
    assert sd._borders(records) == [one, two, two + b"x" * 62, two + b"y" * 62, three]


@pytest.mark.parametrize("open_side", ["opens", "closes", None])
def test_a_gram_over_the_border_goes_to_the_join(open_side):
    group = group_of(3, 6)
    runs = [iter([(c, r, places) for r, places, c in group])]
    batches = list(sd._merge_range(runs, **({open_side: True} if open_side else {})))
    strings = sum(b.num_rows - b.column(3).null_count for b in batches)
    whole = sum(len(sd._text(r)) - sd.LENGTH + 1 for r, _, _ in group)
    assert strings == (whole if open_side else 0)


def test_more_records_than_fit_go_to_the_join(monkeypatch):
    monkeypatch.setattr(sd, "GROUP_RECORDS", 4)
    group = group_of(4, 9)
    batches = list(sd._merge_range([iter([(c, r, places) for r, places, c in group])]))
    strings = sum(b.num_rows - b.column(3).null_count for b in batches)
    assert strings == sum(len(sd._text(r)) - sd.LENGTH + 1 for r, _, _ in group)

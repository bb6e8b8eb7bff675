"""Benchmark phrases as arrays: occurrences against brute force, and what a block holds."""

import pickle
import random

import numpy as np

from quarry.llm import fm_decontam as fm


def brute(text, items, window):
    words, hit, names = text.split(), set(), set()
    for name, item in items:
        own = (item or "").encode().split()
        for at in range(max(1, len(own) - window + 1) if own else 0):
            win = own[at:at + window]
            for k in range(len(words) - len(win) + 1):
                if words[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    names.add(name)
    return len(words), hit, sorted(names)


def test_find_equals_brute_force_with_short_null_and_repeated_items():
    r = random.Random(5)
    for _ in range(150):
        items = [(str(r.randrange(6)), None if r.random() < 0.1 else " ".join(r.choices("abc", k=r.randrange(9))))
                 for _ in range(r.randrange(6))]
        texts = [" ".join(r.choices("abcd", k=r.randrange(30))).encode() for _ in range(4)]
        for text, (n, spans, names) in zip(texts, fm.find(texts, fm.Phrases(items, 4))):
            assert (n, {w for x, y in spans for w in range(x, y)}, names) == brute(text, items, 4)


def test_window_numbers_tell_exactly_equal_windows():
    flat = np.random.default_rng(2).integers(1, 3, 400).astype(np.int32)
    for n in (1, 2, 3, 7, 13):
        number = fm.window_numbers(flat, n)
        windows = [tuple(flat[k:k + n]) for k in range(len(flat) - n + 1)]
        assert len(number) == len(windows)
        assert len(set(number.tolist())) == len(set(windows)) == len(set(zip(number.tolist(), windows)))


def test_a_block_holds_a_few_times_its_text():
    r = np.random.default_rng(1)
    items = [(str(k), " ".join(f"w{i}" for i in r.zipf(1.2, 400) % 20000)) for k in range(1000)]
    text = sum(len(t) for _, t in items)
    assert len(pickle.dumps(fm.Phrases(items), 5)) < 10 * text

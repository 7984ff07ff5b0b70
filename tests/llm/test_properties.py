"""Properties that hold for any text."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import language, leaks, markup, near_duplicates, packing, privacy, stuffing

PIECES = ["<b>", "</b>", "<p", "&amp;", "&#", "**", "__x__", "`", "```\n", "[[", "]]", "{{", "}}", "'''", "== T ==", "$x^2$", "\\begin{a}", "\\item ", "\\\\", "\n", " ", "Wort", "ä", "Frau ", "Anna ", "044 123 45 67", "a@b.example", "756.1234.5678.97", "#tag", " | ", "http://x.example/1", "­", "\x00", "", "😀", "12", "."]
texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_markup_never_fails_and_leaves_no_marks(text):
    families, clean, parts = markup.convert(text)
    assert set(families) <= set(markup.FAMILIES) and not markup._PRIVATE.search(clean)
    assert not any(markup._PRIVATE.search(p) for _, p in parts)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_findings_never_overlap(text):
    found = privacy.find(text, {"Anna": 3.0}, {})
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:])) and all(0 <= a < b <= len(text) for _, a, b in found)
    assert privacy.redact(text, []) == text


@settings(max_examples=100, deadline=None)
@given(texts)
def test_shares_and_languages(text):
    assert 0.0 <= stuffing.stuffed_share(text) <= 1.0
    assert isinstance(language.units(text), list)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_never_overflows(sizes):
    got = packing.best_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    fill = np.bincount(got, weights=sizes) if sizes else np.array([0])
    assert fill.max() <= 50 and (not sizes or sorted(set(got.tolist())) == list(range(len(fill))))
    # of two containers together more than one capacity is filled, save for the last
    assert all(a + b > 50 for a, b in zip(fill, fill[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), min_size=3, max_size=12))
def test_leaks_equal_brute_force(doc, item):
    scanner = leaks.LeakScanner([(1, " ".join(item))], min_words=3)
    grams = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
    want = any(tuple(doc[i : i + 3]) in grams for i in range(len(doc) - 2))
    assert bool(scanner.scan(" ".join(doc))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=50), st.integers(1, 5))
def test_shingles_are_sorted_sets(words, size):
    s = near_duplicates.shingle_hashes(np.array(words, dtype=np.uint64), size)
    assert len(s) and (np.diff(s.astype(object)) > 0).all()

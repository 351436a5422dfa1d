"""The fast patterns find what the full one does; whole texts keep to them."""

import re

from textguard.operators import semantic


def test_fast_segments_are_the_same():
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for text in ("".join(every[:128]), " ".join(every), "".join(f"a{c}1" for c in every), "x\U00020000y \U0001f600", ""):
        full = [m.span() for m in semantic._SEGMENT.finditer(text)]
        assert [m.span() for m in semantic.segment_pattern(text).finditer(text)] == full


def test_usual_texts_meet_the_standard_engine():
    assert isinstance(semantic.segment_pattern("plain words"), re.Pattern)
    assert isinstance(semantic.segment_pattern("Straße 日本"), re.Pattern)


def test_pieces_as_arrays_and_lists():
    pieces = semantic.WordPieces({"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "##a": 4, "e": 5})
    assert pieces("unaffable É unx") == ([1, 2, 3, 5, 0], [0, 0, 0, 10, 12], [9, 9, 9, 11, 15])
    assert [x.tolist() for x in pieces.arrays("unaffable")] == [[1, 2, 3], [0, 0, 0], [9, 9, 9]]
    assert pieces(None) == ([], [], [])

"""License statements that near-equal templates, line lengths, wrapping and neighbours must not hide."""

import textwrap

from weftline.llm.license_scan import TEMPLATES, Scanner


def test_near_equal_templates_hide_none():
    """Five GNU templates save more of this line than its own template does."""
    assert [r[2] for r in Scanner().scan("This work is licensed under a CC BY-ND 4.0 license.")] == ["CC-BY-ND-4.0"]
    for name, (text, _) in TEMPLATES.items():
        assert [(r[2], r[4], r[5]) for r in Scanner().scan(text)] == [(name, [], [])]


def test_statements_inside_prose_lines():
    lead = "The tables of this folder were put together by many hands over the course of several long winters and "
    for name in ("Apache-2.0", "CC-BY-4.0", "MIT"):
        for text in (f"{lead}checked twice. {TEMPLATES[name][0]} Write to us.", f"{lead}are {TEMPLATES[name][0]}"):
            (row,) = Scanner().scan(text)
            assert row[2] == name and not row[4] and TEMPLATES[name][0].rstrip(".") in text[row[0] : row[1]]
    assert Scanner().scan(lead + "licensed drivers may ask for permission under the rules of the road.") == []


def test_wrapped_notices():
    for name, (text, _) in TEMPLATES.items():
        for width in (20, 40, 80):
            wrapped = "\n".join(" * " + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
            assert [(r[2], r[4], r[5]) for r in Scanner().scan(f"# file.c\n{wrapped}\n\nint main")] == [(name, [], [])]


def test_what_a_match_leaves_is_scanned():
    names = list(TEMPLATES)
    for sep in (" ", "\n"):
        assert [r[2] for r in Scanner().scan(sep.join(t for t, _ in TEMPLATES.values()))] == names
    both = "Licensed under CC BY 4.0 and released under the MIT License, as you like."
    assert [r[2] for r in Scanner().scan(both)] == ["CC-BY-4.0", "MIT"]

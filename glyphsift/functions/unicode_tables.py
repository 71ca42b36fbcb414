"""Character classes as explicit code-point ranges.

The JVM, the database used as an oracle and Python know different Unicode
versions, so no property class is used: the ranges are computed from
``unicodedata`` and written as ``\\x{..}-\\x{..}``, which both regex dialects read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache


def ranges(keep: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Maximal runs of code points (surrogates aside) that ``keep`` accepts."""
    out: list[tuple[int, int]] = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or not keep(chr(cp)):
            continue
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def body(spans: list[tuple[int, int]]) -> str:
    """The inside of a regex character class."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def of(*points: int | tuple[int, int]) -> str:
    return body([p if isinstance(p, tuple) else (p, p) for p in points])


def spans_of(cls: str) -> list[tuple[int, int]]:
    """The ranges of a class's inside, as they were written."""
    return [(int(a, 16), int(b or a, 16)) for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", cls)]


def others(cls: str) -> str:
    """The characters outside a class, as ranges: the JVM takes some twenty times as long over a negated class of many ranges."""
    out, at = [], 0
    for a, b in sorted(spans_of(cls)):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return body(out + [(at, sys.maxunicode)] * (at <= sys.maxunicode))


def quick(cls: str) -> str:
    """The same class, asked about its ranges above ASCII only for characters above ASCII."""
    spans = spans_of(cls)
    low, high = [(a, min(b, 0x7F)) for a, b in spans if a < 0x80], [(max(a, 0x80), b) for a, b in spans if b >= 0x80]
    return f"{body(low)}[{of((0x80, sys.maxunicode))}&&[{body(high)}]]"


# Character sets of the detectors.
EMOJI = of((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF), 0x2764, 0x2B50, 0x2705)
RTL = of((0x0590, 0x05FF), (0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
SELECTORS = of((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
TAGS = of((0xE0000, 0xE007F))
JOINERS = of(0x200C, 0x200D)
MARKS = of(0x200E, 0x200F, 0x061C)
BIDI = of(0x202D, 0x202E)
SPACES = of(0xA0, 0x2007, 0x202F, (0x2000, 0x200A))
SPACES_BOM = of(0xA0, 0x2007, 0x202F, (0x2000, 0x200A), 0xFEFF)
#: Python's str.isspace.
PY_SPACE = of((0x09, 0x0D), (0x1C, 0x20), 0x85, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: All else.
NOT_SPACE = others(PY_SPACE)
SCRIPTS = ["LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "HANGUL", "CJK", "HIRAGANA", "KATAKANA", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "ARMENIAN", "GEORGIAN"]
SHAPING = ["ARABIC", "DEVANAGARI", "BENGALI", "TAMIL"]
ALLOWED = [["CJK", "HIRAGANA", "KATAKANA", "LATIN"], ["CJK", "HANGUL", "LATIN"]]
#: Look-alikes of Latin letters.
CONFUSABLES = {
    0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0445: "x", 0x0443: "y", 0x0456: "i", 0x0458: "j",
    0x0421: "C", 0x041E: "O", 0x0420: "P", 0x0425: "X", 0x0410: "A", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x0422: "T", 0x0412: "B",
    0x039F: "O", 0x03A1: "P", 0x03A7: "X", 0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x03A4: "T", 0x03A5: "Y",
    0x03BF: "o", 0x03C1: "p", 0x03BD: "v", 0x0131: "i",
}


@cache
def script_ranges() -> dict[str, list[tuple[int, int]]]:
    """Ranges of each script, by the first of SCRIPTS that begins the character's name; ASCII letters are Latin, other ASCII has none."""
    found: dict[str, list[tuple[int, int]]] = {s: [] for s in SCRIPTS}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if cp < 0x80:
            script = "LATIN" if ch.isalpha() else None
        else:
            name = unicodedata.name(ch, "")
            script = next((s for s in SCRIPTS if name.startswith(s)), None)
        if script:
            spans = found[script]
            if spans and spans[-1][1] == cp - 1:
                spans[-1] = (spans[-1][0], cp)
            else:
                spans.append((cp, cp))
    return found


@cache
def script(name: str) -> str:
    return body(script_ranges()[name])


@cache
def not_latin() -> str:
    """Characters of any script but Latin."""
    return "".join(script(s) for s in SCRIPTS if s != "LATIN")


@cache
def shaping() -> str:
    return "".join(script(s) for s in SHAPING)


@cache
def format_chars() -> str:
    """Category Cf without the tags block."""
    return body(ranges(lambda c: unicodedata.category(c) == "Cf" and not 0xE0000 <= ord(c) <= 0xE007F))


@cache
def plain_format() -> str:
    """Format characters that no context clears: without joiners, directional marks and the byte-order mark."""
    special = {0x200C, 0x200D, 0x200E, 0x200F, 0x061C, 0xFEFF}
    return body(ranges(lambda c: unicodedata.category(c) == "Cf" and not 0xE0000 <= ord(c) <= 0xE007F and ord(c) not in special))


@cache
def word_chars() -> str:
    """Python's \\w."""
    return body(ranges(lambda c: c == "_" or c.isalnum()))

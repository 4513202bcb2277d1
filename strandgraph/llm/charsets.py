"""Character classes of Unicode's letter, number and white-space properties for the standard re module.

re has no \\p{L}; for code points up to U+024F and general punctuation the classes are written out, and texts with any
other character take the slower path of the tokenizers library itself.
"""

from __future__ import annotations

import re
import unicodedata

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _members(kind: str) -> str:
    """The characters up to U+02AF whose general category starts with kind, as ranges of a character class."""
    out, run = [], []
    for c in [*range(0x2B0), None]:
        if c is not None and unicodedata.category(chr(c))[0] == kind:
            run.append(c)
        elif run:
            out.append(chr(run[0]) + ("-" + chr(run[-1]) if len(run) > 1 else ""))
            run = []
    return "".join(out)


LETTERS, NUMBERS = _members("L"), _members("N")
#: Texts without these characters need no other tables. U+0130, U+023A and U+023E lower-case beyond them.
OUTSIDE = re.compile(r"[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f\u2000-\u2064\u20ac]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100."""
    out = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE_OF = _byte_of()
CHAR_OF = {b: c for c, b in BYTE_OF.items()}

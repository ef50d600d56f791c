"""Characters that look like others, and what they stand for."""

from __future__ import annotations

import re
import unicodedata

# Capital and small letters of other scripts that look like a Latin letter.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲνα", "ABEZHIKMNOPTYXocva"))
GREEK.pop("ν"), GREEK.pop("α")
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеоѕіјрсухԁԛԝһ", "ABESIJKMHOPCTYXaeosijpcyxdqwh"))
LOOKALIKE = GREEK | CYRILLIC

# Characters that show nothing (Hangul fillers, zero-width characters, direction and format marks).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ︎️﻿ﾠ"

# Blanks other than U+0020.
BLANKS = "\t\n\x0b\x0c\r\x85                 　"


def styled() -> dict[str, str]:
    """Full-width and mathematical letters and digits, each with its ordinary form."""
    wide = [chr(c) for c in range(0xFF10, 0xFF5B)]
    maths = [chr(c) for c in range(0x1D400, 0x1D800)]
    out = {}
    for c in wide + maths:
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain != c and plain.isascii() and plain.isalnum():
            out[c] = plain
    return out


STYLED = styled()
_DROP = dict.fromkeys(map(ord, INVISIBLE)) | {ord(k): v for k, v in STYLED.items()} | {ord(c): " " for c in BLANKS}
_LOOK = {ord(k): v for k, v in LOOKALIKE.items()}
#: A run of letters that may be Latin or only look so.
RUN = re.compile("[A-Za-zÀ-ɏ" + "".join(LOOKALIKE) + "]+")
_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "]")


def _latin(m: re.Match) -> str:
    """A lone letter is a symbol of its own; next to Latin letters or other look-alikes it is a disguise."""
    run = m[0]
    return run.translate(_LOOK) if len(run) > 1 else run


def ordinary(text: str) -> str:
    """The ordinary form of text: the same letters as seen, composed, one blank between words, nothing invisible."""
    text = unicodedata.normalize("NFC", text.translate(_DROP))
    if _FOREIGN.search(text):
        text = RUN.sub(_latin, text)
    return " ".join(text.split())

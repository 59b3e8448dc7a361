"""Which code page a file's bytes are written in, told from pairs of bytes.

Every page has a weight for each pair of neighbouring characters that its
letters allow: letters of one script and case go together, a small letter is
not followed by a capital, and letters of two scripts do not share a word. The
weights follow from what the characters are, not from tables of counts. The
page whose pairs weigh most on average is the file's, if that is enough to be
text at all.
"""

from __future__ import annotations

import codecs
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are looked at.
HEAD_BYTES = 65_536
#: The page of files without any evidence, or with equal evidence for several.
DEFAULT = "windows-1256"
#: Stands for the page of bytes that are no text.
NO_TEXT = "none"
#: Least average weight of text.
LEAST = 0.15
#: Share of control bytes from which bytes are not text.
CONTROLS = 0.001
# Pages by their names here, to Python and to the JVM.
SINGLE_BYTE = {"windows-1256": "cp1256", "windows-1252": "cp1252", "windows-1251": "cp1251"}
DOUBLE_BYTE = {"gb18030": "gb18030", "shift_jis": "cp932"}
JVM_CHARSETS = {
    "windows-1256": "windows-1256",
    "windows-1252": "windows-1252",
    "windows-1251": "windows-1251",
    "gb18030": "GB18030",
    "shift_jis": "windows-31j",
}

# Kinds of characters; capitals follow their small letters.
_LATIN, _LATIN_CAP, _GUEST, _GUEST_CAP, _OWN, _OWN_CAP, _DIGIT, _GAP, _SIGN, _NONE = range(10)


def _kind(byte: int, codec: str) -> int:
    """Kind of a byte's character: ASCII letters, Latin letters above ASCII
    (guests), letters of the page's own script, digits, gaps, signs, nothing."""
    try:
        char = bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return _NONE
    category = unicodedata.category(char)
    if category[0] in "LM":
        latin = unicodedata.name(char, "").startswith("LATIN")
        cap = category == "Lu"
        return ((_LATIN if byte < 128 else _GUEST) if latin else _OWN) + cap
    if category == "Nd":
        return _DIGIT
    if category == "Cc" and char not in "\t\n\v\f\r":
        return _NONE
    return _SIGN if category[0] in "SN" and byte >= 128 else _GAP


@lru_cache(maxsize=None)
def _weights() -> np.ndarray:
    """Weight of every pair of kinds, first by second; only pairs with a byte above ASCII count."""
    w = np.zeros((10, 10))
    small, caps = (_LATIN, _GUEST), (_LATIN_CAP, _GUEST_CAP)
    for first, second in ((small, small), (caps, small), (caps, caps)):
        for a in first:
            for b in second:
                w[a, b] = 1.0
    for a in small:
        for b in caps:
            w[a, b] = -2.0
    w[_GUEST, _GUEST] = w[_GUEST_CAP, _GUEST] = w[_GUEST_CAP, _GUEST_CAP] = 0.3
    w[_OWN, _OWN] = w[_OWN_CAP, _OWN] = 1.0
    w[_OWN_CAP, _OWN_CAP], w[_OWN, _OWN_CAP] = 0.3, -2.0
    for a in (_OWN, _OWN_CAP):
        for b in (*small, *caps):
            w[a, b] = w[b, a] = -3.0
    letters = (*small, *caps, _OWN, _OWN_CAP)
    for a in letters:
        w[a, _GAP] = w[_GAP, a] = 0.5
        w[a, _DIGIT] = w[_DIGIT, a] = -0.5
        w[a, _SIGN] = w[_SIGN, a] = -2.0
    w[_SIGN, _SIGN] = -1.0
    w[_NONE, :] = w[:, _NONE] = -10.0
    return w


@lru_cache(maxsize=None)
def _kinds(codec: str) -> np.ndarray:
    return np.array([_kind(b, codec) for b in range(256)])


def _single_byte_weight(data: np.ndarray, page: str) -> float:
    kinds = _kinds(SINGLE_BYTE[page])[data]
    counted = (data[:-1] >= 128) | (data[1:] >= 128)
    found = _weights()[kinds[:-1][counted], kinds[1:][counted]]
    if page == DEFAULT:  # Latin words are guests in a page of another script
        latin = (kinds < _OWN)[:-1] & (kinds < _OWN)[1:]
        found = found - 0.1 * latin[counted]
    return float(found.mean()) if len(found) else 0.0


def _double_byte_weight(data: bytes, page: str) -> float:
    """Average over characters above ASCII; less than any text if some bytes are none."""
    try:
        text = codecs.getincrementaldecoder(DOUBLE_BYTE[page])().decode(data)
    except UnicodeDecodeError:
        return -10.0
    chars = [c for c in text if c > "\x7f"]
    if not chars:
        return 0.0
    encoded = [c.encode(DOUBLE_BYTE[page]) for c in chars]
    lead = np.array([x[0] for x in encoded])
    trail = np.array([x[1] if len(x) == 2 else 0 for x in encoded])
    if page == "gb18030":
        # Characters in frequent use, signs, rarer ones, and extensions.
        plain = trail >= 0xA1
        weight = np.select(
            [plain & (lead >= 0xB0) & (lead <= 0xD7), plain & (lead >= 0xA1) & (lead <= 0xA9), plain & (lead >= 0xD8)],
            [1.0, 0.3, 0.0],
            -1.0,
        )
    else:
        # Kana, characters in frequent use, signs, rarer ones, and half-width kana.
        kana = ((lead == 0x82) & (trail >= 0x9F)) | ((lead == 0x83) & (trail <= 0x96))
        weight = np.select(
            [trail == 0, kana, (lead >= 0x88) & (lead <= 0x97), lead == 0x81], [-0.5, 1.0, 0.8, 0.3], 0.0
        )
    return float(weight.mean())


def code_page(head: bytes) -> str | None:
    """The page of bytes that are not valid UTF-8, or None if they are no text.

    ``head`` is the beginning of a file; it may end inside a character.
    """
    head = head[:HEAD_BYTES]
    data = np.frombuffer(head, np.uint8)
    controls = (data < 32) & ~np.isin(data, (9, 10, 11, 12, 13)) | (data == 127)
    if controls.sum() > CONTROLS * len(data):
        return None
    if not (data >= 128).any():
        return DEFAULT
    found = {page: _single_byte_weight(data, page) for page in SINGLE_BYTE}
    found |= {page: _double_byte_weight(head, page) for page in DOUBLE_BYTE}
    best = max(found, key=found.get)  # the first of equals
    return best if found[best] >= LEAST else None


def pages_of(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The page of every head that is not null, or NO_TEXT."""
    for some in heads:
        yield some.map(lambda x: None if x is None else code_page(bytes(x)) or NO_TEXT)

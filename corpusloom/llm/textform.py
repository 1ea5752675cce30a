"""Consistent form, words and adjacent-word pairs of a text.

*Consistent form*: full-width forms and ligatures become plain characters,
accents are composed with their letter, characters without width disappear,
non-breaking spaces become plain spaces, and look-alike letters of other
alphabets become the Latin letters they resemble.  Case, visible accents,
punctuation and digits stay.  ``None`` stays ``None``; ``""`` stays ``""``.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Letters of the Cyrillic and Greek alphabets that look like a Latin letter.
LOOK_ALIKE = dict(
    zip(
        "аеѕіјорсухһԁԛԝѵ" "АВЕЅІЈКМНОРСТУХԌԚԜ" "αινορυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aesijopcyxhdqwv" "ABESIJKMHOPCTYXGQW" "aivopu" "ABEZHIKMNOPTYX",
    )
)
# Spaces that forbid a line break.
NO_BREAK_SPACES = "\u00a0\u2007\u202f"
# Characters without width that are not of category Cf.
WIDTHLESS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d"

_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_TOKEN = re.compile(r"[^\W_]+")
_COMBINING = re.compile("[̀-ͯ]")
# Anything outside ASCII, composed Latin letters and common typographic marks needs work.
_ODD = re.compile("[^\x00-\x7f\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20cf\u2100-\u214f]")
_TO_LATIN = str.maketrans(LOOK_ALIKE)


def _char_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): " " for c in NO_BREAK_SPACES}
    table |= {ord(c): None for c in WIDTHLESS}
    for block in (range(0x80, 0x3000), range(0xFE00, 0x10000), range(0xE0000, 0xE0080)):
        table |= {c: None for c in block if unicodedata.category(chr(c)) == "Cf"}
    table[0x3000] = " "
    for block in (range(0xFB00, 0xFB07), range(0xFF01, 0xFFEF)):
        for c in block:
            plain = unicodedata.normalize("NFKC", chr(c))
            if plain != chr(c):
                table[c] = plain
    return table


_CHARS = _char_table()


def basic_form(text: str) -> str:
    """The consistent form but for look-alike letters."""
    if text.isascii() or not _ODD.search(text):
        return text
    text = text.translate(_CHARS)
    return unicodedata.normalize("NFC", text) if _COMBINING.search(text) else text


def repaired_token(token: str) -> str:
    """Token with look-alikes replaced, if every foreign letter in it has one.

    A word of another alphabet (one that holds letters without a Latin twin)
    stays as it is.
    """
    foreign = _FOREIGN.findall(token)
    return token.translate(_TO_LATIN) if foreign and all(c in LOOK_ALIKE for c in foreign) else token


def consistent_form(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    text = basic_form(text)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: repaired_token(m.group()), text))
    return text


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the consistent form, in lower case."""
    return _TOKEN.findall(consistent_form(text).lower()) if text else []


_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _word_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(c).isalnum() for c in range(0x30000)), bool, 0x30000)
    return _tables["letter"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "power" not in _tables or len(_tables["power"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["power"], _tables["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str | None], block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, and the offset at which each text starts.

    Works on blocks of about ``block`` characters with array operations only;
    the same words as :func:`words` gives.
    """
    hashes, counts, some, chars = [], [], [], 0
    for k, text in enumerate(texts):
        some.append(consistent_form(text).lower() if text else "")
        chars += len(some[-1])
        if chars >= block or k == len(texts) - 1:
            h, c = _hashed_block(some)
            hashes.append(h)
            counts.append(c)
            some, chars = [], 0
    all_counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(all_counts)])


def _hashed_block(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(some) + "\n"
    if joined.isascii():
        codes = np.frombuffer(joined.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _word_letter()[codes if codes.itemsize == 1 else np.minimum(codes, 0x2FFFF)]
    edges = np.diff(letter.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _powers(len(codes) + 1)
    sums = np.cumsum(codes * power[: len(codes)], dtype=np.uint64)
    value = (sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * inverse[starts]
    lengths = np.fromiter(map(len, some), np.int64, len(some)) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return mix(value + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, bounds))


PAIR_BITS = 48


def pair_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """48-bit hash of each pair of adjacent words, in order (not distinct)."""
    if len(word_hashes) < 2:
        return np.empty(0, np.uint64)
    a, b = word_hashes[:-1], word_hashes[1:]
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))) >> np.uint64(64 - PAIR_BITS)


def hashed_pairs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the adjacent word pairs of many texts, and the number of each one's text."""
    return pairs_of_words(*hashed_words(texts))


def pairs_of_words(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the adjacent pairs of hashed words, and the number of each one's text."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    pairs = pair_hashes(h)
    same = owner[:-1] == owner[1:]
    return pairs[same], owner[:-1][same]


def distinct_pairs(texts: list[str | None], owner_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, pair hash), sorted by owner, then hash; an owner may hold several texts."""
    pairs, owner = hashed_pairs(texts)
    return distinct_of(pairs, owner if owner_of is None else owner_of[owner])


def distinct_of(pairs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, pair hash), sorted by owner, then hash."""
    found_pairs, found_owner = [], []
    part = owner >> 16  # 16 bits of the key hold the owner
    for k in np.unique(part) if len(part) else ():
        here = part == k
        key = np.sort(((owner[here] & 0xFFFF).astype(np.uint64) << np.uint64(PAIR_BITS)) | pairs[here])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        found_pairs.append(key & np.uint64((1 << PAIR_BITS) - 1))
        found_owner.append((key >> np.uint64(PAIR_BITS)).astype(np.int64) + (int(k) << 16))
    if not found_pairs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found_pairs), np.concatenate(found_owner)

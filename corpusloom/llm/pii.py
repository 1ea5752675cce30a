"""Personal information in free text: a chain model over word shapes, decoded in batches."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import pii_labels as table
from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.crf import Chain
from corpusloom.llm.textform import consistent_form
from corpusloom.plans.stages import checkpointed

LABELS = ["O", "G", "X", "F", "R", "Eb", "Ei", "Pb", "Pi", "Ib", "Ii", "Ab", "Ai"]
KIND = {"E": "email", "P": "phone", "I": "id", "A": "address"}
NAMES_MOST = 100_000  # given names that the workers are sent
FAMILIES = 5  # family names beside which an unlisted given name must stand
FILLS = 9  # sentences made of each labelled line

_PIECE = re.compile(r"[ \t]*(?:[^\W\d_]+(?:-[^\W\d_]+)*|\d+|[^\w\s]|_)|[ \t]*[^\S \t]+|[ \t]+$|[ \t]+")
_STREETS = {w.lower().rstrip(".") for w in (*table.STREETS_EN, "rue", "avenue", "av", "boulevard", "boul", "chemin", "place", "allée", "route", "rang", "côte")}
_FRENCH_STREETS = {"rue", "avenue", "av", "boulevard", "boul", "chemin", "place", "allée", "route", "rang", "côte"}
_AT, _DOT = {"at", "arobase", "@"}, {"dot", "point"}
_LITERAL = {w.lower() for line in table.SENTENCES.split("\n") for w in re.findall(r"[^\W\d_]+", re.sub(r"[{<]\w[}>]", " ", line))}
_LITERAL |= _STREETS | _AT | _DOT | {w.lower() for b in table.BODY_AFTER for w in b.split()} | {w.lower() for w in (*table.MONTHS, *table.FIRST)} | {w.strip().lower() for w in table.PLACE_AFTER if w} | {w for e in (*table.ENDINGS, "com", "org", "net") for w in e.split(".")}

LOW, HIGH, DIGITS, POINT, BREAK = range(5)


def pieces(text: str) -> list[str]:
    """Words, numbers, signs and line breaks, each with the blanks before it; joined they are the text."""
    return _PIECE.findall(text)


def features(piece: str, given: frozenset[str] | set[str]) -> list[str]:
    """Shape, lexicon and literal features of one piece."""
    core = piece.strip(" \t")
    out = ["bias", "sp" if piece[:1] in " \t" else "touch"]
    if not core or core.isspace():
        return [*out, "break"]
    low = core.lower()
    if core[0].isdigit():
        long = [f"long{len(core)}", f"bare{len(core)}"] if 9 <= len(core) <= 11 else []
        return [*out, f"d{min(len(core), 12)}", "digits", *long]
    if not core[0].isalpha():
        return [*out, f"p={core}"]
    if low in _LITERAL:
        out.append(f"w={low}")
    if low.rstrip(".") in _STREETS:
        out.append("street")
    parts = core.split("-")
    if len(core) == 1 and core.isupper():
        shape = "initial"
    elif core.islower():
        shape = "low"
    elif core.isupper():
        shape = "upper"
    elif all(p[:1].isupper() for p in parts):
        shape = "cap"
    else:
        shape = "mixed"
    out.append(shape)
    if len(parts) > 1:
        out.append(f"{shape}-")
    if shape in ("cap", "upper") and all(p.lower() in given for p in parts):
        out.append("given")
    if shape in ("cap", "upper", "mixed"):
        out += [f"s3={low[-3:]}", f"s2={low[-2:]}"]
    return out


def character(piece: str) -> tuple[int, bool, bool, bool, bool, int]:
    """(class, preceded by blanks, at, dot, street, length)."""
    core = piece.strip(" \t")
    low = core.lower()
    if not core or core.isspace():
        kind = BREAK
    elif core[0].isdigit():
        kind = DIGITS
    elif core[0].isalpha():
        kind = LOW if core.islower() else HIGH
    else:
        kind = POINT
    return kind, piece[:1] in " \t", low in _AT, low in _DOT, low in _FRENCH_STREETS, len(core)


def stretches(traits: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches in which personal information can stand.

    Plain lower-case words bear label 0 unless they touch a sign of an address
    or stand next to a spelt-out one; such words end a stretch, and a stretch
    must hold two capitalised words, a number with company, a long number, or a sign of an email address.
    """
    kind, space, at, dot, street, length = traits.T
    shift = lambda x, k: np.concatenate([x[k:], np.zeros(k, x.dtype)]) if k > 0 else np.concatenate([np.zeros(-k, x.dtype), x[:k]])
    touch, word = space == 0, (kind == LOW) | (kind == HIGH) | (kind == DIGITS)
    glue = sign == 1  # @ + _ ( ) [ ] < > :
    point = sign == 2  # the full stop
    touch_next, glue_next, point_next = shift(touch, 1), shift(glue, 1), shift(point, 1)
    inner = point_next & touch_next & shift(touch & word, 2)
    spelt = (at | dot).astype(bool)
    soft_low = (
        (touch & (shift(glue, -1) | shift(point & touch, -1) | shift(word, -1)))
        | (touch_next & glue_next)
        | inner
        | (touch_next & shift(word, 1))
        | shift(spelt, -1)
        | shift(spelt, 1)
        | (glue_next & shift(spelt, 2))
        | (shift(glue, -1) & shift(spelt, -2))
        | spelt
        | shift(street.astype(bool), -1)
        | (shift(street.astype(bool), -2) & shift(point, -1))
        | street.astype(bool)
    )
    soft = np.where(kind == LOW, soft_low, kind != BREAK)
    edge = np.diff(np.concatenate([[False], soft, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    within = lambda x: total(x)[stop] - total(x)[start]
    n_high, n_digits = within(kind == HIGH), within(kind == DIGITS)
    good = (n_high >= 2) | ((n_digits >= 1) & (within(word) >= 2)) | (within((kind == DIGITS) & (length >= 9)) > 0) | (within(spelt) > 0)
    return start[good], stop[good] - start[good]


def sign_of(piece: str) -> int:
    core = piece.strip(" \t")
    return 2 if core == "." else int(core in ("@", "+", "_", "(", ")", "[", "]", "<", ">", ":"))


class Tagger:
    """The fitted chain with remembered scores of pieces it has seen."""

    def __init__(self, chain: Chain, given: frozenset[str], common: frozenset[str] = frozenset(), bound: int = 400_000):
        self.chain, self.given, self.common, self.bound = chain, given, common, bound
        self._reset()

    def _reset(self) -> None:
        size = len(self.chain.labels)
        self.number: dict[str, int] = {}
        self.scores = np.zeros((len(self.chain.offsets), 1 << 12, size), np.float32)
        self.traits = np.zeros((1 << 12, 6), np.int32)
        self.sign = np.zeros(1 << 12, np.int8)

    def _add(self, piece: str) -> int:
        k = len(self.number)
        if k == len(self.sign):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], 1)
            self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
            self.sign = np.concatenate([self.sign, np.zeros_like(self.sign)])
        self.number[piece] = k
        self.scores[:, k] = self.chain.rows(features(piece, self.given))
        self.traits[k] = character(piece)
        self.sign[k] = sign_of(piece)
        return k

    def numbers(self, found: list[str]) -> np.ndarray:
        if len(self.number) > self.bound:
            self._reset()
        known = self.number
        return np.array([known[p] if p in known else self._add(p) for p in found], np.int64)

    def tag(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, str, str]]]:
        """For each text its findings: (first piece, piece after the last, kind, value); and its pieces first."""
        found: list[str] = []
        bounds = []
        for t in texts:
            found += ["\n", "\n"]  # texts are apart
            bounds.append(len(found))
            found += pieces(t)
        found += ["\n", "\n"]
        ids = self.numbers(found)
        start, length = stretches(self.traits[ids], self.sign[ids])
        at = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        emit = np.zeros((len(at), len(self.chain.labels)), np.float32)
        for o, table_ in zip(self.chain.offsets, self.scores, strict=True):
            emit += table_[ids[np.clip(at + o, 0, len(ids) - 1)]]
        best = self.chain.viterbi(emit, np.cumsum(length) - length, length)
        labels = np.zeros(len(ids), np.int8)
        labels[at] = best
        some = np.flatnonzero(labels)
        cut = np.flatnonzero(np.diff(some) > 1)
        firsts, lasts = (some[np.concatenate([[0], cut + 1])], some[np.concatenate([cut, [len(some) - 1]])]) if len(some) else ([], [])
        per_text: list[list] = [[] for _ in texts]
        owner = np.searchsorted(bounds, firsts, "right") - 1
        for k, a, b in zip(owner, firsts, lasts, strict=True):
            for x, y, kind, value in spans(found, labels, int(a), int(b) + 1, self.common):
                per_text[k].append((x - bounds[k], y - bounds[k], kind, value))
        ends = [*(b - 2 for b in bounds[1:]), len(found) - 2]
        for k in range(len(texts)):
            yield found[bounds[k] : ends[k]], per_text[k]


def spans(found: list[str], labels: np.ndarray, a: int, b: int, common: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, str, str]]:
    """Findings among the pieces a..b, all of them labelled; each passes the exact check of its kind."""
    k = a
    while k < b:
        tag = LABELS[labels[k]]
        end = k + 1
        if tag[0] in "EPIA":
            inside = LABELS.index(tag[0] + "i")
            while end < b and labels[end] == inside:
                end += 1
            text = "".join(found[k:end])
            kind, value = KIND[tag[0]], CHECK[tag[0]](text)
            if not value and tag[0] != "E":  # how many digits there are decides between numbers
                kind, value = ("phone", phone(text)) if phone(text) else ("id", insurance_number(text))
        elif tag == "R":
            while end < b and LABELS[labels[end]] == "R":
                end += 1
            family = [p.strip() for p in found[k:end] if p.strip() != ","]
            g = end
            while end < b and LABELS[labels[end]] == "G":
                end += 1
            kind, value = "name", person([p.strip() for p in found[g:end]], family, common)
        elif tag == "G":
            while end < b and LABELS[labels[end]] == "G":
                end += 1
            given = found[k:end]
            while end < b and LABELS[labels[end]] == "X":
                end += 1
            f = end
            while end < b and LABELS[labels[end]] == "F":
                end += 1
            kind, value = "name", person([p.strip() for p in given], [p.strip() for p in found[f:end]], common)
        else:
            kind, value = "", None
        if value:
            yield k, end, kind, value
        k = end


def person(given: list[str], family: list[str], common: frozenset[str] = frozenset()) -> str | None:
    """Given name, then family name, in lower case; both must be there and be words that the corpus doesn't mostly write in lower case."""
    parts = [p.lower() for p in (*given, *family)]
    return " ".join(parts) if given and family and all(p.replace("-", "").isalpha() and p not in common for p in parts) else None


_EMAIL = re.compile(r"[a-z0-9][a-z0-9._+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)+")


def email(text: str) -> str | None:
    """The plain address, user@host, of however it is written."""
    s = text.strip().lower().strip("<>")
    s = re.sub(r"^mailto:", "", s)
    s = re.sub(r"\s*[\[(]\s*(?:@|at|arobase)\s*[\])]\s*|\s+(?:at|arobase)\s+", "@", s)
    s = re.sub(r"\s*[\[(]\s*(?:\.|dot|point)\s*[\])]\s*|\s+(?:dot|point)\s+", ".", s)
    m = _EMAIL.fullmatch(s.strip(" .;,()<>"))
    return m.group() if m else None


def phone(text: str) -> str | None:
    """The ten digits without country code; NULL if there aren't ten."""
    d = re.sub(r"\D", "", text)
    d = d[1:] if len(d) == 11 and d[0] == "1" else d
    return d if len(d) == 10 else None


def insurance_number(text: str) -> str | None:
    """The nine digits, if the check digit is right."""
    d = re.sub(r"\D", "", text)
    if len(d) != 9:
        return None
    doubled = (int(c) * (1 + k % 2) for k, c in enumerate(d))
    return d if sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0 else None


_PARTICLES = {"de", "du", "des", "d", "la", "le", "les", "l", "'", "’"}


def address(text: str) -> str | None:
    """House number to the end of street name and type, lower case, single spaces.

    An English address ends with the street type; a French one with the first
    word of the name that is no particle.
    """
    w = text.lower().split()
    if len(w) < 3 or not w[0][0].isdigit():
        return None
    if w[1].rstrip(".") in _FRENCH_STREETS and not (len(w) == 3 and w[2].strip(".,;:") in _STREETS):
        stop = next((k for k in range(2, len(w)) if w[k] not in _PARTICLES), None)
    else:
        stop = next((k for k in range(2, len(w)) if w[k].strip(".,;:") in _STREETS), None)
    return " ".join(w[: stop + 1]).rstrip(" .,;:") if stop else None


CHECK = {"E": email, "P": phone, "I": insurance_number, "A": address}


@lru_cache(maxsize=4)
def fitted(fills: int = FILLS) -> Chain:
    """The chain, fitted to the labelled table (``fills`` sentences per labelled line, the bound of its size)."""
    known = frozenset(g.lower() for k, g in enumerate(table.GIVEN) if k % 2)  # the list of given names is incomplete here, too
    xs, ys, r = [], [], random.Random(11)
    number = {name: k for k, name in enumerate(LABELS)}
    followers = np.zeros((len(LABELS), len(LABELS)), bool)
    followers[0, [number[x] for x in ("O", "G", "R", "Eb", "Pb", "Ib", "Ab")]] = True
    for a, after in {"G": "GXF", "X": "XF", "R": "RG", "F": "F"}.items():
        followers[number[a], [number[x] for x in after]] = True
    for last in ("G", "F"):
        followers[number[last]] |= followers[0]
    for c in "EPIA":
        for x in "bi":
            followers[number[c + x]] |= followers[0]
            followers[number[c + x], number[c + "i"]] = True
    for row in table.labelled_table(pieces, fills):
        found = ["\n", "\n", *(p for p, _ in row), "\n", "\n"]
        gold = [0, 0, *(number[label] for _, label in row), 0, 0]
        start, length = stretches(np.array([character(p) for p in found], np.int32), np.array([sign_of(p) for p in found]))
        # every other word hides its ending, so that unseen endings don't mislead
        names = [[f for f in features(p, known) if f[0] != "s" or f == "sp" or f == "street" or hide > 0.5] for p, hide in ((p, r.random()) for p in found)]
        for s, n in zip(start.tolist(), length.tolist(), strict=True):
            xs.append(names[s - 2 : s + n + 2])
            ys.append(gold[s : s + n])
    return Chain(LABELS).fit(xs, ys, followers)


def name_words(docs: DataFrame, names: DataFrame, name_column: str, families: int = FAMILIES) -> tuple[frozenset[str], frozenset[str]]:
    """Given names: the listed ones and those the chain finds before ``families`` different family names or more; and words that are no names.

    The list is incomplete, so a first pass over all documents completes it.
    What the chain takes for part of a name, but the corpus writes in lower case
    more often than with a capital, is no name.
    """
    listed = [r[0] for r in names.select(name_column).filter(f"{name_column} is not null").distinct().limit(NAMES_MOST + 1).collect()]
    known = frozenset(consistent_form(n).strip().lower() for n in _within(listed))

    def rows(keys, texts, tagged):
        count: Counter = Counter()
        seen = set()
        for found_pieces, found in tagged:
            count.update(found_pieces)
            seen.update(tuple(value.split(" ", 1)) for _, _, kind, value in found if kind == "name")
        each = [(part, family) for given, family in seen for part in given.split("-")]
        parts = sorted({w for value in seen for w in " ".join(value).split(" ")})
        times = lambda w: count[w] + count[" " + w]
        low = [times(w) for w in parts]
        high = [times(w.title()) + times(w.upper()) + times(w.capitalize()) * (w.capitalize() != w.title()) for w in parts]
        none, empty = pa.nulls(len(parts), pa.string()), pa.nulls(len(each), pa.string())
        return batch(
            given=pa.concat_arrays([pa.array([g for g, _ in each], pa.string()), none]), family=pa.concat_arrays([pa.array([f for _, f in each], pa.string()), none]),
            word=pa.concat_arrays([empty, pa.array(parts, pa.string())]), low=pa.array([0] * len(each) + low, pa.int64()), high=pa.array([0] * len(each) + high, pa.int64()))

    found = checkpointed(_tagged(docs, known, frozenset(), "given string, family string, word string, low long, high long", rows))
    common = found.filter("word is not null").groupBy("word").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter("low > high")
    common = frozenset(_within([r["word"] for r in common.limit(NAMES_MOST + 1).collect()]))
    often = found.filter("given is not null").groupBy("given").agg(F.countDistinct("family").alias("n")).filter(F.col("n") >= families)
    return known | frozenset(_within([r["given"] for r in often.limit(NAMES_MOST + 1).collect()])) - common, common


def _within(names: list[str]) -> list[str]:
    if len(names) > NAMES_MOST:
        raise ValueError(f"more than {NAMES_MOST} names")
    return names


def _tagged(docs: DataFrame, given: frozenset[str], common: frozenset[str], schema: str, rows) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((fitted(), given, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*sent.value)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [consistent_form(t) or "" for t in strings(b.column(1))]
            for k in _portions(texts):
                yield rows(keys[k], texts[k], tagger.tag(texts[k]))

    return docs.mapInArrow(run, schema)


def _portions(texts: list[str], most: int = 2_000_000) -> Iterable[slice]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def findings(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name_column: str = "given_name") -> DataFrame:
    """(doc_id, kind, value), distinct; kind is email, phone, id, address or name.

    The chain model labels words of the consistent form; what it marks must
    pass the exact check of its kind (ten digits, check digit, user@host ...).
    NULL and blank texts give no rows.
    """

    def rows(keys, texts, tagged):
        seen = {(k, kind, value) for k, (_, found) in zip(keys, tagged, strict=True) for _, _, kind, value in found}
        return batch(doc_id=pa.array([s[0] for s in seen], pa.int64()), kind=pa.array([s[1] for s in seen], pa.string()), value=pa.array([s[2] for s in seen], pa.string()))

    docs = documents.select(F.col(key).cast("long"), F.col(text)).filter(f"{key} is not null and {text} is not null")
    return _tagged(docs, *name_words(docs, names, name_column), "doc_id long, kind string, value string", rows).distinct()


def masked(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name_column: str = "given_name") -> DataFrame:
    """(doc_id, text, n_found): the consistent form with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] in place of findings.

    One row per input row with a key; a NULL text gives an empty one.
    """

    def rows(keys, texts, tagged):
        out, counts = [], []
        for found_pieces, found in tagged:
            new = list(found_pieces)
            for a, b, kind, _ in found:
                lead = new[a][: len(new[a]) - len(new[a].lstrip(" \t"))]
                new[a:b] = [f"{lead}[{kind.upper()}]", *[""] * (b - a - 1)]
            out.append("".join(new))
            counts.append(len(found))
        return batch(doc_id=pa.array(keys, pa.int64()), text=pa.array(out, pa.string()), n_found=pa.array(counts, pa.int64()))

    docs = documents.select(F.col(key).cast("long"), F.col(text)).filter(f"{key} is not null")
    return _tagged(docs, *name_words(docs, names, name_column), "doc_id long, text string, n_found long", rows)

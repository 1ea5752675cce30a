"""One consistent form for texts that look alike but differ in their characters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import batch, strings
from corpusloom.llm.textform import LOOK_ALIKE, basic_form, repaired_token
from corpusloom.plans.stages import checkpointed

# Letters that only roughly resemble a Latin one; a token is repaired with them only if that gives a word of the corpus.
ROUGHLY_ALIKE = dict(zip("вгикмнптεγηκμστωχ", "brukmnntynnkuotwx", strict=True)) | {"ε": "e", "γ": "y", "н": "h"}
_ANY_TWIN = str.maketrans(LOOK_ALIKE | ROUGHLY_ALIKE)
_TOKEN = re.compile(r"[^\W_]+")


def script(letter: str) -> str | None:
    """Latin, Greek, Cyrillic, other; None for what is no letter."""
    c = ord(letter)
    if not letter.isalpha():
        return None
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    if 0x370 <= c < 0x400:
        return "greek"
    return "cyrillic" if 0x400 <= c < 0x530 else "other"


def dominant_script(token: str) -> str | None:
    """The script of most letters; Latin wins a tie."""
    count = Counter(filter(None, map(script, token)))
    return max(count, key=lambda s: (count[s], s == "latin")) if count else None


def scripts(token: str) -> set[str]:
    return {s for s in map(script, token) if s}


def mixed_repaired(token: str) -> str:
    """A token of several scripts, Latin among them, with its sure look-alikes replaced; any other as it is."""
    return repaired_token(token) if not token.isascii() and "latin" in scripts(token) else token


def doubtful_tokens(form: str) -> list[str]:
    """Tokens that only the vocabulary can decide on: those that still mix scripts, and those of one foreign script made of look-alikes only."""
    out = []
    for t in _TOKEN.findall(form):
        if not t.isascii():
            kinds = scripts(t)
            if len(kinds) > 1 or (kinds and kinds <= {"greek", "cyrillic"} and repaired_token(t) != t):
                out.append(t)
    return out


def guess(token: str) -> str | None:
    """The token in Latin letters only, where each foreign letter has a sure twin or, in a token of several scripts, a rough one."""
    plain = token.translate(_ANY_TWIN) if len(scripts(token)) > 1 else repaired_token(token)
    return plain if dominant_script(plain) == "latin" and all(script(c) in (None, "latin") for c in plain) else None


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts, source = b.columns
        form = [unicodedata.normalize("NFC", _TOKEN.sub(lambda m: mixed_repaired(m.group()), basic_form(t))) if t and not t.isascii() else t for t in strings(texts)]
        yield batch(key=keys, source=source, form=pa.array(form, pa.string()), doubtful=pa.array([doubtful_tokens(f) if f and not f.isascii() else [] for f in form], pa.list_(pa.string())))


def _with_repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        source, form, repairs = b.columns
        out = []
        for f, r in zip(strings(form), repairs.to_pylist(), strict=True):
            known = {x["token"]: x["word"] for x in r or ()}
            out.append(_TOKEN.sub(lambda m, known=known: known.get(m.group(), m.group()), f) if known else f)
        yield batch(source=source, form=pa.array(out, pa.string()))


def _guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = strings(b.column(0))
        g = [(t, w) for t in tokens if (w := guess(t))]
        yield batch(token=pa.array([t for t, _ in g], pa.string()), word=pa.array([w for _, w in g], pa.string()))


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, form): every row's text in its consistent form, and the digest of the text as it was.

    Per token: full-width forms, ligatures, accents, widthless characters and
    non-breaking spaces are made plain.  A token of several scripts, Latin among
    them, is repaired where every foreign letter has a sure Latin twin.  All
    others are up to the vocabulary: a token that still mixes scripts is repaired with rough twins, and one
    of a foreign script that consists of look-alikes only with sure ones, if the
    result is Latin and a word of the corpus; else it stays, as real words of that script do.
    A NULL text gives a NULL form, an empty one an empty form.  Repeated rows
    stay; a key may come with several texts.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).select("key", "text", F.md5("text").alias("source"))
    forms = checkpointed(rows.mapInArrow(_forms, "key long, source string, form string, doubtful array<string>"))
    doubtful = forms.select(F.explode("doubtful").alias("token")).distinct().mapInArrow(_guesses, "token string, word string")
    vocabulary = forms.select(F.explode(F.split(F.lower("form"), r"[^\p{L}\p{N}]+")).alias("seen")).filter(F.col("seen").rlike("^[a-z0-9]+$")).distinct()
    sure = doubtful.join(vocabulary, F.lower("word") == F.col("seen"), "left_semi")
    at = forms.filter(F.size("doubtful") > 0).select("source", "form", F.explode("doubtful").alias("token")).distinct()
    repairs = at.join(sure, "token").groupBy("source", "form").agg(F.collect_list(F.struct("token", "word")).alias("repairs"))
    mended = repairs.mapInArrow(_with_repairs, "source string, form string").select("source", F.col("form").alias("mended"))
    return forms.select("key", "source", "form").join(mended, "source", "left").select("key", "source", F.coalesce("mended", "form").alias("form"))


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id_a, record_id_b), smaller first: texts differ, consistent forms are equal.

    Records are first put into classes of equal text; classes of one form are
    paired, and only then the members joined in, so many copies of one text
    are never paired with one another.  NULL and blank texts are no cases.
    """
    texts = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text)).distinct()
    forms = consistent_texts(texts, key, text).filter(F.col("form").rlike(r"\S"))
    members = checkpointed(forms.select("key", F.md5("form").alias("form"), F.col("source").alias("text")).distinct())
    classes = members.select("form", "text").distinct()
    two = classes.join(classes.select("form", F.col("text").alias("other")), "form").filter("text < other")
    a = members.select("form", "text", F.col("key").alias("a"))
    b = members.select("form", F.col("text").alias("other"), F.col("key").alias("b"))
    return (
        two.join(a, ["form", "text"]).join(b, ["form", "other"]).filter("a <> b")
        .select(F.least("a", "b").alias("record_id_a"), F.greatest("a", "b").alias("record_id_b")).distinct()
    )

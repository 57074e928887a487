"""Plain-Python text canonicalisation used inside Arrow batches.

Spark SQL has no Unicode composition, so everything that depends on it runs
here, in batch functions over Arrow columns. All functions are pure.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash

_WORD = re.compile(r"[^\W_]+")
_NOT_ALNUM = re.compile(r"[\W_]+")
#: Field labels of composed questions, in the order in which a key lists them.
FIELD_LABELS = ("task", "data", "model", "goal")
_LABEL = re.compile(r"(?<![^\W_])(" + "|".join(FIELD_LABELS) + r")[\s\u200b-\u200d\u2060\ufeff]*:")


def compose(text: str) -> str:
    """Canonical composition (NFC); ASCII text is returned as it is."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after composition, lower-cased."""
    return [] if text is None else _WORD.findall(compose(text).lower())


def form_key(text: str | None) -> str:
    """What remains of a question when its form is ignored.

    Letters and digits in order, case-folded, composed; blanks, punctuation and
    invisible characters vanish. If the text consists of labelled fields
    (``Label: text``, at least two labels, the first one opening the text) the
    fields are put into one fixed order first. Null, empty or mark-only text
    gives ``""``.
    """
    if text is None:
        return ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    if ":" in folded:
        labels = list(_LABEL.finditer(folded))
        if len(labels) >= 2 and not _WORD.search(folded, 0, labels[0].start()):
            ends = [m.start() for m in labels[1:]] + [len(folded)]
            fields = [
                (FIELD_LABELS.index(m[1]), m[1] + _NOT_ALNUM.sub("", folded[m.end() : end]))
                for m, end in zip(labels, ends)
            ]
            return "".join(text for _, text in sorted(fields))
    return _NOT_ALNUM.sub("", folded)


def key_digest(key: str) -> bytes:
    """128-bit digest of a non-empty key; equal keys and only those share it in practice."""
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def word_code(word: str) -> int:
    """Signed 64-bit code of a word."""
    code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return code - (1 << 64) if code >= 1 << 63 else code

"""Language detection: by script where a language has one of its own, else by frequent short words and letters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column

from .columnar import columnar

#: Frequent words of each language.
WORDS = {
    "en": "the of and to in is it that for on was with as by at from this be are or an not have he his",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec ne se il ce son sont",
    "de": "der die das und in den von zu mit ist des im dem nicht ein eine sich auf für auch als an er es war",
    "es": "el la los las de del y en que un una por con no se su para es al lo como más pero sus le",
    "it": "il lo gli di che è e la per un una in non con del della sono si da come anche più nel alla",
    "pt": "o os de que e do da em um para com não uma no na por mais as dos como mas foi ao ele das",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij maar uit door",
}
#: Scripts that mostly one language of the web is written in; kana and Hangul speak before Han.
SCRIPTS = {
    "ja": "\u3040-\u30ff", "ko": "\uac00-\ud7af\u1100-\u11ff", "zh": "\u4e00-\u9fff", "ru": "\u0400-\u04ff", "el": "\u0370-\u03ff", "ar": "\u0600-\u06ff",
    "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f", "ka": "\u10a0-\u10ff", "hy": "\u0530-\u058f", "bn": "\u0980-\u09ff", "ta": "\u0b80-\u0bff",
}
_SCRIPTS = {code: re.compile(f"[{span}]") for code, span in SCRIPTS.items()}
#: Kana make a text Japanese from this share of its letters on, as the rest of it is Han.
_KANA = 0.1
_SETS = {code: frozenset(words.split()) for code, words in WORDS.items()}
#: Letters that mostly one language of the above has.
_LETTERS = {"fr": "çêèâîôûœ", "de": "äöüß", "es": "ñ¿¡íóú", "pt": "ãõ", "it": "ìò"}


def detect(text: str | None, least: float = 0.02) -> str | None:
    """The code with the largest share of frequent words and own letters; None if too small."""
    words = (text or "").lower().split()
    if not words:
        return None
    letters = [c for c in "".join(words) if c.isalpha() and not c.isascii()]
    if 2 * len(letters) > sum(map(len, words)):
        own = "".join(letters)
        shares = {code: len(s.findall(own)) / len(own) for code, s in _SCRIPTS.items()}
        shares["ja"] = 1.0 if shares["ja"] >= _KANA else 0.0
        best = max(shares, key=lambda c: (shares[c], c))
        if shares[best] > 0.5:
            return best
    words = [w.strip(".,;:!?()[]\"'") for w in words]
    counts = {code: sum(w in own for w in words) / len(words) for code, own in _SETS.items()}
    size = sum(map(len, words)) or 1
    lowered = "".join(words)
    for code, letters in _LETTERS.items():
        counts[code] += 5 * sum(map(lowered.count, letters)) / size
    best = max(counts, key=lambda c: (counts[c], c))
    return best if counts[best] >= least else None


@columnar("string")
def _detect(texts: pd.Series) -> pd.Series:
    return pd.Series([detect(t) for t in texts], dtype=object)


def detect_language(text: Column) -> Column:
    return _detect(text)

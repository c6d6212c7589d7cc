"""Language of a text by character n-grams: a log-likelihood for each language, and a margin below which none is given.

Profiles count single letters, pairs and triples of characters, blanks at word ends among
them, and whole words in the samples of :mod:`leafpress.functions.language_samples`
and the lists of frequent words.  A letter that no word of a language is spelled with
costs that language ``FOREIGN`` besides.  N-grams that no language has are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np

from leafpress.functions.language_samples import COMMON, SAMPLES

# Letters besides a to z that the languages of the Latin script are spelled with, all letters of those of the Cyrillic.
LETTERS = {
    "af": "áèéêëíïîôóöúûý", "ca": "àçèéíïòóúü", "cs": "áčďéěíňóřšťúůýž", "da": "æøåé", "de": "äöüß", "en": "", "es": "áéíñóúü", "et": "õäöüšž",
    "fi": "äöåšž", "fr": "àâæçéèêëîïôœùûüÿ", "ga": "áéíóú", "gl": "áéíñóúü", "hr": "čćđšž", "hu": "áéíóöőúüű", "id": "", "is": "áðéíóúýþæö",
    "it": "àèéìíîòóùú", "lt": "ąčęėįšųūž", "lv": "āčēģīķļņšūž", "ms": "", "nl": "éëïóöüè", "no": "æøåéòôê", "pl": "ąćęłńóśźż",
    "pt": "áâãàçéêíóôõú", "ro": "ăâîșțşţ", "sk": "áäčďéíĺľňóôŕšťúýž", "sl": "čšž", "sq": "çë", "sv": "åäöé", "sw": "", "tl": "ñ",
    "tr": "çğıöşüâî",
    "be": "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "bg": "абвгдежзийклмнопрстуфхцчшщъьюя", "mk": "абвгдѓежзѕијклљмнњопрстќуфхцчџш",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "sr": "абвгдђежзијклљмнњопрстћуфхцчџш", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
}
CYRILLIC = ("be", "bg", "mk", "ru", "sr", "uk")
#: What a foreign letter costs, how often the first frequent word counts, what a whole word counts of an n-gram's weight.
FOREIGN = 4.0
FREQUENT = 2.0
WHOLE = 2.0
SMOOTHING = 0.3
#: Least lead of the best language: in all, and for each letter.
LEAST_LEAD = 6.0
LEAST_LEAD_A_LETTER = 0.03
#: Fewer letters tell no language.
LEAST_LETTERS = 12

_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Words of a text in lower case, a blank before, between and behind them."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def features(text: str) -> Iterator[tuple[str, int]]:
    """N-grams of a plain text and how often they occur; a word has a tab before it, so it is none of the others."""
    yield from ((c, n) for c, n in Counter(text).items() if c != " ")
    yield from ((a + b, n) for (a, b), n in Counter(zip(text, text[1:])).items())
    yield from ((a + b + c, n) for (a, b, c), n in Counter(zip(text, text[1:], text[2:])).items())
    yield from (("\t" + w, n) for w, n in Counter(text.split()).items())


def _kind(feature: str) -> int:
    return 0 if feature[0] == "\t" else len(feature)


class Profiles:
    """Weights of the features for each language, from samples and frequent words."""

    def __init__(self, samples: dict[str, tuple[str, ...]], frequent: dict[str, tuple[str, ...]]):
        self.languages = sorted(samples)
        counts: dict[str, np.ndarray] = {}
        for k, lang in enumerate(self.languages):
            texts = [(plain(t), 1.0) for t in samples[lang]] + [(plain(w), FREQUENT / (1 + r / 15)) for r, w in enumerate(frequent.get(lang, ()))]
            for text, weight in texts:
                for feature, n in features(text):
                    counts.setdefault(feature, np.zeros(len(self.languages)))[k] += weight * n
        self.rows = {f: i for i, f in enumerate(counts)}
        table = np.array(list(counts.values()))
        kinds = np.array([_kind(f) for f in counts])
        self.weights = np.zeros(table.shape)
        for kind in range(4):
            own = kinds == kind
            part = table[own] + SMOOTHING
            self.weights[own] = (WHOLE if kind == 0 else 1.0) * np.log(part / part.sum(0))
        for letter, i in self.rows.items():
            if len(letter) == 1:
                for k, lang in enumerate(self.languages):
                    latin = lang not in CYRILLIC and "a" <= letter <= "z"
                    if lang in LETTERS and not latin and letter not in LETTERS[lang]:
                        self.weights[i, k] -= FOREIGN

    def language(self, text: str | None) -> str | None:
        """Code of the likeliest language, None if the text is short or the lead is small."""
        if not text:
            return None
        words = plain(text)
        letters = len(words) - words.count(" ")
        if letters < LEAST_LETTERS:
            return None
        found = [(self.rows[f], n) for f, n in features(words) if f in self.rows]
        if not found:
            return None
        rows, n = np.array(found).T
        scores = n @ self.weights[rows]
        second, best = np.argsort(scores)[-2:]
        lead = scores[best] - scores[second]
        return self.languages[best] if lead >= max(LEAST_LEAD, LEAST_LEAD_A_LETTER * letters) else None


@cache
def profiles() -> Profiles:
    return Profiles(SAMPLES, COMMON)

"""Which of English, French, German and Spanish a text is written in."""

from __future__ import annotations

#: Frequent function words of each language (fixed values).
FUNCTION_WORDS = {
    "en": frozenset("the of and to is that with a an in for on it how what why when which where can does do i you this are be was from by before after under now without if only my your not as at or but than then while one keep each every we more most try check think start given way has have had will would should may there its into between about so all any no".split()),
    "fr": frozenset("le la les des et est une un pour dans avec que qui du de au aux en sur avant après comment pourquoi quand ce cette il elle je vous nous ne pas plus par sans sous son sa ses se si ou où l d c j qu n s puis lors dont faut être mais car entre donc on".split()),
    "de": frozenset("der die das den dem des und ist ein eine einen einem einer mit von vom zu zum zur nicht wie was warum wann auf aus vor bei nach für im in am an sich es sie ich wir man dass wenn als auch noch nur oder aber denn jetzt soll kann dann sind hat wird werden ohne unter über ihr ihre jeder jede jedes".split()),
    "es": frozenset("el la los las y es un una para con que de del en por se lo al su sus no como cómo qué cuál cuándo dónde después antes más si o pero este esta esto hay cada sin sobre bajo me nos le les a e ha han ser está son uno cuando donde porque todo ya muy entre pues".split()),
}
#: Letters that only some of the languages use (fixed values).
LETTERS = {"de": "äöüß", "es": "ñáíóú", "fr": "àâçèêëîïôùûœ"}
_BY_LETTER = {c: lang for lang, letters in LETTERS.items() for c in letters}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)


def language_scores(words: list[str]) -> dict[str, float]:
    """Evidence for each language: function words (shared ones count less) and letters."""
    scores = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for langs in map(_BY_WORD.__getitem__, filter(_BY_WORD.__contains__, words)):
        for lang in langs:
            scores[lang] += 1.0 / len(langs)
    letters = "".join(words)
    if not letters.isascii():
        for lang in map(_BY_LETTER.__getitem__, filter(_BY_LETTER.__contains__, letters)):
            scores[lang] += 0.5
    return scores


def detect_language(words: list[str], least: float = 0.0) -> str | None:
    """Best-scoring language; None without any evidence above ``least``. Ties: the order above."""
    if not words:
        return None
    scores = language_scores(words)
    best = max(scores, key=scores.get)
    return best if scores[best] > least else None

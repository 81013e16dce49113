"""Language votes: stopwords first, and character trigrams where a text has none.

The trigram model is trained when it is first used, on the samples below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

# Frequent function words per language.
STOPWORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and no to in is that it for on with as are this but be at by an from or was not which have has you your they them their he she his her its we our my me i if when what who where there here than then so do does did can could will would should been being were into out up down about over under only also all any some more most other such very just because while each both these those how why next near together alone".split()),
    "es": frozenset("el la los las un una unos unas de del al y o que en es no se con por para como más pero sus su lo le les ya este esta estos estas ese esa eso muy sin sobre también hasta hay donde quien desde todo todos nos me mi tu te si sí porque cuando entre está están ser son fue era ni otro otra solo qué eres nada contra puede lado ningún ninguna quedan".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war in im an am auf aus bei mit nach von vom zu zum zur für über unter um durch gegen ohne ich du er sie es wir ihr mich dich sich mir dir uns mein dein sein kein keine keiner man auch nur noch schon so wie was wer wo wenn weil dass ob als dann da hier dort sehr mehr alle jeder diese dieser dieses hat haben wird werden kann muss daneben nirgends".split()),
    "fr": frozenset("le la les un une des du de d l et ou mais ne pas n est sont à au aux en dans sur sous par pour avec sans que qui quoi dont où ce cet cette ces se s il elle ils elles on nous vous je tu me te mon ton son ma ta sa mes tes ses leur leurs plus très aussi si comme quand donc car y a ont été être fait tout tous rien même entre chez c j qu voit donc seulement aucun suffit".split()),
    "pt": frozenset("o a os as um uma uns umas de do da dos das em no na nos nas ao aos à às e ou que não se com por para como mais mas seu sua seus suas lhe já este esta isto esse essa isso muito sem sobre também até há onde quem desde tudo todos me mim meu minha te ti teu tua és são foi era nem outro outra só quando entre está estão ser pelo pela você apenas porque".split()),
}

# Own sample sentences about crops, insects and pictures; they train the trigram model.
SAMPLES: dict[str, str] = {
    "en": "the leaf shows small round holes and wilting tips along the stem base; fine webbing and sooty mould cover the lower leaves, with silvered patches, rolled margins, frass pellets, gall swellings, pinholes, stippling, russeting, honeydew film, serpentine mines, interveinal yellowing and skeletonised veins; larvae feed below the flower bud and the adult beetle rests on the twig; pale spots, brown edges, chewed blades, sticky residue, curled leaves, dark droppings, bright speckles, healthy tissue, marked region, bark, root, fruit, blade, picture, row, field, trap",
    "es": "la hoja muestra agujeros pequeños y puntas marchitas; telarañas finas, manchas plateadas, bordes enrollados, bolitas de excremento, una película de melaza, galerías sinuosas, nervios esqueletizados y un punteado claro; agallas hinchadas, fumagina, amarilleo entre nervios, larvas que comen debajo del brote, escarabajos adultos en la rama, hojas rizadas, bordes marrones, residuo pegajoso, excrementos oscuros, tejido sano, región marcada, corteza, raíz, fruto, imagen, fila, campo, trampa, finos, finas, claros, oscuras, hinchazones, puntos, orificios, daños, plateados",
    "de": "das Blatt zeigt kleine Löcher und welke Spitzen; feines Gespinst, silbrige Flecken, eingerollte Ränder, Kotkrümel, einen Honigtaufilm, gewundene Gänge, skelettierte Adern, helle Sprenkelung, feine Löcher; Gallen, Rußtau, Vergilbung zwischen den Adern, Larven fressen unter der Knospe, ausgewachsene Käfer sitzen am Zweig, gekräuselte Blätter, braune Ränder, klebriger Belag, dunkler Kot, gesundes Gewebe, markierte Region, Rinde, Wurzel, Frucht, Bild, Reihe, Feld, Falle, Schwellungen, Punkte, Schäden, Fraßspuren",
    "fr": "la feuille montre de petits trous et des pointes flétries; une toile fine, des plages argentées, des bords enroulés, des déjections, un film de miellat, des galeries sinueuses, des nervures décharnées, des ponctuations claires; des galles gonflées, de la fumagine, un jaunissement entre les nervures, les larves mangent sous le bourgeon, les coléoptères adultes se posent sur le rameau, feuilles recroquevillées, bords bruns, résidu collant, crottes sombres, tissu sain, région marquée, écorce, racine, fruit, image, rang, champ, piège, taches, petits, gonflements, dégâts",
    "pt": "a folha mostra furos pequenos e pontas murchas; teias finas, manchas prateadas, margens enroladas, excrementos, uma película de melada, galerias sinuosas, nervuras esqueletizadas, um pontilhado claro, furos finos; galhas inchadas, fumagina, amarelecimento entre as nervuras, larvas que comem debaixo do botão, escaravelhos adultos no ramo, folhas enroladas, bordas castanhas, resíduo pegajoso, fezes escuras, tecido saudável, região marcada, casca, raiz, fruto, imagem, linha, campo, armadilha, inchaços, pontos, orifícios, prateados",
}
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[㐀-鿿]")
_KANA_HANGUL = re.compile(r"[぀-ヿ가-힯]")


#: Texts with fewer letters and no decisive stopwords have no language.
LEAST_LETTERS = 8


@lru_cache(1)
def _votes() -> dict[str, tuple[tuple[str, ...], float]]:
    """The languages that have a stopword, and its vote, which they share."""
    langs: dict[str, tuple[str, ...]] = {}
    for lang, stop in STOPWORDS.items():
        for w in stop:
            langs[w] = (*langs.get(w, ()), lang)
    return {w: (found, 1.0 / len(found)) for w, found in langs.items()}


@lru_cache(1)
def _model() -> tuple[dict[str, list[tuple[str, float]]], dict[str, float]]:
    """(what a trigram adds to the log likelihood of the languages that have it, what any trigram adds to each)."""
    table, unseen = {}, {}
    for lang, text in SAMPLES.items():
        grams = Counter(g for w in _WORD.findall(text.lower()) for g in _grams(w))
        total = sum(grams.values()) + 2000
        unseen[lang] = math.log(0.2 / total)
        for g, n in grams.items():
            table.setdefault(g, []).append((lang, math.log((n + 0.2) / total) - unseen[lang]))
    return table, unseen


def _grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


#: The trigram model decides by at least this difference of log likelihoods; a single word needs more.
MARGIN, MARGIN_OF_ONE = 3.0, 6.0


def vote(text: str) -> str | None:
    """The language of ``text`` (en, es, de, fr, pt, zh, or ``xx`` for another script), or None where the votes decide nothing."""
    if text.isascii():
        han, words = 0, _WORD.findall(text.lower())
    else:
        han, words = len(_CJK.findall(text)), [w for w in _WORD.findall(text.lower()) if not _CJK.search(w)]
        if _KANA_HANGUL.search(text):
            return "xx"
    letters = sum(map(len, words))
    if han and han * 2 >= letters:
        return "zh"
    if not words:
        return None
    shared, votes = _votes(), dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        if (hit := shared.get(w)) is not None:
            for lang in hit[0]:
                votes[lang] += hit[1]
    (first, n), (_, m) = sorted(votes.items(), key=lambda x: -x[1])[:2]
    if n >= 1 and n >= 1.5 * m and n * 8 >= len(words):
        return first
    if letters < LEAST_LETTERS:
        return None
    table, unseen = _model()
    grams = [g for w in words for g in _grams(w)]
    score = {lang: len(grams) * unseen[lang] + 3.0 * votes[lang] for lang in STOPWORDS}
    for g in grams:
        for lang, gain in table.get(g, ()):
            score[lang] += gain
    best, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best[0] if best[1] - second[1] >= (MARGIN if len(words) > 1 else MARGIN_OF_ONE) else None

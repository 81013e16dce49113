"""Problem 10: abusive, hateful or sexual content.

Multiple-instance learning: a document is a bag of sentences, and the probability
that it is abusive is the noisy-or of its sentences' scores. The sentence model is
logistic over the sentence's concepts (who is spoken to, what is wished or done, to
whom, in which setting) and their n-grams with gaps; concepts are found by an
Aho-Corasick automaton in text freed from disguise, in ten languages. The weights are
learned from labels of whole documents only, on a bounded number of documents made
from this project's own vocabulary and patterns of speech.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .abuse_words import ABUSIVE, CORE, FUNCTION_WORDS, HARMLESS, LEXICON

#: Training documents; the bound of the labelled sample.
TRAINING_DOCUMENTS = 16_000
#: A document counts as abusive from this score on.
THRESHOLD = 0.5
#: Tokens that a task keeps freed from disguise; beyond that it starts anew.
KEPT_TOKENS = 100_000
#: Concepts at most so many tokens apart form an n-gram with a gap.
WINDOW = 6

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])|[\r\n\v\f\x85  ]+")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|['’*@$+](?=[\w*@$])|!(?=[^\W_]))*\*?|[*@$]+\w[\w*@$]*")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPREAD = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_·*]{1,2}){2,}[^\W\d_](?!\w)")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_CAPITAL = re.compile(r"(?<=[a-zà-ÿ0-9%]) ([A-ZÀ-Þ][a-zà-ÿ]*)(?= [a-zà-ÿ])")
_HAN = re.compile(r"[㐀-鿿]")
# a name of a people by its ending
_PEOPLE = re.compile(r"[A-Z](?:[a-z]+|[A-Z]+)(?:ians?|eans?|ese|ish|ites?|IANS?|EANS?|ESE|ISH|ITES?)")
_LATIN = re.compile(r"[a-z]")
_QUOTES = re.compile(r"[\"“«„「‹]([^\"”»“」›]+)[\"”»“」›]|(?<!\w)['‘]([^'’]+)['’](?!\w)")
_MARKS = {c: None for c in range(0x300, 0x370)}
# Letters of other scripts and signs that look like Latin letters.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁѵкмтвнгьαορυικντερη", "aeopcyxijshdvkmtbhrbaopuikvtepn")
LEET = (str.maketrans("013457@$!+", "oieastasit"), str.maketrans("013457@$!+", "oleastaslt"))


def _bare(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFD", text).translate(_MARKS)


class Lexicon:
    """The word lists as one automaton, with what the disguises need."""

    def __init__(self) -> None:
        import ahocorasick

        entries: dict[str, set[tuple[str, str]]] = {}
        self.words, self.stems, masked = set(), set(), {}
        for lang, concepts in LEXICON.items():
            for concept, listed in concepts.items():
                for e in listed.split("|"):
                    stem, core = e.endswith("*"), _bare(e.rstrip("*")).replace("-", " ").replace("'", " ").replace("’", " ").strip()
                    form = core if _HAN.search(core) else f" {core}" if stem else f" {core} "
                    entries.setdefault(form, set()).add((lang, concept))
                    if concept in CORE and " " not in core and core.isascii() and len(core) > 2 and concept in ("INSULT", "SLUR", "PROFANE", "KILL", "SEXBODY", "SEXACT", "ADJ"):
                        (self.stems if stem else self.words).add(core)
                        if lang in ("any", "en") and concept in ("INSULT", "PROFANE", "SLUR", "SEXBODY", "KILL") and len(core) > 3:
                            masked.setdefault(core[0], []).append((core, stem))
        self.longest = max(map(len, self.stems))
        self.masked = {k: sorted(v) for k, v in masked.items()}
        self.all, self.core = ahocorasick.Automaton(), ahocorasick.Automaton()
        for form, found in entries.items():
            self.all.add_word(form, (len(form.strip()), form[:1] == " ", tuple(sorted(found))))
            if any(c in CORE for _, c in found):
                self.core.add_word(form, 1)
        self.all.make_automaton()
        self.core.make_automaton()
        self.function: dict[str, tuple[str, ...]] = {}
        for lang, listed in FUNCTION_WORDS.items():
            for w in listed.split():
                w = _bare(w)
                self.function[w] = (*self.function.get(w, ()), lang)
        # words that begin sentences; pronouns that are capital letters anywhere do not tell
        self.starts = {w.capitalize() for lang, listed in FUNCTION_WORDS.items() for w in listed.split() if w.isalpha() and w not in ("i", "sie", "ihr", "ihnen") and lang not in ("ru", "zh")}

    def known(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.stems for k in range(3, min(len(word), self.longest) + 1))


@lru_cache(1)
def lexicon() -> Lexicon:
    return Lexicon()


def _plain(token: str) -> str:
    """A token freed from disguise: look-alike letters, digits and signs for letters, asterisks, doubled and drawn-out letters.

    A change counts only if a word of the core lists comes out; else the token stays.
    """
    lex, t = lexicon(), token
    if not t.isascii() and _LATIN.search(t):
        t = t.translate(LOOKALIKES)
    if t.isalpha() and not _DOUBLE.search(t):
        return t
    letters = sum(c.isalpha() for c in t)
    if letters and any(c in "013457@$!+" for c in t) and (letters * 2 >= len(t) or letters * 3 >= len(t) > 3 or t[0] in "@$"):
        for table in LEET:
            if lex.known(plain := t.translate(table)):
                return plain
    if "*" in t:
        if letters >= 2 or t.strip("*") in ("f", "s", "b", "c") and len(t) >= 4:
            for w, stem in lex.masked.get(t[0], ()):
                if (len(t) == len(w) or stem and len(t) > len(w)) and all(a in ("*", b) for a, b in zip(t, w)):
                    return w + t[len(w) :].replace("*", "")
        return t.replace("*", "")
    if _DOUBLE.search(t) and not lex.known(t):
        for plain in (_LONG.sub(r"\1\1", t), _LONG.sub(r"\1", t), _DOUBLE.sub(r"\1", _LONG.sub(r"\1", t))) if _LONG.search(t) else ():
            if lex.known(plain):
                return plain
        for m in _DOUBLE.finditer(t):
            if len(t) > 5 and lex.known(plain := t[: m.start()] + t[m.start() + 1 :]):
                return plain
    return t


def visible(text: str) -> str:
    """The text in compatibility form, without invisible signs."""
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def _joined(m: re.Match) -> str:
    """Letters set apart are one word again, where that is a word of the lists; a leading article stays on its own."""
    word = "".join(c for c in m.group() if c.isalpha())
    low, lex = _bare(word), lexicon()
    for k in (0, 1, 2):
        if len(low) - k > 2 and lex.known(low[k:]):
            return f"{word[:k]} {word[k:]}".strip()
    return m.group()


def sentences(text: str) -> list[str]:
    """Sentences of a visible text, by its marks and lines."""
    return [s for part in _SENTENCE.split(text) if part and (s := part.strip())]


def parts(sentence: str) -> list[str]:
    """The parts of a sentence into which another runs without a mark: it is cut before the word that begins the next."""
    cuts, starts = [0], lexicon().starts
    cuts += [m.start(1) for m in _CAPITAL.finditer(sentence) if m[1] in starts]
    return [s for a, b in zip(cuts, [*cuts[1:], len(sentence)]) if (s := sentence[a:b].strip())]


class Reader:
    """Turns texts into rows of concepts; keeps the tokens it has freed from disguise."""

    def __init__(self, most: int = KEPT_TOKENS) -> None:
        self.lex, self.kept, self.most = lexicon(), {}, most

    def _token(self, token: str) -> str:
        plain = " ".join(_plain(token).replace("’", " ").replace("'", " ").split())
        if len(token) <= 40:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[token] = plain
        return plain

    def spaced(self, low: str) -> str:
        kept = self.kept
        return f" {' '.join([kept.get(t) or self._token(t) for t in _TOKEN.findall(low)])} "

    def core(self, low: str) -> bool:
        """A word of a core concept may be in the lower-case text: the cheap test with which most sentences end."""
        find = self.lex.core.iter
        return next(find(self.spaced(low)), None) is not None or not low.isascii() and _HAN.search(low) is not None and next(find(low), None) is not None

    def concepts(self, sentence: str) -> list[tuple[int, str]]:
        """(place, concept) of a sentence in order, of the languages whose function words it has; none without a core concept."""
        low = _bare(sentence)
        if not self.core(low):
            return []
        text, han = self.spaced(low), len(_HAN.findall(low))
        if han and han * 3 > sum(map(str.isalpha, low)):
            text, at = low, lambda end: end
            allowed = {"zh", "any"}
        else:
            ends = [i for i, c in enumerate(text) if c == " "]
            at = lambda end: bisect_right(ends, end)
            votes: dict[str, int] = {}
            for w in text.split():
                for lang in self.lex.function.get(w, ()):
                    votes[lang] = votes.get(lang, 0) + 1
            top = max(votes.values(), default=0)
            allowed = {"any", *(lang for lang, n in votes.items() if n * 3 >= top * 2)} if top else set(LEXICON)
        found, taken = [], {}
        for end, (size, spaced, entries) in self.lex.all.iter(text):
            last = end - 1 if spaced and text[end] == " " else end
            for lang, concept in entries:
                if lang in allowed:
                    found.append((last - size + 1, at(last - size + 1), concept, size))
        # of the hits of one concept that begin at the same place the longest holds
        for start, place, concept, size in sorted(found, key=lambda x: (x[0], -x[3])):
            taken.setdefault((place, concept), start)
        out = sorted((place, concept) for place, concept in taken)
        if any(c in CORE for _, c in out):
            inside = [(at(m.start()), at(m.end())) for m in _QUOTES.finditer(low)] if han * 3 > len(low) else []
            if not inside and _QUOTES.search(low):
                quoted = self.spaced(" ".join(a or b for a, b in _QUOTES.findall(low)))
                if next(self.lex.core.iter(quoted), None):
                    out.append((-1, "QUOTED"))
            elif inside:
                out.append((-1, "QUOTED"))
            if not han:
                out += [(i, "NAME") for i, w in enumerate(_TOKEN.findall(sentence), 1) if _PEOPLE.fullmatch(w)]
                if len(text.split()) <= 4:
                    out.append((-1, "SHORT"))
                out.sort()
        return out


_ADDRESSED = ("YOU", "PERSON", "GROUP", "NAME", "FAMILY", "SHORT")
_SETTINGS = ("PEST", "BIO", "POLICY", "THING", "SELF", "KIND", "COOK", "QUOTED", "NEG")


def features(concepts: list[tuple[int, str]]) -> list[str]:
    """Concepts of a sentence, their pairs, their n-grams with gaps, core concepts that come again, without anybody meant, or in no special setting; none without a core concept."""
    names = sorted({c for _, c in concepts})
    core = [c for c in names if c in CORE]
    if not core:
        return []
    out = {f"1:{n}" for n in names} | {f"2:{a}&{b}" for i, a in enumerate(names) for b in names[i + 1 :]}
    placed = [(p, c) for p, c in concepts if p >= 0]
    for i, (p, a) in enumerate(placed):
        for q, b in placed[i + 1 :]:
            if q - p > WINDOW:
                break
            if q > p:
                out.add(f"3:{a}>{b}")
    out |= {f"4:{c}" for c in core if sum(c == x for _, x in concepts) > 1}
    if not any(w in names for w in _ADDRESSED):
        out |= {f"5:{c}" for c in core}
    if not any(s in names for s in _SETTINGS):
        out |= {f"0:{c}" for c in core}
    return sorted(out)


def _fill(template: str, lang: str, rng: random.Random) -> str:
    def word(m: re.Match) -> str:
        if m[1] == "NAME":
            return "".join(rng.choice(("va", "lo", "ri", "ke", "mu", "ta", "nel", "dor", "shi", "bra")) for _ in range(2)).capitalize() + rng.choice(("ans", "ians", "ish", "ese", "i", "ites"))
        lists = [LEXICON[x][m[1]] for x in (lang, "any") if m[1] in LEXICON[x]]
        return rng.choice(rng.choice(lists[:1] if rng.random() < 0.9 else lists).split("|")).rstrip("*") if lists else ""

    return re.sub(r"\{(\w+)\}", word, template)


def training_documents(count: int, seed: int, skip=lambda template: False) -> list[tuple[list[str], int]]:
    """``count`` labelled documents as lists of sentences; ``skip`` leaves patterns out (for tests)."""
    rng = random.Random(seed)
    pool = {label: {lang: [t for t in by[lang] if not skip(t)] for lang in by} for label, by in ((0, HARMLESS), (1, ABUSIVE))}
    langs = [*pool[1], *["en"] * 9]
    docs = []
    for i in range(count):
        label, lang = i % 2, rng.choice(langs)
        size = rng.choice((1, 1, 2, 3, 5)) if rng.random() < 0.94 else 30  # long documents keep the scores of harmless sentences low
        bag = [_fill(rng.choice(pool[0][lang]), lang, rng) for _ in range(size - (1 if label and rng.random() < 0.6 else 0))]
        if label:
            said = rng.choice(pool[1][lang])
            if rng.random() < 0.35:  # abuse is said in every setting
                said = f"{said} {rng.choice(('{THING}', '{PEST}', '{BIO}', '{COOK}', '{THING} {PEST}', '{PEST} {PERSON}'))}"
            bag.insert(rng.randint(0, len(bag)), _fill(said, lang, rng))
        if bag:
            docs.append((bag, label))
    return docs


def train(documents: list[tuple[list[str], int]], rounds: int = 250, rate: float = 0.08, decay: float = 2e-4, bias: float = -3.0) -> dict[str, float]:
    """Weights of the sentence model, by gradient ascent on the noisy-or likelihood of the documents' labels."""
    reader, index = Reader(), {}
    columns, starts, owner = [], [], []
    for d, (bag, _) in enumerate(documents):
        for s in bag:
            found = [index.setdefault(f, len(index)) for f in features(reader.concepts(visible(s)))]
            if found:
                starts.append(len(columns))
                owner.append(d)
                columns.extend(found)
    cols, first, owner_, y = np.array(columns, np.int64), np.array(starts), np.array(owner), np.array([label for _, label in documents], float)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cols))))
    w, m, v = np.zeros(len(index)), np.zeros(len(index)), np.zeros(len(index))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[cols], len(first))
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        none = np.exp(np.bincount(owner_, np.log1p(-p), len(y)))
        any_ = np.clip(1 - none, 1e-9, 1)
        # d log-likelihood / d z of a sentence: p * (y * none / any - (1 - y)) by its document
        g = p * (y * none / any_ - (1 - y))[owner_]
        grad = np.bincount(cols, g[row], len(index)) / len(y) - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"": bias} | {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}


@lru_cache(2)
def model(count: int = TRAINING_DOCUMENTS, seed: int = 7) -> dict[str, float]:
    """The trained model; made once per process in some seconds."""
    return train(training_documents(count, seed))


def sentence_score(sentence: str, weights: dict[str, float], reader: Reader) -> float:
    """Probability that a visible sentence is abusive; 0 where it has no core concept."""
    found = features(reader.concepts(sentence))
    return float(1 / (1 + np.exp(-np.clip(weights[""] + sum(weights.get(f, 0.0) for f in found), -30, 30)))) if found else 0.0


def document_score(text: str | None, weights: dict[str, float], reader: Reader) -> tuple[float, float, str | None]:
    """(noisy-or of the sentences, greatest sentence score, the sentence that has it); 0 and None without a sentence that has a core concept."""
    text = _SPREAD.sub(_joined, visible(text or ""))
    none, top, worst = 1.0, 0.0, None
    for whole in sentences(text):
        for s in parts(whole) if reader.core(_bare(whole)) else ():
            if (p := sentence_score(s, weights, reader)) > 0:
                none *= 1 - p
                if p > top:
                    top, worst = p, s
    return 1 - none, top, worst


def score_documents(documents: DataFrame, key: str = "doc_id", training: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(key, source, score, sentence_score, sentence) of every document.

    ``score`` is the noisy-or over all sentences of the whole text, ``sentence`` the
    one that scores highest. Null, empty and blank texts score 0 without a sentence.
    The model is trained on the driver from ``training`` labelled documents and sent
    along; the plan is a scan and one map.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model(training))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            found = [document_score(t, weights.value, reader) for t in pdf.text]
            yield pd.DataFrame({key: pdf[key], "source": pdf.source, "score": [x[0] for x in found], "sentence_score": [x[1] for x in found], "sentence": [x[2] for x in found]})

    return documents.select(key, "source", "text").mapInPandas(run, f"{key} {kind}, source string, score double, sentence_score double, sentence string")


def abusive_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of the documents whose noisy-or score reaches the threshold."""
    return score_documents(documents, key).filter(F.col("score") >= THRESHOLD).select(key)


def abuse_report(documents: DataFrame) -> DataFrame:
    """Documents, abusive documents, their share and the mean score, per source; null sources are a group."""
    return score_documents(documents).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("abusive"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("abusive_rate"), F.avg("score").alias("mean_score"))

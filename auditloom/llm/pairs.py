"""Problem 4: defective question and answer pairs.

A suffix automaton of the prompt measures how much of an answer is copied from it,
Aho-Corasick automata hold the phrases of refusals and of answers, the delimiter
stack of ``completeness`` finds truncated answers, and language votes find answers
in another language than the question.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpoint
from . import language
from .completeness import PAD, cut_answers, strip_end, structure
from .ids import plain_id

# How a refusal begins and what it refuses, by language; every beginning may go with every deed.
UNABLE: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "en": (
        ("can't", "cannot", "can not", "could not", "couldn't", "won't", "will not", "would not", "wouldn't", "am unable to", "i'm unable to", "unable to", "not able to", "not going to", "not willing to", "refuse to", "decline to", "must decline to", "not allowed to", "not permitted to", "not authorised to", "not authorized to", "not in a position to", "do not", "don't", "rather not", "prefer not to", "not comfortable with", "not supposed to"),
        ("help", "helping", "assist", "assisting", "answer", "answering", "be answering", "respond", "reply", "comply", "fulfil", "provide", "give assessments", "give opinions", "offer", "comment", "discuss", "engage", "participate", "take part", "process", "analyse", "analyze", "evaluate", "rate pictures", "rate images", "do that", "do this", "support this request", "continue with this", "proceed", "make judgements", "make judgments", "share"),
    ),
    "es": (("no puedo", "no podré", "no es posible", "no me es posible", "no voy a", "no debo", "prefiero no", "no me está permitido", "no estoy autorizado a", "no estoy autorizada a", "me niego a", "no quiero"), ("ayudar", "ayudarle", "ayudarte", "analizar", "responder", "contestar", "atender", "comentar", "proporcionar", "dar", "evaluar", "procesar", "continuar", "cumplir", "hacer eso", "opinar")),
    "de": (("kann ich nicht", "kann ich leider nicht", "kann nicht", "darf ich nicht", "darf nicht", "möchte ich nicht", "möchte nicht", "will ich nicht", "werde ich nicht", "werde nicht", "kann ihnen nicht", "kann dir nicht", "kann ihnen dabei nicht", "kann dir dabei nicht", "kann dabei nicht", "kann dazu nicht", "kann hierbei nicht", "kann diese anfrage nicht", "kann diese frage nicht"), ("helfen", "weiterhelfen", "beantworten", "antworten", "auswerten", "analysieren", "bewerten", "beurteilen", "erfüllen", "bearbeiten", "kommentieren", "unterstützen", "besprechen")),
    "fr": (("ne peux pas", "ne peux", "ne puis", "ne pourrai pas", "ne suis pas en mesure de", "ne suis pas en mesure d'", "ne suis pas autorisé à", "ne suis pas autorisée à", "ne souhaite pas", "ne vais pas", "préfère ne pas", "refuse de", "refuse d'", "dois refuser de", "dois refuser d'", "n'ai pas le droit de", "n'ai pas le droit d'"), ("vous aider", "t'aider", "aider", "répondre", "y répondre", "analyser", "commenter", "évaluer", "fournir", "traiter", "donner suite", "donner", "accéder", "poursuivre")),
    "pt": (("não posso", "não poderei", "não consigo", "não vou", "não devo", "prefiro não", "não me é permitido", "não estou autorizado a", "não estou autorizada a", "recuso-me a", "não é possível", "não me é possível"), ("ajudar", "ajudá-lo", "ajudar-te", "analisar", "responder", "comentar", "avaliar", "fornecer", "processar", "atender", "dar", "continuar", "cumprir", "fazer isso")),
    "zh": (("无法", "不能", "不便", "不可以", "不会", "不予", "没办法", "拒绝", "不愿"), ("协助", "帮助", "提供", "回答", "分析", "回应", "处理", "评论", "讨论", "满足", "评估", "作答", "继续")),
}
# Other phrases that decline a task.
DECLINES = (
    "to decline", "i decline", "must decline", "have to refuse", "must refuse", "i refuse", "not allowed", "not permitted", "my guidelines", "our guidelines", "usage policy", "usage policies", "content policy", "policy does not", "policies do not", "policy forbids", "against my", "against the rules", "language model", "as an ai", "have to pass on", "i'll pass on", "will pass on", "must pass on", "beyond what i", "outside my", "outside of my", "outside what i", "out of scope for me", "not something i", "i'd rather not", "i would rather not", "not comfortable", "requests like this", "requests of this kind", "questions of this kind", "questions like this", "this request is declined", "request denied", "not my place",
    "me niego", "debo rechazar", "tengo que rechazar", "rechazo esta", "no me está permitido", "no está permitido", "mis normas", "mis directrices", "mis políticas", "modelo de lenguaje", "este tipo de solicitud", "este tipo de pregunta", "fuera de mis",
    "muss ich ablehnen", "lehne ich ab", "lehne ab", "ablehnen", "verweigere", "nicht gestattet", "nicht erlaubt", "meine richtlinien", "meinen richtlinien", "sprachmodell", "anfragen dieser art", "fragen dieser art", "außerhalb meiner",
    "dois refuser", "je refuse", "dois décliner", "je décline", "pas permis", "pas autorisé", "mes consignes", "mes directives", "modèle de langage", "ce genre de demande", "ce genre de question", "ce type de demande", "hors de mes",
    "tenho de recusar", "devo recusar", "tenho que recusar", "eu recuso", "recuso este", "recuso esta", "não me é permitido", "não é permitido", "as minhas normas", "minhas diretrizes", "modelo de linguagem", "este tipo de pedido", "este tipo de pergunta", "fora do meu",
    "必须拒绝", "只能拒绝", "拒绝", "不允许", "语言模型", "我的准则", "我的规定", "此类请求", "这类问题", "这类请求",
)
# Phrases that often go with a refusal but also with other answers.
APOLOGIES = (
    "sorry", "apologise", "apologize", "unfortunately", "hope you understand", "please ask", "please consult", "however",
    "lo siento", "lamentablemente", "disculpe", "consulte", "tut mir leid", "leider", "wenden sie sich", "désolé", "malheureusement", "adressez-vous", "sinto muito", "infelizmente", "lamento", "desculpe", "抱歉", "对不起", "遗憾", "请咨询",
)
# Phrases by which an answer speaks of the evidence.
FINDINGS = (
    "evidence", "visible", "abstain", "pixels", "supported", "no support", "present", "absent", "not seen", "can be seen", "cannot see", "frame", "marked region", "uncertain", "insufficient",
    "evidencia", "píxeles", "absten", "apoyo", "presente", "se distingue", "se ve", "ausente", "beleg", "pixel", "enthaltung", "zu sehen", "zu erkennen", "preuve", "abstention", "appui", "présent", "visible", "on y voit", "evidência", "píxeis", "abster", "apoio", "visível", "证据", "像素", "弃权", "看到", "看不到", "支持",
)
# Keys of the answer contract.
ANSWER_KEYS = ("evidence_present", "visible_attributes", "evidence_region")
# Words of the contract that belong to no language.
STATUS_WORDS = frozenset("supported uncertain abstain abstained insufficient_visual_evidence true false null none evidence_present evidence_region visible_attributes diagnosis reliability status pest_id pest_name species stage json present done answer".split())
WRAPPERS = frozenset("question answer user assistant system prompt json q a input response".split())
EMPTY_WORDS = frozenset("null none nil nan na undefined".split())

#: A copy has a run of at least so many characters of the prompt (of Chinese: CJK_RUN) besides the pest's name.
COPY_RUN, CJK_RUN = 20, 8
#: At least this share of a copy's words comes from the prompt, and at most MAX_OWN_RUN words in a row are its own.
COPY_SHARE, MAX_OWN_RUN = 0.75, 3
#: A sentence with a run of so many characters of the prompt may be copied from it.
SENTENCE_RUN = 15
#: Shortest piece of the prompt that counts as copied.
MIN_PIECE = 4
#: Characters of prompts whose automata a task keeps (some 0.3 KB each), and of texts whose language it keeps.
AUTOMATON_CHARS, LANGUAGE_CHARS = 60_000, 2_000_000

_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:[-'’][^\W_㐀-鿿]+)*|§")
# a name in quotes; an apostrophe between letters opens and ends nothing
_QUOTED = re.compile(r"“([^”]+)”|「([^」]+)」|(?<![^\W_㐀-鿿])(?:'((?:[^']|(?<=\w)'(?=\w))+?)'|‘([^’]+)’|\"([^\"]+)\")(?![^\W_㐀-鿿])")
_BLANKS = re.compile(r"\s+")
_HAN = re.compile(r"[㐀-鿿]")
_PART = re.compile(r"[.!?\n。！？]+")
_FILLED = re.compile(r"\"\s*:\s*(?:true|false|-?\d|\"[^\"\s])")
_MARKUP = re.compile(r"```[a-z]*|</?[A-Za-z|][^<>]*>|^\s*>\s?", re.M)


@lru_cache(1)
def _automata():
    import ahocorasick

    found = ahocorasick.Automaton()
    unable = (f"{begin}{'' if lang == 'zh' or begin.endswith(chr(39)) else ' '}{deed}" for lang, (begins, deeds) in UNABLE.items() for begin in begins for deed in deeds)
    for kind, phrases in (("decline", {*DECLINES, *unable}), ("apology", APOLOGIES), ("finding", FINDINGS)):
        for p in phrases:
            found.add_word(p, (*found.get(p, ()), (kind, p)))
    found.make_automaton()
    return found


class SuffixAutomaton:
    """Suffix automaton of one text; ``runs`` gives the longest piece of it that ends at each character of another."""

    def __init__(self, text: str) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, text: str) -> list[int]:
        state, size, out = 0, 0, []
        for ch in text:
            while state and ch not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if ch in self.next[state]:
                state, size = self.next[state][ch], size + 1
            else:
                size = 0
            out.append(size)
        return out


class Kept:
    """Results of a function of one text, the last used first, up to so many characters of texts in all."""

    def __init__(self, function, most: int) -> None:
        self.function, self.most, self.held, self.of = function, most, 0, OrderedDict()

    def __call__(self, text: str, *more):
        key = (text, *more)
        if key in self.of:
            self.of.move_to_end(key)
            return self.of[key]
        found = self.function(*key)
        size = sum(map(len, key)) + 100
        if size <= self.most // 8:
            self.of[key] = found
            self.held += size
            while self.held > self.most:
                self.held -= sum(map(len, self.of.popitem(last=False)[0])) + 100
        return found


_automaton = Kept(SuffixAutomaton, AUTOMATON_CHARS)


@lru_cache(1024)
def _name_pattern(name: str) -> re.Pattern:
    return re.compile(r"\s+".join(map(re.escape, name.split())))


def _flat(text: str, name: str) -> str:
    text = text.casefold()
    if name:
        text = _name_pattern(name).sub("§", text)
    return " ".join(_WORD.findall(text))


_prompt = Kept(lambda question, system, name: f"{_flat(system, name)} ¶ {_flat(question, name)}", LANGUAGE_CHARS)


def _own_sentence(part: str, prompt: str, name: str) -> bool:
    """A sentence of at least three words of its own kind: no long piece of it is from the prompt."""
    flat = _flat(part, name)
    words = [w for w in flat.split(" ") if w and w != "§" and w not in WRAPPERS]
    if len(words) < 3:
        return False
    pieces = [(size, flat[i - size + 1 : i + 1]) for i, size in enumerate(_automaton(prompt).runs(flat))]
    return not any(size >= SENTENCE_RUN or sum(c >= "㐀" for c in piece) >= CJK_RUN - 2 for size, piece in pieces)


def copied(answer: str, question: str, system: str, name: str) -> tuple[bool, str]:
    """(the answer is a copy of the prompt and nothing else, the answer's words without those of copied pieces).

    Where no piece is long enough for a copy, the words are all the answer's.
    """
    prompt = _prompt(question, system, name)
    flat = _flat(_MARKUP.sub(" ", answer), name)
    if not flat:
        return False, ""
    chinese = _HAN.search(flat) is not None
    # a run of n characters holds a whole block of (n + 1) // 2 characters; without a common block there is no run
    block = ((2 * CJK_RUN - 1 if chinese else COPY_RUN) + 1) // 2
    if not any(flat[i : i + block] in prompt for i in range(0, len(flat) - block + 1, block)):
        return False, flat
    runs = _automaton(prompt).runs(flat)
    covered, longest, cjk_longest = bytearray(len(flat)), 0, 0
    for i, (size, after) in enumerate(zip(runs, [*runs[1:], -1])):
        if after == size + 1 or size < (2 if chinese else MIN_PIECE):
            continue  # the match goes on, or is too short to count
        piece = flat[i - size + 1 : i + 1]
        han = len(_HAN.findall(piece)) if chinese else 0
        if size >= MIN_PIECE or han >= 2:
            covered[i - size + 1 : i + 1] = b"\1" * size
        longest, cjk_longest = max(longest, len(piece.replace("§", "").strip())), max(cjk_longest, han)
    own, words, run, worst, at = [], 0, 0, 0, 0
    for w in flat.split(" "):
        inside = 0 not in covered[at : at + len(w)] and w != "§"
        at += len(w) + 1
        if w in WRAPPERS or w == "§":
            continue
        words += 1
        run = 0 if inside else run + 1
        worst = max(worst, run)
        if not inside:
            own.append(w)
    is_copy = words > 0 and (longest >= COPY_RUN or cjk_longest >= CJK_RUN) and len(own) <= (1 - COPY_SHARE) * words and worst <= MAX_OWN_RUN
    if is_copy and any(_own_sentence(part, prompt, name) for part in _PART.split(_MARKUP.sub(" ", answer))):
        is_copy = False
    return is_copy, " ".join(own)


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, marks, markup, keys and empty values."""
    if text is None:
        return True
    if text[:1].isalpha() and text[:40].isascii() and len(text.split(None, 4)) > 4 and not any(c in text for c in "{[(<`\\"):
        return False  # running text
    if _FILLED.search(text):
        return False
    core = _MARKUP.sub(" ", strip_end(text)[0]).strip(PAD)
    if not any(c.isalnum() for c in core):
        return True
    if core[0] in "{[\"'":
        found = structure(core)
        if not found.left_open and found.end == len(core) and core[0] in "{[":
            bare = re.sub(r"[\"'][^\"']*[\"']\s*:", "", core)
            bare = re.sub(r"\"\s*\"|'\s*'", "", bare)
            return not [w for w in _WORD.findall(bare.lower()) if w not in EMPTY_WORDS] and not any(c.isdigit() for c in bare)
    return core.lower().strip(" .\"'`/") in EMPTY_WORDS | {"n/a"}


def _texts(answer: str) -> tuple[str, list[str], bool]:
    """(running text outside structures, text values inside them, the answer contract is met)."""
    core = strip_end(answer)[0]
    begin = min((i for i in (core.find("{"), core.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return core, [], False
    _, end, values, _ = structure(core)
    running = core[:begin] + " " + core[max(end, begin) :] if end else core[:begin]
    contract = sum(k in core for k in ANSWER_KEYS) >= 2
    return running, [v for f, v in values if f not in ("status", "reliability", "pest_name", "pest_id", "species", "stage", "question", "prompt")], contract


def _language_text(text: str, name: str) -> str:
    flat = _flat(_MARKUP.sub(" ", re.sub(r"[A-Za-z]+_[A-Za-z_]+", " ", text)), name)
    return " ".join(w for w in flat.split(" ") if w != "§" and w not in STATUS_WORDS)


_spoken = Kept(lambda text, name: language.vote(_language_text(text, name)), LANGUAGE_CHARS)


def refuses(text: str, name: str) -> bool:
    """The text declines the task: it holds a phrase that declines, and more of refusals than of findings.

    A text that says nothing of the kind is no refusal, whatever it leaves out.
    """
    low = _BLANKS.sub(" ", text.casefold().replace("’", "'"))
    kinds: dict[str, set[str]] = {"decline": set(), "apology": set(), "finding": set()}
    for _, hits in _automata().iter(low):
        for kind, phrase in hits:
            kinds[kind].add(phrase)
    answers = len(kinds["finding"]) + 3 * bool(name and name.casefold() in low)
    score = 2 * len(kinds["decline"]) + len(kinds["apology"])
    return bool(kinds["decline"]) and score > 2 * answers


def defect(question: str, system: str, answer: str | None, cut: bool) -> str | None:
    """The defect of one pair, or None; the first that holds of empty, copy, truncated, refusal and other_language."""
    if is_empty(answer):
        return "empty"
    quoted = _QUOTED.search(question)
    name = next(g for g in quoted.groups() if g).strip().casefold() if quoted else ""
    running, values, contract = _texts(answer)
    own, plain = running, "{" not in answer
    if not contract or plain:
        is_copy, own_words = copied(answer, question, system, name)
        if is_copy:
            return "copy"
        own = own_words if plain else running
    if cut:
        return "truncated"
    spoken = " ".join([running, *values])
    if not contract and refuses(spoken, name):
        return "refusal"
    if not plain and running.strip(PAD + "`"):
        own = copied(running, question, system, name)[1]
    wanted = _spoken(question, name)
    if wanted:
        for text in (own, " ".join(values)):
            got = _spoken(text, name) if text.strip() else None
            if got and got != wanted:
                return "other_language"
    return None


def _defects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [defect(q, s or "", t, bool(c)) for q, s, t, c in zip(pdf.question, pdf.system, pdf.raw_text, pdf.cut)]
        out = pdf[["id", "attempt", "source"]].assign(defect=found)
        yield out[out.defect.notna()]


def message_text(role: str) -> Column:
    """The text items of all messages of one role, joined by line breaks; null without any."""
    parts = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: F.coalesce(F.transform(F.filter(m["content"], lambda c: c["text"].isNotNull() & F.coalesce(c["type"] == "text", F.lit(True))), lambda c: c["text"]), F.array().cast("array<string>"))))
    return F.array_join(parts, "\n")


def pair_defects(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, attempt, source, defect) of each answer whose question is not blank and that has a defect.

    A question is the text of all user messages of the manifest rows of one id (of
    repeated rows the greatest); a null answer counts as empty, a null or blank
    question leaves its answers out, and so does a missing manifest row. Repeated
    deliveries give one row per distinct text and source. Empty tables give no rows.
    """
    # the generator keeps the texts from being taken from the messages anew by each expression that reads them
    texts = F.explode(F.array(F.struct(message_text("user").alias("question"), message_text("system").alias("system"))))
    asked = manifest.filter("id IS NOT NULL").select(plain_id(F.col("id")).alias("id"), texts.alias("q")).filter(F.col("id").isNotNull() & F.col("q.question").rlike(r"[^\s\x{a0}\x{3000}\x{200b}]")).groupBy("id").agg(F.max("q").alias("q")).select("id", "q.question", "q.system")
    answers = checkpoint(predictions.select(plain_id(F.col("id")).alias("id"), "attempt", "source", "raw_text").filter("id IS NOT NULL").distinct())
    hot = hot_keys(answers.groupBy("id").agg(F.count("*").alias("n")), "id", "n", answers.count())
    cut = cut_answers(predictions).select(plain_id(F.col("id")).alias("id"), F.coalesce("attempt", F.lit(-1)).alias("_attempt"), F.lit(True).alias("cut")).distinct()
    pairs = salted_join(answers, asked, "id", hot, F.xxhash64("attempt", "source", "raw_text")).withColumn("_attempt", F.coalesce("attempt", F.lit(-1))).join(cut, ["id", "_attempt"], "left")
    return pairs.select("id", "attempt", "source", "raw_text", "question", "system", "cut").mapInPandas(_defects, "id string, attempt int, source string, defect string")


def defect_report(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Defective answers per source and defect."""
    return pair_defects(manifest, predictions).distinct().groupBy("source", "defect").agg(F.count_distinct("id", "attempt").alias("answers"))

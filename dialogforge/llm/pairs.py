"""Broken prompt and response pairs: one row per turn with the kind of its defect.

Prompt and response are aligned as words: shared shingles of three words say how much of the response is the prompt, and
the longest common subsequence decides where shingles leave it open; the same subsequence aligns the sentences of a
response with refusal templates. Kinds, in this order: ``empty``, ``copy``, ``refusal``, ``truncated``,
``other_language``.

Scale: prompts and responses of a turn meet by one aggregation with map-side combine (each turn keeps one row however
often it was delivered); the judgement is a narrow step in Arrow batches.

Defined results: turns without a user message or without an answer, and null dialogue or turn ids, are in no result; of
several user messages in a turn the first counts, of several answers the last (by msg_index, then msg_id); a null prompt
is an empty text; very long texts are judged whole; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER_ROLES = ("user", "User", "human")
ANSWER_ROLES = ("assistant", "Assistant", "ASSISTANT", "model")

SHINGLE = 3
#: A copy leaves at most so many words that are not the prompt's, and at most this share of the response.
OWN_WORDS, OWN_SHARE = 10, 0.45
#: A response of at least so many words is a reordered copy if at most this share of its words is its own and it holds so much of the prompt.
MOVED_WORDS, MOVED_OWN, MOVED_SHARE = 8, 0.1, 0.6
#: Share of a refusal template's words that a sentence must hold in order, and words that other sentences may have.
TEMPLATE_SHARE, OTHER_WORDS = 0.8, 12

_WORD = re.compile(r"[^\W_]+(?:['_][^\W_]+)*")
_INVISIBLE = "​‌‍⁠﻿­‎‏"
_STRIP = re.compile(rf"[\s{_INVISIBLE}]+$")
#: Words that stand for "nothing" (compared without punctuation, fixed list).
_NOTHING = frozenset(
    ["", "n a", "na", "none", "null", "nil", "nan", "empty", "undefined", "blank", "no answer", "no response", "no content", "no output", "no reply", "not available", "not applicable", "nothing", "tbd", "void", "missing", "placeholder"]
    + ["keine antwort", "leer", "nichts", "pas de réponse", "vide", "rien", "aucune réponse", "sin respuesta", "vacío", "nada"]
)
#: Refusals; "_" is a slot for any words.
_REFUSALS = [
    "i cannot assist with this request", "i cannot help with that", "i can't help with _", "i am sorry but i can't help with _", "i'm sorry but i can't help with _", "i'm sorry but i cannot _ that", "sorry that falls outside of what i am allowed to do",
    "unfortunately i am not able to work on _", "i must respectfully decline to _ for you", "i must decline", "as an assistant i have to decline this one", "as an ai language model i cannot _", "this is something i'm unable to do", "i am unable to do that",
    "it would not be appropriate for me to touch the _", "i won't be providing code for the _ as it may go against the usage rules", "regrettably this task lies beyond my remit hence no _ from my side", "no i am going to pass on this", "i don't feel comfortable giving an answer here",
    "my guidelines do not let me discuss _ so i will leave it there", "i'd rather not take this on changing _ is not something i can support", "the _ question is not one i may answer", "i will not answer this", "i refuse to do this", "this violates my guidelines",
    "leider darf ich zu _ keine auskunft geben", "diese anfrage muss ich ablehnen", "zu _ möchte ich mich nicht äußern", "es tut mir leid aber dabei kann ich nicht helfen", "das kann ich leider nicht beantworten",
    "je préfère ne pas répondre à cela", "je suis désolé mais je ne peux pas vous aider pour _", "malheureusement je dois refuser cette demande", "désolé je ne peux pas répondre à cette question",
    "lo siento pero no puedo ayudarte con _", "por desgracia tengo que rechazar esta petición", "prefiero no responder a esto", "no me está permitido hablar de _", "il ne m'est pas permis de traiter _", "no puedo ayudar con esta solicitud",
]
#: What may stand beside a refusal without being an answer.
_COURTESIES = [
    "thank you for the details", "good question", "i see", "let me know if there is anything else", "i hope that is fine with you", "thanks for your understanding", "please ask something else", "is there another topic i may help with", "consider asking a qualified engineer about the _",
    "danke für die angaben", "ich hoffe das ist in ordnung", "fragen sie gern etwas anderes", "merci pour les détails", "posez-moi une autre question", "j'espère que cela vous convient", "gracias por los detalles", "pregúntame otra cosa", "espero que no sea un problema",
]
#: Function words by language (fixed lists); a word of several languages counts for each by its part.
_LANGUAGES = {
    "en": "the is of and to that which with for it in this not you your be was were has have will would should how why does did what where when they their from by an a into than then could can on at as are if but or we my i me there still after before now same please only both each so while although whereas because",
    "de": "der die das und ist nicht mit ein eine einen einer auf im wie dass den dem des von zu wird werden ich du er sie es wir aber bei für nur noch nach bitte warum kannst soll sollte meine mein aus sich so wenn weil oder am vor durch über hat habe haben keine kein gibt welche welcher dann deshalb darum außerdem solange dort schon zwischen jede jeder jedes doch als seit uns",
    "fr": "le la les et est que qui des du une un dans pour pas vous tu avec sur ne se ce cette il elle je nous mais plus au aux par ou donc car merci pourquoi comment sont mon ma mes ton quand ai à de en tant lieu mieux vaut chaque entre depuis quelle faut",
    "es": "el la los las y es que de una un en con por para no se lo su al más pero como cuando cada está este esta mi qué cómo desde hasta sin sobre son fue ha he del gracias porque puede puedes conviene mejor así ya nunca siempre mientras entre hay",
}
_SCORES: dict[str, list[tuple[str, float]]] = {}
for _language, _words in _LANGUAGES.items():
    for _w in _words.split():
        _SCORES.setdefault(_w, []).append((_language, 1.0))
_SCORES = {w: [(k, 1.0 / len(v)) for k, _ in v] for w, v in _SCORES.items()}
_ASKED = re.compile(
    r"\b(?:in|auf|en)\s+(?:(?P<de>german|deutsch|allemand|alemán)|(?P<fr>french|französisch|français|francés)|(?P<es>spanish|spanisch|espagnol|español)|(?P<en>english|englisch|anglais|inglés))\b"
    r"|\b(?:translate|übersetze|tradui\w*|traduce)\b"
    r"|\b(?:in|into|auf|en)\s+(?:chinese|mandarin|japanese|korean|russian|ukrainian|greek|arabic|hebrew|hindi|thai|chinesisch|japanisch|koreanisch|russisch|griechisch|arabisch|chinois|japonais|coréen|russe|grec|arabe|chino|japonés|coreano|ruso|griego|árabe)\b",
    re.I,
)
#: Languages told by their script: name -> its letters (fixed ranges); Han with Kana is Japanese.
_SCRIPTS = {
    "ja": re.compile("[\u3040-\u30ff]"), "zh": re.compile("[\u3400-\u4dbf\u4e00-\u9fff]"), "ko": re.compile("[\uac00-\ud7af]"), "cyrillic": re.compile("[\u0400-\u04ff]"), "el": re.compile("[\u0370-\u03ff]"),
    "ar": re.compile("[\u0600-\u06ff]"), "he": re.compile("[\u0590-\u05ff]"), "hi": re.compile("[\u0900-\u097f]"), "th": re.compile("[\u0e00-\u0e7f]"),
}
#: Share of the letters that must be of a script, and Latin words that make a prompt one in a Latin script.
_SCRIPT_SHARE, _LATIN_WORDS = 0.5, 4
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_NAMES = re.compile(r"\S*[_/\\@=<>{}|]\S*|\d\S*")
_ALPHA = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])(?:\s|$)")
_STUB = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s*$")
_FINISHED = re.compile(r"[.!?…。][\"'»”’)\]*_]*$")
_URL_END = re.compile(r"(?:https?://|www\.)\S+$")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


_Template = tuple[list[str], frozenset[str], list[list[str]]]


def _templates(texts: list[str]) -> list[_Template]:
    """Words, distinct words and the runs of words around the slots of each template."""
    pieces = [[_WORD.findall(part) for part in re.split(r"(?<!\S)_(?!\S)", t)] for t in texts]
    words = [[w for part in parts for w in part] for parts in pieces]
    return [(w, frozenset(w), parts) for w, parts in zip(words, pieces)]


#: Words that begin something else within a sentence, as an answer after a refusal.
_TURNS = frozenset("but however instead though although yet nevertheless aber jedoch doch trotzdem stattdessen mais cependant toutefois pourtant pero aunque".split())


def _run(piece: list[str], words: list[str], begin: int) -> tuple[int, int]:
    """Most words of ``piece`` that stand in order within a stretch of as many words and two, and the least end of such a stretch."""
    if not piece:
        return 0, begin
    bag, best, end = frozenset(piece), 0, begin
    for k in range(begin, len(words)):
        if words[k] in bag and (found := lcs_length(piece, words[k : k + len(piece) + 2])) > best:
            best, end = found, k + len(piece) + 2
            while lcs_length(piece, words[k : end - 1]) == best:
                end -= 1
            if best == len(piece):
                break
    return best, min(end, len(words))


def _in_long(words: list[str], template: _Template, need: float) -> int | None:
    """In a sentence of any length: number of words that say something else, None if the template isn't there.

    The template's runs of words stand close together, in order; slots, and what comes before and after, take any number of
    words, but after a turn ("but", "however") behind the first run they say something else.
    """
    held, at, first = 0, 0, None
    for piece in template[2]:
        found, at = _run(piece, words, at)
        held += found
        if first is None and piece:
            first = at
    if held < need:
        return None
    turn = next((k for k in range(first, len(words)) if words[k] in _TURNS), len(words))
    return len(words) - turn


_REFUSAL_WORDS, _COURTESY_WORDS = _templates(_REFUSALS), _templates(_COURTESIES)


def other_words(words: list[str], templates: list[_Template], long: bool) -> int | None:
    """Words of a sentence that say something else than the template whose words it holds in order; None if it follows none.

    What a sentence has besides fills the slots. long: whether it may have any number of words, wherever the template stands.
    """
    own = frozenset(words)
    least = None
    for template in templates:
        plain, bag, pieces = template
        need = TEMPLATE_SHARE * len(plain)
        if len(own & bag) < need * len(bag) / len(plain):
            continue
        if len(words) <= len(plain) + 8:
            if lcs_length(plain, words) >= need:
                return 0
        elif (long or len(pieces) > 1) and (found := _in_long(words, template, need)) is not None:
            least = found if least is None else min(least, found)
    return least


def is_empty(content: str) -> bool:
    text = content.translate({ord(c): None for c in _INVISIBLE}).lower()
    return " ".join(_WORD.findall(text)) in _NOTHING


def is_refusal(content: str, has_code: bool) -> bool:
    if has_code or "```" in content:
        return False
    refused, others = False, 0
    for sentence in _SENTENCES.split(content):
        words = _WORD.findall(sentence.lower().replace("’", "'"))
        if not words:
            continue
        if (rest := other_words(words, _REFUSAL_WORDS, long=True)) is not None:
            refused = True
        elif (rest := other_words(words, _COURTESY_WORDS, long=False)) is None:
            rest = len(words)
        others += rest
    return refused and others <= OTHER_WORDS


def is_copy(prompt: str, content: str) -> bool:
    a, b = _WORD.findall(prompt.lower()), _WORD.findall(content.lower())
    if len(b) < SHINGLE or len(a) < SHINGLE:
        return bool(b) and a == b and len(b) > 1
    held = sum((Counter(a) & Counter(b)).values())
    if len(b) >= MOVED_WORDS and len(b) - held <= MOVED_OWN * len(b) and held >= MOVED_SHARE * len(a):
        return True  # the prompt's words in another order
    known = set(zip(*(a[k:] for k in range(SHINGLE))))
    covered = bytearray(len(b))
    for k, gram in enumerate(zip(*(b[k:] for k in range(SHINGLE)))):
        if gram in known:
            covered[k : k + SHINGLE] = b"\x01" * SHINGLE
    shared = sum(covered)
    if shared == 0:
        return False
    own = len(b) - shared
    if own <= OWN_WORDS and own <= OWN_SHARE * len(b):
        return True
    if shared < 0.3 * len(b):
        return False
    own = len(b) - lcs_length(a, b)
    return own <= OWN_WORDS and own <= OWN_SHARE * len(b)


def is_truncated(content: str, has_code: bool) -> bool:
    text = _STRIP.sub("", content)
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1]
    if _STUB.match(last):
        return True
    if _FINISHED.search(last):
        return False
    if text.endswith((":", "：")):
        return not has_code
    if _URL_END.search(last):
        return False
    if _ITEM.match(last):
        # An entry is whole if its marks are closed and it ends as the entries before it do.
        before = [x for x in lines[:-1] if _ITEM.match(x)]
        if last.count("`") % 2 or last.count("(") != last.count(")"):
            return True
        if not before:
            return not last.endswith(("`", ")"))
        ends = {("w" if x.rstrip()[-1].isalnum() else x.rstrip()[-1]) for x in before}
        return ("w" if last.rstrip()[-1].isalnum() else last.rstrip()[-1]) not in ends
    words = text.split()
    return not (len(words) == 1 and len(lines) == 1)


def script(text: str) -> str | None:
    """The language or script of a text whose letters are mostly not Latin."""
    letters = sum(map(str.isalpha, text))
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS.items()}
    if counts["ja"]:
        counts["ja"], counts["zh"] = counts["ja"] + counts["zh"], 0
    best = max(counts, key=counts.get)
    return best if counts[best] and counts[best] >= _SCRIPT_SHARE * letters else None


def language(text: str) -> str | None:
    """The natural language by its script or by function words, None if they don't tell; code, names and numbers are left out."""
    plain = _NAMES.sub(" ", _FENCE.sub(" ", text) if "```" in text else text)
    if not plain.isascii() and (written := script(plain)) is not None:
        return written
    scores = dict.fromkeys(_LANGUAGES, 0.0)
    for w in _ALPHA.findall(plain.lower()):
        if w in _SCORES:
            for k, part in _SCORES[w]:
                scores[k] += part
    best, second = sorted(scores, key=scores.get, reverse=True)[:2]
    return best if scores[best] >= 1.5 and scores[best] >= 1.5 * scores[second] else None


def is_other_language(prompt: str, content: str) -> bool:
    said = language(content)
    if said is None:
        return False
    spoken = language(prompt)
    if spoken is None and said in _SCRIPTS and len(_ALPHA.findall(prompt)) >= _LATIN_WORDS:
        spoken = "latin"
    if spoken is None or spoken == said:
        return False
    for asked in _ASKED.finditer(prompt):
        if asked.lastgroup in (None, said):
            return False
    return True


def defect_of(prompt: str | None, content: str | None, has_code: bool) -> str | None:
    """The defect of a pair, or None."""
    prompt, content = prompt or "", content or ""
    if is_empty(content):
        return None if has_code else "empty"
    if is_copy(prompt, content):
        return None if has_code else "copy"
    if is_refusal(content, has_code):
        return "refusal"
    if is_truncated(content, has_code):
        return "truncated"
    if is_other_language(prompt, content):
        return "other_language"
    return None


def turn_pairs(messages: DataFrame) -> DataFrame:
    """``dialogue_id, turn_id, prompt, content, has_code`` of every turn with a user message and an answer."""
    order = F.struct(F.coalesce("msg_index", F.lit(2**31 - 1)), F.coalesce("msg_id", F.lit(2**63 - 1)))
    user, answer = F.col("role").isin(*USER_ROLES), F.col("role").isin(*ANSWER_ROLES)
    spoken = messages.filter((user | answer) & F.col("dialogue_id").isNotNull() & F.col("turn_id").isNotNull())
    has_code = F.coalesce(F.regexp_like("code_snippet", F.lit(r"\S")), F.lit(False))
    narrow = spoken.select("dialogue_id", "turn_id", user.alias("is_user"), order.alias("place"), F.struct("content", F.when(~user, has_code).alias("has_code")).alias("m"))
    first = F.min_by(F.when(F.col("is_user"), F.col("m")), F.when(F.col("is_user"), F.col("place")))
    last = F.max_by(F.when(~F.col("is_user"), F.col("m")), F.when(~F.col("is_user"), F.col("place")))
    turns = narrow.groupBy("dialogue_id", "turn_id").agg(first.alias("u"), last.alias("a")).filter("u is not null and a is not null")
    return turns.select("dialogue_id", "turn_id", F.col("u.content").alias("prompt"), F.col("a.content").alias("content"), F.col("a.has_code").alias("has_code"))


def find_defects(messages: DataFrame) -> DataFrame:
    """``dialogue_id, turn_id, defect`` of the turns whose answer is defective."""

    @F.pandas_udf("string")
    def judged(prompt: pd.Series, content: pd.Series, has_code: pd.Series) -> pd.Series:
        return pd.Series([defect_of(p, c, bool(h)) for p, c, h in zip(prompt, content, has_code)], dtype=object)

    pairs = turn_pairs(messages)
    return pairs.select("dialogue_id", "turn_id", judged("prompt", "content", "has_code").alias("defect")).filter("defect is not null")

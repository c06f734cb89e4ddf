"""Problem 4: defects of answers.

A pair is an assistant message with the latest earlier user message of its conversation. An answer is a copy when,
compressed with the question as a zstandard dictionary, it leaves little of itself: at most LEFT of what it takes alone,
and fewer bytes than a short sentence (OWN). Refusals and languages show by dictionaries of phrases and function words;
cut-off answers by a model of terminal contexts, which counts over all answers of pairs how often a word, the word before
it with the word's shape, and the word's last letters end a line or an item, and how often they do not.

Pairing splits a conversation by the hour: the question comes from the hour's own messages or from the last earlier
hour that has one, so a conversation of any size is never in one task. The model's counts are joined to the answers'
endings; only the counts of letter triples, bounded by the alphabet, go to all tasks.

Cases: a null answer is empty; an assistant message without an earlier question has no pair and no defect, as has one
with a null question; null ids, times, roles and conversations take part in no pair; equal times are not earlier;
repeated rows count once; of users' messages at one time the last by id is taken; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.words import WORD, words
from foliant.runtime import checkpoint

HOUR = 3_600_000_000
#: A copy, compressed with the question, keeps at most this share of its size and at most so many bytes.
LEFT, OWN = 0.6, 56
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x206A), 0xFEFF)))
# Words that only announce an answer, and words that stand for no value.
LABELS = "answer antwort réponse reponse respuesta result ergebnis résultat resultado output response assistant".split()
PLACEHOLDERS = "n/a na null none nil nan undefined empty leer vide vacío ninguno keine kein aucun aucune".split() + ["no content", "no value", "no answer", "kein inhalt", "keine antwort", "sans contenu", "aucun contenu", "sin contenido", "sin valor"]
# Function words that tell the languages apart.
LANGUAGES = {
    "en": "the and of is was that which with for from by each every when although because neither nor between section table readings how what does where why".split(),
    "de": "der die das den dem ein eine und ist nicht mit für auf bei wenn weil obwohl sowohl auch als zwischen laut wie warum welcher zeigt".split(),
    "fr": "le la les un une des du et est à au pour dans quand comme bien que selon entre sur pourquoi combien quelle sous".split(),
    "es": "el la los las un una del y es en por para cuando como aunque según entre qué cuánto dónde tras bajo".split(),
}
# The languages' names in each other.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles".split(),
    "de": "german deutsch allemand alemán aleman".split(),
    "fr": "french französisch français francais francés frances".split(),
    "es": "spanish spanisch espagnol español espanol".split(),
}
# Phrases of declining or of finding nothing.
REFUSALS = re.compile(
    "|".join(
        (
            r"\b(?:i'?m|i am) (?:very |so |really )?sorry\b|^sorry\b|\bmy apologies\b|\bi apologi[sz]e\b",
            r"\b(?:i|we) (?:can ?not|can'?t|could not|couldn'?t|won'?t be able to|am not able to|am unable to|are unable to|must respectfully|have to decline|must decline|would rather not|prefer not to|do not have|don'?t have|did not find|didn'?t find|found nothing|found no)\b",
            r"\bi (?:was|am) unable\b|\bas an? (?:assistant|ai|language model)\b|\bnot something i (?:can|may)\b|\bdecline (?:this|to)\b|\bpass on this\b",
            r"\bno (?:answer|information|evidence|basis|reply) (?:is|was|could|can|for|available)\b|\b(?:is|are)n'?t (?:sufficient|enough) (?:evidence|information)\b|\b(?:is|are) not (?:sufficient|enough) (?:evidence|information)\b|\bgive me no basis\b|\bnothing (?:was |is )?(?:found|in the (?:files|documents|passages))\b|\bdo(?:es)? not (?:contain|mention|cover|say|answer|provide)\b",
            r"\bleider\b|\btut mir leid\b|\bkann ich (?:nicht|leider|keine|dabei nicht)\b|\b(?:kann|darf|möchte|werde) (?:ich )?(?:diese |dies |dazu |das )?(?:\w+ )?nicht (?:beantworten|helfen|behandeln|sagen)\b|\bich muss (?:.{0,40})ablehnen\b|\bnichts gefunden\b|\bkeine (?:antwort|auskunft|angaben?)\b|\bnicht in der lage\b|\blehne (?:.{0,30})ab\b|\bdarf ich nicht\b|\breichen (?:.{0,40})nicht aus\b",
            r"\bdésolée?\b|\bmalheureusement\b|\bje ne (?:peux|suis|saurais|dispose|trouve|souhaite)\b|\bje n'ai (?:rien|pas)\b|\bje préfère ne pas\b|\bje dois (?:décliner|refuser)\b|\bne permett(?:ent|ait|aient) aucune?\b|\baucune (?:réponse|information)\b|\bn'offrent aucune?\b|\bne contien(?:t|nent) (?:pas|aucune?|rien)\b",
            r"\blo siento\b|\bpor desgracia\b|\blamentablemente\b|\bdesafortunadamente\b|\bno (?:puedo|encontré|encuentro|estoy en|tengo|he encontrado|me es posible|dispongo)\b|\bdebo (?:rechazar|declinar)\b|\bprefiero no\b|\bno (?:ofrecen|contienen|permiten|hay|contiene|ofrece) (?:ninguna?|nada|suficiente|información|respuesta)\b",
        )
    ),
    re.I,
)
# What refusals add, which is no content either.
FOLLOW_UPS = re.compile(r"^(?:please |bitte |veuillez |por favor,? )?(?:ask|try|choose|pick|select|contact|rephrase|consult|frag\w*|wähle?\w*|versuch\w*|wende|essayez|demandez|choisissez|adressez|consultez|prueb[ae]\w*|elij?g?[ae]|intent\w*|pregunt\w*|consult\w*|seleccion\w*)\b", re.I)
QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"")
ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])(?:\s+|$)")
STOP = re.compile(r"[.!?]\s*$")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def bare(text: str) -> str:
    """The text without markup, labels, source numbers, invisible characters and placeholders."""
    text = text.translate({ord(c): None for c in INVISIBLE})
    try:
        value = json.loads(text)
        if value is None or isinstance(value, dict) and not str(value.get("answer", text) or "").strip():
            return ""
    except ValueError:
        pass
    text = re.sub(r"</?[A-Za-z][^<>]*>|\[\d+(?:,\s*\d+)*\]|```\w*", " ", text)
    text = re.sub(r"[*_#`>|~]+", " ", text).strip()
    text = re.sub(rf"^(?:{'|'.join(LABELS)})\s*[:：]?\s*$", "", text, flags=re.I)
    text = re.sub(rf"^(?:{'|'.join(LABELS)})\s*[:：]\s*", "", text, flags=re.I)
    core = re.sub(r"[^\w/ ]+", " ", text).strip().lower()
    return "" if " ".join(core.split()) in PLACEHOLDERS or not WORD.search(core) else text


def language(text: str) -> str | None:
    """The language most of whose function words occur, if it is ahead of the others."""
    found = Counter(words(text))
    ranked = sorted(((sum(found[w] for w in own), lang) for lang, own in LANGUAGES.items()), reverse=True)
    (best, lang), (second, _) = ranked[:2]
    return lang if best >= 2 and best > 1.5 * second else None


def other_language(question: str, answer: str) -> bool:
    asked = set(words(question))
    allowed = {lang for lang, names in LANGUAGE_NAMES.items() if asked.intersection(names)}
    own, given = language(QUOTED.sub(" ", question)) or language(question), language(answer)
    return bool(own and given and given != own and given not in allowed)


@cache
def frame() -> zstandard.ZstdCompressionParameters:
    """Frames without sizes, sums and names, so that what is counted is the text."""
    return zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)


@cache
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=frame())


def copies(question: str, answer: str) -> bool:
    """Whether the answer, compressed with the question as dictionary, leaves next to nothing of its own."""
    q, a = (" ".join(t.lower().split()).encode("utf-8", "replace") for t in (question, answer))
    if not q or len(WORD.findall(answer)) < 3:
        return False
    knowing = zstandard.ZstdCompressor(compression_params=frame(), dict_data=zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    rest = len(knowing.compress(a))
    return rest <= OWN and rest <= LEFT * len(plain().compress(a))


#: What every refusal holds, for an automaton that reads each text once.
HINT = "(?i)" + REFUSALS.pattern.replace(r"\b", "").replace("^", "").replace(r"\w", r"\S")


def may_refuse(answers: pd.Series) -> np.ndarray:
    """Which answers hold a phrase of refusing at all; only these are looked at sentence by sentence."""
    texts = pc.replace_substring_regex(pa.array(answers, pa.string()), r"\[\d+\]", " ")
    return pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)


def refuses(answer: str) -> bool:
    """Whether the answer declines or finds nothing and says nothing else."""
    sentences = [s.strip() for s in SENTENCE.findall(re.sub(r"\[\d+\]", " ", answer)) if WORD.search(s)]
    declining = [bool(REFUSALS.search(s)) for s in sentences]
    return any(declining) and all(d or FOLLOW_UPS.search(s) or len(words(s)) < 3 for d, s in zip(declining, sentences, strict=True))


def contexts(line: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The line's kind and, for each word, its keys in the model: the word, the word before and its shape, its last letters."""
    kind = "item" if ITEM.match(line) else "text"
    body = re.findall(r"[\w'’/²³°%-]+", ITEM.sub("", line))
    out = []
    for k, w in enumerate(body):
        before = body[k - 1] if k > 1 else "^" * (k + 1)  # a first word's capital says nothing
        shape = "0" if w[0].isdigit() else "A" if w[0].isupper() else "a"
        out.append((f"{kind} w {shape if shape == '0' else w.lower()}", f"{kind} p {'A' if before[0].isupper() else before.lower()} {shape}", f"t {w.lower()[-3:]}"))
    return kind, out


def terminal_counts(texts: Iterator[str | None]) -> Counter:
    """(key, whether it ended a line, sentence or item) -> how often. The last line of a text proves an end only by a full stop."""
    pieces: Counter = Counter()
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip() and not x.lstrip().startswith(("|", "{"))]
        for n, line in enumerate(lines):
            stopped = bool(STOP.search(line))
            own = [p for p in re.split(r"(?<=[.!?])\s+", line) if p.strip()]
            for m, piece in enumerate(own):
                text_of = ITEM.sub("", piece) if stopped else piece  # an item that is a sentence is text
                ended = bool(STOP.search(piece)) and not piece.rstrip().endswith("...") or m == len(own) - 1 and n < len(lines) - 1 and bool(ITEM.match(text_of))
                pieces[text_of, ended, piece] += 1
    counts: Counter = Counter()
    words_in: Counter = Counter()
    keys_in: Counter = Counter()
    for (text_of, ended, piece), n in pieces.items():
        keys = contexts(text_of)[1]
        for three in keys[:-1]:
            keys_in[three, False] += n
        if keys and ended:
            keys_in[keys[-1], True] += n
        for w in re.findall(r"[^\W\d_]{4,}", piece.lower()):
            words_in[w] += n
    for ((word, before, letters), last), n in keys_in.items():
        counts[word, last] += n
        counts[before, last] += n
        counts[letters, True] += n
    for w, n in words_in.items():
        for i in range(len(w) - 3):
            counts[f"t {w[i : i + 3]}", False] += n
    return counts


def ending(answer: str) -> str | list[str]:
    """"whole" or "cut" where the form tells, else the model's keys of the last word."""
    text = answer.strip()
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    last = lines[-1]
    if text.startswith(("{", "[{")):
        try:
            json.loads(text)
            return "whole"
        except ValueError:
            return "cut"
    if last.lstrip().startswith("|"):
        first = next(x for x in lines if x.lstrip().startswith("|"))
        return "whole" if last.endswith("|") and last.count("|") == first.count("|") and not re.fullmatch(r"[\s|:-]+", last) else "cut"
    if last.endswith(("...", "…", ",", ";", "(", "-", ":")) or re.fullmatch(r"\s*(?:[-*•]|\d+[.)]?)", last) and len(lines) > 1:
        return "cut"
    body = ITEM.sub("", last)
    if body.count("**") % 2 or body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count("“") > body.count("”"):
        return "cut"
    if text.endswith((".", "!", "?", "]", ")", "*", "}", '"', "”", "»", "`", "%")):
        number = re.search(r"(\S+)\.$", text)
        return "cut" if number and re.fullmatch(r"\d{1,3}(?:,\d{3})*", number[1]) and not ITEM.match(last) and len(words(last)) > 4 else "whole"
    kind, keys = contexts(last)
    if not keys or kind == "text" and len(keys) > 4 or kind == "item" and any(ITEM.match(x) and STOP.search(x) for x in lines[:-1]):
        return "cut"  # running text without an end
    word, before, letters = keys[-1]
    return [word, before, letters] if kind == "item" else [word, letters]  # a short value


def pairs(messages: DataFrame) -> DataFrame:
    """message_id, answer, question of each assistant message with an earlier user message in its conversation."""
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    rows = messages.select("id", "conversation_id", role.alias("role"), F.unix_micros("created_at").alias("at")).filter("id is not null and conversation_id is not null and at is not null and role in ('user', 'assistant')")
    rows = rows.distinct().withColumn("hour", F.floor(F.col("at") / HOUR))
    asked = F.when(F.col("role") == "user", F.struct("at", "id"))
    inside = rows.withColumn("own", F.max(asked).over(W.partitionBy("conversation_id", "hour").orderBy("at").rangeBetween(W.unboundedPreceding, -1)))
    hours = rows.groupBy("conversation_id", "hour").agg(F.max(asked).alias("last"))
    hours = hours.withColumn("carried", F.max("last").over(W.partitionBy("conversation_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    answers = inside.filter("role = 'assistant'").join(hours, ["conversation_id", "hour"]).select(F.col("id").alias("message_id"), F.coalesce("own.id", "carried.id").alias("question_id")).filter("question_id is not null")
    texts = messages.select("id", "content").dropDuplicates(["id"])
    with_question = answers.join(texts.select(F.col("id").alias("question_id"), F.col("content").alias("question")), "question_id").filter("question is not null")
    return with_question.join(texts.select(F.col("id").alias("message_id"), F.col("content").alias("answer")), "message_id").select("message_id", "question", "answer")


def defects(messages: DataFrame) -> DataFrame:
    """message_id, defect of each answer that has one: empty, copy, refusal, truncated or language, the first that holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = terminal_counts(iter(batch["answer"]))
            yield pd.DataFrame([(k, n if end else 0, 0 if end else n) for (k, end), n in got.items()], columns=["key", "ends", "goes_on"])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (i, q, a), declining in zip(batch.itertuples(index=False, name=None), may_refuse(batch["answer"]), strict=True):
                defect, keys = None, None
                if not a or not (core := bare(a)):
                    defect = "empty"
                elif copies(q, core):
                    defect = "copy"
                elif declining and refuses(a):
                    defect = "refusal"
                else:
                    how = ending(a)
                    if how == "cut":
                        defect = "truncated"
                    else:
                        keys = None if how == "whole" else how
                        if other_language(q, a):
                            defect = "language"
                out.append((i, defect, keys))
            yield pd.DataFrame(out, columns=["message_id", "defect", "keys"])

    both = checkpoint(pairs(messages))
    labelled = checkpoint(both.select("message_id", "question", "answer").mapInPandas(label, "message_id string, defect string, keys array<string>"))
    counts = both.select("answer").mapInPandas(count, "key string, ends long, goes_on long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    open_ended = labelled.filter("keys is not null")
    key = F.explode("keys").alias("key")
    # what each key says for an end, in logarithms
    said = F.log((F.col("ends") + 0.5) / (F.col("goes_on") + 0.5))
    # a short value ends with any word that ends a sentence now and then
    sometimes = (F.col("ends") >= 2) & (F.col("ends") * 1000 >= F.col("goes_on"))
    said = F.when(F.col("key").startswith("text w"), F.when(sometimes | (F.col("goes_on") < 3), 0.0).otherwise(-5.0)).otherwise(said)
    weighed = open_ended.select("message_id", key).join(counts, "key", "left").withColumn("said", said)
    letters = F.col("key").startswith("t ")
    by_word, by_letters, known = (F.coalesce(F.sum(F.when(x, y)), z) for x, y, z in ((~letters, F.col("said"), F.lit(0.0)), (letters, F.col("said"), F.lit(math.log(0.2))), (F.col("key").rlike("^\\w+ w "), F.col("ends") + F.col("goes_on"), F.lit(0))))
    # the last letters speak for words that are not known
    total = weighed.groupBy("message_id").agg(by_word.alias("w"), by_letters.alias("t"), known.alias("known"))
    cut = total.filter(F.col("w") + F.when(F.col("known") >= 2, 0.0).otherwise(F.col("t")) < 0).select("message_id", F.lit("truncated").alias("cut"))
    return labelled.join(cut, "message_id", "left").select("message_id", F.coalesce("cut", "defect").alias("defect")).filter("defect is not null")

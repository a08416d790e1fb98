"""Broken prompt-response pairs.

Distinct responses are range-sorted by text; a response that is a proper prefix of its successor, also across the borders
of partitions, is a shortened version where the longer one goes on inside a sentence. Completion lengths that are hit far
more often than their neighbours are length limits. The last words of lists without an ending are looked up among the words
of all responses: a word cut off in the middle hardly occurs elsewhere. Then rules decide, in this order: empty, copy,
refusal, wrong language, truncated.

Defined results: a null or blank response is `empty`; a null prompt can't be copied and has no language; a null id is
kept; repeated rows are folded; one row has one defect at most. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import langid
from marlstone.session import cut

MIN_PREFIX = 24  # characters: "yes" is no shortened "yes, because"
SPIKE = 8.0

_THINK = re.compile(r"(?is)<(think|thinking|thought|reasoning)>.*?(?:</\1>|\Z)")
_FENCE = re.compile(r"(?s)```[^\n`]*\n?(.*?)(?:```|\Z)|~~~[^\n~]*\n?(.*?)(?:~~~|\Z)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」|`[^`\n]+`")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")

# How refusals are worded.
REFUSALS = [re.compile(x) for x in (
    r"(?i)\b(?:i|we)(?:'m| am|'re| are)? (?:(?:really|simply|afraid|i|unfortunately|regrettably|sorry|just) )*(?:cannot|can't|can not|am not able to|are not able to|not able to|unable to|won't|will not|'d rather not|would rather not|must decline|have to decline|have to refuse|have to pass|must refuse|must pass|decline|refuse|am not allowed|do not have permission|don't have permission|am not comfortable|do not feel comfortable|don't feel comfortable)\b",
    r"(?i)\bi(?:'m|'d|'ll)? (?:am )?(?:not able|unable|not allowed|not permitted|rather not|not going to|not comfortable)\b",
    r"(?i)\bi'd rather not\b",
    r"(?i)\b(?:this|that|it|which) (?:goes|is) against (?:my|our) (?:guidelines|rules|policy|policies)\b|\bagainst (?:my|our) (?:guidelines|policy|policies)\b",
    r"(?i)\bis (?:something|a request) (?:that )?(?:i|we) (?:won't|will not|cannot|can't|must not)\b",
    r"(?i)\boutside (?:of )?what (?:i|we) (?:may|can|am allowed)\b|\bno answer from me\b|\byou will need to ask (?:a person|someone)\b",
    r"(?i)\bkann ich\b.{0,60}\bnicht\b.{0,30}\b(?:helfen|beantworten|antworten|geben|weiterhelfen|liefern|unterstützen)\b|\bich kann\b.{0,60}\bnicht\b.{0,30}\b(?:helfen|beantworten|antworten|geben|weiterhelfen|liefern)\b|\bich\b.{0,40}\bablehnen\b|\babl?ehnen\b.{0,20}\bmuss\b|\bmuss\b.{0,40}\bablehnen\b|\bich darf\b.{0,60}\bnicht\b",
    r"(?i)\bje (?:ne )?(?:peux|puis|suis)\b.{0,30}\b(?:pas|répondre|aider|refuser|capable)\b.{0,60}\b(?:répondre|aider|demande|fournir|traiter|requête)|\bje (?:dois|préfère|me vois).{0,40}\b(?:refuser|décliner|ne pas)|\bje ne (?:peux|suis) pas\b",
    r"(?i)\b(?:no puedo|no me es posible|no estoy en condiciones de|debo (?:rechazar|negarme)|tengo que (?:rechazar|negarme))\b",
    r"(?i)\bnão (?:posso|consigo|estou autorizad|me é possível)|\b(?:devo|tenho de|tenho que|preciso) recusar\b",
    r"(?i)\bnie (?:mogę|jestem w stanie|wolno mi)\b|\bmuszę odmówić\b|\bodmawiam\b",
    r"(?i)\bя не (?:могу|буду|имею права|в состоянии)|\bне могу (?:помочь|ответить|выполнить|предоставить|с этим)|\bвынужден[а]? отказать|\bотказаться от\b.{0,20}ответа",
    r"我(?:们)?(?:不能|无法|不可以|没有办法|没法)|(?:抱歉|对不起|很遗憾|遗憾).{0,20}(?:不能|无法|没法|不可以)|(?:无法|不能)(?:协助|帮助|回答|提供|满足|处理这)",
    r"(?:お手伝い|お答え|お応え|対応|回答|お力)(?:することは|することが|は|が|に)?(?:できません|できかねます|いたしかねます|致しかねます|なれません)|申し訳.{0,30}(?:できません|できかねます|ません)",
)]
# Sentences that may stand beside a refusal.
POLITE = re.compile(
    r"(?i)^\W*(?:i(?:'m| am)? (?:hope|sorry|apologi[sz]e|understand)|sorry|apologies|unfortunately|regrettably|hmm|thank|thanks|feel free|please|let me know|as an? (?:ai|language|assistant)|you (?:will|may|can|could) |if you|instead|perhaps|maybe|"
    r"ich hoffe|es tut|leider|bitte|gerne|je suis|désol|j'espère|n'hésitez|lo siento|espero|por favor|desculp|lamento|przepraszam|mam nadzieję|proszę|извин|прост|к сожалению|надеюсь|пожалуйста|抱歉|对不起|很抱歉|希望|请|申し訳|すみません|ご了承|どうか)"
)
# Names of the languages, to find the one that a prompt asks for.
NAMES = {
    "en": "english|englisch|anglais|inglés|inglês|angielsk|английск|英语|英文|英語",
    "de": "german|deutsch|allemand|alemán|alemão|niemieck|немецк|德语|德文|ドイツ語",
    "fr": "french|französisch|français|francés|francês|francusk|французск|法语|法文|フランス語",
    "es": "spanish|spanisch|espagnol|español|espanhol|hiszpańsk|испанск|西班牙|スペイン語",
    "pt": "portuguese|portugiesisch|portugais|portugués|português|portugalsk|португальск|葡萄牙|ポルトガル語",
    "pl": "polish|polnisch|polonais|polaco|polonês|polsk|польск|波兰|ポーランド語",
    "ru": "russian|russisch|russe|ruso|russo|rosyjsk|русск|俄语|俄文|ロシア語",
    "zh": "chinese|chinesisch|chinois|chino|chinês|chińsk|китайск|中文|汉语|中国語",
    "ja": "japanese|japanisch|japonais|japonés|japonês|japońsk|японск|日语|日文|日本語",
}
_NAMES = {k: re.compile(f"(?i)(?:{v})") for k, v in NAMES.items()}
_CODE_LINE = re.compile(r"^\s*(?:def |class |async |import |from \S+ import|function |export |const |let |var |#include|static |struct |return\b|@|//|/\*|\*|#|}|{|\"\"\")|[;{}]\s*$|^\s{4,}\S|^\s*[\w.]+ = ")


def plain(response: str) -> str:
    """The response without thinking."""
    s = _THINK.sub("", response)
    return re.sub(r"(?is)\A.*?</(?:think|thinking|thought|reasoning)>", "", s)


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    s = plain(response)
    s = re.sub(r"(?m)^\s*(?:```|~~~)[\w+-]*\s*$|```[\w+-]*", "", s)
    return not re.sub(r"[\s\"'“”„«»‘’`​﻿「」()\[\]{}]+", "", s)


def _normal(s: str) -> str:
    s = re.sub(r"(?m)^\s*(?:>+|[-*•]|\d+[.)])\s+", "", s.casefold())
    return " ".join(re.findall(r"\w+", s))


def _units(s: str) -> list[str]:
    return [w for w, _, _ in langid.words_of(s)] if re.search(r"[぀-ヿ㐀-鿿]", s) else s.split()


def is_copy(prompt: str | None, response: str) -> bool:
    """Nearly all of the response, in runs of words, stands in the prompt, or all that follows a few words of introduction
    and a colon; answers of up to three words aren't judged."""
    if not prompt:
        return False
    led = re.match(r"\s*[^\n:：]{1,40}[:：]\s*(.+)", plain(response), re.S)
    if led and len(_units(rest := _normal(led[1]))) >= 4 and f" {rest} " in f" {_normal(prompt)} ":
        return True
    p, r = _normal(prompt), _normal(re.sub(r"```[\w+-]*", "", plain(response)))
    if not r or not p:
        return False
    if r == p:
        return True
    n = len(_units(r))
    if n < 4:
        return False
    if f" {r} " in f" {p} " and n >= 5 or (f" {p} " in f" {r} " and len(p) >= 0.8 * len(r)):
        return True
    size = 4
    pu, ru = _units(p), _units(r)
    have = {tuple(pu[i : i + size]) for i in range(len(pu) - size + 1)}
    if len(ru) < size + 2:
        return False
    hit = [False] * len(ru)
    for i in range(len(ru) - size + 1):
        if tuple(ru[i : i + size]) in have:
            hit[i : i + size] = [True] * size
    return sum(hit) >= 0.85 * len(ru)


def is_refusal(response: str) -> bool:
    """A sentence that refuses, outside of quotes and code, with hardly anything else being said."""
    s = plain(response).strip()
    if s.startswith("{"):
        try:
            s = ". ".join(v for v in json.loads(s).values() if isinstance(v, str))
        except (ValueError, AttributeError):
            pass
    if "```" in s:
        s = _FENCE.sub(" ", s)
    s = _QUOTED.sub(" ", s.replace("’", "'")) if not re.fullmatch(r"\s*\"[^\"]*\"\s*", s) else s.strip().strip('"')
    sentences = [x.strip() for x in _SENTENCE.findall(s) if x.strip(" .!?。！？\n\t-*>:\"'")]
    bad = [any(r.search(x) for r in REFUSALS) for x in sentences]
    if not any(bad):
        return False
    rest = [x for x, b in zip(sentences, bad) if not b and not POLITE.match(x)]
    return len(" ".join(rest)) <= 60 or len(rest) <= 1


def prose(text: str) -> str:
    """The text without code: fences, code lines, JSON keys, quotes of other texts stay."""
    s = _FENCE.sub("\n", text)
    t = s.strip()
    if t[:1] in "{[":
        t = re.sub(r"\"[\w ]{1,30}\"\s*:", " ", t)
        return re.sub(r"[{}\[\]\":,]+", " ", t)
    return "\n".join(x for x in s.split("\n") if not _CODE_LINE.search(x))


def prompt_language(prompt: str | None) -> str | None:
    if not prompt:
        return None
    first = re.split(r"\n\s*\n", prompt, maxsplit=1)
    if len(first) > 1 and any(_CODE_LINE.search(x) for x in first[1].split("\n")[:2]) and len(langid.words_of(first[0])) >= 4:
        return langid.main_language(first[0])
    return langid.main_language(prose(prompt))


def wrong_language(prompt: str | None, response: str) -> bool:
    want = prompt_language(prompt)
    text = prose(plain(response))
    if want is None or len(text.strip()) < 10:
        return False
    got = langid.main_language(text)
    words = langid.words_of(text)
    if got is None or got == want or len(words) < 4:
        return False
    if got not in ("zh", "ja", "ru") and langid.evidence(text, got) < max(2, len(words) // 8):
        return False
    return not _NAMES[got].search(prompt)


def ends_well(response: str) -> bool:
    """Whether the response ends as answers end: with a full stop, a closed fence, quote or bracket, or as a short word."""
    s = plain(response).rstrip()
    if s.count("```") % 2:
        return False
    t = re.sub(r"```[\w+-]*", "", s).strip() if s.startswith("```") else s
    if t[:1] in "{[":
        try:
            json.loads(t)
            return True
        except ValueError:
            return not t[:2].strip("{[ \n").startswith('"') and t[-1:] in "}]"
    if s.endswith("```"):
        return True
    if re.search(r"(?:^|\s|\()(?:https?://\S+|(?:[\w.-]+/)+[\w.-]+\.\w{1,5}|[A-Z]{2,}-\d+|#\d+)$", s):
        return True  # a reference
    if s[-1:] in ".!?。！？…）)]}>\"'”»」；;*":
        return True
    return len(langid.words_of(s)) <= 2


def tail_word(response: str) -> str | None:
    """The last word of a response that doesn't end well, unless it is a list whose items all lack an end."""
    s = plain(response).rstrip()
    m = re.search(r"([^\W\d_]+)$", s)
    return m.group(1).casefold() if m else None


def _is_list(response: str) -> bool:
    lines = [x for x in plain(response).strip().split("\n") if x.strip()]
    items = [x for x in lines if re.match(r"\s*(?:\d+[.)]|[-*•])\s", x)]
    return len(items) >= 2 and len(items) >= len(lines) - 1 and sum(x.rstrip()[-1] not in ".!?。！？" for x in items[:-1]) > 0


_JOINERS = set("the a an and or of to in is are with that which before after until when than der die das und oder den dem le la les un une et de du des que el los las y o os as e и в на".split())


def _goes_on(longer: str, n: int) -> bool:
    """Whether a text goes on inside a sentence after n characters."""
    before, after = longer[:n].rstrip(), longer[n:]
    return bool(after.strip()) and not ("\n" in longer[len(before) : n] + after[: len(after) - len(after.lstrip())] or before[-1:] in ".!?。！？…" and (after[0].isspace() or before[-1] in "。！？" or n > len(before)))


def shortened(responses: DataFrame) -> DataFrame:
    """(response, inside) of the distinct texts that are a proper prefix of another one, by comparing neighbours in text order; `inside` where the next one goes on inside a sentence."""
    parts = max(1, int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = responses.select("response").where(F.length("response") >= MIN_PREFIX).distinct()
    placed = cut(rows.repartitionByRange(parts, "response").sortWithinPartitions("response").withColumn("part", F.spark_partition_id()))
    # one row a partition: the first text of each, so that the last text of the partition before meets its successor
    firsts = {r["part"]: r["first"] for r in placed.groupBy("part").agg(F.min("response").alias("first")).collect()}
    order = sorted(firsts)
    after = {p: firsts[q] for p, q in zip(order, order[1:])}

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part = None, None
        for b in batches:
            out = []
            for text, p in zip(b["response"], b["part"]):
                if last is not None:
                    nxt = text if p == part else after.get(part, "")
                    if nxt.startswith(last):
                        out.append((last, _goes_on(nxt, len(last))))
                last, part = text, p
            yield pd.DataFrame(out, columns=["response", "inside"])
        if last is not None and after.get(part, "").startswith(last):
            yield pd.DataFrame([(last, _goes_on(after[part], len(last)))], columns=["response", "inside"])

    return placed.sortWithinPartitions("part", "response").mapInPandas(neighbours, "response string, inside boolean")


def length_limits(calls: DataFrame) -> DataFrame:
    """(completion_tokens) that come SPIKE times more often than the lengths within 20 around them: limits, not chance."""
    n = calls.where(F.col("completion_tokens") > 16).groupBy("completion_tokens").agg(F.count("*").alias("n"))
    near = n.select(F.explode(F.sequence(F.col("completion_tokens") - 20, F.col("completion_tokens") + 20)).alias("at"), F.col("completion_tokens").alias("of"), F.col("n").alias("m"))
    mean = near.where(F.col("at") != F.col("of")).groupBy("at").agg((F.sum("m") / 40).alias("mean"))
    spikes = n.join(mean, n["completion_tokens"] == mean["at"], "left").where((F.col("n") >= 10) & (F.col("n") > SPIKE * F.coalesce("mean", F.lit(0.0))))
    return spikes.select("completion_tokens")


def defects(calls: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, defect): one row per call with a broken response."""
    kind = calls.schema[id_col].dataType.simpleString()
    rows = calls.select(F.col(id_col).alias("id"), "prompt", "response", "completion_tokens").distinct()

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, p, r, n in zip(b["id"], b["prompt"], b["response"], b["completion_tokens"]):
                if is_empty(r):
                    d = "empty"
                elif is_copy(p, r):
                    d = "copy"
                elif is_refusal(r):
                    d = "refusal"
                elif wrong_language(p, r):
                    d = "wrong_language"
                else:
                    d = None
                open_ = d is None and not ends_well(r)
                word = tail_word(r) if open_ else None
                sure = open_ and (word is None or not _is_list(r) or word in _JOINERS or plain(r).count("```") % 2 == 1)
                out.append((i, d, open_, sure, word, r if d is None else None, n))
            yield pd.DataFrame(out, columns=["id", "defect", "open", "sure", "word", "response", "completion_tokens"])

    judged = cut(rows.mapInPandas(rules, f"id {kind}, defect string, open boolean, sure boolean, word string, response string, completion_tokens double"))
    closed = judged.where("defect is not null").select("id", "defect")
    open_ = judged.where("defect is null and open")
    sure = open_.where("sure").select("id")
    maybe = open_.where("not sure")
    ending = maybe.groupBy("word").agg(F.countDistinct("response").alias("m"))
    seen = calls.select("response").distinct().select(F.explode(F.split(F.lower("response"), r"[^\p{L}]+")).alias("word"))
    # A word is whole where less than half of its uses end such lists.
    known = seen.join(ending, "word").groupBy("word").agg(F.count("*").alias("n"), F.max("m").alias("m")).where("m < 0.5 * n").select("word")
    cut_word = maybe.join(known, "word", "left_anti").select("id")
    short = judged.where("defect is null").join(shortened(calls).where("inside"), "response", "left_semi").select("id")
    limits = length_limits(calls).withColumn("completion_tokens", F.col("completion_tokens").cast("double"))
    # At a limit, an item list whose other items are longer than the last one by far is taken as stopped.
    last_line = F.element_at(F.split(F.regexp_replace("response", r"\s+$", ""), "\n"), -1)
    at_limit = maybe.join(limits, "completion_tokens", "left_semi").where(F.length(last_line) < 14).select("id")
    truncated = sure.unionByName(cut_word).unionByName(short).unionByName(at_limit).withColumn("defect", F.lit("truncated"))
    return closed.unionByName(truncated).distinct()

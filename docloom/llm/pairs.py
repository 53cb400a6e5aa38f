"""Broken question-answer pairs (problem 1).

- copies: the answer is compressed with zstandard, with the question and common
  lead-ins as dictionary, and the question with the answer as dictionary. What
  is new in the answer, in its last clause and in the question, in compressed
  bytes, is weighed by a logistic model that learns from questions of the data,
  changed as copies are, and from answers that only begin like them;
- refusals: an answer of nothing but clauses that the refusal dictionary knows,
  at least one of them a refusal and the rest courtesy. A refusing clause holds
  a word of inability and a word of answering, in any combination;
- languages: scripts, and dictionaries of function words of some twenty
  languages, on the prose only (without quotations, tables, citations, addresses and codes);
- truncation: a model of terminal contexts with back-off. It learns from a
  bounded sample of answers how texts end, and from the same answers cut at
  random places and after an item's mark how broken ones do; answers that its first fit finds broken
  take no part in the second.

The first defect in the order empty, refusal, copies_question, wrong_language,
truncated is a pair's kind. A null answer or payload is empty; a payload that
is no whole JSON object is truncated; a null or wordless question can't be
copied and has no language. A row that comes twice gives one case. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import hashed_sample, spread

#: Pairs that the models learn from, those with the smallest hashed keys.
SAMPLE = 4000

_CITATION = re.compile(r"\[\d{1,3}\]")
_WORDS = re.compile(r"[^\W_]")

# ---- refusals ---------------------------------------------------------------------------------------------------------
_CLAUSE = re.compile(r"[。！？!?；;\n，,：:—]+|\.(?!\w)|(?<= )(?=but |however |aber |jedoch |pero |mais )|(?=但是|但|不过|然而)")
_UNABLE_ZH = "无法|不能|没有办法|没办法|没法|不便|难以|无从|恕不|恕难|恕我|拒绝|谢绝|婉拒|不予|不愿|不想|不会|不宜|不方便|不打算|无权|无可奉告|没有权限|没有资格|未获授权|不被允许|不允许我|不知道如何|不知道怎么|不适合"
_ANSWER_ZH = "作答|回答|回应|回复|答复|解答|奉告|告知|告诉|透露|披露|提供|给出|协助|帮助|帮忙|帮您|帮你|判断|评论|置评|讨论|谈论|谈|说明|解释|分享|处理您|处理这|满足|受理|配合|涉及"
_UNABLE_EN = r"cannot|can ?not|can't|cant|could not|couldn't|won't|will not|wouldn't|would not|unable|not able|rather not|prefer not|not (?:allowed|permitted|authori[sz]ed|comfortable|willing|going|supposed|prepared|equipped|in a position|at liberty)|may not|must not|mustn't|shouldn't|should not|don't want|do not wish|don't wish|declin\w*|refus\w*|have to pass|must pass"
_ANSWER_EN = r"answer|answering|help|helping|assist|assisting|provide|providing|share|sharing|discuss|discussing|comment|commenting|respond|responding|reply|replying|disclose|disclosing|reveal|revealing|tell|telling|talk|talking|say|speak|speaking|comply|advise|advice|give|offer|go into|get into|engage|address|fulfil\w*|process|support|on this|on that"
_ANSWER_DE = r"beantwort\w*|antwort\w*|weiterhelfen|helfen|geben|erteilen|sagen|mitteilen|äußern|verraten|nennen|auskunft|angaben|stellung|sprechen|reden|liefern|eingehen|kommentieren|unterstützen"
_REFUSES = re.compile(
    rf"({_UNABLE_ZH}).{{0,12}}?({_ANSWER_ZH})|无可奉告|爱莫能助|超出了?.{{0,16}}(范围|能力|权限)|不在.{{0,16}}(范围|能力|职责)|(没有|未能?|无|缺乏|缺少|找不到|查不到|检索不到)(找到|检索到|查到|查询到|发现)?.{{0,12}}(信息|可用依据|相关内容|资料|答案|依据|记录)"
    rf"|\b(?:{_UNABLE_EN})\b.*\b(?:{_ANSWER_EN})\b"
    r"|\boutside (?:of )?(?:what i|my|the scope)|\bbeyond (?:what i|my|the scope)|\bnothing in .*(?:lets me|about|on that)|\bno (?:relevant |matching |further )?(?:information|data|answer|comment|evidence)\b|\b(?:don't|do not) have (?:any |the |enough |sufficient )*(?:information|access|data|permission)|\bnot (?:something|a topic) (?:i|we)\b"
    rf"|\b(?:kann|können|darf|dürfen|möchte|will|werde|werden|mag)\b.*\b(?:nicht|nichts|keine|keinen|kein)\b.*\b(?:{_ANSWER_DE})\b|\b(?:nicht|nichts|keine)\b.*\b(?:{_ANSWER_DE})\b.*\b(?:kann|können|darf|dürfen|möchte|will)\b|\bkeine (?:auskunft|antwort|angaben|informationen)\b|\bsteht (?:dazu |darüber )?nichts\b|\b(?:nicht|nichts) (?:dazu |darüber )?(?:beantworten|sagen|mitteilen)\b|\blehne\b.*\bab\b|\baußerhalb (?:meiner|meines|unserer)\b"
    r"|\b(?:ne peux pas|ne puis|ne souhaite pas|suis incapable|refuse de)\b.*\b(?:répondre|aider|fournir|dire|donner|commenter|partager)|\b(?:no puedo|no podemos|no me es posible|no quiero|prefiero no|me niego a)\b.*\b(?:responder|contestar|ayudar|proporcionar|dar|decir|comentar|compartir)"
    r"|お答えできません|回答できません|お手伝いできません|ответить не могу|не могу (?:ответить|помочь|предоставить)"
)
_COURTESY = re.compile(
    r"(真的|很|非常|十分|实在)?(抱歉|遗憾|对不起|不好意思|见谅|请谅解|敬请谅解|请见谅)|您好|你好|(我)?(只)?(是|作为).{0,10}(助手|助理|模型|机器人|系统)|(根据|依据|按照|在|从)?(我的|现有|目前|已有|提供的|知识库).{0,2}(资料|信息|材料|权限|规定|中)?中?(来看|里)?|(对于|关于|针对)?(这|那|该|此|您)(个|类|项|的)?.{0,2}(问题|请求|话题|要求|内容)"
    r"|请?您?(联系|咨询|询问|尝试|改问|换|查阅|查询|参考|另行).*|建议您?.*|如有.*|如果您?.*(请|可以).*|(谢谢|感谢).*|还有.*(吗|么)|有什么.*(吗|么)|希望.*谅解|因此|所以|目前|暂时"
    r"|(but |and )?(i'm|i am|we are|we're)?( so| very| really)? ?sorry( about that| for that)?|unfortunately|regrettably|sadly|i'm afraid|i am afraid|hello|hi|as an? (ai|assistant|language model|chatbot)\b.*|i'm (just|only) an? .*|please (contact|ask|consult|try|reach|refer|check|feel free|rephrase|understand).*|is there (anything|something) else.*|(can|may) i help.*|(let me know|feel free).*|try (another|a different).*|(my )?apologies|i apologi[sz]e.*|thank you.*|thanks.*|if you (need|have|want).*|at (this|the) (time|moment)|for (that|this) reason|at this point"
    r"|leider|bedauerlicherweise|hallo|guten tag|(es )?tut mir (sehr |wirklich )?leid|(ich )?(bitte um )?(entschuldigung|verständnis)|ich bedauere.*|bitte (wenden|kontaktieren|fragen|versuchen|haben|stellen).*|daher|deshalb|als (ki|assistent|sprachmodell).*|vielen dank.*|danke.*|kann ich (ihnen )?sonst.*|gibt es .*(sonst|noch).*|bei (weiteren )?fragen.*"
    r"|désolée?|je suis désolée?|malheureusement|veuillez .*|lo siento|lamentablemente|por favor .*|disculpe|申し訳ありません(が)?|すみません|извините|к сожалению"
)


def refuses(answer: str) -> bool:
    """Whether the answer declines and says nothing else of substance."""
    low = _CITATION.sub("", answer).lower().replace("’", "'")
    if not _REFUSES.search(low):
        return False
    clauses = [c for c in (c.strip(" \t\"'“”*_()（）") for c in _CLAUSE.split(low)) if _WORDS.search(c)]
    for lead in ("but ", "and ", "但是", "但", "不过", "aber ", "so ", "therefore "):
        clauses = [c.removeprefix(lead) for c in clauses]
    refusal = [bool(_REFUSES.search(c)) for c in clauses]
    return any(refusal) and all(r or not c or _COURTESY.fullmatch(c) for c, r in zip(clauses, refusal))


# ---- copies -----------------------------------------------------------------------------------------------------------
_LEADS = "答 问 回答 回答如下 问题 您的问题是 您问的是 你问的是 您想知道 您想了解的是 关于 针对 以下是 您好 问题如下 原问题 用户问题 重复一遍 you asked your question was your question is the question is question answer you want to know here is regarding about ihre frage lautet ihre frage war frage antwort sie fragten sie möchten wissen zu ihrer frage"
_SETTINGS = zstandard.ZstdCompressionParameters(window_log=20, hash_log=12, chain_log=12, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
_FRAME = 17  # bytes of a frame that holds one match


def letters(text: str) -> str:
    return "".join(_WORDS.findall(_CITATION.sub("", text).casefold()))


_LEAD_BYTES = letters(_LEADS).encode()


def _packed(text: bytes, book: bytes) -> int:
    known = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return max(0, len(zstandard.ZstdCompressor(compression_params=_SETTINGS, dict_data=known).compress(text)) - _FRAME)


def measures(question: str, answer: str) -> np.ndarray | None:
    """What is new, in compressed bytes by the other text as dictionary: in the answer and in its end (the last clause, at most a third of it), each as a share of its size, the first to the third power, in the
    end by the question's size, in an answer whose end has anything new, and in the question; None if too little of the
    question's character pairs is in the answer for a copy."""
    q, a = letters(question), letters(answer)
    if not q or not a:
        return None
    own = {q[i : i + 2] for i in range(len(q) - 1)} or {q}
    there = sum(x in a for x in own)
    if there < 0.5 * len(own):
        return None
    last = next((c for c in (letters(x) for x in reversed(re.split(r"[。！？!?\n：:”]+|\.(?!\w)", answer))) if c), a)
    last = last[-max(4, len(a) // 3) :]
    raw, asked, end = a.encode(), q.encode(), last.encode()
    book = _LEAD_BYTES + asked
    fresh = _packed(raw, book)
    # behind the question, as a short frame of its own tells little; a word or two are new unless the question ends with them
    known = q.endswith(last) if len(end) <= 9 else last in q or last in letters(_LEADS)
    tail = 0 if known else max(0, _packed(asked + end, book) - _packed(asked, book) - 3) if len(end) > 9 else len(end)
    return np.array([1.0, (fresh / len(raw)) ** 3, tail / len(end), min(1.0, tail / len(asked)), fresh / len(raw) * (tail > 0), _packed(asked, raw) / len(asked)])


def _copies(q: str, rng: random.Random) -> Iterator[str]:
    """Copies of a question, as they come."""
    words = q.split(" ") if " " in q.strip() else list(q)
    cut = rng.randrange(1, max(2, len(words)))
    join = " " if " " in q.strip() else ""
    yield rng.choice([q, q.upper(), q.lower(), q.rstrip("?？"), q + "[1]", f"“{q}”"])
    yield rng.choice(["您的问题是：", "问题：", "关于", "Your question: ", "You asked: ", "Ihre Frage: ", "这里把问题再说一遍：", "To repeat: ", "Nochmals die Frage: ", "请允许我先重复您刚才提出的问题：", "I would like to state your question once more: ", "Ich wiederhole gern noch einmal Ihre Frage: ", "用户想知道的内容如下：", "The user wrote: ", "Der Nutzer schrieb: "]) + rng.choice([q, q.rstrip("?？"), f"“{q}”"])
    yield q + join * 2 + q
    yield (q + "\n") * rng.randrange(3, 20)
    yield join.join(words[cut:] + words[:cut])
    yield join.join([*words[:cut], rng.choice(["also", "then", "noch", "so", "bitte"] if join else ["也", "还", "又", "呢"]), *words[cut:]])
    yield join.join(words[: max(1, int(len(words) * rng.uniform(0.7, 0.95)))])


def _answers(q: str, a: str, other: str, rng: random.Random) -> Iterator[str]:
    """Answers that are none: the real one, the question with an answer behind it, a statement made from it."""
    yield a
    yield q + " " + a
    yield a + " " + q
    yield q + rng.choice(["是", "不是", "需要", "每周一次", " Yes", " No", " Twice a week", " Ja", " Nein", f" {rng.randrange(2, 99)}", f"{rng.randrange(2, 99)}天"]) + rng.choice(["", "。", "."])
    yield q + " " + rng.choice(["不需要", "每月两次", "由主管确认", "Every day", "By the manager", "After two weeks", "Jeden Tag", "Vom Leiter", other[: rng.randrange(4, 16)]])
    yield rng.choice(["关于", "对于", "Regarding ", "Zu "]) + q.rstrip("?？") + rng.choice(["，", ": ", ", "]) + other[: rng.randrange(12, 60)]
    half = q[: int(len(q) * rng.uniform(0.3, 0.6))]
    yield half + rng.choice([other[: len(half) + 4], f"{rng.randrange(2, 999)}{rng.choice(['天', '台', '次', ' days', ' Tage'])}"])


def _fit_copies(pairs: list[tuple[str, str]], seed: int = 5, rounds: int = 600) -> np.ndarray:
    """Weights of the logistic model of copies, from changed questions and from their answers."""
    rng, xs, ys = random.Random(seed), [], []
    for i, (q, a) in enumerate(pairs):
        other = pairs[(i + 1) % len(pairs)][1]
        for made, y in ((_copies(q, rng), 1.0), (_answers(q, a, other, rng), 0.0)):
            for text in made:
                # an answer of the data may itself be a copy: only what differs from the question teaches what an answer is
                if (y or letters(q) not in letters(text) or len(letters(text)) > len(letters(q))) and (m := measures(q, text)) is not None:
                    if y or m[1] > 0.02:
                        xs.append(m)
                        ys.append(y)
    if not xs or len(set(ys)) < 2:
        return np.array([4.0, -2.0, -10.0, -6.0, -12.0, -12.0])
    x, y = np.array(xs), np.array(ys)
    weight = np.where(y > 0, 1.0 / y.sum(), 1.0 / (len(y) - y.sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def copies(question: str, answer: str, weights: np.ndarray) -> bool:
    """Whether the answer only repeats the question."""
    m = measures(question, answer)
    return m is not None and float(m @ weights) > 0


# ---- languages --------------------------------------------------------------------------------------------------------
# Frequent function words.
_FUNCTION_WORDS = {
    "en": "the a an of to and or in on for with within without by from at is are was were be been has have had what who how which when does do did please about after before every each say says rules yes no days day week weeks month months twice once not this that these those it its under over during through across beside between despite toward near against i my me you your we they he she will can should would if then than there their",
    "de": "der die das den dem des ein eine einen einem einer und oder im auf für mit ohne durch gegen unter über neben hinter nach bei von vom zu zum zur ist sind war wird werden wurde hat haben welche welcher wer wie was wann nicht ja nein tag tage tagen woche wochen monat monate bitte ich sie es er wir gelten gilt sich auch sowie um aus als wenn dass kann noch nur",
    "fr": "le la les un une des du de et ou à au aux en dans sur pour avec sans par est sont était être ont avait qui que quoi dont où ne pas plus ce cette ces il elle nous vous ils leur son sa ses se comme mais si tout chaque jour jours après avant",
    "es": "el la los las un una unos de del y o a al en con sin por para es son era ser fue ha han que quien como cuando no más este esta estos su sus se lo le nos pero si todo cada día días después antes hay muy también",
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas com sem por para é são era ser foi tem que quem como quando não mais este esta seu sua se mas também cada dia dias depois antes há muito pelo pela",
    "it": "il lo la i gli le un uno una di del della dei e o a al in nel nella con senza per è sono era essere ha hanno che chi come quando non più questo questa suo sua si ma anche ogni giorno giorni dopo prima molto",
    "nl": "de het een van en of in op voor met zonder door is zijn was worden heeft wie wat hoe wanneer niet meer dit dat deze ik je hij zij wij ook als maar elke dag dagen na bij naar uit nog",
    "sv": "och eller i på för med utan av är var blir har hade vem vad hur när inte mer detta den det de jag du han hon vi också men varje dag dagar efter före att som till från ett en",
    "pl": "i lub w na dla z bez przez jest są był być ma kto co jak kiedy nie więcej ten ta to jego jej się ale także każdy dzień dni po przed do od że który oraz",
    "tr": "ve veya bir bu şu için ile olan olarak da de mi ne nasıl değil daha çok her gün sonra önce var yok gibi kadar ise ama",
    "fi": "ja tai on ovat oli ei että se tämä joka mitä kuinka kun mutta myös jokainen päivä päivää jälkeen ennen ovatko hän minä sinä",
    "cs": "a nebo v na pro s bez je jsou byl být má kdo co jak kdy ne více tento tato se ale také každý den dní po před do od že který",
    "ro": "și sau în pe pentru cu fără de este sunt era fi are cine ce cum când nu mai acest această se dar de fiecare zi zile după înainte la din",
    "vi": "và hoặc của trong cho với không là được có ai gì như khi này đó các những một ngày sau trước thì cũng",
    "id": "dan atau di ke dari untuk dengan tanpa adalah yang ini itu tidak akan telah siapa apa bagaimana setiap hari setelah sebelum pada",
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in _FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _BY_WORD.setdefault(_w, []).append(_lang)
_NAMES = {
    "en": "英文 英语 english englisch", "de": "德文 德语 german deutsch", "zh": "中文 汉语 简体中文 chinese chinesisch", "fr": "法文 法语 french französisch", "es": "西班牙文 西班牙语 spanish spanisch", "ja": "日文 日语 japanese japanisch", "ko": "韩文 韩语 korean koreanisch",
    "ru": "俄文 俄语 russian russisch", "it": "意大利文 意大利语 italian italienisch", "pt": "葡萄牙文 葡萄牙语 portuguese portugiesisch",
}
_ANSWERS = r"(回答|作答|答复|写|说明|版本|回复)"
_REQUESTS = tuple(
    (lang, re.compile("|".join([
        *(rf"(用|以|请给出|给出|翻译成|改成)(一份)?{n}{_ANSWERS}?|{n}版" for n in names.split() if not n.isascii() and not n[0].islower()),
        *(rf"(answer|reply|respond|write|response)\b[^.?!]*? in {n}|auf {n}" for n in names.split() if n[0].islower() or n.isascii()),
    ]), re.I)) for lang, names in _NAMES.items()
)
_NOT_PROSE = re.compile(r"“[^”]*”|\"[^\"\n]*\"|「[^」]*」|『[^』]*』|„[^“”]*[“”]|«[^»]*»|`[^`]*`|^\s*\|.*$|\[\d{1,3}\]|\S+@\S+|https?://\S+|\S*\d\S*(?![぀-鿿])", re.M)
_HAN, _KANA, _LATIN = re.compile(r"[㐀-鿿]"), re.compile(r"[ぁ-ヿ]"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-žǍ-ǜƠ-ưẠ-ỹ]+")
_SCRIPTS = {"ko": re.compile("[\uac00-\ud7a3]"), "cyrillic": re.compile("[\u0400-\u04ff]"), "greek": re.compile("[\u0370-\u03ff]"), "arabic": re.compile("[\u0600-\u06ff]"), "hebrew": re.compile("[\u0590-\u05ff]"), "thai": re.compile("[\u0e00-\u0e7f]"), "hindi": re.compile("[\u0900-\u097f]")}


def language(text: str) -> str | None:
    """The language of the prose by script and function words; ``latin`` if many Latin words are of none that is known; None if it has too few to tell."""
    prose = _NOT_PROSE.sub(lambda m: re.sub(r"[A-Za-z0-9@._+-]", "", m[0]) if m[0][0] not in "“\"「『„«`|[ \t" else " ", text)
    han, kana = len(_HAN.findall(prose)), len(_KANA.findall(prose))
    words = [w.lower() for w in _LATIN.findall(prose)]
    if kana > 0.15 * (han + kana) and han + kana > 2 * len(words):
        return "ja"
    if not prose.isascii():
        script, n = max(((k, len(p.findall(prose))) for k, p in _SCRIPTS.items()), key=lambda x: x[1])
        if n > 1.5 * han and n > 3 * len(words) and n >= 6:
            return "ru" if script == "cyrillic" else script
    if han / 2 >= max(1, len(words)):
        return "zh"
    if han and not words:
        return "zh"
    hits: Counter[str] = Counter()
    for w in words:
        for lang in _BY_WORD.get(w, ()):
            hits[lang] += 1
        if any(c in "äöüß" for c in w):
            hits["de"] += 1
    # languages beside the two main ones need a clear lead, as short words are shared
    (first, n), second = hits.most_common(1)[0] if hits else ("", 0), max(hits["en"], hits["de"])
    if first not in ("en", "de") and n >= 3 and n >= 2 * second and n >= 0.2 * len(words):
        return first
    if hits["en"] != hits["de"]:
        return "en" if hits["en"] > hits["de"] else "de"
    return "latin" if len(words) >= 8 and not n else None


def asked_language(question: str) -> str | None:
    for lang, pattern in _REQUESTS:
        if pattern.search(question):
            return lang
    return language(question)


def wrong_language(question: str, answer: str) -> bool:
    """Whether both languages can be told and differ; Latin prose of no known language is wrong to a question in another script only."""
    wanted, got = asked_language(question), language(answer)
    if not wanted or not got or wanted == got or wanted == "latin":
        return False
    return got != "latin" or wanted in ("zh", "ja", "ru", *_SCRIPTS)


# ---- truncation -------------------------------------------------------------------------------------------------------
_TAIL = re.compile(r"[\s​]*(\[\d{1,3}\]|[\"”’」』*]|[\s​])*$")
_OPEN, _CLOSE = "（([{“「『【《", "）)]}”」』】》"
_ITEM = re.compile(r"\n\s*(\d{1,3}[.、)）]|[-*•])(?=\s)")
_MARKER = re.compile(r"(\d{1,3}[.、)）]|[-*•]|\|[^|\n]*)$")


def _kind(c: str) -> str:
    if c in "。！？!?.；;":
        return "stop"
    if c in "…":
        return "dots"
    if c in "，,、：:—-":
        return "going on"
    if c in _OPEN:
        return "open"
    if c in _CLOSE:
        return "close"
    if c == "|":
        return "bar"
    if c.isdigit():
        return "digit"
    return "han" if _HAN.match(c) else "letter" if c.isalpha() else "other"


def contexts(answer: str) -> tuple[str, str]:
    """Where an answer ends, the more specific context first: a short answer as a whole with figures as 9, and the
    kind of the last character with whether a bracket is open, the last line is only an item's mark, and the answer is short."""
    body = _TAIL.sub("", answer)
    line = body.rpartition("\n")[2].strip()
    depth = sum(body.count(a) - body.count(b) for a, b in zip(_OPEN, _CLOSE))
    last = "dots" if body.endswith(("...", "。。", "…")) else _kind(body[-1]) if body else "none"
    bare = bool(_MARKER.fullmatch(line)) and line.count("|") < 2
    short = len(body) <= 16
    return f"whole:{re.sub(r'[0-9]+', '9', body).lower()}" if short else "", f"state:{last},{depth > 0},{bare},{short}"


#: Complete short answers, as they begin any sample. Figures are written 9.
_SHORT = "是 否 不是 需要 不需要 可以 不可以 有 没有 无 每周一次 每月一次 每天 每年 9台 9个月 9天 9次 9人 9件 9项 9份 9米 9吨 9箱 9批 9个 9小时 9千瓦 yes no twice_a_week once_a_month daily weekly 9_days 9_months 9_pieces ja nein 9_tage 9_monate zweimal_pro_woche täglich"


def _train(answers: list[str], seed: int = 11) -> dict[str, float]:
    """Log odds of complete against broken for every context that was seen three times.

    Complete: the answers and the short answers above. Broken: the answers cut
    at random places, as they are, with marks of omission and within a bracket. An answer whose
    whole is a known context tells nothing about its kind of ending.
    """
    rng = random.Random(seed)
    ends = [contexts(a) for a in answers]
    broken = [contexts(a[: rng.randrange(4, len(a) - 4)].rstrip() + end) for a in answers if len(a) > 24 for end in ("", "", "……", "...")]
    # and broken within brackets and behind an item's mark, which few cuts hit
    for a in answers:
        if len(a) > 24:
            k = rng.randrange(12, len(a) - 4)
            broken.append(contexts(a[: k // 2] + rng.choice(_OPEN) + a[k // 2 : k].rstrip()))
        broken += [contexts(a[: m.end()]) for m in list(_ITEM.finditer(a))[1:]]
    whole = Counter(w for w, _ in ends if w) + Counter(contexts(s.replace("_", " "))[0] for s in _SHORT.split() for _ in range(3))
    cut = Counter(w for w, _ in broken if w)
    known = {w for w in whole + cut if w and whole[w] + cut[w] >= 3}
    states, cuts = Counter(s for w, s in ends if w not in known), Counter(s for w, s in broken if w not in known)
    n, m = len(ends) + 1, len(broken) + 1
    odds = {}
    for good, bad, keys in ((whole, cut, known), (states, cuts, {s for s in states + cuts if states[s] + cuts[s] >= 3})):
        odds |= {c: math.log((good[c] + 0.3) / n * m / (bad[c] + 0.3)) for c in keys}
    return odds


def train(answers: list[str]) -> dict[str, float]:
    """The terminal-context model of the answers, without those that a first model finds broken."""
    first = _train(answers)
    return _train([a for a in answers if not truncated(a, first)] or answers)


def truncated(answer: str, odds: dict[str, float]) -> bool:
    """Whether the answer breaks off, by the most specific of its contexts that the model knows. A context it
    never saw is complete if it ends with a full stop or a table row and nothing is open."""
    whole, state = contexts(answer)
    unseen = 1.0 if state.startswith(("state:stop,False,False", "state:bar,False,False")) else -1.0
    return odds.get(whole, odds.get(state, unseen)) < 0


# ---- the operator -----------------------------------------------------------------------------------------------------
def payload_answer(payload: str | None) -> tuple[str, str | None]:
    """(state, answer) of a cached payload: whole, cut or empty."""
    if payload is None or not payload.strip():
        return "empty", None
    try:
        value = json.loads(payload)
    except ValueError:
        return "cut", None
    answer = value.get("answer") if isinstance(value, dict) else None
    return "whole", answer if isinstance(answer, str) else None


@dataclass(frozen=True)
class Models:
    """What is learnt from a sample of the pairs: odds of terminal contexts, and weights of the copies' measures."""

    odds: dict[str, float]
    copy: np.ndarray


def learnt(pairs: list[tuple[str | None, str]]) -> Models:
    """Models of (question, answer) pairs."""
    good = [(q or "", a) for q, a in pairs if a and _WORDS.search(_CITATION.sub("", a))]
    asked = [(q, a) for q, a in good if len(letters(q)) >= 4][:600]
    return Models(train([a for _, a in good]), _fit_copies(asked))


def defect(question: str | None, answer: str | None, models: Models) -> str | None:
    """The kind of defect of a pair, or None."""
    if answer is None or not _WORDS.search(_CITATION.sub("", answer)):
        return "empty"
    if refuses(answer):
        return "refusal"
    question = question or ""
    if copies(question, answer, models.copy):
        return "copies_question"
    if wrong_language(question, answer):
        return "wrong_language"
    return "truncated" if truncated(answer, models.odds) else None


def fitted(pairs: DataFrame, sample: int = SAMPLE) -> Models:
    """The models of a bounded sample of the pairs."""
    rows = hashed_sample(pairs.where(F.length("answer") > 0), sample, "key", "answer").select("question", "answer", "cached").collect()
    return learnt([(q, payload_answer(a)[1] if cached else a) for q, a, cached in rows])


def broken(pairs: DataFrame) -> DataFrame:
    """(key, source, defect) of pairs(key, source, question, answer, cached), where a cached answer is a JSON payload."""
    models = pairs.sparkSession.sparkContext.broadcast(fitted(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, a, cached in zip(b.column("question").to_pylist(), b.column("answer").to_pylist(), b.column("cached").to_pylist()):
                state, text = payload_answer(a) if cached else ("whole", a)
                out.append("truncated" if state == "cut" else defect(q, text, models.value))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), pa.array(out, pa.string())], names=["key", "source", "defect"])

    rows = spread(pairs.select("key", "source", "question", "answer", "cached"))
    return rows.mapInArrow(run, "key string, source string, defect string").where("defect is not null").distinct()

"""Pages of repeated keywords, link lists or product tags, told from speech by a prose-trained n-gram model.

A text is taken apart into lines of speech, and a line into function words (by themselves) and classes of all other
words, marks and links. A trigram model of these symbols is trained on the documents that read like prose. Lines whose
perplexity under it lies outside the range of prose are keyword lines; pages with mostly such words are reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import only, spread, written

# fixed values: function words of six languages
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for with from and or but not no is are was were be been am do did does have has had will would can could must i you he she it we they me him her us them my your his its our their this that these those what who where when why how if so as than then there here",
    "es": "el la los las un una unos de del al en con por para sin y o pero no es son era fue está están hay ser yo tú él ella nosotros ellos me te se lo le les mi tu su nos que qué quién dónde cuándo cómo cuánto si más ya muy aquí allí",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren sein bin habe hat haben wird will kann muss ich du er sie es wir ihr mir dir ihm uns mein dein mich dich zu im am vom zum von mit auf für aus bei nach vor um so was wer wo wann wie warum wenn nur da hier jeder jemand niemand",
    "fr": "le la les l d un une des du de au aux et ou mais ne pas n est sont était c ce cette ça j je tu il elle on nous vous ils me m te t se s y leur mon ton son ma ta sa qui que qu quoi où quand comment pourquoi si ici là dans en sur sous avec pour par sans plus ai as a ont va faut",
    "ru": "и в во не на я ты он она мы вы они это этот эта то что кто где когда как почему с со к ко у о об от до из за по под над для без но а или же бы ли да нет мой моя моё твой его её их наш ваш меня мне тебя тебе был была было были есть так там тут здесь надо чьё чей если нас",
    "zh": "的了在是我你他她它们把被和与就都也不没有很太这那哪里个要会能得着过吗呢吧什么谁为去来到从对上下说问听别好多少人一再",
}
_WORDS = frozenset(w for lang, text in FUNCTION_WORDS.items() if lang != "zh" for w in text.split())
_HAN = frozenset(FUNCTION_WORDS["zh"])
_MARKS = frozenset(",.!?;:|/-—…♪♫#()[]*\"'。，？！>«»¿¡")

#: nats per symbol: lines of prose lie between these
LOW, HIGH = 0.35, 2.3
#: a page is reported above this share of its words; a line's neighbours weigh in on it by NEAR
SHARE, NEAR = 0.5, 0.5
#: words of usual cost that weigh in on each line: the perplexity of a few words says little
EVEN, USUAL = 1, 1.5
#: a list in brackets is a sound or lyric up to so many nats a symbol beyond HIGH; of the readable words of broken lines,
#: a page needs so many to be judged by them, and this share of function words to be speech
LEEWAY, READABLE, SPOKEN_SHARE = 0.7, 5, 0.1
#: trigrams below this share of all are left to the bigrams, so the model has at most 1 / MIN_SHARE; lines a worker remembers the score of
MIN_SHARE, REMEMBERED = 1e-6, 200_000

_TIME = r"\d{1,2}\s*[:.]\s*\d{2}\s*[:.,]\s*\d{2}(?:\s*[:.,]\s*\d{1,3})?"
_CUES = re.compile(rf"{_TIME}\s*\S{{0,6}}\s?>?\s*{_TIME}|{_TIME}|\{{\d+\}}(?:\{{\d*\}})?|^[ \t﻿]*\d+[ \t]*$|^﻿?WEBVTT.*$", re.M)
_TIMES = re.compile(rf"{_TIME}\s*-->\s*{_TIME}\s*").fullmatch
_MARKUP = re.compile(r"</?[biusv](?:\s[^>]*)?>|</?font[^>]*>|</?c[.\w]*>|\{\\[^}]*\}")
_ENDS = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+(?=[A-ZÀ-ÞА-ЯЁ¿¡«\"(\[♪♫*-])|(?<=[。？！])")
_LINK = r"(?P<URL>(?:h[tx]{2}ps?://|www\.)\S+|<a\s[^>]*>|[a-z0-9][a-z0-9-]*(?:\.|\s?\(\.\)\s?|\s?\[dot\]\s?)[a-z]{2,}\b(?:/\S*)?)|(?P<HASH>#[^\W_]\w*)|"
_PLAIN = r"(?P<PRICE>[$€£]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£])|(?P<word>(?:[^\W_㐀-鿿]|\ufffd)+)|(?P<mark>[^\w\s])|(?P<han>[㐀-鿿]+)|(?P<gap>(?<=[㐀-鿿])\s+(?=[㐀-鿿]))"
_TOKENS, _LINKED_TOKENS = re.compile(_PLAIN).finditer, re.compile(_LINK + _PLAIN).finditer
_MAY_LINK = re.compile(r"://|www\.|<a\s|#|\(\.\)|\[dot\]|[a-z0-9]\.[a-z]").search
_RUNS = re.compile(r"\w+").findall
_LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])").sub
_TWICE = re.compile("[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ�]{2,}")
_WESTERN = re.compile("[\xa8\xb8\xc0-\xff]")
_SUNG = re.compile(r"^\s*(?:-\s*)?(?:[♪♫]|[#?]\s|[A-ZÀ-ÞА-ЯЁ]{2,}:\s*[♪♫])")
_OPENED = re.compile(r"^\s*(?:-\s*)?[*(\[]")
_ENCLOSED = re.compile(r"^\s*(?:-\s*)?(?:\*[^*]+\*|\([^()]+\)|\[[^\[\]]+\])\W*$")
_NOTES = frozenset("#?P")
_LISTED = re.compile(r"[|,;/，]").search


def _as_utf8(m: re.Match) -> str:
    found = m.group()
    data = bytearray()
    for c in found:
        data += b"\xff" if c == "�" else bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")
    read = data.decode("utf-8", "replace")
    return read if 2 * read.count("�") <= len(read) < len(found) else found


def repaired(line: str) -> str:
    """Undo UTF-8 read as a Western code page, once or twice, and Cyrillic code pages read as Western."""
    if line.isascii():
        return line
    for _ in range(2):
        read = _TWICE.sub(_as_utf8, line)
        if read == line:
            break
        line = read
    western = len(_WESTERN.findall(line))
    if western > 3 and 2 * western > sum(c.isalpha() for c in line):
        line = "".join(bytes([ord(c)]).decode("cp1251", "replace") if "\xa8" <= c <= "\xff" else c for c in line)
    return line


def raw_lines(text: str) -> list[str]:
    """All lines but empty ones, cue numbers and plain lines of cue times."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [x for x in text.split("\n") if x and not x.isdigit() and not ("0" <= x[0] <= "9" and _TIMES(x))]


def pieces(raw: str) -> list[str]:
    """What a raw line says, without cue numbers, times and markup; a long one, as of texts that lost their line ends, by sentence."""
    out = []
    for line in _MARKUP.sub("", _CUES.sub("\n", repaired(raw))).split("\n"):
        line = line.strip("\ufeff \t|")
        if len(line) <= 60:
            if line:
                out.append(line)
        else:
            out += [s.strip() for s in _ENDS.split(line) if s and s.strip()]
    return out


def symbols(line: str) -> tuple[list[str], float, float]:
    """The symbols of a line, its words, and those of them that are broken. A Han character is half a word; a link has as many words as runs of letters and digits."""
    if "?" in line:
        line = _LOST("�", line)
    out: list[str] = []
    words = broken = 0.0
    seen: set[str] = set()
    for m in (_LINKED_TOKENS if _MAY_LINK(line) else _TOKENS)(line):
        kind, x = m.lastgroup, m.group()
        if kind == "mark":
            out.append(x if x in _MARKS else "P")
        elif kind == "han":
            words += 0.5 * len(x)
            if x in seen:
                out.append("REP")
            else:
                out += [c if c in _HAN else "HAN" for c in x]
                if len(x) > 1:
                    seen.add(x)
        elif kind == "gap":
            out.append("GAP")
        elif kind != "word":
            words += len(_RUNS(x))
            out.append(kind)
        else:
            low = x.lower()
            words += 1
            if low in _WORDS:
                symbol = low
            elif x.isdigit():
                symbol = "NUM"
            elif "�" in x:
                symbol = "BROKEN"
                broken += 1
            elif any(c.isdigit() for c in x):
                symbol = "MIX"
            elif len(x) == 1:
                symbol = "ONE"
            elif low in seen:
                symbol = "REP"
            else:
                symbol = "CAPS" if x.isupper() else "CAP" if x[0].isupper() else "LOW"
            seen.add(low)
            out.append(symbol)
    return out, words, broken


def _is_function(symbol: str) -> bool:
    return symbol in _WORDS or symbol in _HAN


def _in_prose(s: list[str]) -> bool:
    """Whether a line holds function words, as an advert with a link does too, or is sung or described."""
    if "HASH" in s or "MIX" in s:
        return False
    named = [x for x in s if x.isalpha()]
    return 4 * sum(map(_is_function, named)) >= len(named) or ("URL" not in s and s[0] in "♪♫#([*" and s[-1] in ".!?…。？！♪♫#)]*")


def _is_text(s: list[str]) -> bool:
    return any(x.isalpha() and x != "NUM" and x != "PRICE" for x in s)


class ProseCounter:
    """Trigrams of the documents that read like prose: most of their words stand in lines that do.

    Of their lines, those that don't are left out, but for short ones and misread ones, as of speech.

    Equal raw lines are taken apart once; `remembered` bounds how many are kept.
    """

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.counts: Counter = Counter()
        self.lines: Counter = Counter()  # symbols of lines of prose documents, not yet in counts
        self.known: dict[str, list[tuple[tuple[str, ...], float, bool]]] = {}

    def _pieces(self, raw: str) -> list[tuple[tuple[str, ...], float, bool]]:
        out = []
        for line in pieces(raw):
            s, words, _ = symbols(line)
            if words and _is_text(s):
                out.append((tuple(s), words, _in_prose(s)))
        if len(raw) <= 200:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[raw] = out
        return out

    def add(self, text: str) -> bool:
        total = prose = 0.0
        found = []
        known = self.known
        for raw in raw_lines(text):
            parts = known.get(raw)
            for s, words, good in self._pieces(raw) if parts is None else parts:
                if good or words < 3 or "MIX" in s:
                    found.append(s)
                if words >= 3:
                    total += words
                    prose += words * good
        if not total or prose < 0.7 * total:
            return False
        self.lines.update(found)
        if len(self.lines) >= self.remembered:
            self.flush()
        return True

    def flush(self) -> Counter:
        counts = self.counts
        for symbols_, n in self.lines.items():
            s = ["<s>", "<s>", *symbols_, "</s>"]
            for t in zip(s, s[1:], s[2:]):
                counts[t] += n
        self.lines.clear()
        return counts


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = ProseCounter()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text and not text.isspace():
                counter.add(text)
    counts = counter.flush()
    if counts:
        a, b, c = zip(*counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (a, b, c)] + [pa.array(list(counts.values()), pa.int64())], names=["a", "b", "c", "n"])


def prose_counts(docs: DataFrame, text: str = "text", least: float = MIN_SHARE) -> list[tuple[str | None, str | None, str, int]]:
    """(a, b, c, n) of trigrams of symbols in all documents that read like prose, (None, b, c, n) of bigrams and (None, None, c, n) of symbols.

    Of trigrams and bigrams those with at least the share `least` of all counts: the same ones whatever the size of the
    corpus, and no more than 1 / least of either. Symbols are function words and classes, a fixed alphabet.
    """
    counted = written(spread(only(docs, text)).mapInArrow(_trigrams, "a string, b string, c string, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n")), "trigrams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    none = F.lit(None).cast("string")
    enough = F.col("n") >= F.lit(least * total)
    pairs = counted.groupBy("b", "c").agg(F.sum("n").alias("n")).filter(enough).select(none.alias("a"), "b", "c", "n")
    singles = counted.groupBy("c").agg(F.sum("n").alias("n")).select(none.alias("a"), none.alias("b"), "c", "n")
    return [tuple(x.values()) for x in counted.filter(enough).unionByName(pairs).unionByName(singles).toArrow().to_pylist()]


class ProseModel:
    """Interpolated trigram model, as tables of negative log probabilities."""

    WEIGHTS = (0.05, 0.25, 0.7)

    def __init__(self, counts: list[tuple[str | None, str | None, str, int]]):
        one, two, three = self.WEIGHTS
        singles = {c: n for a, b, c, n in counts if b is None}
        pairs = {(b, c): n for a, b, c, n in counts if a is None and b is not None}
        triples = {(a, b, c): n for a, b, c, n in counts if a is not None}
        before = self._before({**singles, "<s>": singles.get("</s>", 0)}, pairs)
        before2 = self._before(pairs, triples)
        total = sum(singles.values()) + 1
        p1 = {c: one * (n + 0.5) / total for c, n in singles.items()}
        self.unseen = -math.log(one * 0.5 / total)
        self.one = {c: -math.log(p) for c, p in p1.items()}
        p2 = {(b, c): p1[c] + two * n / before[b] for (b, c), n in pairs.items()}
        self.two = {k: -math.log(p) for k, p in p2.items()}
        self.three = {(a, b, c): -math.log(p2[b, c] + three * n / before2[a, b]) for (a, b, c), n in triples.items()}

    @staticmethod
    def _before(known: dict, longer: dict) -> dict:
        """How often each beginning of a longer sequence comes up: at least as often as the sequences that begin with it."""
        found: Counter = Counter()
        for key, n in longer.items():
            found[key[0] if len(key) == 2 else key[:2]] += n
        return {k: max(n, known.get(k, 0)) for k, n in found.items()}

    def cost(self, s: list[str]) -> float:
        """Nats per symbol, the end included."""
        padded = ["<s>", "<s>", *s, "</s>"]
        three, two, one, total = self.three, self.two, self.one, 0.0
        for t in zip(padded, padded[1:], padded[2:]):
            x = three.get(t)
            if x is None:
                x = two.get(t[1:])
                if x is None:
                    x = one.get(t[2], self.unseen)
            total += x
        return total / (len(s) + 1)


class Line(NamedTuple):
    """cost and words of a line; spoken: sung or described; of a line too broken for the model, its readable words and the function words among them, else None."""

    cost: float
    words: float
    spoken: bool
    readable: tuple[int, int] | None = None


def _line(model: ProseModel, line: str, s: list[str], words: float, broken: float) -> Line:
    if 5 * broken >= words:
        named = [x for x in s if x.isalpha() and x != "BROKEN"]
        return Line(model.cost(s), words, False, (len(named), sum(map(_is_function, named))))
    cost = model.cost(s)
    if "URL" in s or "HASH" in s:
        return Line(cost, words, False)
    if _OPENED.match(line):
        if _ENCLOSED.match(line) and (cost <= HIGH + LEEWAY or not _LISTED(line)):
            return Line(cost, words, True)
        return Line(model.cost([x for x in s if x not in "*()[]"]), words, False)
    # a line behind a note is sung; behind a weaker mark only if what follows reads as a lyric may
    sung = _SUNG.match(line) and ("♪" in s or "♫" in s or model.cost([x for x in s if x not in _NOTES]) <= HIGH + LEEWAY)
    return Line(cost, words, bool(sung))


def line_scores(model: ProseModel, text: str, remembered: dict) -> list[Line]:
    """Each line with words."""
    found = []
    for raw in raw_lines(text):
        scores = remembered.get(raw)
        if scores is None:
            scores = []
            for line in pieces(raw):
                s, words, broken = symbols(line)
                if words and _is_text(s):
                    scores.append(_line(model, line, s, words, broken))
            if len(raw) <= 200:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                remembered[raw] = scores
        found += scores
    return found


def keyword_words(scores: list[Line], low: float = LOW, high: float = HIGH, near: float = NEAR) -> tuple[float, float]:
    """Words in keyword lines, and all words. A line is judged with its neighbours, as single short lines vary much.

    Broken lines are judged together: by the function words among what can be read of them.
    """
    bad = total = 0.0
    read = [x.readable for x in scores if x.readable]
    readable = sum(n for n, _ in read)
    broken_bad = readable >= READABLE and sum(f for _, f in read) < SPOKEN_SHARE * readable
    for k, (cost, words, spoken, broken) in enumerate(scores):
        total += words
        if broken:
            bad += words * broken_bad
            continue
        if spoken:
            continue
        mass, weight = cost * words + EVEN * USUAL, words + EVEN
        for j in (k - 1, k + 1):
            if 0 <= j < len(scores):
                c, w = scores[j][:2]
                w = near * min(w, words)
                mass, weight = mass + c * w, weight + w
        if not low <= mass / weight <= high:
            bad += words
    return bad, total


def _scorer(trigrams, low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, remembered = ProseModel(trigrams.value), {}
        for batch in batches:
            costs, bad, total = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                scores = line_scores(model, text, remembered) if text and not text.isspace() else []
                b, t = keyword_words(scores, low, high)
                costs.append(sum(x.cost * x.words for x in scores) / t if t else None)
                bad.append(b)
                total.append(t)
            f = lambda x: pa.array(x, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), f(costs), f(bad), f(total)], names=["doc_id", "cost", "keyword_words", "words"])

    return run


def page_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, cost, keyword_words, words) of every row.

    cost is the mean of nats per symbol over the lines, weighted by words. Null, empty and blank texts, and those
    without words, have a null cost and 0 words. The model is trained on all documents that read like prose; its size is
    bounded by MIN_SHARE, whatever the corpus, and it is all that goes through the driver. If no document reads like prose,
    every line is abnormal. Repeated rows and copies are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prose_counts(docs, text))
    return spread(only(docs, key, text)).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scorer(shared, low, high), "doc_id bigint, cost double, keyword_words double, words double"
    )


def keyword_pages(scores: DataFrame, share: float = SHARE) -> DataFrame:
    """Of the result of page_scores, the pages with more than `share` of their words in keyword lines."""
    return scores.filter(F.col("keyword_words") > F.lit(share) * F.col("words"))

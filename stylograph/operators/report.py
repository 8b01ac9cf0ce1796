"""Attribution of words and sentences, evidence rules, and reports."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L

AI_WORDS, HUMAN_WORDS = L.AI_WORDS, L.HUMAN_WORDS


def word_scores(text: Column, score: Column) -> Column:
    """array<struct<word, position, score, confidence>>: the text's score, moved by indicator words (AI ones first), decaying by position."""
    ai, human = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (AI_WORDS, HUMAN_WORDS))

    def rated(w: Column, keys: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            key = F.get(keys, i)
            # maps are searched from the start, so only for words that they hold
            moved = F.when(key.isin(*AI_WORDS), F.least(F.lit(1.0), score + ai[key] * 0.3)).when(key.isin(*HUMAN_WORDS), F.greatest(F.lit(0.0), score - human[key] * 0.3)).otherwise(score)
            held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved * (1 - i / F.size(w) * 0.1)))
            return F.struct(F.translate(raw, L.ZERO_WIDTH_ATTRIBUTION, "").alias("word"), i.alias("position"), held.alias("score"), F.when(key.isin(*AI_WORDS, *HUMAN_WORDS), 0.8).otherwise(0.5).alias("confidence"))

        return F.filter(F.transform(w, one), lambda s: F.length(s["word"]) > 0)

    # all words are lower-cased and stripped of marks at once
    keys = lambda w: F.split(F.regexp_replace(F.lower(F.array_join(w, " ")), r"(?U)[^\w ]", ""), " ")
    return C.let(C.tok_ws(text), lambda w: C.let(keys(w), lambda k: rated(w, k)))


def sentence_scores(text: Column, score: Column) -> Column:
    """array<struct<position, text, score, indicators>>: mean of the words' scores; indicators by substring."""
    strong = [w for w, s in AI_WORDS.items() if s > 0.7]

    def one(s: Column, i: Column) -> Column:
        low = F.lower(s)
        marks = [F.when(F.contains(low, F.lit(w)), f"AI indicator: '{w}'") for w in strong]
        marks += [F.when(low.rlike(r"(?U)\b(first|second|third|finally)\b"), "Sequential structure"), F.when(low.rlike(r"(?U)\b(therefore|thus|hence|consequently)\b"), "Logical connector")]
        mean = C.mean(F.transform(word_scores(s, score), lambda x: x["score"]))
        return F.struct(i.alias("position"), C.trimmed(s).alias("text"), mean.alias("score"), F.array_compact(F.array(*marks)).alias("indicators"))

    return F.transform(C.sent_punct(text), one)


SCORED = "struct<sentences:array<struct<position:int,text:string,score:double,indicators:array<string>>>,stats:struct<mean:double,high:bigint,ai:bigint,human:bigint>>"
#: What (?U)\\s is, and what of it str.split() cuts at besides.
SPACE, NO_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", re.compile("[\x1c-\x1f]")
STOPS, GAPS = re.compile("[.!?]+"), re.compile(f"[{SPACE}]+")
STRUCTURE = [(re.compile("first|second|third|finally"), "Sequential structure"), (re.compile("therefore|thus|hence|consequently"), "Logical connector")]


class _Marks(dict):
    """For str.translate: characters that aren't (?U)\\w go, but for spaces."""

    def __missing__(self, code: int) -> int | None:
        c, kind = chr(code), unicodedata.category(chr(code))
        circled = 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x1F150 <= code <= 0x1F169 or 0x1F170 <= code <= 0x1F189
        self[code] = code if c in " \u200c\u200d" or kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or circled else None
        return self[code]


_MARKS = _Marks()
_GONE = dict.fromkeys(map(ord, L.ZERO_WIDTH_ATTRIBUTION))


def _stands(pattern: re.Pattern, low: str) -> bool:
    """Whether one of the words stands in a text as a whole word."""
    apart = lambda c: not c or c == " " or _MARKS[ord(c)] is None
    return any(apart(low[m.start() - 1 : m.start()]) and apart(low[m.end() : m.end() + 1]) for m in pattern.finditer(low))


def _split(text: str) -> list[str]:
    return text.split() if not NO_SPACE.search(text) else [w for w in GAPS.split(text) if w]


def _scored(text: str, score: float, strong: list[tuple[str, str]]) -> tuple[list[tuple], tuple]:
    moved = {w: min(1.0, score + s * 0.3) for w, s in AI_WORDS.items()} | {w: max(0.0, score - s * 0.3) for w, s in HUMAN_WORDS.items() if w not in AI_WORDS}
    sentences, every, words, high, ai, human = [], 0.0, 0, 0, 0, 0
    for part in STOPS.split(text):
        w = _split(part)
        if not w:
            continue
        low, n, total, many = part.lower(), len(w), 0.0, 0
        bare = " ".join(w).lower().translate(_MARKS)
        shown = [x.translate(_GONE) for x in w] if any(c in part for c in L.ZERO_WIDTH_ATTRIBUTION) else w
        for i, key in enumerate(bare.split(" ")):
            if shown[i]:
                held = max(0.0, min(1.0, moved.get(key, score) * (1 - i / n * 0.1)))
                total += held
                every += held
                many += 1
                high += held > 0.7
        counted = bare.split(" ") if shown is w else " ".join(shown).lower().translate(_MARKS).split(" ")
        for key in moved.keys() & set(counted):
            found = counted.count(key)
            ai, human = (ai + found, human) if key in AI_WORDS else (ai, human + found)
        words += many
        marks = [label for x, label in strong if x in low] + [label for p, label in STRUCTURE if _stands(p, low)]
        sentences.append((part.strip(SPACE), total / many if many else 0.0, marks))
    return sentences, (every / words if words else None, high, ai, human)


def scored(text: Column, score: Column) -> Column:
    """struct<sentences, stats>: sentence_scores of a text, and evidence.word_stats of the words in them, in one pass of a task's Python."""
    strong = [(w, f"AI indicator: '{w}'") for w, s in AI_WORDS.items() if s > 0.7]

    @F.arrow_udf(SCORED)
    def both(texts: pa.Array, scores: pa.Array) -> pa.Array:
        starts, positions, parts, means, marks, stats = [0], [], [], [], [], []
        for t, s in zip(texts.to_pylist(), scores.to_pylist(), strict=True):
            found, stat = ([], (None,) * 4) if t is None or s is None else _scored(t, s, strong)
            positions.extend(range(len(found)))
            parts.extend(x[0] for x in found)
            means.extend(x[1] for x in found)
            marks.extend(x[2] for x in found)
            stats.append(stat)
            starts.append(len(positions))
        items = pa.StructArray.from_arrays([pa.array(positions, pa.int32()), pa.array(parts, pa.string()), pa.array(means, pa.float64()), pa.array(marks, pa.list_(pa.string()))], ["position", "text", "score", "indicators"])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items, mask=pa.array([t is None for t in texts.to_pylist()], pa.bool_()))
        numbers = pa.StructArray.from_arrays([pa.array([s[i] for s in stats], pa.float64() if i == 0 else pa.int64()) for i in range(4)], ["mean", "high", "ai", "human"])
        return pa.StructArray.from_arrays([lists, numbers], ["sentences", "stats"])

    return both(text, score)


def sentence_level(score: Column) -> Column:
    return F.when(score >= 0.85, "very high").when(score >= 0.65, "high").when(score >= 0.45, "uncertain").when(score >= 0.25, "low").otherwise("very low")


def hybrid(scores: Column) -> Column:
    """Whether the halves of six or more sentences differ by over .25 and lie on different sides of .5, to nine places."""
    half = F.floor(F.size(scores) / 2).cast("int")
    a, b = (F.round(C.mean(x), 9) for x in (F.slice(scores, F.lit(1), half), F.slice(scores, half + 1, F.size(scores))))
    return (F.size(scores) >= 6) & (F.abs(a - b) > 0.25) & ((a > 0.5) != (b > 0.5))


def report_json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _safe(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _gauge(name: str, value: Column) -> Column:
    """A bar from 0 to 100 %, drawn by width alone."""
    return F.format_string('<div class="gauge"><span>%s</span><div style="width:%.1f%%"></div><b>%.1f%%</b></div>', F.lit(name), *(F.bround(value * 100, 1),) * 2)


def report_html(title: Column, given: dict[str, Column]) -> Column:
    """A page of one result: gauges of the scores, the summary, the first 8 items of evidence, a comparison with what people write, levels
    of risk and the first 10 sentences. given: as for evidence.summary, with evidence and summary (string). Sections without content are left out.
    """
    gauges = F.concat(*(_gauge(name, given[k]) for k, name in (("neural", "Neural"), ("statistical", "Statistical"), ("reasoning_score", "Reasoning"), ("watermark_score", "Watermark"))))
    section = lambda name, body, when: F.when(when, F.concat(F.lit(f'<section id="{name}"><h2>{name.title()}</h2>'), body, F.lit("</section>"))).otherwise("")
    always = F.lit(True)
    items = F.array_join(F.transform(F.slice(given["evidence"], 1, 8), lambda e: F.concat(F.lit('<li class="evidence"><code>'), e["type"], F.lit("</code> "), _safe(e["explanation"]), F.lit("</li>"))), "")
    rows = F.array_join(F.transform(F.slice(given["sentences"], 1, 10), lambda s: F.concat(F.format_string('<tr class="sentence"><td>%d</td><td>%.3f</td><td>%s</td>', s["position"] + 1, s["score"], sentence_level(s["score"])), F.lit("<td>"), _safe(s["text"]), F.lit("</td></tr>"))), "")
    compared = F.array_join(F.transform(given["baseline"], lambda b: F.format_string("<tr><td>%s</td><td>%.3f</td><td>%.3f</td></tr>", b["metric"], b["value"], b["human"])), "")
    levels = F.concat(F.lit("<p>Invented details: "), F.coalesce(given["hallucination"]["level"], F.lit("unknown")), F.lit("</p><p>Reasoning markers: "), F.coalesce(given["reasoning"]["level"], F.lit("unknown")), F.lit("</p>"))
    parts = [
        section("scores", gauges, always), section("summary", F.concat(F.lit("<p>"), _safe(given["summary"]), F.lit("</p>")), always), section("evidence", F.concat(F.lit("<ul>"), items, F.lit("</ul>")), F.size(given["evidence"]) > 0),
        section("statistics", F.concat(F.lit("<table>"), compared, F.lit("</table>")), always), section("risks", levels, always), section("sentences", F.concat(F.lit("<table>"), rows, F.lit("</table>")), F.size(given["sentences"]) > 0),
    ]
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), _safe(title), F.lit("</title></head><body><h1>"), _safe(given["verdict"]), F.lit("</h1>"), *parts, F.lit("</body></html>"))

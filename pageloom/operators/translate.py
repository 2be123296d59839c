"""Translation: registered batch functions, each distinct text once, and rules over the result."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.metrics import stripped
from pageloom.functions.text import collapsed, with_glossary, without_repeats

#: A translator gets (texts, target language, model) and gives as many texts.
Translator = Callable[[list[str], str, str], list[str]]
TRANSLATORS: dict[str, Translator] = {}

#: HTTP statuses worth another attempt; attempts; the pause before each further one, times its number.
RETRIED, ATTEMPTS, BACK_OFF = (408, 429, 500, 502, 503, 504), 3, 1.0
#: Words that betray a bad translation.
SPAM = ("관련검색", "검색사이트", "다운로드", "브랜드명", "상품명", "정 피곤", "욕구알아보기", "가필니다", "e-도서", "publication")
#: Phrases and their translations, in order (plural before singular).
PHRASES = (
    ("Integrated Work Challenge:", "통합 과제:"),
    ("Applied Aerodynamics:", "응용 공기역학:"),
    ("Historical Note:", "역사적 참고:"),
    ("Models of the Fluid:", "유체 모델:"),
    ("Shock-Expansion Theory:", "충격-팽창 이론:"),
    ("Airplane Lift and Drag", "비행기 양력과 항력"),
    ("The Flow over a Sphere—The Real Case", "구 주위의 흐름 - 실제 사례"),
    ("The Flow over a Sphere-The Real Case", "구 주위의 흐름 - 실제 사례"),
    ("Relation Between Aerodynamic Drag and the Loss of Total Pressure in the Flow Field", "공력 항력과 유동장 전체 압력 손실의 관계"),
    ("Control Volumes and Fluid Elements", "제어 체적과 유체 요소"),
    ("Applications to Supersonic Airfoils", "초음속 에어포일에 대한 적용"),
    ("Comments", "논평"),
    ("Comment", "논평"),
    ("Summary", "요약"),
    ("Problems", "문제"),
    ("Introduction and Road Map", "소개 및 로드맵"),
    ("Introduction", "소개"),
)


def phrases(spark: SparkSession, rows: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """A glossary (ord, src, dst) of ordered phrases."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "ord int, src string, dst string")


def register(name: str) -> Callable[[Translator], Translator]:
    def keep(f: Translator) -> Translator:
        TRANSLATORS[name] = f
        return f

    return keep


@register("identity")
def identity(texts: list[str], target: str, model: str) -> list[str]:
    return list(texts)


def translator(name: str, key: str | None = None, needs_key: tuple[str, ...] = ("openrouter",)) -> Translator:
    """A registered translator; an unknown one, or one without its key, is an error."""
    if name in needs_key and not key:
        raise ValueError(f"{name} needs an API key")
    if name not in TRANSLATORS:
        raise ValueError(f"unknown translator {name}; registered: {', '.join(sorted(TRANSLATORS))}")
    return TRANSLATORS[name]


class RemoteError(RuntimeError):
    """A remote translator's refusal, with its status and what it says about it."""


#: Sends (url, headers, JSON body) and gives (status, answer's text).  There is none by default: a network is the caller's.
Transport = Callable[[str, dict[str, str], str], tuple[int, str]]


def detail(body: str) -> str:
    """The message inside an error's JSON, else its start."""
    try:
        x = json.loads(body)
        said = (x.get("error") or {}).get("message") if isinstance(x.get("error"), dict) else x.get("error") or x.get("message")
    except (ValueError, AttributeError):
        said = None
    return str(said) if said else body[:200]


def answer(body: str) -> str:
    """The text of the first choice; another shape is an error."""
    try:
        said = json.loads(body)["choices"][0]["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise RemoteError("the answer has no choices[0].message.content") from e
    if isinstance(said, list):  # parts of a text
        said = "".join(p.get("text", "") for p in said if isinstance(p, dict))
    if not isinstance(said, str) or not said.strip():
        raise RemoteError("the answer's text is empty")
    return said.strip()


def remote(transport: Transport, key: str, url: str, prompt: str = "Translate the user's text into {target}. Answer with the translation only.", attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Translator:
    """A translator over a chat-completions service (E4, F16): temperature 0, a fixed prompt, retries after 1 s and then 2 s."""

    def ask(text: str, target: str, model: str) -> str:
        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "system", "content": prompt.format(target=target)}, {"role": "user", "content": text}]}, ensure_ascii=False)
        for attempt in range(1, attempts + 1):
            status, said = transport(url, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, body)
            if status < 400:
                return answer(said)
            if status not in RETRIED or attempt == attempts:
                raise RemoteError(f"HTTP {status} after {attempt} attempts: {detail(said)}")
            sleep(BACK_OFF * attempt)
        raise RemoteError("no attempt was made")

    return lambda texts, target, model: [ask(t, target, model) if t.strip() else t for t in texts]


def translated(units: DataFrame, name: str | Translator, target: str, model: str = "", batch: int = 64) -> DataFrame:
    """units with translated: each distinct text is translated once, in batches, and joined back.

    A translator must give the same result for the same text; an empty result of a text that isn't is an error.
    """
    f = translator(name) if isinstance(name, str) else name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = list(x["text"])
            out = [y for i in range(0, len(texts), batch) for y in f(texts[i : i + batch], target, model)]
            if any(a.strip() and not (b or "").strip() for a, b in zip(texts, out, strict=True)):
                raise ValueError("a translator gave an empty text")
            yield pd.DataFrame({"text": texts, "raw": out})

    once = units.select("text").filter("text is not null").distinct().mapInPandas(run, "text string, raw string")
    return units.join(once.withColumnRenamed("raw", "translated"), "text", "left").select(*units.columns, "translated")


def corrected(original: Column, said: Column, terms: list[tuple[str, str, str]]) -> Column:
    """Terms (word in the original, from, to) replaced in order where their word occurs."""
    for word, a, b in terms:
        said = F.when(F.contains(original, F.lit(word)), F.replace(said, F.lit(a), F.lit(b))).otherwise(said)
    return said


#: Templates of structural headings by target language.
STRUCTURE = {"en": ("Chapter {n}", "Part", "Part {n}"), "de": ("Kapitel {n}", "Teil", "Teil {n}"), "fr": ("Chapitre {n}", "Partie", "Partie {n}"), "es": ("Capítulo {n}", "Parte", "Parte {n}"), "ko": ("{n}장", "부", "부 {n}")}


def structural(original: Column, toc_page: Column, target: str) -> Column:
    """Chapter and part headings by template; null for other texts (T7).  A target without templates is an error."""
    if target not in STRUCTURE:
        raise ValueError(f"no headings in {target!r}; there are: {', '.join(STRUCTURE)}")
    chapter, bare, part = STRUCTURE[target]
    x = collapsed(original)
    number = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    fill = lambda t, n: F.concat(*[F.lit(s) if i == 0 else F.concat(n, F.lit(s)) for i, s in enumerate(t.split("{n}"))])
    n, k = number(r"(?iU)^chapter\s+(\d+)$"), number(r"(?iU)^part\s+(\d+)$")
    alone = x.rlike("(?i)^part$")
    return F.when(n.isNotNull(), fill(chapter, n)).when(alone & (F.coalesce(toc_page, F.lit("")) != ""), fill(part, toc_page)).when(alone, F.lit(bare)).when(k.isNotNull(), fill(part, k))


def suspicious(said: Column, words: Iterable[str] = SPAM) -> Column:
    """Whether a translation holds a word that betrays a bad one, in any case."""
    low = F.lower(said)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def worth_drawing(units: DataFrame, column: str = "translated") -> DataFrame:
    """Units whose translation isn't blank and whose box has four sides."""
    box = F.col("box")
    return units.filter(F.col(column).rlike(r"(?U)\S") & box.isNotNull() & box["left"].isNotNull() & box["bottom"].isNotNull() & box["right"].isNotNull() & box["top"].isNotNull())


def postprocessed(units: DataFrame, glossary: DataFrame, target: str = "en", terms: list[tuple[str, str, str]] = (), spam: Iterable[str] = SPAM) -> DataFrame:
    """units (text, translated, toc_page) with final: structure first, then fallbacks, then what was said."""
    u = with_glossary(units, "text", glossary, "__phrases")
    u = u.withColumn("__fallback", F.coalesce(structural(F.col("text"), F.lit(""), target), F.col("__phrases"))).drop("__phrases")
    said = corrected(F.col("text"), stripped(without_repeats(F.coalesce("translated", F.lit("")))), list(terms))
    u = u.withColumn("__said", said)
    plain = collapsed(F.col("text"))
    untouched = (F.col("__fallback") != plain) & (F.col("__said") == plain)
    final = F.coalesce(structural(F.col("text"), F.col("toc_page"), target), F.when(untouched | suspicious(F.col("__said"), list(spam)), F.col("__fallback")).otherwise(F.col("__said")))
    return u.withColumn("final", final).drop("__said", "__fallback")

"""Translators over local models, which a worker loads once and keeps.

A model is for one direction (a folder with the model and two tokenizers), or for all languages (one model and one tokenizer, the target named
by a tag).  What loads them is an argument, so that any engine can be used: ``ctranslate2`` and ``sentencepiece`` if they are there.
Language names are looked up in fixed tables; one that isn't there is an error, not another language.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.operators.translate import Translator
from pageloom.sources.documents import POINTER

#: Tags of target languages; folders of the models into a language; files of such a folder; tags of detected scripts.
TAGS = {"English": "eng_Latn", "Korean": "kor_Hang", "Japanese": "jpn_Jpan", "Simplified Chinese": "zho_Hans", "Traditional Chinese": "zho_Hant"}
DIRECTIONS = {"English": "quickmt-ko-en", "Korean": "quickmt-en-ko"}
FILES = ("model.bin", "src.spm.model", "tgt.spm.model")
DETECTED = {"ko": "kor_Hang", "ja": "jpn_Jpan", "zh": "zho_Hans", "en": "eng_Latn"}


class UnsupportedLanguage(ValueError):
    """A target language that there is no tag or model for."""


class ModelMissing(RuntimeError):
    """A model's file isn't there, or only a pointer to it is."""


def tag(language: str) -> str:
    """The tag of a target language."""
    if language not in TAGS:
        raise UnsupportedLanguage(f"no tag for {language!r}; there are: {', '.join(TAGS)}")
    return TAGS[language]


def tags(language: Column) -> Column:
    """The same for a column; a language that isn't there ends the job, a null stays null."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), language)
    miss = F.raise_error(F.concat(F.lit("no tag for language "), language)).cast("string")
    return F.when(language.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, miss))


def folder(root: str, language: str) -> str:
    """The folder of the model into a language, beside others in root (or root itself, if it is one of them)."""
    if language not in DIRECTIONS:
        raise UnsupportedLanguage(f"no model into {language!r}; there are: {', '.join(DIRECTIONS)}")
    root = os.path.abspath(os.path.expanduser(root))
    base = os.path.dirname(root) if os.path.basename(root) in DIRECTIONS.values() else root
    return os.path.join(base, DIRECTIONS[language])


def checked(path: str) -> str:
    """path, if the file is there and is no pointer."""
    try:
        with open(path, "rb") as f:
            if f.read(len(POINTER)) == POINTER.encode():
                raise ModelMissing(f"{path} is a pointer to a large file, not the file")
    except OSError as e:
        raise ModelMissing(f"no model file {path}") from e
    return path


def source_tag(text: str) -> str:
    """The tag of a text's script, by the rule of ``text.detected_language``."""
    for kind, low, high in (("ko", "가", "힣"), ("ja", "぀", "ヿ"), ("zh", "㐀", "鿿")):
        if any(low <= c <= high for c in text):
            return DETECTED[kind]
    return DETECTED["en"]


def engine(path: str) -> object:
    """A model with ``translate_batch`` (a list of token lists -> results with hypotheses)."""
    import ctranslate2

    return ctranslate2.Translator(path, device="cpu")


def tokenizer(path: str) -> object:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: What this process has loaded, by loader and path.
_kept: dict[tuple[str, str], object] = {}


def kept(load: Callable[[str], object], path: str) -> object:
    key = (f"{load.__module__}.{load.__qualname__}", path)
    if key not in _kept:
        _kept[key] = load(path)
    return _kept[key]


def _texts(results: list, texts: list[str], said: Callable[[list[str]], str]) -> list[str]:
    if len(results) != len(texts) or any(not r.hypotheses for r in results):
        raise RuntimeError("the model gave no translation")
    out = [said(list(r.hypotheses[0])).strip() for r in results]
    if any(not x for x in out):
        raise RuntimeError("the model gave an empty translation")
    return out


def directional(root: str, load: Callable[[str], object] = engine, tokens: Callable[[str], object] = tokenizer) -> Translator:
    """A translator by models of one direction each (E3): greedy, in batches, blank texts as they are."""

    def run(texts: list[str], target: str, model: str) -> list[str]:
        at = folder(root, target)
        checked(os.path.join(at, FILES[0]))
        m, source, into = kept(load, at), kept(tokens, os.path.join(at, FILES[1])), kept(tokens, os.path.join(at, FILES[2]))
        full = [t for t in texts if t.strip()]
        done = iter(_texts(m.translate_batch([source.encode(t, out_type=str) for t in full], beam_size=1), full, into.decode) if full else [])
        return [next(done) if t.strip() else t for t in texts]

    return run


def multilingual(path: str, pieces: str, load: Callable[[str], object] = engine, tokens: Callable[[str], object] = tokenizer) -> Translator:
    """A translator by one model for all languages (E3): texts begin with the tag of their script, translations with that of the target."""

    def run(texts: list[str], target: str, model: str) -> list[str]:
        to = tag(target)
        m, p = kept(load, path), kept(tokens, checked(pieces))
        full = [t for t in texts if t.strip()]
        said = lambda x: p.decode(x[1:] if x[:1] == [to] else x)
        asked = [[source_tag(t), *p.encode(t, out_type=str)] for t in full]
        done = iter(_texts(m.translate_batch(asked, target_prefix=[[to]] * len(full), beam_size=1), full, said) if full else [])
        return [next(done) if t.strip() else t for t in texts]

    return run

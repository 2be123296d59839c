"""Translators over local models: loading, keeping, lookups with errors."""

import os
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as t
from pageloom.operators import models, translate
from pageloom.sources.documents import POINTER


class Engine:
    """Turns each token round; keeps what it was asked."""

    def __init__(self, path):
        self.path, self.asked = path, []

    def translate_batch(self, batch, target_prefix=None, beam_size=1):
        self.asked.append((batch, target_prefix))
        turned = [[x[::-1] for x in tokens if not re.fullmatch(r"[a-z]{3}_[A-Z][a-z]{3}", x)] for tokens in batch]
        return [SimpleNamespace(hypotheses=[] if "EPON" in x else [[*(target_prefix[0] if target_prefix else []), *x]]) for x in turned]


class Words:
    def __init__(self, path):
        self.path = path

    def encode(self, text, out_type=str):
        return text.split()

    def decode(self, tokens):
        return " ".join("" if x == "YTPME" else x for x in tokens)


def load_engine(path):
    return Engine(path)


def load_words(path):
    return Words(path)


@pytest.fixture()
def root(tmp_path):
    for d in models.DIRECTIONS.values():
        (tmp_path / "models" / d).mkdir(parents=True)
        for f in models.FILES:
            (tmp_path / "models" / d / f).write_bytes(b"x" * 10)
    return str(tmp_path / "models")


def test_directional(root):
    f = models.directional(root, load_engine, load_words)
    assert f(["ab cd", " ", "ef"], "Korean", "") == ["ba dc", " ", "fe"] and f(["x"], "English", "") == ["x"] and f([], "Korean", "") == []
    assert models.directional(os.path.join(root, "quickmt-en-ko"), load_engine, load_words)(["ab"], "Korean", "") == ["ba"]
    with pytest.raises(models.UnsupportedLanguage, match="French"):
        f(["x"], "French", "")
    for bad in ("NOPE", "EMPTY"):
        with pytest.raises(RuntimeError, match="the model gave"):
            f([bad], "Korean", "")


def test_missing_models(root):
    path = os.path.join(root, "quickmt-en-ko", "model.bin")
    with open(path, "w") as f:
        f.write(POINTER + "v1\n")
    with pytest.raises(models.ModelMissing, match="pointer"):
        models.directional(root, load_engine, load_words)(["x"], "Korean", "")
    os.remove(path)
    with pytest.raises(models.ModelMissing, match="no model file"):
        models.directional(root, load_engine, load_words)(["x"], "Korean", "")


def test_multilingual(root):
    folder = os.path.join(root, "quickmt-en-ko")
    f = models.multilingual(folder, os.path.join(folder, "src.spm.model"), load_engine, load_words)
    assert f(["ab 가", "ひ x", "漢 y", "z"], "Japanese", "") == ["ba 가", "ひ x", "漢 y", "z"]
    asked, prefix = models.kept(load_engine, folder).asked[-1]
    assert [x[0] for x in asked] == ["kor_Hang", "jpn_Jpan", "zho_Hans", "eng_Latn"] and prefix == [["jpn_Jpan"]] * 4
    with pytest.raises(models.UnsupportedLanguage):
        f(["x"], "Klingon", "")


def test_a_worker_loads_a_model_once(spark, root):
    def load_turner(path):  # (what workers call must not need this module)
        import os as o
        from types import SimpleNamespace as S

        with open(o.path.join(path, f"loaded-{o.getpid()}-{len(o.listdir(path))}"), "w"):
            pass
        return S(translate_batch=lambda batch, beam_size=1: [S(hypotheses=[[x[::-1] for x in tokens]]) for tokens in batch])

    def load_splitter(path):
        from types import SimpleNamespace as S

        return S(encode=lambda text, out_type=str: text.split(), decode=" ".join)

    rows = [(k, f"text number{k}") for k in range(400)]
    u = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = translate.translated(u, models.directional(root, load_turner, load_splitter), "Korean", batch=7)
    assert {r["doc_id"]: r["translated"] for r in out.collect()} == {k: " ".join(w[::-1] for w in x.split()) for k, x in rows}
    loaded = [f for f in os.listdir(os.path.join(root, "quickmt-en-ko")) if f.startswith("loaded-")]
    assert loaded and len(loaded) == len({f.split("-")[1] for f in loaded})  # one for each process


def test_tags(spark):
    d = spark.createDataFrame([("Korean",), ("English",), (None,)], "x string")
    assert [r[0] for r in d.select(models.tags(F.col("x"))).collect()] == ["kor_Hang", "eng_Latn", None]
    with pytest.raises(Exception, match="no tag for language French"):
        spark.createDataFrame([("French",)], "x string").select(models.tags(F.col("x"))).collect()
    said = ["plain", "한국", "ひら", "漢字", "カ 漢", ""]
    got = spark.createDataFrame([(x,) for x in said], "x string").select("x", t.detected_language(F.col("x")).alias("k")).collect()
    assert all(models.source_tag(r["x"]) == models.DETECTED[r["k"]] for r in got)


def test_structure_needs_a_known_target():
    with pytest.raises(ValueError, match="Klingon"):
        translate.structural(F.lit("Part"), F.lit(""), "Klingon")


def test_markdown_in_batches(spark, tmp_path):
    from pageloom.plans import reports

    d = spark.createDataFrame([(k, f"## Page 1\n\ntext {k}") for k in range(300)], "doc_id long, markdown string")
    reports.write_markdown_batches(d, str(tmp_path / "md"), 8)
    back = spark.read.json(str(tmp_path / "md"))
    assert {(r["doc_id"], r["markdown"]) for r in back.collect()} == {(k, f"## Page 1\n\ntext {k}") for k in range(300)}
    assert len([f for _, _, fs in os.walk(tmp_path / "md") for f in fs if f.endswith(".json")]) == 8


def test_sweep_counts_folders_and_odd_names(spark, tmp_path):
    from pageloom.operators import jobs

    for name in ("old and odd%20name", "empty old", "deep", "new"):
        (tmp_path / name / "a" / "b").mkdir(parents=True)
    for name in ("old and odd%20name", "deep", "new"):
        (tmp_path / name / "a" / "b" / "f.txt").write_text("x")
    for name in ("old and odd%20name", "empty old", "deep"):
        for p in (tmp_path / name).rglob("*"):
            os.utime(p, (1_000, 1_000))
        os.utime(tmp_path / name, (1_000, 1_000))
    os.utime(tmp_path / "deep" / "a" / "b" / "f.txt")  # one file deep inside is new
    assert jobs.sweep(spark, str(tmp_path), 10_000_000, 3600) == ["empty old", "old and odd%20name"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deep", "new"]
    assert jobs.sweep(spark, str(tmp_path / "nowhere"), 10_000_000, 3600) == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import language as L


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return L.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/lang_reference.parquet"))


#: Sentences of other subjects than the training texts', to measure accuracy on.
HELD_OUT = {
    "en": ["The old bridge was closed after the storm.", "My sister bought three apples at the market.", "We should have left before it started to rain."],
    "de": ["Die alte Brücke wurde nach dem Sturm gesperrt.", "Meine Schwester hat auf dem Markt drei Äpfel gekauft.", "Wir hätten vor dem Regen gehen sollen."],
    "nl": ["De oude brug werd na de storm afgesloten.", "Mijn zus heeft op de markt drie appels gekocht.", "We hadden moeten vertrekken voordat het ging regenen."],
    "fr": ["Le vieux pont a été fermé après la tempête.", "Ma sœur a acheté trois pommes au marché.", "Nous aurions dû partir avant qu'il ne pleuve."],
    "es": ["El viejo puente se cerró después de la tormenta.", "Mi hermana compró tres manzanas en el mercado.", "Deberíamos haber salido antes de que lloviera."],
    "pt": ["A velha ponte foi fechada depois da tempestade.", "Minha irmã comprou três maçãs no mercado.", "Nós devíamos ter saído antes de começar a chover."],
    "zh": ["暴风雨之后，那座旧桥被封闭了。", "我妹妹在市场上买了三个苹果。", "我们应该在下雨之前离开。"],
}


def test_held_out_accuracy(model):
    cases = [(lang, s) for lang, xs in HELD_OUT.items() for s in xs]
    got = L.Judge(model).texts([s for _, s in cases])
    right = sum(bool(g) and g[0][0] == lang for g, (lang, _) in zip(got, cases, strict=True))
    assert right / len(cases) >= 0.9


def test_confidences_are_calibrated_on_documents_never_seen(spark, model):
    """Of stretches with a confidence, about that share is right: labels of documents of other tables tell."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3 and lang in ('en', 'zh', 'de', 'fr', 'es', 'pt', 'nl')")
    rows = docs.select("lang", "text").where("text is not null").collect()
    found, owner = L._examples([(r["lang"], r["text"]) for r in rows])
    _, beside = L._agreed(model, found, owner)
    best, sure = model.judge(model.scores(L.Sentences([w for _, w in found])))
    right = np.array([L.LANGUAGES[b] == lang for b, (lang, _) in zip(best, found, strict=True)])[beside]
    sure = sure[beside]
    off = 0.0
    for low in np.arange(0, 1, 0.1):
        own = (sure >= low) & (sure < low + 0.1 + 1e-9 * (low > 0.85))
        if own.any():
            off += own.mean() * abs(sure[own].mean() - right[own].mean())
    assert off < 0.03
    assert right.mean() > 0.97


def test_model_is_fitted_once_and_read_again(spark, monkeypatch, tmp_path, model):
    L.save(model, spark, str(tmp_path / "m"))
    again = L.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.scale, model.scale) and again.sure == model.sure
    d = "/root/testdata/sf0.001"
    docs, ref = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/lang_reference.parquet")
    first = L.stored(docs, ref)
    monkeypatch.setattr(L, "train", None)
    assert np.array_equal(L.stored(docs, ref).weights, first.weights)


def test_agrees_with_labels_on_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = L.languages(docs, model).where((F.size("langs") == 1) & F.col("label").isNotNull()).collect()
    right = sum(r["label"] == r["langs"][0]["lang"] for r in rows)
    assert right / len(rows) > 0.85  # some labels are wrong


def test_what_counts_as_a_sentence():
    text = (
        "# Heading here now\n\nOne real sentence stands here. Another one follows it!\n```\ncode is. not prose.\n```\n"
        '> "A quoted sentence stands here."\n2026-05-03T15:34:55.425Z INFO svc broker 4 not reachable.\n{"svc": "x. y."}\n'
        "1. pkg/retry/loop.go:603: <nil>\n<|x|> ## Late heading\nunfinished line"
    )
    assert [text[a:b].strip() for a, b in L.sentences(text)] == ["One real sentence stands here.", "Another one follows it!"]
    assert L.sentences("") == [] and len(L.sentences("版本2.4.1已经发布。第二句在这里。")) == 2


def test_stretches_and_mixed_texts(model):
    two = "The old bridge was closed. My sister bought three apples. " + "".join(HELD_OUT["zh"][:2])
    got = L.Judge(model).texts([two, "The old bridge was closed.", None, "", "   ", "12345 67", "x" * 200_000])
    assert [g[0] for g in got[0]] == ["en", "zh"]
    assert two[got[0][1][2] : got[0][1][3]] == "".join(HELD_OUT["zh"][:2])
    assert all(0.5 <= g[1] <= 1 for g in got[0])
    assert [g[0] for g in got[1]] == ["en"] and got[2:] == [[]] * 5
    # a single foreign sentence between others is no language of the text
    assert [g[0] for g in L.Judge(model).texts([f"{' '.join(HELD_OUT['en'])} {HELD_OUT['zh'][0]} {' '.join(HELD_OUT['en'])}"])[0]] == ["en", "en"]


def test_labels(spark):
    cases = {" EN ": "en", "zh_Hans": "zh", "pt-BR": "pt", "dut": "nl", "Français": "fr", "中文": "zh", "es-419": "es", "und": None, "xx": None, "": None, None: None, "-": None, "Deutsch": "de"}
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    got = {r["lang"]: r["l"] for r in df.select("lang", L.label_of(F.col("lang")).alias("l")).collect()}
    assert got == cases


def test_mislabelled(spark, model):
    en, zh = " ".join(HELD_OUT["en"]), "".join(HELD_OUT["zh"])
    rows = [(1, en, "en", 0), (2, en, "de", 0), (3, en, None, 0), (4, f"{en} {zh}", "en", 0), (5, None, None, 0), (6, "", "xx", 0), (7, "# only a heading", "", 0), (2, en, "de", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, langs int")
    got = sorted(tuple(r) for r in L.mislabelled(df, model).collect())
    assert got == [(2, "en"), (2, "en"), (3, "en"), (4, "en"), (4, "zh")]
    assert L.mislabelled(df.limit(0), model).count() == 0 and L.segments(df.limit(0), model).count() == 0
    spans = L.segments(df.where("doc_id = 4"), model).orderBy("segment").collect()
    assert [(r["segment"], r["lang"], r["n_sentences"]) for r in spans] == [(1, "en", 3), (2, "zh", 3)]


def test_training_needs_references(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.train(docs, spark.createDataFrame([], "lang string, text string"))
    ref = spark.createDataFrame([(k, s) for k, xs in HELD_OUT.items() for s in xs], "lang string, text string")
    assert L.train(docs, ref).weights.shape[0] == L.BUCKETS

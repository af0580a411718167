"""Languages: held-out sentences, training by aggregation, calibration, the second look in lower case."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import language as L

HELD = {
    "en": ["I think the train is late again, so start without me", "Win a free ticket, just send your name to this number", "What time does the shop close on Sunday?"],
    "fr": ["Je pense que le train est encore en retard, commencez sans moi", "Gagnez un billet gratuit en envoyant votre nom à ce numéro", "À quelle heure ferme le magasin le dimanche ?"],
    "de": ["Ich glaube, der Zug hat wieder Verspätung, fangt ohne mich an", "Gewinnen Sie eine Karte und schicken Sie uns Ihren Namen", "Wann schließt das Geschäft am Sonntag?"],
    "es": ["Creo que el tren llega tarde otra vez, empezad sin mí", "Gane una entrada gratis enviando su nombre a este número", "¿A qué hora cierra la tienda el domingo?"],
    "it": ["Penso che il treno sia di nuovo in ritardo, cominciate senza di me", "Vinci un biglietto gratis inviando il tuo nome a questo numero", "A che ora chiude il negozio la domenica?"],
    "pt": ["Acho que o trem está atrasado de novo, comecem sem mim", "Ganhe um bilhete grátis enviando o seu nome para este número", "A que horas fecha a loja no domingo?"],
    "nl": ["Ik denk dat de trein weer te laat is, begin maar zonder mij", "Win een gratis kaartje door je naam naar dit nummer te sturen", "Hoe laat sluit de winkel op zondag?"],
    "id": ["Saya kira kereta terlambat lagi, mulai saja tanpa saya", "Menangkan tiket gratis dengan mengirim nama Anda ke nomor ini", "Jam berapa toko tutup pada hari Minggu?"],
}


def test_held_out_sentences():
    model = L.default_model()
    told = [(lang, *model.detect(s)) for lang, said in HELD.items() for s in said]
    right = [lang == found for lang, found, _ in told]
    assert sum(right) >= len(right) - 1
    assert sum(p for ok, (_, _, p) in zip(right, told, strict=True) if ok) / sum(right) > 0.6


def test_second_look_in_lower_case():
    """Capitals are other n-grams than those that training saw."""
    model = L.default_model()
    said = HELD["fr"][0]
    upper = model.once(said.upper())
    assert model.detect(said.upper())[0] == "fr" and model.detect(said.upper())[1] >= round(upper[1], 4)
    assert model.detect("y") == model.detect(" a ") == model.detect(None) == model.detect("12 34") == ("unknown", 0.0)


def test_training_by_aggregation(spark, tmp_path):
    rows = spark.createDataFrame([(s, lang) for lang, said in L.SENTENCES.items() for s in said.split(". ")] + [(None, "en"), ("x y", None)], "text string, lang string")
    model = L.train_languages(rows)
    counts = {}
    for lang, said in L.SENTENCES.items():
        for s in said.split(". "):
            for g, n in L.grams(s).items():
                counts.setdefault(g, {}).setdefault(lang, 0)
                counts[g][lang] += n
    assert model.languages == tuple(sorted(L.SENTENCES)) and model.grams == tuple(sorted(counts))
    total = {x: sum(by.get(x, 0) for by in counts.values()) for x in model.languages}
    for g in ("th", " de", "ão ", "ij"):
        k = model.grams.index(g)
        want = [math.log((counts[g].get(x, 0) + L.ADDED) / (total[x] + L.ADDED * len(counts))) for x in model.languages]
        assert model.weights[k].tolist() == pytest.approx(want)
    model.save(spark, f"{tmp_path}/model")
    held = L.LanguageModel.load(spark, f"{tmp_path}/model")
    assert held.detect(HELD["nl"][0]) == model.detect(HELD["nl"][0]) and held.scale == model.scale
    few = L.train_languages(rows, most=20)
    assert len(few.grams) == 20


def test_confidence_is_calibrated(spark):
    """On documents held out, confidence is about how often the answer is right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.substring("text", 1, 25).alias("text"), "lang")
    train, test = docs.filter("doc_id % 3 != 0"), docs.filter("doc_id % 3 = 0")
    found, sure = L.detect_language(F.col("text"), L.train_languages(train))
    told = test.select("lang", found.alias("found"), sure.alias("sure")).filter("found != 'unknown'").toPandas()
    right = (told["lang"] == told["found"]).mean()
    assert right > 0.85 and abs(told["sure"].mean() - right) < 0.08


def test_many_texts_are_told_as_one_is(monkeypatch):
    """N-grams and scores of texts together are those of each alone, also where there are too many letters for a table."""
    texts = ["Ça va bien ²½?", None, "", "  1 2 ", "a", "ab\x00c d", "été 漢字 \U0001f600 ǅ x", "the the\nthe"] * 2
    model = L.default_model()
    for cells in (L.CELLS, 4):
        monkeypatch.setattr(L, "CELLS", cells)
        names, place, owner = L.spelt(texts)
        for k, t in enumerate(texts):
            assert Counter(names[p] for p in place[owner == k]) == L.grams(t or "")
        scores, known = model.scores_of(texts)
        for t, s, n in zip(texts, scores, known, strict=True):
            want, m = model.scores(t or "")
            assert n == m and np.allclose(s, want)

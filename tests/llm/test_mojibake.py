import random

import numpy as np
import pytest

from tessera.llm import mojibake as m

CLEAN = {
    "fr": ["Où se trouve l’échelle ?", "La réponse n’est pas étayée.", "Ça ne change rien, déjà vu à côté.", "Le garçon a mangé à la fête.", "Voilà un théâtre très fréquenté."],
    "de": ["Die Köchin überprüft die Brötchen.", "Der Prüfvermerk ist gültig.", "Große Straßen führen über Flüsse.", "Das Mädchen wäscht die Gläser.", "Er übergibt später die Schlüssel."],
    "pl": ["Może łódź leży nad rzeką.", "Dziewczynka trzyma piłkę przy młynie.", "Ktoś wziął świecę i książkę.", "Gość oświetla dzbanek na końcu ścieżki.", "Żółta łyżka leży w łazience."],
    "ru": ["Пекарь открывает ящик во дворе.", "Пометка судьи: ключ сомнителен.", "Учительница поворачивает ложку под мостом.", "Потом садовник ещё раз несёт лестницу.", "Фонарь стоит возле дома."],
    "ja": ["溶接工がロープを測る様子が見える。", "注釈の長さと動画の長さが一致しない。", "先生は港で鏡を見せる。", "画面が暗すぎて細部が確認できない。"],
    "tr": ["Aşçı dağ yolunda kapağı açıyor.", "Çoban sınıfta çiçeği yıkıyor.", "Balıkçı bahçede gözlüğü kaldırıyor.", "Kamera yavaşça uzaklaşıyor.", "Şişeyi köprünün altında bıraktı."],
}
ODD = ["ÄÖÜ ÀÉÎ ÑÅØ chart legend", "x̄ = 3.2, Δt → 0, ∑ ≈ π", "├── frames/ │ └── 00017", "tone marks: ā á ǎ à"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [f"{rng.choice(CLEAN[lang])[:-1]} {k}." if lang != "ja" else rng.choice(CLEAN[lang]) for lang in CLEAN for k in range(40)] + [f"{o} {k}" for o in ODD for k in range(12)]


def test_chains_invert_exactly():
    for texts in CLEAN.values():
        for t in texts:
            for k in range(m.CLEAN):
                g = m.garble(t, k)
                if g is not None and m.REPLACED not in g and m.CHAINS[k][0][1] not in ("gbk", "cp932") and g != t:
                    back = m.invert(g, k)
                    assert back is None or back == t or len(m.CHAINS[k]) > 1
    assert m.invert("Ã©tÃ©", m.CHAINS.index((("utf-8", "cp1252"),))) == "été" and m.invert("été", m.CHAINS.index((("utf-8", "cp1252"),))) is None


def test_finds_and_restores(spark, corpus):
    rng = random.Random(2)
    common = [m.CHAINS.index(c) for c in ((("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1250"),), (("utf-8", "cp437"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")))]
    rows, truth = [], {}
    for i, t in enumerate(corpus):
        rows.append((i, f"Plain words first. {t}", "xx", "no"))
    for i in range(60):
        t = rng.choice([s for v in CLEAN.values() for s in v])
        rows.append((1000 + i, f"Plain words first. {m.garble(t, rng.choice(common))}", "xx", "no"))
        truth[1000 + i] = f"Plain words first. {t}"
    rows += [(2000, "na�ve sketch.", None, "no"), (2001, None, None, "no"), (2002, "", None, "no"), (2003, "only ascii", None, "no"), (2004, "Où est l’échelle ? " + m.garble("Ça ne change rien, déjà vu.", common[0]) + " Fin.", "fr", "no")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, restored string")
    got = {r.doc_id: r for r in m.find_garbled(df, "doc_id", "text", "lang").collect()}
    clean = [i for i in got if i < 1000]
    assert len(clean) <= 2
    assert sum(i in got for i in truth) >= 58
    assert sum(i in got and got[i].restored == t for i, t in truth.items()) >= 55
    assert got[2000].restored is None and not got[2000].complete
    assert not {2001, 2002, 2003} & set(got)
    assert got[2004].restored == "Où est l’échelle ? Ça ne change rien, déjà vu. Fin."


def test_empty_and_ascii_corpora(spark):
    df = spark.createDataFrame([(1, "plain", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert m.find_garbled(df, "doc_id", "text", "lang").collect() == []
    assert m.find_garbled(df.limit(0), "doc_id", "text", "lang").collect() == []


def test_many_copies_of_a_garbled_text_are_found(spark, corpus):
    clean = CLEAN["ru"][0]
    bad = m.garble(clean, m.CHAINS.index((("cp1251", "latin-1"),)))
    rows = [(i, t, "xx") for i, t in enumerate(corpus)] + [(5000 + i, bad, "xx") for i in range(len(corpus) // 2)]
    got = {r.doc_id: r for r in m.find_garbled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert all(5000 + i in got and got[5000 + i].restored == clean for i in range(len(corpus) // 2))


def test_a_sure_sentence_is_reported_without_a_restoration(corpus):
    detector = m.train(corpus)
    bad = m.garble(CLEAN["ru"][3], m.CHAINS.index((("cp1251", "latin-1"),)))
    chain = m.CHAINS.index((("cp1251", "latin-1"),))
    p = np.zeros(m.CLEAN + 1)
    p[chain], p[m.CLEAN] = 0.9995, 0.0005
    assert m.restore_sentence(bad, p, detector, {w: 1000 for w in m.words_of(bad)})[:3] == (None, chain, True)
    assert m.restore_sentence(bad, p, detector, None)[3] >= set(m.words_of(CLEAN["ru"][3]))
    assert m.no_rarer("été", "ÈtÈ", {"été": 1, "ÈtÈ": 2}) and not m.no_rarer("été", "ÈtÈ", {"été": 1, "ÈtÈ": 3})


def test_words_are_cut_alike_in_python_and_in_spark(spark):
    texts = ["Où est (l’échelle), «là» ?\nétait\tvu", "画面が 暗 été", "", "plain", "naïve—déjà 🎬x", " \u00a0é. "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", m.word_column(m.F.col("t")).alias("w")).collect()
    assert {r.i: sorted(r.w) for r in got} == {i: m.words_of(t) for i, t in enumerate(texts)}


def test_strict_runs_layers_capitals_and_long_lines(corpus):
    detector = m.train(corpus)
    utf8 = m.CHAINS.index((("utf-8", "cp1252"),))
    once = m.garble("Où est l’échelle déjà", utf8)
    line = "plain words and more of them " * 40 + once + " été à côté" + " and so on" * 200
    (found,) = m.restore([line], detector, [None])
    assert found[0] and found[2] == line.replace(once, "Où est l’échelle déjà") and found[3]
    twice = m.garble(m.garble("Où est l’échelle déjà", utf8), utf8)
    assert m.restore([twice], detector, [None])[0][2] == "Où est l’échelle déjà"
    assert m.restore(["Девочка открывает чайник, ребёнок молчит."], detector, [None])[0][0] is False
    assert "".join(m.pieces(line)) == line and max(map(len, m.pieces("é" * 1000))) <= m.PIECE

import pytest
from pyspark.sql import functions as F

from komagrid.llm import lang, langid, lines

HELD_OUT = [
    ("en", "the children were playing in the garden when the rain began."), ("de", "die kinder spielten im garten, als der regen begann."), ("fr", "les enfants jouaient dans le jardin quand la pluie a commencé."),
    ("es", "los niños jugaban en el jardín cuando empezó la lluvia."), ("it", "i bambini giocavano nel giardino quando è cominciata la pioggia."), ("pt", "as crianças brincavam no jardim quando começou a chuva."),
    ("vi", "bọn trẻ đang chơi trong vườn thì trời bắt đầu mưa."), ("id", "anak-anak sedang bermain di taman ketika hujan mulai turun."), ("ru", "дети играли в саду, когда начался дождь."),
    ("ja", "雨が降り始めたとき、子供たちは庭で遊んでいました。"), ("ko", "비가 오기 시작했을 때 아이들은 정원에서 놀고 있었다."), ("zh", "开始下雨的时候，孩子们正在花园里玩。"),
]
MORE = [
    ("en", "She said that they would not come. We were going to the house. It is not the first time that you have been there. There was nothing to do but wait for the train."),
    ("de", "Sie sagte, dass sie nicht kommen würden. Wir gingen zum Haus. Es ist nicht das erste Mal. Die Kinder waren im Garten, als er kam. Dann begann es."),
    ("fr", "Elle a dit que les autres ne viendraient pas. Nous allions dans la maison. Ce n'est pas la première fois. Les enfants étaient dans le jardin quand il est arrivé."),
    ("es", "Ella dijo que los otros no vendrían. Íbamos a la casa cuando llegó. No es la primera vez. Los niños estaban en el jardín cuando empezó todo."),
    ("it", "Lei ha detto che gli altri non sarebbero venuti. Andavamo nella casa quando è arrivato. Non è la prima volta. I bambini erano nel giardino con la pioggia."),
    ("pt", "Ela disse que os outros não viriam. Nós íamos para a casa quando ele chegou. Não é a primeira vez. As crianças estavam no jardim quando começou tudo."),
    ("id", "Dia berkata bahwa mereka tidak akan datang. Kami pergi ke rumah ketika dia tiba. Ini bukan yang pertama kali. Anak-anak sedang berada di taman ketika itu mulai."),
]


def test_held_out_accuracy():
    classify = lang.Classifier(lang.dictionaries(MORE * 3))
    got = [classify(s)[0] for _, s in HELD_OUT]
    right = sum(a == b for a, (b, _) in zip(got, HELD_OUT, strict=True))
    wrong = [(a, b) for a, (b, _) in zip(got, HELD_OUT, strict=True) if a not in (None, b)]
    assert right >= 9 and len(wrong) <= 1


def test_narrow_margins_are_rejected(dictionaries):
    classify = lang.Classifier(dictionaries)
    for text in ("mipizu?", "oh!", "0...", "", "kazu kazu"):
        assert classify(text)[0] is None


@pytest.mark.parametrize(("label", "code"), [("ja-JP", "ja"), ("EN", "en"), ("en_GB", "en"), ("zh-CN", "zh"), ("Portuguese", "pt"), ("es-la", "es"), ("n/a", None), ("und", None), ("", None), (None, None), ("xx", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(lang.canonical_label(F.col("l"))).first()[0] == code


def test_noisy_sample_is_cleaned():
    good = [("de", t) for c, t in MORE if c == "de"] + [("en", t) for c, t in MORE if c == "en"]
    kept = lang.clean_sample({"de": [t for c, t in good if c == "de"] * 2 + [HELD_OUT[0][1]], "en": [t for c, t in good if c == "en"] * 2})
    assert HELD_OUT[0][1] not in kept["de"]


def test_find(spark):
    en = "The children were playing in the garden. She said that they would not come. It is not the first time."
    de = "Die Kinder waren im Garten, als er kam. Sie sagte, dass sie nicht kommen würden. Es ist nicht das erste Mal."
    docs = [(i, code, text) for i, (code, text) in enumerate(MORE * 4)]
    docs += [(100, "de", en), (101, None, en), (102, "en-US", en), (103, "en", f"{en}\n{de}"), (104, "fr", ""), (105, "fr", None), (106, "de", en), (107, "en", "The Garden of Kazu"), (None, "de", en)]
    documents = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    box = "region_id long, chapter_id string, manga_id string, text string"
    regions = spark.createDataFrame([(1, "c1", "m", "The Garden of Kazu / 3\nShe said that they\nwould not come."), (1, "c1", "m", "The Garden of Kazu / 3\nShe said that they\nwould not come."), (2, "c1", "m", f"{en} Die Kinder waren im Garten, als er kam."), (3, "c2", "m", None), (4, None, None, "¿?")], box)
    chapters = spark.createDataFrame([(1, "c1", "de"), (2, "c1", "en"), (3, "c2", "de"), (4, "c1", "??")], "record_id long, id string, language string")
    manga = spark.createDataFrame([("m", "The Garden of Kazu")], "id string, title string")
    residue = spark.createDataFrame([(106,)], "doc_id long")
    got = {tuple(r) for r in langid.find(documents, chapters, regions, manga, residue).collect()}
    assert got == {
        ("documents", 100, "wrong", "en"), ("documents", 101, "missing", "en"), ("documents", 103, "mixed", "en"), ("documents", 103, "mixed", "de"),
        ("region_info", 2, "mixed", "en"), ("region_info", 2, "mixed", "de"), ("chapters", 1, "wrong", "en"), ("chapters", 4, "missing", "en"),
    }


def test_segments(spark):
    text = "She said that they would not come. Sie sagte, dass sie nicht kommen würden. Es ist nicht das erste Mal."
    page = "The Garden of Kazu / 2\nShe said that they would not\ncome. Sie sagte, dass sie nicht kommen würden."
    rows = [("documents", 1, None, text), ("documents", 1, None, text), ("documents", 2, None, None), ("documents", 3, None, ""), ("region_info", 1, "m", page), (None, None, None, "x")]
    texts = spark.createDataFrame(rows, "record_kind string, record_id long, manga_id string, text string")
    got = langid.segments(texts, lang.dictionaries(MORE * 3), {"m": lines.Title("thegardenofkazu", "garden")}).orderBy("record_kind", "segment").collect()
    assert [(r.record_kind, r.record_id, r.segment, r.lang, r.n_sentences) for r in got if r.lang] == [
        ("documents", 1, 0, "en", 1), ("documents", 1, 1, "de", 2), ("region_info", 1, 0, "en", 1), ("region_info", 1, 1, "de", 1),
    ]
    assert all(0 < r.confidence <= 1 for r in got if r.lang)


def test_thinned_evenly():
    lines_ = [f"sentence number {i:04d}" for i in range(1000)]
    kept = lang._thinned(lines_, 2_100)
    assert sum(len(x) + 1 for x in kept) <= 2_100 and len(kept) >= 90 and kept[0] < "sentence number 0020" and kept[-1] > "sentence number 0980"
    assert lang._thinned(lines_, 10**6) == lines_ and lang._thinned([], 5) == []


def test_short_whole_sentences(spark):
    """A short sentence that a language's dictionary holds as a whole makes a mix in scripts of one language too."""
    classify = lang.Classifier(lang.dictionaries([("ko", "잠깐만. 이것은 나의 책이에요. 오늘은 날씨가 아주 좋네요.")] * 2))
    assert not langid.judge(["가나."], classify)[1] and classify.holds("고맙습니다.", "ko") is False


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    regions = spark.createDataFrame([], "region_id long, chapter_id string, manga_id string, text string")
    chapters = spark.createDataFrame([], "record_id long, id string, language string")
    manga = spark.createDataFrame([], "id string, title string")
    assert langid.find(none, chapters, regions, manga, none.select("doc_id")).count() == 0


def test_lines():
    title = lines.Title("thegardenofkazu", "garden")
    for line in ("The Garden of Kazu / 2", "3 | THE GARDEN OF KAZU", "Chapter 2 - The Garden of Kazu", "Ninth Ladder presents: The Garden of Kazu", "the garden of kazu • Ch. 1."):
        assert lines.is_header(line, title) and lines.is_header(line, None, frozenset([title.flat]))
    assert not lines.is_header("I was in the garden of Kazu when the rain began to fall on us.", title)
    for line in ("12", "- 59 -", "(7)", "p. 12", "Page 181", "~69~", "42 |", "cxxvi", "· 8 ·"):
        assert lines.is_page_number(line)
    for line in ("9!", "8?!", "7...", "in 3 days", "mix", "i"):
        assert not lines.is_page_number(line)
    assert lines.paragraph(["wri-", "tten on", "it"]) == "written on it" and lines.paragraph(["あと2", "6分"]) == "あと26分"

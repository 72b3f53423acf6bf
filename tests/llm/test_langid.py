import zlib

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import langid as m
from emberlog.llm.common import table, utf8
from tests.llm.conftest import documents
from tests.oracle import TESTDATA


def test_held_out_accuracy(spark):
    docs = table(spark, f"{TESTDATA}/sf0.01", "documents").selectExpr("*", "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 as held")
    model = m.fit(docs.filter("not held"))
    got = m.identify(docs.filter("held"), model, ["doc_id", "lang"]).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert sum(r.rejected for r in got) < 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows_and_rejection(spark, odd_rows):
    docs = table(spark, f"{TESTDATA}/sf0.001", "documents")
    model = m.fit(docs)
    far = [(50, "日本語のテキストはここにあります。" * 10, "ja", "a"), (51, "Привет мир как дела сегодня " * 5, "ru", "a")]
    got = {(r.doc_id, r.lang_pred == "und"): r for r in m.identify(documents(spark, odd_rows + far), model, ["doc_id"]).collect()}
    for i in (3, 4, 5, 10):
        assert got[(i, True)].rejected and got[(i, True)].score == 0
    for i in (50, 51):
        assert got[(i, False)].rejected
    # One letter is too short to be told to be far.
    for i in (1, 2, 11):
        assert not got[(i, False)].rejected


def test_nothing_learned(spark, odd_rows):
    assert m.fit(documents(spark, [(1, "text", None, "a"), (2, None, "en", "a")])) is None
    got = m.identify(documents(spark, odd_rows), None, ["doc_id"]).collect()
    assert len(got) == len(odd_rows) and {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}


def test_empty_table(spark):
    assert m.fit(documents(spark, [])) is None
    assert m.identify(documents(spark, []), None, ["doc_id"]).columns == ["doc_id", "lang_pred", "score", "rejected"]


def test_grams_do_not_depend_on_windows(monkeypatch):
    texts = pa.array(["Ab cd efg hij", "", "x", "É ab-cd " * 30])
    whole = m.gram_counts(*utf8(texts))
    monkeypatch.setattr(m, "WINDOW", 7)
    assert np.array_equal(m.gram_counts(*utf8(texts)), whole)
    alone = [m.gram_counts(*utf8(texts.slice(i, 1)))[0] for i in range(4)]
    assert np.array_equal(np.stack(alone), whole)


def test_several_centroids():
    rng = np.random.default_rng(0)
    x = np.zeros((40, m.SIZE), dtype=np.float32)
    for i in range(40):
        x[i, i % 4 * 10:i % 4 * 10 + 10] = rng.random(10)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = (x @ m.cluster(x, 4).T).argmax(axis=1)
    assert len({tuple(own[i::4]) for i in range(4)}) == 4 and all(len(set(own[i::4])) == 1 for i in range(4))


def test_every_language_is_learned(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"l{i:03}" for i in range(410)]
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)), lang, "a") for i, lang in enumerate(names)]
    docs = documents(spark, rows, False).coalesce(4)
    model = m.fit(docs)
    assert sorted(set(model.languages)) == names
    assert all(r.lang_pred == r.lang for r in m.identify(docs, model, ["lang"]).collect())
    # Without the broadcast the sample is the same.
    monkeypatch.setattr(m, "SENT_LANGUAGES", 3)
    few = documents(spark, rows[:8] * 3, False)
    shuffled = m.fit(few, per_language=1)
    monkeypatch.undo()
    sent = m.fit(few, per_language=1)
    assert shuffled.languages == sent.languages and np.array_equal(shuffled.centres, sent.centres)


def test_a_sample_beyond_one_task_is_refused(spark, odd_rows):
    with pytest.raises(ValueError):
        m.fit(documents(spark, odd_rows), per_language=1001)


#: Sentences of languages that are not learned: three in Latin script, three in others.
FOREIGN = {
    "fi": "Aamulla kaupungin kadut olivat vielä hiljaisia, mutta satamassa kalastajat purkivat jo saalistaan. Vanha mies istui laiturilla ja katseli lokkeja, jotka kiertelivät veneiden yllä. Hänen pojanpoikansa juoksi kauppaan ostamaan leipää, juustoa ja kahvia ennen kuin muut heräsivät. Illalla he soutivat yhdessä saareen ja lämmittivät saunan.",
    "pl": "Wczesnym rankiem ulice miasta były jeszcze puste, ale na targu sprzedawcy rozkładali już warzywa i owoce. Starsza kobieta szukała świeżych jabłek, a jej wnuk przyglądał się gołębiom na dachu ratusza. Potem poszli razem do piekarni, żeby kupić chleb i drożdżówki z serem. Wieczorem opowiadała mu o dawnych czasach.",
    "tr": "Sabah erkenden şehrin sokakları henüz sessizdi, fakat limandaki balıkçılar ağlarını çoktan toplamıştı. Yaşlı adam iskelede oturmuş, teknelerin üzerinde dönen martıları izliyordu. Torunu ise kahvaltı için ekmek, peynir ve zeytin almaya bakkala koşuyordu. Akşam olunca hep birlikte eski şarkılar söylediler.",
    "ru": "Ранним утром улицы города были ещё пусты, но на рынке продавцы уже раскладывали овощи и фрукты. Пожилая женщина искала свежие яблоки, а её внук смотрел на голубей на крыше ратуши. Потом они вместе пошли в пекарню за хлебом и булочками. Вечером она рассказывала ему о прежних временах.",
    "el": "Νωρίς το πρωί οι δρόμοι της πόλης ήταν ακόμη άδειοι, αλλά στο λιμάνι οι ψαράδες ξεφόρτωναν ήδη τα δίχτυα τους. Ένας γέρος καθόταν στην προβλήτα και κοιτούσε τους γλάρους που πετούσαν πάνω από τις βάρκες. Ο εγγονός του έτρεξε στο μαγαζί για ψωμί και τυρί.",
    "ja": "朝早く、町の通りはまだ静かだったが、港では漁師たちがもう魚を下ろしていた。老人は桟橋に座り、船の上を飛ぶかもめを眺めていた。孫は朝食のパンとチーズを買いに店へ走っていった。夕方になると二人は島まで舟をこぎ、昔の歌を歌った。",
}


def test_foreign_texts_are_rejected_and_clean_ones_kept(spark):
    docs = table(spark, f"{TESTDATA}/sf0.01", "documents").selectExpr("*", "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 as held")
    model = m.fit(docs.filter("not held"))
    rng = np.random.default_rng(5)
    far = [(0, "漢字 " * 40, "zh", "a")]
    for lang, text in FOREIGN.items():
        parts = text.split("。" if lang == "ja" else " ")
        # Texts of 80 to 2,000 parts in random order.
        far += [(len(far) + k, " ".join(rng.choice(parts, n)), lang, "a") for k, n in enumerate([*[80] * 10, *[400] * 10, *[2000] * 5])]
    got = m.identify(documents(spark, far, False), model, ["lang", "doc_id"]).collect()
    assert all(r.rejected for r in got)
    clean = m.identify(docs.filter("held and text is not null"), model, ["doc_id"]).collect()
    rejected = sum(r.rejected for r in clean)
    print(f"foreign {sum(r.rejected for r in got)} of {len(got)} rejected, clean {rejected} of {len(clean)}")
    assert rejected <= 0.005 * len(clean)


def test_bounds_follow_the_learned_cosines():
    found = np.zeros((3, 2, m.STEPS), dtype=np.int64)
    found[0, 0, 100:120] = 50
    found[1, 0, 60] = 5
    found[2, 0, 60] = 5
    got = m.bounds_from(found, ["a", "a", "b"])
    assert got[0, 0] == m.SLACK * 100 / m.STEPS
    # Too few texts of its own: the language's; too few of those: the least of any language, or none.
    assert got[1, 0] == m.SLACK * 100 / m.STEPS
    assert got[2, 0] == got[0, 0] and np.isnan(got[:, 1]).all()


def test_numbers_and_marks_are_no_letters(spark):
    model = m.fit(table(spark, f"{TESTDATA}/sf0.001", "documents"))
    rows = [(i, t, "en", "a") for i, t in enumerate(["½ ² 123", "Ⅷ ١٢٣", "́ ̈", "a", "漢", "ªº"])]
    got = {r.doc_id: r.lang_pred for r in m.identify(documents(spark, rows), model, ["doc_id"]).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, False, False, False]


def test_copies_and_null_ids_do_not_widen_the_sample(spark, monkeypatch):
    """A language whose rows repeat one text, or have no id, is fitted on no more texts than any other."""
    monkeypatch.setattr(m, "_bounds", lambda rows, model: None)
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(400)]
    rows = [(None, t, "en", "a") for t in texts] + [(1, "ein text der oft steht", "de", "a")] * 400 + [(2, "noch ein text", "de", "a")]
    docs = documents(spark, rows)
    small = m.fit(docs, per_language=5)
    assert small.languages.count("en") <= 5 and small.languages.count("de") == 2
    again = m.fit(docs.repartition(7), per_language=5)
    assert again.languages == small.languages and np.allclose(again.centres, small.centres)


def test_cosines_against_plain_tf_idf(spark):
    docs = table(spark, f"{TESTDATA}/sf0.001", "documents")
    model = m.fit(docs)
    for text in ["The quick brown fox", "Ünd ein Wort", "x", ""]:
        raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in raw]
        tf = {}
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if sum(x != 32 for x in (a, b, c)) >= 2:
                slot = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 19
                tf[slot] = tf.get(slot, 0) + 1
        weights = {slot: np.log1p(n) * model.idf[slot] for slot, n in tf.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5 or 1
        cosines = [sum(w * centre[slot] for slot, w in weights.items()) / norm for centre in model.centres]
        best, score = model.nearest(m.gram_counts(*utf8(pa.array([text]))))
        assert abs(score[0] - max(cosines)) < 1e-5 and abs(cosines[best[0]] - max(cosines)) < 1e-6

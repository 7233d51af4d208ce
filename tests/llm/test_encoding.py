import random

import pytest

from quillstone.llm.encoding import CHAINS, fitted, garble, repaired, restore

CLEAN = {
    "fr": "Le nœud de relais répète la fenêtre élargie lorsque le délai est dépassé. L’équipement vérifie la clé déjà dérivée à très faible débit.",
    "de": "Der Größenwächter überträgt die nächste Kennung während der Übergabe. Das Zugangsnetz löscht den Zähler für Fußnoten.",
    "ru": "Узел ретрансляции проверяет отложенный запрос во время передачи. Функция привязки обновляет таблицу маршрутов.",
    "ja": "制御ノードは経路トークンを必要に応じて保持する。待受状態の装置は保存された鍵を送信する。",
    "en": "If the value is ≥ 30 µs, the node – see § 8.1 – doesn’t “confirm” the message… 25 °C ± 1",
}


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    return [f"{rng.choice(list(CLEAN.values()))} {i}" for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    lines = corpus()
    lines[::97] = [garble(x, CHAINS[1]) for x in lines[::97]]
    return fitted(spark, lines)


@pytest.mark.parametrize("language", CLEAN)
def test_clean_text_is_left(model, language):
    assert model.repair(CLEAN[language]) == ([], None)


@pytest.mark.parametrize("language", CLEAN)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp1251", "cp850", "mac_roman"])
def test_round_trip(model, language, wrong):
    garbled = garble(CLEAN[language], (("utf-8", wrong),))
    chains, text = model.repair("Clean line: “quoted”.\n" + garbled)
    assert chains and text == "Clean line: “quoted”.\n" + CLEAN[language]


def test_held_out_accuracy(model):
    hits = total = 0
    for chain in ((("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("koi8-r", "cp1251"),), (("cp1251", "latin-1"),)):
        for line in corpus(100, seed=9):
            text = garble(line, chain)
            if text is not None and text != line:
                total += 1
                hits += model.repair(text)[1] == line
    assert total > 250 and hits / total >= 0.95


def test_chains_invert():
    for chain in CHAINS:
        for line in CLEAN.values():
            text = garble(line, chain)
            if text is not None and "�" not in text and chain[-1][1] != "latin-1 stripped":
                assert restore(text, chain) == line


def test_frames(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(corpus(400))]
    rows += [(1000, garble(CLEAN["fr"], CHAINS[0]), "", ""), (1001, CLEAN["de"].encode("cp1252").decode("utf-8", "replace"), "", ""), (1002, None, "", ""), (1003, "", "", ""), (1004, "plain", "", "")]
    rows += [(1005, "word " * 200_000 + "dÃ©bit limitÃ©", "", "")] + [(1006, garble(CLEAN["fr"], CHAINS[0]), "", "")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, chains string, restored string")
    got = {r.doc_id: r.restored for r in repaired(frame).collect()}
    assert set(got) == {1000, 1001, 1005, 1006} and got[1000] == CLEAN["fr"] == got[1006] and got[1001] is None and got[1005].endswith("débit limité")
    assert repaired(frame).filter("doc_id = 1006").count() == 2
    assert repaired(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rare, wrong", [("ქართული ტექსტი აქ არის", w) for w in ("latin-1", "cp1252", "mac_roman")] + [("works for me ✅ and ☂ too", "mac_roman"), ("የአማርኛ ጽሑፍ", "latin-1")])
def test_pages_the_sample_lacks_are_restored(model, rare, wrong):
    garbled = garble(rare, (("utf-8", wrong),))
    assert not model._familiar(rare) and model.repair(rare) == ([], None)
    chains, text = model.repair(garbled)
    assert chains and text == rare

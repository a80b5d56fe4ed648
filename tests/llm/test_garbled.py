"""Restoring garbled words, against what was garbled."""

import random

from glossmark.llm import garbled as G

WORDS = ["nedöl", "çürüğ", "valópli", "byńłun", "příliš", "бёгуцюл", "что", "φανφών", "και", "痕瘢嘆", "ガハボ", "toskångsät", "för", "là"]


def test_forms_of_a_word():
    forms = G.garbled_forms("valópli")
    assert forms["valÃ³pli"] == ("utf-8>cp1252", True)
    assert forms["valÃƒÂ³pli"][1] and forms["val—pli"] == ("mac_roman>cp1252", False)
    assert "val�pli" in forms and "valópli" not in forms and "plain" not in G.garbled_forms("plain")


def test_made_like_words():
    assert all(map(G.natural, ["valópli", "NÃO", "Ångel", "что", "痕ガ", "ü", "½"]))
    assert not any(map(G.natural, ["pΦntvΓs", "valÃ³pli", "r�d", "Å\x9fey", "╨╕"]))


def test_read_back():
    for word in ("ιλυρά", "зудыму", "çözığ"):
        assert G.read_back(word) is None and G.read_back(word.encode().decode("ascii", "ignore") + "x") is None
        assert G.read_back(word.encode().decode("latin-1"))[0] == word
    assert G.read_back("m³") is None and G.read_back("não") is None


def entries(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    chains = [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r")]
    for i in range(120):
        words = rng.sample(WORDS, 5)
        if i % 3 == 0:
            e, d = chains[i % 4]
            rows.append((i, " ".join(w.encode(e).decode(d) for w in words)))
            truth[i] = " ".join(words)
        else:
            rows.append((i, " ".join(words + [rng.choice(["×", "½", "Ü", "m³", "þorn", "NÉDÖL"])])))
    return rows, truth


def test_tables(spark):
    rows, truth = entries(spark)
    rows += [(500, None), (501, ""), (502, "val�pli"), (503, "x" * 3000 + "é"), (504, "ｖａｌóｐｌｉ"), (None, "valÃ³pli")]
    texts = spark.createDataFrame(rows, "entry_id long, hyp string")
    clean = [(spark.createDataFrame([(" ".join(WORDS),)], "w string"), "w")]
    got = {r.entry_id: (r.restored, r.whole) for r in G.restored(texts, clean, "entry_id", "hyp").collect()}
    assert {k: v for k, v in got.items() if k in truth} == {k: (v, True) for k, v in truth.items()}
    assert set(got) - set(truth) == {502, None} and got[502][0] in ("valópli", "val�pli") and got[None][0] == "valópli"
    assert G.garbled_entries(texts.limit(0), clean, "entry_id", "hyp").collect() == []


def test_long_tokens(spark):
    """Clauses without blanks, thousands of characters long."""
    rng = random.Random(7)
    clauses = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (80, 400, 3000)]
    clean = [(spark.createDataFrame([(c,) for c in clauses], "w string"), "w")]
    garbled = [c.encode().decode(d) for c, d in zip(clauses, ("cp866", "latin-1", "koi8-r"))]
    texts = spark.createDataFrame(list(enumerate(garbled + clauses)), "entry_id long, hyp string")
    got = {r.entry_id: (r.original, r.origin) for r in G.garbled_entries(texts, clean, "entry_id", "hyp").collect()}
    assert got == {i: (c, "table") for i, c in enumerate(clauses)}


def test_origins(spark):
    """Originals come from the table; what only its trace tells of has none."""
    clean = [(spark.createDataFrame([("valópli было от",)], "w string"), "w")]
    texts = spark.createDataFrame([(1, "valÃ³pli"), (2, "x�y"), (3, "ι".encode().decode("latin-1") + "λυρά".encode().decode("latin-1")), (4, "было îò")], "entry_id long, hyp string")
    for bits in (None, 64):  # a bitmap that is full lets everything through
        found = G.garbled_tokens(*G.matches(texts, clean, "hyp", bits)).collect()
        assert {(r.original, r.chain, r.origin) for r in found if r.token != "îò"} == {
            ("valópli", "utf-8>cp1252", "table"), (None, "lost", "trace"), (None, "utf-8>latin-1", "trace"),
        }
    assert [(r.original, r.origin) for r in G.garbled_entries(texts, clean, "entry_id", "hyp").where("entry_id = 4").collect()] == [("от", "row")]


def test_short_words_by_their_row(spark):
    """Short garbled words look like words; the script of their row, or a chain found beside them, tells them."""
    clean = [(spark.createDataFrame([("от бы как у и что они на от гирэй кежетен каводуть стюпря было авый vět uče πρηβά θα σώ να το",)], "w string"), "w")]
    rows = [
        (1, "гирэй кежетен îò стюпря áû , ó"), (2, "было авый îò стюпря"), (3, "было êàê стюпря"), (4, "πρηβά èá σώ να το"),
        (5, "êàê îò"), (6, "the word îò stands alone"), (7, "было ó стюпря"), (8, "каводуть РєР°Рє было Рё"),
        (9, "vìt ale na uèe levavát"), (10, "vìt ale na levavát"), (11, "ЭТО МЮ БЫЛО НР"), (12, "это МЮ было НР"),
        (None, "было îò"), (None, "the îò"),
    ]
    texts = spark.createDataFrame(rows, "entry_id long, hyp string")
    got = G.garbled_entries(texts, clean, "entry_id", "hyp").collect()
    told = {(r.entry_id, r.token): r.original for r in got}
    assert {k: v for k, v in told.items() if k[0] != 8} == {
        (1, "îò"): "от", (1, "áû"): "бы", (1, "ó"): "у", (2, "îò"): "от", (3, "êàê"): "как", (4, "èá"): "θα", (None, "îò"): "от",
        (5, "êàê"): "как", (5, "îò"): "от", (9, "vìt"): "vět", (9, "uèe"): "uče", (12, "МЮ"): "на", (12, "НР"): "от",
    }
    assert told[8, "РєР°Рє"] == "как" and told[8, "Рё"] == "и"
    assert sum(r.entry_id is None for r in got) == 1
    assert G.restored(texts, clean, "entry_id", "hyp").where("entry_id = 1").first().restored == "гирэй кежетен от стюпря бы , у"

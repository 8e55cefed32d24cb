"""Splitting, look-alikes, encoding, leaks and personal information: properties, brute force, edges."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvist.llm.encode import TOKENIZERS, encode_column, vocabulary
from kvist.llm.leak import Passages, leaked_passages, words
from kvist.llm.lookalike import ORDINARY, ORDINARY_IDENTIFIER, Normalizer, look_alike_cases, plain_corpus, trigram_counts
from kvist.llm.pii import Names, Pseudonyms, country, find, personal_information, pseudonymised, valid_id
from kvist.llm.split import split, split_fields

SMALL = "/root/testdata/sf0.001"


# Splitting


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aåb1. \n()•-̊‍🏠", max_size=600), st.integers(2, 80), st.data())
def test_split_properties(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in pieces) == text
    assert all(e - b <= limit and s - b <= overlap and s < e for b, s, e in pieces)
    assert all(b >= p[0] and s == p[2] for p, (b, s, _) in zip(pieces, pieces[1:]))


def test_split_cuts_at_natural_boundaries():
    text = "\n\n".join(" ".join(f"Setning {i} i avsnitt {k} er her." for i in range(9)) for k in range(6))
    for begin, start, _ in split(text, 300, 60)[1:]:
        assert text[start - 2 : start] in ("\n\n", ". ") and (text[begin - 1].isspace() or begin == start)
    assert all(text[s - 2 : s] == "\n\n" for _, s, _ in split(text, 400, 60)[1:])
    assert [e - s for _, s, e in split("x" * 1000, 400, 100)] == [300, 300, 300, 100] or len(split("x" * 1000, 400, 100)) >= 3
    with pytest.raises(ValueError):
        split("x", 10, 10)


def test_split_fields(spark):
    long = "ord " * 5000
    df = spark.createDataFrame([(1, long, None), (1, long, None), (2, "x" * 800, ""), (3, None, "y" * 801)], "_ord bigint, a string, b string").withColumn("item_table", F.lit(0))
    got = split_fields(df, "t", ["a", "b"]).filter("piece = 0").select("item_ord", "item_field").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "a"), (3, "b")]
    assert split_fields(df.limit(0), "t", ["a"]).count() == 0


# Look-alikes

COUNTS = {}
for _w in "dersom ildsted tunsøyle fasade krav nødgrense hører i og merkerapport prosent".split():
    for _i in range(len(_w) + 1):
        _g = f"^^{_w}^"[_i : _i + 3]
        COUNTS[_g] = COUNTS.get(_g, 0) + 50
COUNTS["^a^"] = 5


@pytest.mark.parametrize("text,plain,case", [
    ("dersοm krav", "dersom krav", True), ("Ιldsted", "Ildsted", True), ("nødgrеnsе", "nødgrense", True), ("і og", "i og", True), ("а) krav", "a) krav", True),
    ("ｋｒａｖ", "krav", True), ("Krav", "Krav", True), ("loftsﬂaten", "loftsflaten", True), ("må", "må", True), ("kr­av", "krav", True), ("krav og", "krav og", True),
    ("стена og σύστημα", "стена og σύστημα", False), ("λ-verdi og ΔT, m² ½ × «x» – 5", "λ-verdi og ΔT, m² ½ × «x» – 5", False),
    ("🏗️ 👨‍👩‍👧 krav", "🏗️ 👨‍👩‍👧 krav", False), (" krav\r\nog ", "krav\nog", False), ("", "", False), ("entré à la", "entré à la", False),
])
def test_plain_text(text, plain, case):
    assert Normalizer(COUNTS).plain(text, False) == (plain, case)


@pytest.mark.parametrize("text,plain,case", [("§ 16–1а ", "§ 16-1a", True), ("8-5", "§ 8-5", False), (" § 8-5 ", "§ 8-5", False), ("１５-9", "§ 15-9", True), ("§ 8-​5", "§ 8-5", True), ("annet", "annet", False), ("", "", False)])
def test_plain_identifier(text, plain, case):
    assert Normalizer({}).plain(text, True) == (plain, case)


@pytest.mark.parametrize("text,plain,case", [("стена", "стена", False), ("ο ρ σύστημα 1–2", "o ρ σύστημα 1-2", True), ("krаv 3", "krav 3", True), ("§ 8-5 а", "§ 8-5a", True), ("8-5α", "§ 8-5a", True), ("νερό", "νερό", False)])
def test_words_of_identifiers(text, plain, case):
    assert Normalizer(COUNTS | {"^o^": 1}).plain(text, True) == (plain, case)


@pytest.mark.parametrize("text,plain,case", [
    ("caf\u0435", "cafe", True), ("\u0443oga", "yoga", True), ("yog\u0430", "yoga", True), ("\u0501ag", "dag", True), ("T\u0395\u039a", "TEK", True), ("\u041c\u043e\u0441k\u0432\u0430", "\u041c\u043e\u0441\u043a\u0432\u0430", False),
    ("\u0445\u043e\u0440 \u0441\u043e\u0440 \u043e\u0441\u0430", "\u0445\u043e\u0440 \u0441\u043e\u0440 \u043e\u0441\u0430", False), ("Ⅳ", "IV", True), ("ǆ", "dž", True), ("⑴", "(1)", True), ("\u00b5m", "\u00b5m", False), ("№ 5…", "№ 5…", False), ("ΔT", "ΔT", False),
])
def test_words_of_one_script(text, plain, case):
    assert Normalizer(COUNTS).plain(text, False) == (plain, case)


def test_look_alike_tables(spark):
    p = spark.createDataFrame([(1, "§ 1-1", "krav"), (2, None, None), (3, "§ 1-1", "kr­av"), (3, "§ 1-1", "kr­av")], "_ord bigint, section_id string, reg_text string").withColumn("value", F.lit(1))
    q = spark.createDataFrame([(7, ["1-1", None, "1–1", "1‑2"]), (8, None), (9, [])], "_ord bigint, target_sections array<string>")
    assert sorted(map(tuple, look_alike_cases(p, q).collect())) == [("tek17_dibk", 1, "section_id"), ("tek17_dibk", 3, "reg_text"), ("tek17_eval_questions", 7, "target_sections")]
    plain = plain_corpus(p, q)
    assert plain.filter("item_field = 'target_sections'").count() == 4 and {r["plain"] for r in plain.filter("item_field = 'section_id'").collect()} == {"§ 1-1", None}
    assert look_alike_cases(p.limit(0), q.limit(0)).count() == 0
    counts = trigram_counts(spark.createDataFrame([(1, "av av"), (2, None)], "_ord int, t string"), "t")
    assert counts == {"^^a": 2, "^av": 2, "av^": 2}


def test_an_en_dash_alone_is_a_case_of_identifiers(spark):
    p = spark.createDataFrame([(1, "§ 8–5", "1–2 m"), (2, "§ 8-5", "«krav» – 5 m²"), (3, "8−5", "−5")], "_ord bigint, section_id string, reg_text string")
    q = spark.createDataFrame([(7, ["1-1", "16–3"]), (8, ["16-3", None])], "_ord bigint, target_sections array<string>")
    got = look_alike_cases(p, q)
    assert sorted(map(tuple, got.collect())) == [("tek17_dibk", 1, "section_id"), ("tek17_dibk", 3, "section_id"), ("tek17_eval_questions", 7, "target_sections")]
    plain = plain_corpus(p, q).filter("is_case").select("item_table", "item_ord", "item_field").distinct()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.collect()))


def test_long_words_are_counted(spark):
    word = "ab" * 50_000
    counts = trigram_counts(spark.createDataFrame([(1, f"{word} av"), (2, "")], "_ord int, t string"), "t")
    assert counts == {"^^a": 2, "^ab": 1, "aba": 49_999, "bab": 49_999, "ab^": 1, "^av": 1, "av^": 1}


@pytest.mark.parametrize("identifier,pattern", [(True, ORDINARY_IDENTIFIER), (False, ORDINARY)])
def test_the_filter_drops_no_case(identifier, pattern):
    n = Normalizer(COUNTS)
    for ch in map(chr, (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))):
        assert not n.plain(f"8{ch}5", identifier)[1] or re.search(pattern, ch), hex(ord(ch))


# Encoding


def test_encoding_is_exact():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n  x", "a" * 3000, "ab" * 2000, "<|endoftext|> hei", " " * 500 + "x"]
    texts += ["".join(rng.choice("aaabcdeé ØøÆ​ \t\n'’s<|>12²½九🏠́\U0001f468‍") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(25)) for _ in range(1000)]
    bpe = vocabulary(f"{TOKENIZERS}/byte_bpe_50k.json")
    offsets, ids = bpe.encode(texts)
    want = [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert 0 < bpe.failed < bpe.seen


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hei"), (1, "hei"), (2, ""), (3, None), (4, " ")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    rows = sorted((r["doc_id"], tuple(r["ids"])) for r in encode_column(df, "doc_id", "text").collect())
    assert rows == [(1, (27392,)), (1, (27392,)), (2, ()), (3, ()), (4, (220,))] and encode_column(df.limit(0), "doc_id", "text").count() == 0


# Leaks


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary_ = [f"o{i}" for i in range(12)]
    passages = [(i, " ".join(rng.choice(vocabulary_) for _ in range(rng.randint(3, 30)))) for i in range(25)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary_) for _ in range(20)]
        for _ in range(rng.randint(0, 2)):
            p = passages[rng.randrange(25)][1].split()
            a = rng.randrange(len(p))
            w[5:5] = p[a : a + rng.randint(5, 30)]
        docs.append((d, ", ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(90, None), (91, ""), (92, " \n")]
    want = set()
    for d, t in docs:
        for i, p in passages:
            pw, dw = words(p), words(t)
            runs = {tuple(pw[k : k + 12]) for k in range(len(pw) - 11)}
            if any(tuple(dw[k : k + 12]) in runs for k in range(len(dw) - 11)):
                want.add((d, i))
    got = leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x")), spark.createDataFrame([*passages, (77, None), (78, "")], "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.filter("longest >= 12").collect()} == want


def test_reordered_passage_is_a_leak():
    halves = [" ".join(f"w{i}" for i in range(8)), " ".join(f"w{i}" for i in range(8, 16))]
    index = Passages([(1, " ".join(halves))])
    import numpy as np

    codes = np.array([index.code.get(w, 0) for w in words(f"x {halves[1]} y {halves[0]} z {halves[0]}")])
    assert list(index.tiles(codes)) == [(0, 8, 16, 2)]


def test_passages_held_and_joined_agree(spark, monkeypatch):
    import kvist.llm.leak as leak

    d, p = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "eval_passages"))
    whole = sorted(map(tuple, leaked_passages(d, p).collect()))
    held = leak.leaked_passages(d, p, run=9, coverage=0.3)
    lower = sorted(map(tuple, held.collect()))
    monkeypatch.setattr(leak, "HELD_CHARS", 1000)
    monkeypatch.setattr(leak, "HEAVY", 2)
    assert sorted(map(tuple, leaked_passages(d, p).collect())) == whole and len(whole) < len(lower)
    assert sorted(map(tuple, leaked_passages(d, p, run=9, coverage=0.3).collect())) == lower
    assert leaked_passages(d.limit(0), p).count() == 0 == leaked_passages(d, p.limit(0)).count()
    same = [spark.createDataFrame([(1, "ja " * 40)], "doc_id bigint, text string"), spark.createDataFrame([(7, "ja " * 30 + "x " * 400)], "item_id bigint, text string")]
    assert [r["longest"] for r in leaked_passages(*same).collect()] == [30]
    twice = d.filter("text IS NOT NULL").limit(20)
    assert leaked_passages(twice.union(twice), p).count() == 2 * leaked_passages(twice, p).count()


# Personal information

NAMES = Names(["Marit", "Ola", "Per"], ["Nordbakkmo", "Solbakkmo", "Flatbakkmo", "Kvitgrindmo", "Hesgrindmo", "Lundgrindmo"])


@pytest.mark.parametrize("text,kind,found", [
    ("skriv til ola.n+1@mail.firma-as.example.", "email", "ola.n+1@mail.firma-as.example"), ("til post (krøllalfa) mail punkt firma punkt test i dag", "email", "post (krøllalfa) mail punkt firma punkt test"),
    ("OLA[at]FIRMA.EXAMPLE", "email", "OLA[at]FIRMA.EXAMPLE"), ("tlf. 22 33 44 55.", "phone", "22 33 44 55"), ("(kontakt (+47) 99 88 77 66)", "phone", "(+47) 99 88 77 66"),
    ("ring +44 7700 900023 nå", "phone", "+44 7700 900023"), ("Mobil: 99887766", "phone", "99887766"), ("nås på 0047 41234567.", "phone", "0047 41234567"),
    ("bor i Nedre Lillegata 12 B. Så", "address", "Nedre Lillegata 12 B"), ("i Storebakkv. 7", "address", "Storebakkv. 7"), ("Prestens vei 4a,", "address", "Prestens vei 4a"), ("lives at 71 Quill Close.", "address", "71 Quill Close"),
    ("Marit Ola Nordbakkmo sa", "name", "Marit Ola Nordbakkmo"), ("av Ola K. Ukjentgrindmo.", "name", "Ola K. Ukjentgrindmo"), ("(NORDBAKKMO, MARIT)", "name", "NORDBAKKMO, MARIT"), ("P. Nyttbakkmo skrev", "name", "P. Nyttbakkmo"), ("marit-ola nordbakkmo hesgrindmo", "name", "marit-ola nordbakkmo hesgrindmo"),
])
def test_found(text, kind, found):
    assert [(text[s:e], k) for s, e, k in find(text, NAMES)] == [(found, kind)]


@pytest.mark.parametrize("sign", [f"{b}{s}{w}{s}{e}" for b, e in ("()", "[]", "{}", "<>") for s in ("", " ", "\u00a0", "\n") for w in ("at", "æt", "KRØLLALFA", "alfakrøll", "snabel-a", "snabela")] + [f"{s}{w}{s}" for s in (" ", "\t", "\u00a0", "\n") for w in ("at", "krøllalfa", "alfakrøll", "snabela")])
def test_written_out_signs(sign):
    dot = f"{sign[-1]}dot{sign[-1]}" if sign[0].isspace() else "."
    mail = f"ola{sign}firma{dot}example"
    assert [(mail, "email")] == [(f"skriv til {mail}"[s:e], k) for s, e, k in find(f"skriv til {mail}", NAMES)]


@pytest.mark.parametrize("text", [
    "fil plan3@2x.png og pris@enhet og @tilsyn", "Saksnr. 20177825 er avsluttet, beløp 36 742 048 kroner", "Org.nr. 993 526 722, konto 7050.81.86807, datert 15.03.2019", "Riksvei 15 og Fylkesvei 515 og County Road 585",
    "Nordbakkmo kommune, Nordbakkmo-metoden, Marit alene", "over 27 °C. Nordbakkmo kommune har", "tallet 12345678901 her", "", "rom 15B, rev. 12, tegning 869171-16",
])
def test_not_found(text):
    assert find(text, NAMES) == []


def made_id(rng, d_off=0, m_off=0):
    while True:
        d, m, y, i = rng.randint(1, 28) + d_off, rng.randint(1, 12) + m_off, rng.randint(0, 99), rng.randint(0, 999)
        head = f"{d:02d}{m:02d}{y:02d}{i:03d}"
        for k in range(100):
            if valid_id(head[:2], head[2:4], head[4:6], head[6:], f"{k:02d}"):
                return f"{head}{k:02d}"


def test_ids_and_pseudonyms():
    rng, p = random.Random(5), Pseudonyms(b"k")
    seen = {}
    for off in ((0, 0), (40, 0), (0, 40), (0, 65), (0, 80), (40, 80)):
        for _ in range(30):
            x = made_id(rng, *off)
            text = f"{x[:6]} {x[6:]}"
            assert [(text[s:e], k) for s, e, k in find(text, NAMES)] == [(text, "id_number")]
            y = p.id_number(text)
            digits = y.replace(" ", "")
            assert y[6] == " " and valid_id(digits[:2], digits[2:4], digits[4:6], digits[6:9], digits[9:]) and y == p.id_number(text)
            assert seen.setdefault(y, x) == x
    assert p.phone("+47 22 33 44 55").startswith("+47 ") and p.phone("22334455") == p.phone("22 33 44 55").replace(" ", "") and p.phone("22334455") != Pseudonyms(b"l").phone("22334455")
    values = [p.permute(v, 1000, "t") for v in range(1000)]
    assert sorted(values) == list(range(1000)) and [p.permute(v, 1000, "t", back=True) for v in values] == list(range(1000))


def test_personal_information_tables(spark):
    text = "Marit Nordbakkmo og Marit Nordbakkmo, tlf 22 33 44 55. " * 200
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " ")], "doc_id bigint, text string").withColumn("kind", F.lit(1))
    names = spark.createDataFrame([("Marit", "given"), ("Nordbakkmo", "family"), (None, "given")], "name string, name_kind string")
    assert sorted(map(tuple, personal_information(docs, names).collect())) == [(1, "name", "Marit Nordbakkmo"), (1, "phone", "22 33 44 55")]
    out = {r["doc_id"]: r for r in pseudonymised(docs, names, b"k").collect()}
    assert out[1]["replaced"] == 600 and "Marit" not in out[1]["text"] and out[1]["text"].count(", tlf [PHONE:") == 200 and out[2]["text"] is None and out[3]["text"] == ""
    assert personal_information(docs, names.limit(0)).filter("kind = 'name'").count() == 0 and personal_information(docs.limit(0), names).count() == 0


@pytest.mark.parametrize("kind,spellings", [
    ("phone", ["91234567", "912 34 567", "91 23 45 67", "+47 91234567", "+4791234567", "004791234567", "(+47) 91 23 45 67", "0047 912 34 567"]), ("phone", ["+447700900023", "+44 7700 900023", "0044 7700 900-023"]),
    ("email", ["Ola.Berg@firma.example", "ola.berg (at) firma.example", "ola.berg[at]firma dot example", "ola punkt berg krøllalfa firma punkt example", "OLA.BERG@FIRMA.EXAMPLE"]),
    ("name", ["Ola Nordbakkmo", "Nordbakkmo, Ola", "NORDBAKKMO OLA", "ola  nordbakkmo"]), ("address", ["Nedre Lillegata 12 B", "nedre  Lillegata 12b", "Nedre Lillegt. 12B"]), ("address", ["Storebakkv. 7", "Storebakkveien 7"]),
    ("date", ["2020-01-31", "31.01.2020", "31/1/2020", "31.1.2020"]),
])
def test_spellings_of_a_value_are_linked(kind, spellings):
    p = Pseudonyms(b"k", NAMES)
    bare = {re.sub(r"^00(?=4)|[^0-9a-f]", "", p.placeholder(kind, x).split(":")[1]) if kind == "phone" else p.placeholder(kind, x) for x in spellings}
    if kind == "phone":
        bare = {x.removeprefix("47" if len(x) > 8 else "") for x in bare} if spellings[0] == "91234567" else bare
    elif kind == "date":
        bare = {tuple(map(int, re.split("[./-]", x[6:-1])[:: 1 if "-" in x else -1])) for x in bare}
    assert len(bare) == 1 and p.placeholder(kind, spellings[0]) != Pseudonyms(b"l", NAMES).placeholder(kind, spellings[0])


def test_pseudonyms_are_permutations():
    p = Pseudonyms(b"k")
    numbers = [f"+47 {n}" for n in range(91234000, 91234300)]
    assert len({p.phone(x) for x in numbers}) == len(numbers) and {p.phone(x)[:4] for x in numbers} == {"+47 "} and len({p.phone(x)[4] for x in numbers}) > 4
    assert {p.phone(x)[4:].replace(" ", "") for x in numbers} == {p.phone(x[4:]) for x in numbers}
    days = [f"{d:02d}.{m:02d}.{y}" for y in range(1999, 2003) for m in range(1, 13) for d in range(1, 29)]
    assert len({p.date(x) for x in days}) == len(days) and all(re.fullmatch(r"\d\d\.\d\d\.\d{4}", p.date(x)) for x in days)
    assert [country(x) for x in ("4791234567", "15551234", "79001234", "3581234")] == ["47", "1", "7", "358"]
    with pytest.raises(ValueError):
        Pseudonyms(b"")


def test_long_local_parts_and_streets():
    local, street = f"{'a' * 63}b punkt {'c' * 63}d", f"Nedre {'S' + 'o' * 90}s vei"
    text = f"skriv til {local}@firma.example, bor i {street} 12 B"
    assert [(text[s:e], k) for s, e, k in find(text, NAMES)] == [(f"{local}@firma.example", "email"), (f"{street} 12 B", "address")]
    assert find("organisasjons" + "u" * 60 + "nummeret: 99 35 26 72", NAMES) == []


def test_a_large_register_is_looked_up():
    many = Names(["Ola"], [f"{a}{b}{c}bakkmo" for a in "BDFGHK" for b in "aeiou" for c in "lmnr"])
    text = "Ola Tunbakkmo og Ola Viken. " * 400
    assert len(find(text, many)) == 800 and many.is_composed("tunbakkmo") and not many.is_composed("bakkmo")


def test_dates_are_replaced_on_request(spark):
    docs = spark.createDataFrame([(1, "født 31.01.1980, sak 2020-02-30, versjon 1.2.3, den 5.6.2021.")], "doc_id bigint, text string")
    names = spark.createDataFrame([], "name string, name_kind string")
    text = pseudonymised(docs, names, b"k", with_dates=True).first()
    assert text["replaced"] == 2 and "31.01.1980" not in text["text"] and "2020-02-30, versjon 1.2.3" in text["text"] and pseudonymised(docs, names, b"k").first()["replaced"] == 0

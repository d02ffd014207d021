"""Canonical names, token ids, leaks and languages on small rows, against brute force where there is one."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import canonical, encode, language, leak

ENTITY = "id string, name string, kind string, aliases array<string>"


def test_map_to_list(spark):
    catalog = spark.createDataFrame(
        [("E1", "parcel-planner", "rule", ["kelmirvex"]), ("E2", "parcel_planner", "flag", []), ("E3", "GET /parcel/planner/north", "endpoint", None), ("E4", "locker window", "team", ["felgimost", None]),
         ("E5", "recipient-settlement", "job", [])],
        ENTITY,
    )
    cases = [
        ("ParcelPlaner", "rule", [], "E1"), ("parcel planner flag", None, [], "E2"), ("planner, parcel north", None, [], "E3"), ("parcel planner south", "rule", [], ""), ("LOCKER_WINDOWS", None, None, "E4"),
        ("ｌｏｃｋｅｒ　ｗíndow", "team", [None], "E4"), ("l o c k e r  w i n d o w", "team", [], "E4"), ("lckr wndw", "x", [], "E4"), ("recipient settlem.", "job", [], "E5"), ("ABC-12", None, ["misc", "felgimost"], "E4"),
        ("n/a", None, [], ""), (None, None, ["kelmirvex"], "E1"), ("", None, None, ""), ("locker carousel", "team", ["locker window"], ""), ("old carousel", None, ["lockerwindow"], "E4"), ("z" * 2000, None, [], ""),
        ("locker manifest", "team", [], ""), ("lосkеr windоw", None, [], "E4"),
    ]
    rows = [(f"e{n}", name, kind, al) for n, (name, kind, al, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:2], ENTITY).withColumns({"key": F.lit("clash"), "entity_id": F.lit("clash")})
    # So short a list marks no kinds; what decorates its values is given.
    typed = canonical.Vocabulary(decoration=frozenset([*canonical.DECORATION, "old"]), markers={"get": "endpoint"})
    for bound in (100_000, 0):
        got = {r.entity_id: r.catalog_id for r in canonical.map_to_list(df, catalog, catalog_bound=bound, vocabulary=typed).collect()}
        assert got == {f"e{n}": want for n, (*_, want) in enumerate(cases)}
    assert canonical.map_to_list(df.where("false"), catalog).count() == 0
    empty = canonical.map_to_list(df, catalog.where("false")).collect()
    assert len(empty) == len(rows) and {r.catalog_id for r in empty} == {""}


TITLES = ["Team Lead", "Table Games Dealer", "Software Engineer", "Senior Software Engineer", "Test Manager", "Head of People", "The Table", "Planner", "Form Planner", "From Planner",
          "Chief executive officer for regional development of northern industrial harbours and bridges", "Old Town Guide"]


def test_job_titles_and_brands_without_kinds(spark):
    catalog = spark.createDataFrame([(f"T{n:02d}", t, None, None) for n, t in enumerate(TITLES)], ENTITY)
    exact = [(t, f"T{n:02d}") for n, t in enumerate(TITLES)]
    typed = [
        ("team-lead", "T00"), ("TEAM LEADS", "T00"), ("lead", ""), ("sofware enginer", "T02"), ("Senior Sofware Engineer", "T03"), ("softwareengineer", "T02"), ("test", ""), ("Tests Manager", "T04"), ("people, head of", "T05"),
        ("form planner", "T08"), ("from planner", "T09"), ("chief executive oficer for regional developmnt of northern industrial harbours and bridges", "T10"), ("the old town guide", "T11"),
        ("bridges and harbours industrial northern of development regional for officer executive chief", "T10"), ("tbd", ""), ("x" * 3000, ""),
    ]
    df = spark.createDataFrame([(f"e{n:02d}", t, None, None) for n, (t, _) in enumerate(exact + typed)], ENTITY)
    for bound in (100_000, 0):
        got = {r.entity_id: r.catalog_id for r in canonical.map_to_list(df, catalog, catalog_bound=bound).collect()}
        assert {t: got[f"e{n:02d}"] for n, (t, _) in enumerate(exact + typed)} == dict(exact + typed)


def test_words_that_mark_a_kind_are_learned(spark):
    names = [(f"E{n}", "route", 0, f"{'PUT' if n % 2 else 'GET'} /a{n}/b") for n in range(30)] + [(f"R{n}", "rule", 0, f"late a{n}" if n % 2 else f"a{n} late") for n in range(30)]
    got = canonical.learned(spark.createDataFrame(names, "id string, kind string, pos int, value string"), canonical.Vocabulary())
    assert got.markers == {"put": "route", "get": "route"} and got.kinds == {"route": "route", "rule": "rule"}


def test_alignment_reads_any_number_of_words():
    words = [f"word{c}{c}x" for c in "abcdefghijklmnop"]
    assert canonical.align(words, words, frozenset()) == 0.0
    assert canonical.align(words[::-1], words, frozenset()) == pytest.approx(0.05)
    assert canonical.align([words[0][:-1] + "q", *words[1:]], words, frozenset()) == pytest.approx(0.3)
    assert canonical.align(words[1:], words, frozenset()) is None
    assert canonical.align(["form", "planner"], ["from", "planner"], frozenset({"form", "from", "planner"})) is None


def test_token_ids_equal_a_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", None, " ", "a" * 3000, "Hello  world\r\n\tit's 12345 <|endoftext|>", "Ünïcödé — 日本語 🚚📦‍ x", "don'T we'll  \n\n  ", "0x1f_" * 40, "﻿é́"]
    texts += ["".join(rng.choice("abz ABC \n'0129,.-_äßпр日🚀") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(df, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()}
    assert got == {n: (reference.encode(t, add_special_tokens=False).ids if t else []) for n, t in enumerate(texts)}
    assert encode.encode_corpus(df.where("false"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


ITEM = "The frosted notch shelters the lively lantern against the humble tarpaulin at gate 44 while brittle pallets cross the narrow quay."
FILL = "Nobody could explain why only some of these doors opened during the night. " * 30


def test_leaks(spark):
    words = ITEM.split()
    half = " ".join(words[3:16])
    texts = {
        1: FILL + ITEM, 2: FILL + half + ". " + FILL, 3: FILL + " ".join(words[:9]) + ". " + FILL, 4: ITEM.upper().replace(" ", "\n"), 5: "**" + ITEM.replace(" ", "** _"),
        6: ITEM.replace("lively", "sleepy").replace("gate", "the gate"), 7: ITEM.replace("o", "0").replace("l", "1"), 8: " ".join(sorted(words)), 9: None, 10: "", 11: FILL * 40 + half,
        12: '{"a": "' + "".join(f"\\u{ord(c):04x}" if c == "e" else c for c in ITEM) + '"}', 13: ITEM.replace("a", "á").replace("against", "agai­nst"),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("hash", F.lit(0))
    docs = docs.unionByName(docs.where("doc_id = 1"))
    items = spark.createDataFrame([(1, ITEM), (2, "too short to leak"), (3, None), (1, ITEM)], "item_id bigint, text string")
    for bound in (3_000_000, 0):
        got = {tuple(r) for r in leak.leaked(docs.select("doc_id", "text"), items, item_bound=bound).collect()}
        assert got == {(n, 1) for n in (1, 2, 4, 5, 6, 7, 11, 12, 13)}
    assert leak.leaked(docs.select("doc_id", "text").where("false"), items).count() == 0
    assert leak.leaked(docs.select("doc_id", "text"), items.where("false")).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(6)
    shared = [rng.choice(["amber", "quay", "zinc", "hollow", "jetty", "winch"]) for _ in range(4)]
    a = fingerprints_of(["x", "yy", *shared, "zzz"])
    b = fingerprints_of(["other", "text", "before", *shared, "and", "after"])
    assert a & b


def test_fingerprints_of_a_batch_are_those_of_each_text():
    rng = random.Random(8)
    texts = [[rng.choice(["amber", "quay", "zinc", "hü", "a", "😀x"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))] for _ in range(60)]
    text, at, hashed = leak.fingerprints(texts, 8, 4)
    for n, words in enumerate(texts):
        _, alone, own = leak.fingerprints([words], 8, 4)
        assert at[text == n].tolist() == alone.tolist() and hashed[text == n].tolist() == own.tolist()
        letters = len("".join(words)) - 7
        assert (len(alone) > 0) == (letters > 0) and all(0 <= p < letters for p in alone)


def brute_stretch(item, doc, drop=2, least=8):
    """Every match against every match before it."""
    best, found = 0, []
    for i, word in enumerate(doc):
        for j in range(1, len(item) + 1):
            if leak.same_word(item[j - 1], word):
                before = [(s - max(i - a, j - b) + 1, p, f) for a, b, (s, p, f) in found if a < i and b < j and max(i - a, j - b) <= drop + 1]
                score, peak, first = max([(s, p, f) for s, p, f in before if s > 0 and s >= p - drop], default=(0, 0, j))
                found.append((i, j, (score + 1, max(peak, score + 1), first)))
                if score + 1 >= least:
                    best = max(best, j - first + 1)
    return best


def test_stretches_against_all_cells():
    rng, words = random.Random(2), [f"word{c}x" for c in "abcdefghij"] + ["the", "of", "12345"]
    for _ in range(300):
        item = [rng.choice(words) for _ in range(30)]
        doc = [rng.choice(words) for _ in range(10)] + item[rng.randrange(5) : rng.randrange(12, 30)] + [rng.choice(words) for _ in range(10)]
        for _ in range(rng.randrange(6)):
            n = rng.randrange(len(doc))
            doc[n : n + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        if rng.random() < 0.5:
            n = rng.randrange(len(doc))
            doc[n] = doc[n][:2] + "q" + doc[n][3:]
        assert leak.longest_stretch(leak.Wanted(item), doc) == brute_stretch(item, doc)


def fingerprints_of(words):
    return set(leak.fingerprints([words], 8, 4)[2].tolist())


TEXT = {
    "en": "The parcel was left at the door because nobody answered. We will try again tomorrow morning. Please keep your receipt.",
    "de": "Das Paket wurde vor der Tür abgelegt, weil niemand öffnete. Wir versuchen es morgen früh noch einmal. Bitte bewahren Sie den Beleg auf.",
    "fr": "Le colis a été laissé devant la porte car personne ne répondait. Nous réessayerons demain matin. Merci de conserver votre reçu.",
    "ru": "Посылку оставили у двери, потому что никто не ответил. Мы попробуем снова завтра утром. Пожалуйста, сохраните чек.",
}


def test_wrong_labels(spark):
    train = [(n * 10 + k, t, lang) for n in range(6) for k, (lang, t) in enumerate(TEXT.items())]
    odd = [
        (100, TEXT["de"], "en"), (101, TEXT["fr"], None), (102, TEXT["en"] + " " + TEXT["de"], "en"), (103, TEXT["en"], "English"), (104, "x = f(1);\nreturn x", "xx"), (105, None, None), (106, "", "de"),
        (107, '{"key": "K-1", "body": "' + TEXT["ru"] + '"}', "ru_RU"), (108, "# Titel\n\n" + TEXT["en"], "de"), (109, TEXT["en"] * 300, "en-GB"),
    ]
    df = spark.createDataFrame(train + odd, "doc_id bigint, text string, lang string").withColumns({"seg": F.lit("clash"), "label": F.lit("clash")})
    got = {tuple(r) for r in language.wrong_labels(df).collect()}
    assert got == {(100, 0, "de"), (101, 0, "fr"), (102, 0, "en"), (102, 1, "de"), (108, 0, "en")}
    assert language.wrong_labels(df.where("false")).count() == 0


def test_languages_of_every_document(spark):
    rows = [(n * 10 + k, t, lang) for n in range(6) for k, (lang, t) in enumerate(TEXT.items())]
    rows += [(100, TEXT["en"] + " " + TEXT["de"], "xx"), (101, "Bitte bewahren Sie den Beleg auf", None), (102, None, "en"), (103, "12 + 4", None), (104, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("confidence", F.lit("clash"))
    got = {(r.doc_id, r.seg): r for r in language.languages(df).collect()}
    assert len({d for d, _ in got}) == len(rows) and all(r.confidence > 0 for r in got.values() if r.lang)
    assert [got[100, n].lang for n in (0, 1)] == ["en", "de"] and got[100, 0].n_sentences == 3
    assert (got[101, 0].lang, got[101, 0].n_sentences) == ("de", 0)
    assert all((got[n, 0].lang, got[n, 0].confidence) == (None, 0.0) for n in (102, 103, 104))


def test_labels_and_sentences():
    assert [language.label_language(x) for x in ("EN", "pt-PT", "deu", "Русский", "und", "", None, "en_GB")] == ["en", "pt", "de", "ru", None, None, None, "en"]
    text = "---\nid: a\n---\n# A heading\n\nfoo.bar() { x == 1 }\n# This comment is a sentence about parcels.\n- a/b.py\n2025-01-01T00:00:00 INFO x=1\nIt was `code` here (#12). Yes.\n"
    assert language.sentences(text) == ["this comment is a sentence about parcels", "it was here"][:1] + (["it was here"] if len("itwashere") >= 12 else [])

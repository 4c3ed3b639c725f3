"""The problems' operators against brute force, exact round trips and edge cases."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import canonical, frequency, garble, leaks, packing, pairs, pieces, sampling, sentences, truncation
from quirelake.llm.pairs import Pair, core, stopped, target

NOW = dt.datetime(2025, 1, 1)


# --- 1 and 5


def test_endings():
    assert stopped("He left.") and stopped("«Он ушёл».") and stopped("他走了。”") and stopped("Il part ! »")
    assert not stopped("He le") and not stopped("He met Dr.") and not stopped("„Es ist")
    assert core("He left… (line 4)") == ("He left", True)
    assert target("runs/a/set1.en-ru.pred.txt", None) == "ru" and target(None, "pt-BR") == "pt"


def test_evidence():
    ref = "Der Fährmann verkaufte die Winteräpfel im leeren Theater am dritten Tag."
    evidence = truncation.Evidence({}, {})

    def odds(pred, ref=ref, original="The pilot sold the apples."):
        p = Pair(original, pred, ref, 1.0)
        _, _, words, ends, _, broken, by_ref, by_original, _ = truncation.view(p)
        return evidence.cell[by_ref if by_ref >= 0 else by_original] if not ends else None

    assert odds("Der Fährmann verkaufte die Wint") > 3
    assert odds(ref) is None and odds(ref[:-1]) < -1
    assert odds("Der Fährmann verkaufte …") > 1
    assert truncation.view(Pair("x", "Ganz etwas anderes ohne Ende", ref, 1.0))[3]  # another text: no case here
    # what is seen at limits outweighs what is assumed
    taught = truncation.Evidence({(True, 4): 500.0, (False, 0): 500.0}, {})
    assert taught.cell[4] > evidence.cell[4]


PAIR = "pair_id long, pred_path string, line_idx int, system string, src_lang string, target_lang string, original_text string, pred string, refs array<string>, loaded_at timestamp"


def test_truncated_finds_the_limit(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(400):
        ref = " ".join(random.choice(words) for _ in range(random.randint(5, 40))) + "."
        rows.append((i, "x.en-de.pred.txt", i, "s", "en", "de", ref, ref[:60], [ref], NOW))
    rows += [(1000, None, None, None, None, None, None, None, None, None), (1001, "x", 1, "s", "en", "de", "", "", [], NOW)]
    df = spark.createDataFrame(rows, PAIR)
    got = {r.pair_id: r for r in truncation.truncated(df).collect()}
    assert len(got) == 402 and not got[1000].truncated and not got[1001].truncated
    assert all(got[i].truncated == (len(r[6]) > 60 and not r[7].endswith(".")) for i, r in enumerate(rows[:400]) if len(r[6]) != 61)
    assert truncation.truncated(df.limit(0)).count() == 0
    limits = truncation.hazards(truncation.looked_at(df)).filter("significant and unit = 'chars'").collect()
    assert 60 in {r.length for r in limits}
    assert all(got[i].at_limit for i in range(400) if got[i].truncated)


def test_native_ends_agree_with_python(spark):
    texts = ["He left the town.", "Er ging nach Haus!”", "他走了。”", "approx.", "He met Dr.", "He left… ", "He left town. (line 4)", "no end", "", None, "a\nfinished text.\n", "long 3.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", pairs.finished(F.col("t")).alias("f"), pairs.ending(F.col("t")).alias("e")).collect():
        if r.f:
            cut, added = core(r.t)
            assert stopped(cut) and not added, r.t
    got = {r.t: r.e for r in df.select("t", pairs.ending(F.col("t")).alias("e")).collect()}
    assert got["no end"] is not None and got["approx."] is None and got[""] is None


def test_sample_of_a_share_below_a_millionth(spark):
    """A share that whole millionths round to nothing still draws rows."""
    rows = sampling.sample(spark.range(3_000_000), ["id"], 2)
    assert 1 <= len(rows) <= 2
    assert sampling.sample(spark.range(0), ["id"], 5) == []
    assert len(sampling.sample(spark.range(10), ["id"], 50)) == 10


def test_defects_of_made_pairs(spark):
    from quirelake.llm import defects

    random.seed(4)
    en = "the a pilot sold apples near river bank under bridge while others slept quietly beyond hills".split()
    de = "der ein Lotse verkaufte Äpfel am Fluss Ufer unter Brücke während andere schliefen still hinter Hügeln".split()
    fr = "le un pilote vendait pommes près rive fleuve sous pont pendant autres dormaient calme derrière collines".split()
    rows = []
    for i in range(300):
        at = [random.randrange(len(en)) for _ in range(random.randint(6, 14))]
        text = lambda words: " ".join(words[k] for k in at).capitalize() + "."
        lang = "de" if i % 2 else "fr"
        ref = text(de if i % 2 else fr)
        kind = i % 30
        pred = {0: text(en), 1: text(fr if i % 2 else de), 2: "I'm sorry, but I can't help with that request.", 3: "…", 4: ref[: len(ref) // 2]}.get(kind, ref)
        rows.append((i, f"r/x.en-{lang}.pred.txt", i, "s", "en", lang, text(en), pred, [ref], NOW))
    refusal = " ".join(["I cannot translate this text, and I will say so at great length."] * 100)
    rows.append((1000, "r/x.en-de.pred.txt", 1, "s", "en", "de", "The pilot slept near hills.", refusal, ["Der Lotse schlief hinter Hügeln."], NOW))
    rows.append((1001, "r/x.en-de.pred.txt", 1, "s", "en", "de", "Anna Bell", "", [], NOW))
    got = {r.pair_id: r.defect for r in defects.defects(spark.createDataFrame(rows, PAIR)).collect()}
    want = {0: "copy", 1: "wrong_language", 2: "refusal", 3: "empty", 4: "truncated"}
    right = sum(got.get(i) == want.get(i % 30) for i in range(300))
    assert right >= 297 and got[1000] == "refusal" and 1001 not in got


def test_defects_empty_table(spark):
    from quirelake.llm import defects

    assert defects.defects(spark.createDataFrame([], PAIR)).count() == 0
    rows = [(1, "x.en-de.pred.txt", 0, "s", "en", "de", "The map", "​ …", [], NOW), (2, "x.en-de.pred.txt", 0, "s", "en", "de", None, None, None, NOW), (3, "x", 1, "s", "en", None, "* * *", "", [], NOW)]
    assert [tuple(r) for r in defects.defects(spark.createDataFrame(rows, PAIR)).collect()] == [(1, "empty")]


# --- 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;\n。é́", max_size=400), st.integers(12, 60))
def test_pieces_cover(text, limit):
    overlap = limit // 6
    spans = pieces.cut(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a2 <= b1 and a2 > a1 and b2 > b1 for (a1, b1), (a2, b2) in zip(spans, spans[1:]))
    else:
        assert spans == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    table = pieces.RangeMaximum(np.array(values), len(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    best = max(values[a : b + 1])
    assert table.best(a, b) == max(i for i in range(a, b + 1) if values[i] == best)


def test_pieces_with_much_overlap():
    text = "word after word of text, " * 400
    for overlap in (10, 45, 50, 60, 90):
        spans = pieces.cut(text, 100, overlap)
        assert spans[-1][1] == len(text) and all(b - a <= 100 for a, b in spans)
        assert sum(text[b - 1] == " " for _, b in spans[:-1]) >= 0.95 * (len(spans) - 1)


def test_pieces_long_text_in_blocks():
    text = "One two three. " * 20_000
    spans = pieces.cut(text, 1200, 120)
    assert spans[-1][1] == len(text) and all(text[b - 2 : b] == ". " for _, b in spans)


UNIT = "unit_id long, original_text string, kind string, tag string, segments array<struct<line int, lines int, original_text string>>, loaded_at timestamp"


def test_split_units(spark):
    rows = [(1, "x" * 30, "body", "p", None, NOW), (2, "short", None, None, [(1, 1, "y" * 25), (2, 1, None), (3, 1, "ok")], NOW), (3, None, None, None, None, NOW), (4, "", None, None, None, NOW), (5, "old" * 20, "body", "p", None, NOW), (5, "new", "body", "p", None, NOW + dt.timedelta(1))]
    df = spark.createDataFrame(rows, UNIT)
    found = {(r.unit_id, r.segment_no) for r in pieces.split_units(df, 20, 4, long_only=True).collect()}
    assert found == {(1, 0), (2, 1)}
    every = pieces.split_units(df, 20, 4).filter("unit_id = 2").orderBy("line").collect()
    assert [r.segment_no for r in every] == [1, 1, 3] and [r.line for r in every] == [0, 1, 2]
    assert pieces.split_units(df.limit(0), 20, 4).count() == 0


# --- 3


def _texts():
    names = ["Anna", "Bertram", "Clarissa", "Doran", "Elmira"]
    out = []
    for i in range(400):
        n = names[i % 5]
        out += [f"Dr. {n} met Mr. Smith near the river. The ferry waited, e.g. for {n}.", f"“Is it far?” asked {n} at noon.", f"It was {i}.5 miles to the town.", f"{n} said: “It is late. We go!” Then they left.", "“The shop is closed.”", "谁知道呢？我们走吧。", f"{n} slept."]
    return out


def test_sentences():
    splitter = sentences.Splitter(sentences.train(_texts()))
    cut = lambda t: [t[a:b] for a, b in zip(*[iter(splitter.spans(t))] * 2)]
    assert cut("Dr. Anna met Mr. Smith near the river.  It was 3.5 miles to the town.") == ["Dr. Anna met Mr. Smith near the river.", "It was 3.5 miles to the town."]
    assert cut("“Is it far?” asked Doran at noon. They left.") == ["“Is it far?” asked Doran at noon.", "They left."]
    assert cut("我们走吧。谁知道呢？") == ["我们走吧。", "谁知道呢？"]
    assert cut("ผู้แปลขายแอปเปิล แพะรอรถไฟ") == ["ผู้แปลขายแอปเปิล", "แพะรอรถไฟ"]
    assert cut("  ") == [] and cut("one") == ["one"] and splitter.spans("A. B.", one=True) == [0, 5]
    long = "It was late. They slept. " * 2000
    spans = splitter.spans(long)
    assert "".join(long.split()) == "".join("".join(long[a:b] for a, b in zip(*[iter(spans)] * 2)).split())


def test_sentences_of_a_table(spark):
    rows = [(1, "They left. It rained.", "heading", "h1", None, NOW), (2, None, None, "p", None, NOW), (3, " ", None, "p", None, None), (4, "One.", "body", "p", None, NOW)]
    df = spark.createDataFrame(rows, UNIT)
    got = sorted(tuple(r) for r in sentences.sentences(df, sentences.train([])).collect())
    assert got == [(1, 1, 0, 21), (4, 1, 0, 4)]


# --- 4


def test_canonical_is_sound():
    assert canonical.conflicts() == []
    same = [("ﬁne", "fine"), ("Ｆｕｌｌ", "Full"), ("été", "\xe9t\xe9"), ("a\xa0b", "a b"), ("Ве​er", "Beer"), ("ﾊﾞ", "バ"), ("⼯", "工"), ("x‐y", "x-y"), ("so­ft", "soft"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0e4d\u0e32", "\u0e33"), ("\ufe8d", "\u0627"), ("\ufefb", "\u0644\u0627"), ("\u2163", "IV"), ("a\u2028b", "a b"), ("Օft", "Oft")]
    for a, b in same:
        assert canonical.canonical(a) == canonical.canonical(b), (a, b)
    for a, b in [("e", "é"), ("A", "a"), ("a  b", "a b"), ("–", "-")]:
        assert canonical.canonical(a) != canonical.canonical(b)
    assert canonical.caseless("Вода") == canonical.caseless("вода") and canonical.caseless("Вar") == canonical.caseless("bar")
    assert canonical.canonical(None) is None and canonical.canonical("") == ""


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_idempotent(text):
    once = canonical.canonical(text)
    assert canonical.canonical(once) == once


def test_same_look_pairs(spark):
    rows = [(1, "Full", NOW), (2, "Ｆｕｌｌ", NOW), (3, "Full", NOW), (4, "full", NOW), (5, None, NOW), (6, " ", NOW), (7, " ", NOW), (8, "Fu​ll", NOW)]
    df = spark.createDataFrame(rows, "id long, t string, at timestamp")
    got = {(r.id_a, r.id_b) for r in canonical.same_look_pairs(df, "id", "t", "f", "at").collect()}
    forms = {i: t for i, t, _ in rows if t and t.strip()}
    brute = {(a, b) for a in forms for b in forms if a < b and forms[a] != forms[b] and canonical.canonical(forms[a]) == canonical.canonical(forms[b])}
    assert got == brute == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}


# --- 6


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(0, 3)), min_size=1, max_size=14))
def test_term_counts(spark, values):
    df = spark.createDataFrame([(t, i, 2, rec or None) for i, (t, rec) in enumerate(values)], "t array<string>, k long, m int, rec long")
    got = frequency.term_counts(df, "t", ["m"], "k", "rec").collect()
    occurrences, within, least = Counter(), {}, {}
    for k, (t, rec) in enumerate(values):
        for g in [(False, " ".join(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)] + [(True, " ".join(t))]:
            occurrences[g] += 1
            within.setdefault(g, set()).update({rec} - {0})
            least.setdefault(g, k)
    assert len(got) == len(occurrences)
    assert {(r.whole, r.ngram): (r.occurrences, r.records, r.m, r.k) for r in got} == {g: (n, len(within[g]), 2 * n, least[g]) for g, n in occurrences.items()}


def test_intervals_at_borders():
    """Cut anywhere, sums add up and records are told by name."""
    random.seed(6)
    rows = sorted((s, rec, (1, rec)) for rec in range(12) for s in set(frequency.value_suffixes([random.choice("ab") for _ in range(5)], 3)))
    whole = {tuple(g): (records if names is None else len(names), sums[0]) for g, _, records, sums, names in frequency.intervals(iter(rows))}
    at = len(rows) // 2
    parts = [x for half in (rows[:at], rows[at:]) for x in frequency.intervals(iter(half))]
    total = Counter()
    told: dict = {}
    for g, _, records, sums, names in parts:
        total[tuple(g)] += sums[0]
        told.setdefault(tuple(g), set()).update(names if names is not None else range(1000, 1000 + records))
    assert {g: (len(told[g]), n) for g, n in total.items()} == whole


def test_suffixes_are_linear():
    text = [f"w{i % 700}" for i in range(3000)]
    size = len(" ".join(text))
    assert sum(map(len, frequency.value_suffixes(text, 16))) < 20 * size
    assert len(frequency.value_suffixes(text, 16)) == 3001


# --- 7


def test_pack_keeps_everything():
    random.seed(1)
    sizes = [random.randint(1, 100) for _ in range(300)]
    terms = [Counter(random.choices(range(50), k=8)) for _ in sizes]
    boxes = packing.pack(sizes, terms, 100, np.ones(1 << packing.TERM_BITS, np.float32), 8.0)
    assert sorted(i for b in boxes for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 100 for b in boxes)
    assert sum(sizes) / (100 * len(boxes)) > 0.9


def test_pack_searches_all_terms():
    """A neighbour that shares only a seed's least telling term is found."""
    idf = np.full(1 << packing.TERM_BITS, 5.0, np.float32)
    idf[999] = 0.5
    terms = [Counter([*range(100, 180), 999]), Counter(range(200, 280)), Counter(range(300, 310)), Counter([*range(400, 409), 999])]
    boxes = packing.pack([60, 60, 40, 40], terms, 100, idf, 50.0)
    assert sorted(map(sorted, boxes)) == [[0, 3], [1, 2]]


def test_containers(spark):
    rows = [(1, "word " * 60), (2, "other " * 5), (3, None), (4, ""), (5, "more text here"), (6, "more text here")]
    got = packing.containers(spark.createDataFrame(rows, "doc_id long, text string"), 32).collect()
    tokens = Counter()
    for r in got:
        if r.container is not None:
            tokens[r.container] += r.tokens
    assert max(tokens.values()) <= 32 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6}
    assert all(r.container is None for r in got if r.doc_id in (3, 4))
    assert [r.parts for r in got if r.doc_id in (2, 5, 6)] == [1, 1, 1]
    enc = packing.tokenizer()
    assert sum(r.tokens for r in got if r.doc_id == 1) == len(enc.encode_ordinary("word " * 60))
    assert packing.containers(spark.createDataFrame([], "doc_id long, text string"), 32).count() == 0


# --- 8


def _brute(item, doc, share=0.5):
    n = len(item)
    for shift in range(-n, len(doc)):
        for i in range(n):
            for j in range(n, i, -1):
                if (j - i) < share * n or i + shift < 0 or j + shift > len(doc):
                    continue
                if item[i] != doc[i + shift] or item[j - 1] != doc[j - 1 + shift]:
                    continue  # a stretch begins and ends with words it holds
                wrong = sum(item[k] != doc[k + shift] for k in range(i, j))
                if wrong <= 0.1 * (j - i):
                    return True
    return False


def test_leaks_against_brute_force():
    random.seed(5)
    item = [f"i{k}" for k in range(24)]
    index = leaks.Index([(7, " ".join(item))])
    for _ in range(60):
        a, b = sorted(random.sample(range(25), 2))
        part = item[a:b]
        for _ in range(random.randint(0, 3)):
            if part:
                part[random.randrange(len(part))] = "zz"
        doc = ["x", "y"] + part + ["q"] * 3
        assert bool(index.found(" ".join(doc))) == _brute(item, doc), part


def test_short_items():
    index = leaks.Index([(1, "one two three four five six"), (2, "alpha beta"), (3, "word")])
    assert [x[0] for x in index.found("x two three four y")] == [1]
    assert index.found("x two three y four") == [] and [x[0] for x in index.found("beta word")] == [2, 3]


def test_a_window_that_many_items_share(monkeypatch):
    monkeypatch.setattr(leaks, "AT_ONCE", 50)
    common = "once upon a time there was a lonely"
    index = leaks.Index([(i, f"{common} w{i} x{i} y{i}") for i in range(300)])
    got = index.found(f"{common} w7 x7 y7 and {common} cat")
    assert len(got) == 300 and next(x for x in got if x[0] == 7)[1] == 11


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"passage number {i} about the old ferry and its {i} winter apples", "en") for i in range(40)], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(i, f"Intro. Passage number {i} about the old ferry and its {i} winter apples. End.") for i in range(0, 40, 3)], "doc_id long, text string")
    once = sorted(map(tuple, leaks.leaks(docs, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 100)
    assert once and sorted(map(tuple, leaks.leaks(docs, items).collect())) == once


def test_removal(spark):
    items = spark.createDataFrame([(1, "The old ferry pilot sold the winter apples near the river bank", "en")], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "A long beginning of its own, much longer than what comes after it here. The OLD ferry pi-\nlot sold the ｗｉｎｔｅｒ apples near the river bank. The end."), (2, "The old ferry pilot sold the winter apples"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r for r in leaks.cleaned(docs, items).collect()}
    assert set(got) == {1, 2} and got[2].dropped and got[2].text is None
    assert got[1].text == "A long beginning of its own, much longer than what comes after it here.\nThe end." and not got[1].dropped


def test_leaks_of_tables(spark):
    items = spark.createDataFrame([(1, "The old ferry pilot sold the winter apples near the river bank", "en"), (2, None, "en"), (3, "", "en")], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "x OLD ferry, pilot\nsold the ｗｉｎｔｅｒ apples y"), (2, "The old ferry"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()] == [(1, 1)]


# --- 9


@pytest.fixture(scope="module")
def lang(spark):
    random.seed(2)
    words = "Der Fährmann verkaufte die Äpfel über den größten Fluss für zwei Körbe Öl „spät“ während später Wärme".split()
    russian = "По словам часовщик продал зимние яблоки рядом с бумажной мельницей перед рассветом".split()
    texts = [" ".join(random.choices(w, k=12)) + "." for _ in range(300) for w in (words, russian)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return garble.language(df)


def test_tables_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(garble, "LOAD", 0.0005)
    df = spark.createDataFrame([(i, f"wört {chr(97 + i % 26)}{chr(97 + i % 23)}{chr(97 + i % 19)}") for i in range(500)], "doc_id long, text string")
    assert garble.language(df).more > 0


def test_garble_round_trip(lang):
    text = "Der Fährmann verkaufte die Äpfel über den größten Fluss."
    russian = "часовщик продал зимние яблоки рядом с бумажной мельницей."
    for raw, right, wrong in [(text, "utf-8", "latin-1"), (text, "utf-8", "cp1251"), (text, "utf-8", "cp437"), (text, "cp1252", "mac-roman"), (russian, "cp1251", "latin-1"), (russian, "koi8-r", "cp1251"), (russian, "utf-8", "cp1251")]:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw.encode(right))
        assert garble.restore_line(bad, lang) == (raw, True), (right, wrong)
    assert garble.restore_line(text, lang) == (text, False) and garble.restore_line(russian, lang) == (russian, False)
    lost = "Der F�hrmann verkaufte die �pfel."
    assert garble.restore_line(lost, lang) == ("Der Fährmann verkaufte die Äpfel.", True)


def test_two_lost_bytes_of_a_character(lang):
    """A character of three bytes with two lost ones must not keep the rest of the line from being restored."""
    assert garble.restore_line("â��spÃ¤tâ�� wÃ�hrend der WÃ¤rme", lang) == ("„spät“ während der Wärme", True)
    lost = "Рядом с бумажной мельницей часовщик продал зимние яблоки перед рассветом.".encode().decode("cp1252", "replace")
    assert garble.restore_line(lost, lang)[0].endswith("с бумажной мельницей часовщик продал зимние яблоки перед рассветом.")
    assert garble.restore_line("�" * 30 + " 84", lang) == ("�" * 30 + " 84", True)


def test_meant_sign_is_no_case(lang):
    """A replacement sign by itself may be meant; the same sign at the end of misread bytes is not."""
    assert garble.restore_line("Der Fluss „�“ später.", lang) == ("Der Fluss „�“ später.", False)


def test_garbled_table(spark, lang):
    docs = spark.createDataFrame([(1, "clean"), (2, None), (3, ""), (4, "über den Fluss\ndie Ã„pfel fÃ¼r Ã–l"), (5, "für Öl")], "doc_id long, text string")
    got = garble.garbled(docs, lang).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(4, "über den Fluss\ndie Äpfel für Öl")]
    assert garble.language(docs.limit(0)).total == 1.0

"""The core operators: literal cases, invariants, edge cases, and brute force where SQL has no say."""

import datetime as dt
import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import chunking, cleaning, grouping, lines, metrics, ordered, prompts, resume, terms, units
from quirelake.operators.delivery import latest
from quirelake.sources import epub, html

LINE = "book_id long, line_idx int, text string, kind string, item_id string, file_name string, section_group int"


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f("t").alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, T.normalize_source_text, " a  b ,c ( d ) ", None, "", "x　y") == ["a b,c (d)", None, "", "x y"]
    assert values(spark, T.normalize_output_text, "中 文 字 符", "你好 ， 吗") == ["中文 字符", "你好， 吗"]
    assert values(spark, T.encode_string, "a\nb\tc\rd") == [r"a\nb\tc\rd"]
    assert values(spark, lambda c: T.compact(c, 10), "short", "a much longer text", None) == ["short", "a much lo...", None]


def test_translatable(spark):
    got = values(spark, T.reject_reason, None, " ", "BODY", "<?xml version", "http://a.b/c", "123", "[12].", "(iv)", "I", "—…", "Word", "xmlish text", "é")
    assert got == ["empty", "empty", "markup", "xml declaration", "url", "number", "number", "roman page", "roman page", "punctuation", None, None, None]
    assert values(spark, T.is_note_marker, "[12]", "fn-3", "note", "x") == [True, True, False, False]


def test_codes_and_budget(spark):
    assert values(spark, T.language_codes, "zh-CN", "en_GB", "de", None, "")[0][:2] == ["zh-CN", "zh_CN"]
    got = values(spark, T.language_codes, "zh-CN", "en_GB", "de", None, "")
    assert "zh" in got[0] and got[1] == ["en_GB", "en-GB", "en"] and got[2] == ["de"] and got[3] == [] and got[4] == []
    assert values(spark, T.epub_language, "Traditional Chinese", "Chinese", "Japanese", None) == ["zh-Hant", "zh-Hans", "zh-Hans", "zh-Hans"]
    df = spark.createDataFrame([(10, 1), (1000, 3), (100000, 1)], "t int, g int").select(T.output_budget("t", "g", 2048).alias("x"))
    assert [r.x for r in df.collect()] == [64, 1656, 2048]


def test_latest(spark):
    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    df = spark.createDataFrame([(1, "old", a), (1, "new", b), (2, "x", None), (2, "y", None), (None, "n", a)], "k int, __rank string, loaded_at timestamp")
    assert sorted((r.k or 0, r["__rank"]) for r in latest(df, ["k"]).collect()) == [(0, "n"), (1, "new"), (2, "y")]
    assert latest(df.limit(0), ["k"]).count() == 0


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, "x"), (3, None), (4, ""), (5, "\n\n")], "k int, t string")
    got = [(r.k, r.line_idx, r.text) for r in lines.text_lines(df, "k", "t").orderBy("k", "line_idx").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (5, 0, ""), (5, 1, "")]
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    read = lines.read_lines(spark, str(tmp_path), "txt")
    assert [r.text for r in read.orderBy("line_idx").collect()] == ["one", "two"]
    lines.write_lines(read, str(tmp_path / "out"))
    assert (tmp_path / "out").read_text() == "one\ntwo\n"
    two = read.select("line_idx", "text")
    assert [tuple(r) for r in lines.parallel(two, two).orderBy("line_idx").collect()] == [(0, "one", ["one"]), (1, "two", ["two"])]
    with pytest.raises(ValueError):
        lines.parallel(two, two.limit(1))


def test_kind(spark):
    df = spark.createDataFrame([("toc.xhtml", "p", ""), ("c1", "h2", "note"), ("c1", "td", ""), ("c1", "p", "id_works-cited"), ("c1", "p", "the-index"), (None, "figcaption", None), ("c1", "p", "notepad")], "i string, t string, h string")
    got = [r.k for r in df.select(units.infer_kind(F.col("i"), F.col("t"), F.col("h")).alias("k")).collect()]
    assert got == ["toc", "heading", "table_cell", "bibliography", "index", "caption", "body"]


def test_groups(spark):
    texts = ["short", "tiny", "this block is much longer", "mini"]
    df = spark.createDataFrame([(1, i, t, None, None, None, None) for i, t in enumerate(texts)], LINE)
    assert sorted((r.line_idx, r.group_start) for r in grouping.merge_groups(df, 10).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    df = spark.createDataFrame([(1, 0, "a", "heading", "i", "f", 0), (1, 1, "b", "body", "i", "f", 1), (1, 2, "c", "body", None, None, None), (1, 3, None, "body", "i", "f", 1), (2, 0, "d", "body", "i", "f", 1)], LINE)
    assert sorted((r.book_id, r.line_idx, r.group_start) for r in grouping.merge_groups(df, 10).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 0, 0)]
    assert grouping.merge_groups(df.limit(0), 10).count() == 0


def test_blocks_of_a_book_give_the_same(spark, monkeypatch):
    import random

    from quirelake.operators import ordered

    random.seed(8)
    rows, item = [], None
    for i in range(60):
        if random.random() < 0.2:
            item = random.choice([None, "a", "b", "c"])
        kind = random.choice(["heading", "body", None, "opf_title"])
        rows.append((1, i, random.choice(["x", "", None, f"t{i}"]), kind, item, random.choice(["f", "g", None]), random.choice([0, 1])))
    df = spark.createDataFrame(rows, LINE)
    records = df.selectExpr("book_id", "line_idx as group_start", "line_idx % 5 as token_count")
    every = (lambda: units.sections(df.drop("section_group")), lambda: grouping.segments(df), lambda: grouping.context(df.filter("line_idx % 3 > 0"), 2), lambda: grouping.batches(records, 4))
    once = [sorted(map(str, f().collect())) for f in every]
    monkeypatch.setattr(ordered, "BLOCK", 7)
    assert [sorted(map(str, f().collect())) for f in every] == once
    assert len(once[2]) == 40 and len(once[3]) == 60
    assert units.sections(df.drop("section_group").limit(0)).count() == 0 and grouping.segments(df.limit(0)).count() == 0


def test_numbered_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 0, "阿尔法。"), (1, 1, 0, "b"), (1, 2, 2, None)], "book_id long, line_idx int, group_start int, text string")
    made = {r.group_start: r.numbered for r in grouping.numbered(rows).collect()}
    assert made == {0: "[1] 阿尔法。\n[2] b", 2: "[1] "}
    df = spark.createDataFrame([(1, "[1] x\nlost\n2: y\n[1] z\n[1]"), (2, None), (3, "")], "k int, t string")
    assert sorted((r.k, r.number, r.value) for r in grouping.parse_numbered(df, "k", "t").collect()) == [(1, 1, "]"), (1, 2, "y")]


def test_context(spark):
    df = spark.createDataFrame([(1, i, t, None, None, None, None) for i, t in enumerate(["zero", "one", "two", "three"])], LINE)
    got = {r.line_idx: r.context for r in grouping.context(df, 1).collect()}
    assert got[2] == "Previous block -1: one\nNext block +1: three" and got[0] == "Next block +1: one"
    assert {r.context for r in grouping.context(df, 0).collect()} == {""}


def test_resume(spark):
    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    src = spark.createDataFrame([(1, i, "t", None, None, None, None) for i in range(4)], LINE)
    rec = spark.createDataFrame([(1, 0, "old", a), (1, 0, "new", b), (1, 1, "x", a), (1, 1, "", b), (1, 9, "none", a), (1, None, "z", a)], "book_id long, `index` int, text string, written_at timestamp")
    done = resume.completed(rec, src)
    assert [tuple(r) for r in done.collect()] == [(1, 0, "new")]
    groups = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 2)], "book_id long, line_idx int, group_start int")
    assert sorted(tuple(r) for r in resume.regroup(groups, done).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 2)]
    assert resume.fingerprint(src).first().source_sha256 == hashlib.sha256(hashlib.sha256(b"t\n" * 4).hexdigest().encode()).hexdigest()


def test_chunks():
    assert chunking.chunks("First sentence. Second sentence. Third sentence.", 30) == ["First sentence.", "Second sentence.", "Third sentence."]
    assert chunking.chunks(" short ", 30) == [" short "] and chunking.chunks("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    parts = chunking.budget_chunks("one two three. four five six. " * 20, lambda t: len(t) <= 40, 200)
    assert all(len(p) <= 40 for p in parts) and "".join("".join(parts).split()) == "".join(("one two three. four five six. " * 20).split())
    with pytest.raises(ValueError):
        chunking.budget_chunks("abc", lambda t: False, 2)


def test_clean_output(spark):
    leaked = r"Requirements:\n- Preserve all information.\nText:\nHello\nworld"
    context = "Context for consistency only.\nPrevious block -1: a\nGuten Tag"
    terminology = "锁定术语\n- a => b\nc → d\n译文：\n你好"
    assert values(spark, cleaning.clean_output, leaked, context, terminology, "  plain\n text ", None) == ["Hello world", "Guten Tag", "你好", "plain\n text", ""]


def test_prompts(spark):
    df = spark.createDataFrame([("say {CONTEXT}", "near", "", "Bk", "Ch", "f.xhtml", "body")], "t string, c string, s string, b string, h string, f string, k string")
    place = prompts.document_context(F.col("b"), F.col("h"), F.col("f"), F.col("k"))
    got = df.select(prompts.render(F.col("t"), F.lit("German"), F.col("c"), F.col("s"), place).alias("p")).first().p
    df2 = df.select(prompts.render(F.col("t"), F.lit("German"), F.lit("see {TEXT} and {CONTEXT}"), F.col("s"), F.lit("{TERMINOLOGY_SECTION}")).alias("p")).first().p
    assert "see {TEXT} and {CONTEXT}" in df2 and "{TERMINOLOGY_SECTION}" in df2 and df2.count("say {CONTEXT}") == 1
    assert "fluent and accurate German" in got and got.endswith("Text:\n\nsay {CONTEXT}") and "Book: Bk\nChapter: Ch\nBlock kind: body" in got and "near\n\n" in got
    with pytest.raises(ValueError):
        prompts.render(F.lit("x"), F.lit("x"), F.lit(""), F.lit(""), F.lit(""), "no placeholder")


def test_memory_repair():
    assert terms.parse_memory('```json\n{"terms":[{"source":"a" "target":"b"}{"source":"c","target":"d"},],"proper_names":["x"]}```') == {"terms": [{"source": "a", "target": "b"}, {"source": "c", "target": "d"}], "proper_names": []}
    with pytest.raises(ValueError):
        terms.parse_memory("nothing")


def test_term_keys(spark):
    assert values(spark, lambda c: terms.key(F.col(c)), "“Dr. Smiths”", "Names", "Straße", "well – known", "glasses", "") == ["dr smith", "nam", "strasse", "well-known", "glasse", ""]


def test_candidates_brute_force(spark):
    texts = ["The NASA probe met Anna Bell near Dover.", "Anna Bell saw the grey stone tower.", "A grey stone tower stood there. NASA left.", "well-known things", "", None, "http://NASA.gov said so"]
    df = spark.createDataFrame([(1, i, t, "heading" if i == 0 else None) for i, t in enumerate(texts)], "book_id long, line_idx int, text string, kind string")
    got = {r.source: (r["count"], r.lines, r.score) for r in terms.candidates(df.filter("text is not null")).collect()}
    assert got["grey stone tower"] == (2, 2, 6) and got["grey stone"] == (2, 2, 6)
    assert got["Anna Bell"][1] == 2 and "The NASA" in got and "Dover" not in got
    # counts of the families, once more by hand
    seen, where = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        for m in re.findall(r"\b[A-Z][A-Z0-9&.-]{1,}\b", re.sub(r"https?://\S+", " ", t or "")):
            seen[m] += 1
            where[m].add(i)
    assert {r.match: (r.n, r.l) for r in terms.family_hits(df.filter("text is not null"), "acronym").groupBy("match").agg(F.count("*").alias("n"), F.countDistinct("line_idx").alias("l")).collect()} == {k: (n, len(where[k])) for k, n in seen.items()}


def test_relevant(spark):
    df = spark.createDataFrame([(1, 0, "Miss Marple met the Grey-Stone men."), (1, 1, "marplesque"), (1, 2, None), (2, 0, "Marple")], "book_id long, line_idx int, text string")
    memory = spark.createDataFrame([(1, "proper_names", 1, "Jane Marple", "M"), (1, "terms", 2, "grey stone", "G"), (1, "terms", 3, "absent", "A"), (1, "terms", 4, "x", None), (1, "terms", 5, "Grey Stone", "again")], "book_id long, section string, ord int, source string, target string")
    got = sorted((r.line_idx, r.rank, r.source, r.target) for r in terms.relevant(df, memory).collect())
    assert got == [(0, 1, "Jane Marple", "M"), (0, 2, "grey stone", "G")]


def test_terms_of_the_context(spark, tmp_path):
    """A term that occurs only in a neighbouring block belongs to the line's prompt."""
    from quirelake.plans import queries

    spark.createDataFrame([(1, i, t, dt.datetime(2025, 1, 1)) for i, t in enumerate(["Anna Bell waved.", "She left.", None, "Rain."])], "book_id long, line_idx int, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/source_lines.parquet")
    spark.createDataFrame([(1, "proper_names", 1, "Anna Bell", "A. B.")], "book_id long, section string, ord int, source string, target string").write.parquet(f"{tmp_path}/term_memory.parquet")
    spark.createDataFrame([("context_window", "1")], "setting string, value string").write.parquet(f"{tmp_path}/run_settings.parquet")
    assert sorted(r.line_idx for r in queries.relevant_terms(spark, str(tmp_path)).collect()) == [0, 1]
    assert sorted(r.line_idx for r in queries.terminology_section(spark, str(tmp_path)).collect()) == [0, 1]


def test_metrics(spark):
    df = spark.createDataFrame([("s", 1, "the cat sat on the mat", ["x", "the cat sat on the mat"]), ("s", 2, None, ["x"]), ("z", 3, "a b", ["c d"]), ("z", 4, "a", []), ("z", 5, "a", None)], "system string, id long, pred string, refs array<string>")
    assert {r.system: round(r.bleu, 6) for r in metrics.bleu(df).collect()} == {"s": 1.0, "z": 0.0}
    assert {r.system: r.rouge for r in metrics.rouge(df, 2).collect()} == {"s": 1.0, "z": 0.0}
    got = {r.system: r for r in metrics.sentence_metrics(df).collect()}
    assert got["s"].ter == 0 and got["s"].rouge_l == 1 and got["z"].ter == 1
    assert metrics.edits("c d a b".split(), "a b c d".split()) == 1
    assert metrics.edits([], ["a"]) == 1 and metrics.edits(["a"], []) == 1 and metrics.edits([], []) == 0


def _slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _slow_lcs(a, b):
    return 0 if not a or not b else _slow_lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(_slow_lcs(a[:-1], b), _slow_lcs(a, b[:-1]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9), st.integers(0, 8))
def test_bit_vectors(a, b, k):
    at = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    states = []
    assert metrics.distance(a, at, len(b), states) == _slow_distance(a, b)
    if b and k < len(a):
        assert metrics.distance(a, at, len(b), states, k) == _slow_distance(a, b)
    assert metrics.lcs(a, b) == _slow_lcs(a, b)
    assert metrics.edits(a, b) <= _slow_distance(a, b)


def test_words_13a(spark):
    got = values(spark, lambda c: metrics.words_13a(F.col(c)), 'Hello, "world"! It costs 3.5 - or 1,000-2. &amp; x')[0]
    assert got == ["Hello", ",", '"', "world", '"', "!", "It", "costs", "3.5", "-", "or", "1,000", "-", "2", ".", "&", "x"]


def test_kept_memory(spark):
    rows = [(1, "proper_names", 1, "Jane Marple", "简·马普尔"), (1, "proper_names", 2, "Marple House", "M"), (1, "terms", 3, "the house", "H"), (1, "terms", 4, "amber", "B"), (1, "terms", 5, "grey stone", "G"), (1, "terms", 6, "x", None)]
    memory = spark.createDataFrame(rows, "book_id long, section string, ord int, source string, target string")
    got = [(r.source, r.target, r.alias) for r in terms.kept_memory(memory).orderBy("alias", "ord").collect()]
    assert got == [("Jane Marple", "简·马普尔", False), ("Marple House", "M", False), ("grey stone", "G", False), ("Marple", "马普尔", True)]
    assert terms.kept_memory(memory, 2).count() == 2 and terms.kept_memory(memory.limit(0)).count() == 0


def test_memory_prompt_and_answers(spark):
    import json

    found = spark.createDataFrame([(1, i, s, 9 - i, 2, 2) for i, s in enumerate(['Say "x"', "B\\c", "Ä"], 1)] + [(2, 1, "few", 1, 1, 1)], "book_id long, rank int, source string, score int, count int, lines int")
    got = terms.memory_prompts(found, "German", 7).collect()
    assert [r.book_id for r in got] == [1] and "into German" in got[0].prompt and "at most 7" in got[0].prompt
    assert [e["source"] for e in json.loads(got[0].prompt.rsplit("terms:\n", 1)[1])] == ['Say "x"', "B\\c", "Ä"]
    asked = []

    def generate(prompt):
        asked.append(prompt)
        return "sorry" if len(asked) == 1 else '{"terms": [{"source": "a", "target": "b"}]}'

    assert terms.ask_memory("P", generate)["terms"] == [{"source": "a", "target": "b"}] and "Previous response:\nsorry" in asked[1]
    assert terms.ask_memory("P", lambda p: "no") == {"terms": [], "proper_names": []}


def test_one_rule_of_translatable_text(spark):
    texts = ["xxi", "(iv)", "I", "xx.", "12", "[12].", "12345", "body", "BODY", "<?xml version", "xmlish", "http://a.b/c d", "www.x.y", "—…", "é", "_", "Word", "v. i.", "中"]
    native = values(spark, T.is_translatable, *texts)
    assert [epub.translatable(t) for t in texts] == native


PAGE = """<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body><h1>Title</h1>
<p>First claim<a class="noteref" href="#n1">1</a> and tail text.</p><p>See <a href="x.xhtml">the map</a> today.</p><div>Own <p>Inner</p></div><p>12</p></body></html>"""


def package() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", '<package xmlns:dc="d"><metadata><dc:title>Tiny Book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx"><itemref idref="c1"/></spine></package>')
        z.writestr("OEBPS/toc.ncx", "<ncx><navMap><navPoint><navLabel><text>Title</text></navLabel></navPoint></navMap></ncx>")
        z.writestr("OEBPS/c1.xhtml", PAGE)
        z.writestr("OEBPS/s.css", "p{}")
    return out.getvalue()


def test_html_blocks():
    got = [(b.node.name, b.mode, [epub.source_text("".join(n.text for n in p)) for p in b.parts]) for b in html.blocks(html.parse(PAGE))]
    assert got == [("h1", "block", ["Title"]), ("p", "block", ["First claim", "and tail text."]), ("p", "block", ["See the map today."]), ("div", "direct_text", ["Own"]), ("p", "block", ["Inner"]), ("p", "block", ["12"])]


def test_epub_round_trip(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(package())
    rows = epub.read_epub(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.original_text for r in rows] == ["Tiny Book", "Title", "Title", "First claim", "and tail text.", "See the map today.", "Own", "Inner"]
    assert [r.kind for r in rows][:3] == ["opf_title", "ncx_label", "heading"]
    new = epub.rebuild(package(), [f"L{i}" if i != 5 else "Heute the map siehe" for i in range(8)], "de", "p{margin:0}")
    assert [t[-1] for t in epub.extract(new, "")] == ["L0", "L1", "L2", "L3", "L4", "Heute the map siehe", "L6", "L7"]
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.namelist()[0] == "mimetype" and 'href="x.xhtml"' in z.read("OEBPS/c1.xhtml").decode() and ">1</a>" in z.read("OEBPS/c1.xhtml").decode()
        assert "margin" in z.read("OEBPS/s.css").decode() and ">de<" in z.read("OEBPS/content.opf").decode()
    with pytest.raises(ValueError, match="line count"):
        epub.rebuild(package(), ["one"], "de")


def test_stream_append(spark, tmp_path):
    from quirelake.streaming import results

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "book_id long, `index` int, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        results.append(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_answers(spark):
    from quirelake.operators import answers

    assert answers.parsed(answers.numbered(["阿尔法。", "b"]), 2) == ["阿尔法。", "b"] and answers.parsed("[1] a", 2) is None and answers.parsed("", 1) is None

    class Model:
        """Forgets the last of several lines; answers 'mute' without a number."""

        def generate(self, prompts, most):
            text = prompts[0].split("T:", 1)[1]
            lines = text.split("\n")
            return ["just words" if "mute" in text and len(lines) == 1 else "\n".join(x.upper() for x in (lines[:-1] if len(lines) > 2 else lines))]

    frame = f"Context.\nT:{answers.SLOT}"
    long = "one two three. " * 30
    rows = [(1, 0, [0, 1], ["a", "b"], frame, "T:" + answers.SLOT, 64), (1, 2, [2, 3, 4], ["c", "mute", "d"], frame, "T:" + answers.SLOT, 64), (1, 5, [5], [long], frame, "T:" + answers.SLOT, 64)]
    records = spark.createDataFrame(rows, "book_id long, group_start int, line_idxs array<int>, texts array<string>, frame string, bare string, max_new_tokens int")
    got = {r.line_idx: (r.text, r.asked) for r in answers.resolve(records, Model, 40, chunk=60).collect()}
    assert got[0] == ("A", "group") and got[1] == ("B", "group") and got[2] == ("C", "single") and got[3] == ("just words", "raw") and got[4] == ("D", "single")
    assert got[5][1] == "chunks" and "".join(got[5][0].split()) == "".join(long.upper().split())


def test_budget_groups(spark):
    from quirelake.operators import answers

    df = spark.createDataFrame([(1, i, "x" * n, None, None, None, None) for i, n in enumerate([8, 8, 400, 4])] + [(1, 4, None, None, None, None, None)], LINE)
    got = sorted((r.line_idx, r.group_start, r.over) for r in answers.budget_groups(df, 20).collect())
    assert got == [(0, 0, False), (1, 0, False), (2, 2, True), (3, 3, False), (4, 3, False)]
    near = {r.group_start: r.context for r in answers.group_contexts(df, answers.budget_groups(df, 20), 1).collect()}
    assert near[0] == "Next block +1: " + "x" * 400 and near[3] == "Previous block -1: " + "x" * 400


def test_translate(spark):
    from quirelake.streaming import results

    class Echo:
        def generate(self, prompts, most):
            if len(prompts) > 2:
                raise MemoryError
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, i, f"p{i}", 64) for i in range(5)], "book_id long, group_start int, prompt string, max_new_tokens int")
    assert sorted(r.output for r in results.translate(df, Echo).collect()) == [f"P{i}" for i in range(5)]


def test_registry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert "translation_plan" in q and set(o) <= set(q)


ODD = ("foo", "foos", "bar", "bars", "dogs", "bus", "next", "block", "previous", "1", "2", "-", "–", "'", "’", "‘", '"', ".", "...", "!", "#", "_", "/", " ", " ", "\n", "ß", "Σ", "ÉS", "o'x", "has", "ies", "cats-", "-cats", "é", " ", "中文", "")


@pytest.mark.parametrize("window,unit,block", [(0, 1, 65_536), (2, 1, 3), (2, 3, 5), (1, 4, 65_536), (0, 3, 65_536)])
def test_terms_of_units_are_those_of_the_whole_text(spark, monkeypatch, window, unit, block):
    """Lines are normalised and shuffled once; what is found must be what the key of unit and context, put together first, holds."""
    monkeypatch.setattr(ordered, "BLOCK", block)
    rnd = random.Random(window * 10 + unit)
    texts = {(b, 3 * i): None if rnd.random() < 0.05 else "".join(rnd.choice(ODD) + rnd.choice(("", "", " ", " ")) for _ in range(rnd.randint(0, 5))) for b in range(30) for i in range(rnd.randint(1, 12))}
    sources = ["foo", "Foo Bars", "foo-bar", "Dogs", "Bus", "next", "Block 1", "2 foo", "foo previous", "O'x", "has", "Foo-has", "Cats", "ss", "Σ", "ÉS", "中文", "bar Foo dogs", "1", "foo'", "cats-cats"]
    memory = spark.createDataFrame([(b, "terms", i, s, "t") for b in range(30) for i, s in enumerate(sources)], "book_id long, section string, ord int, source string, target string")
    places = {b: [i for c, i in sorted(texts) if c == b] for b in range(30)}
    start = {(b, i): at[k - k % unit] for b, at in places.items() for k, i in enumerate(at)}
    wholes = []
    for b, at in places.items():
        for k in range(0, len(at), unit):
            own, before, after = at[k : k + unit], at[max(k - window, 0) : k], at[k + unit : k + unit + window]
            near = [f"Previous block -{len(before) - n}: {texts[b, i] or ''}" for n, i in enumerate(before)] + [f"Next block +{n + 1}: {texts[b, i] or ''}" for n, i in enumerate(after)]
            wholes.append((b, own[0], "\n".join([texts[b, i] or "" for i in own] + ["\n".join(near)])))
    hays = spark.createDataFrame(wholes, "book_id long, line_idx int, text string").select("book_id", "line_idx", terms.key(F.col("text")).alias("hay")).collect()
    looks = terms.entries(memory).filter("book_id = 0").select("source", terms.match_keys(F.col("source")).alias("looks")).collect()
    expected = {}
    for r in hays:
        words = " " + " ".join(w for w in re.split("[ -]", r.hay) if w) + " "
        hit = {e.source for e in looks for x in e.looks if " " + " ".join(w for w in re.split("[ -]", x) if w) + " " in words and re.search(f"(?:^|[' -]){re.escape(x)}(?:$|[' -])", r.hay)}
        if hit:
            expected[r.book_id, r.line_idx] = sorted(hit, key=lambda s: (-len(s), s.lower(), s))
    lines = spark.createDataFrame([(b, i, t, start[b, i]) for (b, i), t in texts.items()], "book_id long, line_idx int, text string, start int")
    got = {(r.book_id, r.line_idx): [t.source for t in r.terms] for r in terms.matched(lines, memory, window, unit="start").collect()}
    assert got == expected and len(expected) > 20


def test_no_word_run_is_shuffled_for_terms(spark):
    """A line goes through one shuffle, with its words once: runs of words joined with the terms made relevant_terms fail at 1 GB by time."""
    df = spark.createDataFrame([(1, 0, "a foo of bars")], "book_id long, line_idx int, text string")
    memory = spark.createDataFrame([(1, "terms", 0, "Foo of bars", "F")], "book_id long, section string, ord int, source string, target string")
    plan = terms.relevant(df, memory)._jdf.queryExecution().optimizedPlan().toString()
    assert "shingle" not in plan and plan.count("RepartitionByExpression") == 1


def test_sections_of_terms_need_no_second_grouping(spark):
    """The terms of a line come in one row, in order; terminology_section gathered them again and failed at 1 GB by time."""
    df = spark.createDataFrame([(1, 0, "Anna Bell met Tom."), (1, 1, "nobody")], "book_id long, line_idx int, text string")
    memory = spark.createDataFrame([(1, "terms", i, s, t) for i, (s, t) in enumerate((("Tom", "T"), ("Anna Bell", "A")))], "book_id long, section string, ord int, source string, target string")
    found = terms.matched(df, memory)
    got = terms.section(found)
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert [(r.line_idx, r.terminology) for r in got.collect()] == [(0, terms.HEADER + "\n- Anna Bell => A\n- Tom => T\n\n")] and count(got) == count(found)


def test_context_is_put_beside_the_other_columns(spark):
    """prompt_render joined each line's context to it by key and failed at 1 GB by time; now lines bring all they need to their context."""
    df = spark.createDataFrame([(1, i, t, f"place {i}") for i, t in enumerate(["a", None, "c"])], "book_id long, line_idx int, text string, place string")
    got = {r.line_idx: (r.place, r.context) for r in grouping.with_context(df, 1).collect()}
    assert got == {0: ("place 0", "Next block +1: "), 1: ("place 1", "Previous block -1: a\nNext block +1: c"), 2: ("place 2", "Previous block -1: ")}
    assert {r.context for r in grouping.with_context(df, 0).collect()} == {""}


def test_sides_stand_at_the_ends_of_groups_alone(spark, monkeypatch):
    """prompt_groups carried the context of every line and joined it to the lines again: it failed at 1 GB by time."""
    from quirelake.operators import answers

    monkeypatch.setattr(ordered, "BLOCK", 2)
    df = spark.createDataFrame([(1, i, t, g) for i, (t, g) in enumerate((("a", 0), ("b", 0), ("c", 0), (None, 3), ("e", 4)))], "book_id long, line_idx int, text string, group_start int")
    got = {r.line_idx: (r.before, r.after) for r in answers.with_sides(df, 1).collect()}
    assert got == {0: ("", None), 1: (None, None), 2: (None, "Next block +1: "), 3: ("Previous block -1: c", "Next block +1: e"), 4: ("Previous block -1: ", "")}
    near = {r.group_start: r.context for r in answers.group_contexts(df.drop("group_start"), df.select("book_id", "line_idx", "group_start"), 1).collect()}
    assert near == {0: "Next block +1: ", 3: "Previous block -1: c\nNext block +1: e", 4: "Previous block -1: "}


def test_a_leak_is_looked_for_in_one_pass(spark):
    """Each of the markers put the answer into small letters again; answers_resolved failed at 1 GB by time."""
    texts = [f"x{m.upper()} y" for m in T.LEAK_MARKERS] + [r"a\nREQUIREMENTS:", "requirements", "text", "", None]
    assert values(spark, T.has_prompt_leak, *texts) == [any(m in (t or "").lower() for m in T.LEAK_MARKERS) for t in texts]
    assert "lambda" not in spark.range(1).select(T.has_prompt_leak(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()


def _terms_found(rows, window, limit):
    """What the search for terms gives for (book, part, kind, line, unit, ghost, five texts, flags) in order: {(book, unit): sources}."""
    import pyarrow as pa

    kinds = [*[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2, pa.bool_(), *[pa.string()] * 4, pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [str(i) for i in range(len(kinds))])
    return {(r["book_id"], r["line_idx"]): [t["source"] for t in r["terms"]] for out in terms._found(window, limit)(iter([batch])) for r in out.to_pylist()}


def _term_rows(looks, lines):
    key = [(1, 0, 0, 0, 0, False, look, source, source.lower(), "T", 0) for look, source in looks]
    return key + [(1, 0, 1, i, i, False, text, None, None, None, 0) for i, text in enumerate(lines)]


def test_a_key_of_many_terms_is_looked_at_once(monkeypatch):
    """A line with a word that many names of its book share was tried with each of them; terminology_section failed at 1 GB by time."""
    names, tried, stands = [f"N{i} office" for i in range(300)], [], terms._stands
    monkeypatch.setattr(terms, "_stands", lambda *a: tried.append(a) or stands(*a))
    got = _terms_found(_term_rows([(look, s) for s in names for look in (s.lower(), "office")], ["the office of n7"] * 20), 0, 35)
    best = sorted(names, key=lambda s: (-len(s), s.lower(), s))[:35]
    assert got == {(1, i): best for i in range(20)} and len(tried) <= 2 * 20


@pytest.mark.parametrize("window", [0, 2])
def test_the_best_terms_are_the_first_of_all(window):
    """Only as many entries as are asked for are kept of a key; what a line gets must be the first of all that it would get."""
    rnd = random.Random(window)
    words = ["ab", "cd", "ef's", "gh-ij", "next", "1", "office", "co"]
    looks = sorted({(" ".join(rnd.choices(words, k=rnd.randint(1, 2))), f"{rnd.choice('XyZ') * rnd.randint(1, 4)}{i % 60}") for i in range(400)})
    rows = _term_rows(looks, [" ".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(60)])
    every = _terms_found(rows, window, 1_000_000)
    assert max(map(len, every.values())) > 40 and _terms_found(rows, window, 7) == {k: v[:7] for k, v in every.items()}

import html

import pytest
from pyspark.sql import functions as F

from screenlens.functions import lang, text, urls
from screenlens.operators import ranking, subtitles

SRT = "1\r\n00:00:01,000 --> 00:00:04,500\r\n<i>Hello</i> <font color=\"red\">there</font>\r\n\r\n2\n00:01:05,250 --> 00:01:09,000\n{\\an8}if (a < b) {return x;}\n"
VTT = "WEBVTT - talk\n\nNOTE this --> is no cue\n\nSTYLE\n::cue { color: red }\n\n00:01.000 --> 00:03.000 align:start\n<v.loud Anna>Good <00:00:02.000>day\n\nid-7\n00:00:05.000 --> 00:00:06.500\n&lt;i&gt; stays &amp;amp; a&nbsp;b\n"
SMI = "<SAMI><BODY><!-- <SYNC Start=1> --><SYNC Start=1000><P Class=KRCC>one<SYNC Start=3000><P Class=KRCC>&nbsp;<SYNC Start=20000><P Class=KRCC>two<br>lines<P Class=ENCC>two en<SYNC Start=60000><P Class=krcc>three</BODY></SAMI> tail"


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file_id string, text string")


def cues(df):
    return [(r.file_id, r.start, r.end, r.text) for r in df.orderBy("file_id", "cue_no").collect()]


def test_srt_and_vtt(spark):
    got = cues(subtitles.parse_timed_blocks(files(spark, a=SRT, b=VTT)))
    assert got == [
        ("a", 1.0, 4.5, "Hello there"),
        ("a", 65.25, 69.0, "if (a < b) {return x;}"),
        ("b", 1.0, 3.0, "Anna: Good day"),
        ("b", 5.0, 6.5, "<i> stays &amp; a b"),
    ]


def test_smi(spark):
    got = cues(subtitles.parse_smi_corpus(files(spark, a=SMI)))
    assert got == [("a", 1.0, 3.0, "one"), ("a", 20.0, 27.0, "two lines"), ("a", 60.0, 67.0, "three")]
    picked = subtitles.smi_class_pick(subtitles.smi_entries(files(spark, a=SMI))).first()
    assert (picked["class"], picked.n_texts, picked.n_classes) == ("KRCC", 3, 2)


def test_smi_without_classes(spark):
    body = "<SYNC Start=0>plain<SYNC Start=2000><P>second<SYNC Start=-5>never"
    got = cues(subtitles.parse_smi_corpus(files(spark, a=body)))
    assert got in ([("a", 0.0, 2.0, "plain")], [("a", 0.0, 2.0, "plain"), ("a", 2.0, 9.0, "second")])


def test_entities_once_and_after_tags(spark):
    raw = spark.createDataFrame([("&amp;lt;i&amp;gt; <b>x</b> a < b &eacute;",)], "s string")
    assert raw.select(text.clean_text(F.col("s"))).first()[0] == "&lt;i&gt; x a < b é"
    assert html.unescape("&eacute;") == "é"


@pytest.mark.parametrize(
    "data, want",
    [
        ("가나".encode("utf-8"), ("가나", "utf-8")),
        ("가나".encode("utf-8-sig"), ("가나", "utf-8-sig")),
        ("가나".encode("utf-16"), ("가나", "utf-16")),
        ("안녕하세요".encode("cp949"), ("안녕하세요", "cp949")),
        (b"\xff\xa0abc\x81", (b"\xff\xa0abc\x81".decode("latin-1"), "latin-1")),
    ],
)
def test_bytes(spark, data, want):
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert tuple(df.select(text.decode_subtitle_bytes("b")).first()[0]) == want


def verdict(spark, spans, duration, texts=None):
    data = [("f", i, float(a), float(b), (texts or {}).get(i, f"line {i}")) for i, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(data, "file_id string, cue_no bigint, start double, end double, text string")
    given = spark.createDataFrame([("f", float(duration))], "file_id string, duration double")
    return subtitles.subtitle_quality(df, given).first()


def test_a_file_covered_to_exactly_the_required_share_is_not_partial(spark, both_ways):
    """Lengths whose sum in doubles is a little below 8.4 of 28 seconds in some order of the rows."""
    tenths = {"a": [0, 0, 0, 0, 34], "b": [0, 0, 0, 2, 32], "c": [34, 0, 0, 0, 0], "d": [7, 7, 7, 7, 6], "e": [0, 4, 0, 30, 0], "f": [0, 0, 0, 0, 33]}
    rows = [(f, n, n * 5.0, n * 5.0 + 1 + x / 10.0, f"text {n}") for f, xs in tenths.items() for n, x in enumerate(xs)]
    said = spark.createDataFrame(rows, "file_id string, cue_no long, start double, end double, text string")
    files_ = spark.createDataFrame([(f, 28.0) for f in tenths], "file_id string, duration double")
    got = {r.file_id: (r.coverage, r.reason) for r in subtitles.subtitle_quality(said, files_).collect()}
    assert got == {**dict.fromkeys("abcde", (0.3, None)), "f": (8.3 / 28, "partial")}


def test_coverage_is_a_union(spark, both_ways):
    got = verdict(spark, [(0, 10), (1, 9), (5, 12), (50, 55), (56, 58)], 100)
    assert abs(got.coverage - 0.19) < 1e-12 and (got.span_start, got.span_end) == (0.0, 58.0)


def test_refusals(spark):
    grown = {i: "la " * (i + 1) for i in range(6)}
    steady = [(i * 5, i * 5 + 4) for i in range(6)]
    assert verdict(spark, steady, 30, grown).reason == "auto-generated"
    assert verdict(spark, steady, 30).ok
    assert verdict(spark, [(i * 50, i * 50 + 1.5) for i in range(6)], 300).reason == "partial"
    assert verdict(spark, steady[:3], 30).reason == "too-few-cues"
    assert verdict(spark, [(a + 3600, b + 3600) for a, b in steady], 30).reason == "other-video"
    assert verdict(spark, [(a + 3600, b + 3600) for a, b in steady], 0).ok
    none = verdict(spark, [], 30)
    assert (none.ok, none.n_cues, none.reason) == (False, 0, "too-few-cues")


def test_open_cues_close(spark):
    df = spark.createDataFrame([("f", 0, 1.0, None), ("f", 1, 2.0, 2.5), ("f", 2, 9.0, None)], "file_id string, ord bigint, start double, end double")
    assert [r.end for r in subtitles.close_open_cues(df).orderBy("ord").collect()] == [2.0, 2.5, 11.0]


CANDIDATE = "video_id string, kind string, path string, name string, format string, language string, label string, forced boolean, is_default boolean, track int"


def ranked(spark, data, target):
    df = spark.createDataFrame([("v", k, n, n, f, l, n, fo, d, t) for k, n, f, l, fo, d, t in data], CANDIDATE)
    return [r.name for r in ranking.rank_subtitles(df, target).orderBy("rank").collect()]


def test_language_beats_source(spark):
    pool = [("sidecar", "side", "srt", "en", False, False, None), ("embedded", "inner", "srt", "kor", False, False, 2)]
    assert ranked(spark, pool, "ko")[0] == "inner"
    assert ranked(spark, pool, "en")[0] == "side"
    assert ranked(spark, pool, None)[0] == "side"


def test_tail_keys(spark):
    pool = [
        ("sidecar", "b.vtt", "vtt", None, False, False, None), ("sidecar", "a.srt", "srt", None, True, False, None),
        ("sidecar", "c.srt", "srt", None, False, False, None), ("embedded", "e3", "srt", None, False, False, 3),
        ("embedded", "e5", "srt", None, False, True, 5),
    ]
    assert ranked(spark, pool, "ko") == ["c.srt", "b.vtt", "a.srt", "e5", "e3"]


def test_language_matches(spark):
    yes = [("ko", "KO"), ("ko", "ko-KR"), ("zh-Hans", "zh_Hant"), ("ko", "kor"), ("deu", "de"), ("bo", "bos")]
    no = [("ko", "en"), ("de", "ger"), (None, "ko"), ("ko", None), ("", "ko"), ("kor", "kok")]
    df = spark.createDataFrame(yes + no, "a string, b string")
    got = [r[0] for r in df.select(lang.lang_matches(F.col("a"), F.col("b"))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    "name, prefix, want",
    [("talk.ko.srt", "talk.", "ko"), ("talk.srt", "talk.", None), ("talk.mkv.srt", "talk.mkv.", None), ("talk.KO.forced.srt", "talk.", "ko"),
     ("talk.zh-Hans.vtt", "talk.", "zh-hans"), ("x.720p.srt", "", None), ("x.en.srt", "", "en")],
)
def test_language_of_names(spark, name, prefix, want):
    assert spark.range(1).select(lang.language_tag(F.lit(name), F.lit(prefix))).first()[0] == want


def test_sidecars_prefer_the_longer_name(spark):
    videos = spark.createDataFrame([("1", "d", "talk.mkv"), ("2", "d", "talk"), ("3", "e", "talk.mkv")], "video_id string, dir string, name string")
    found = spark.createDataFrame([("d", "talk.mkv.srt"), ("d", "talk.ko.SMI"), ("d", "talks.srt"), ("d", "talk.txt")], "dir string, name string")
    got = {(r.video_id, r.name): (r.language, r.format) for r in ranking.sidecar_candidates(ranking.sidecar_match(videos, found)).collect()}
    assert got == {("1", "talk.mkv.srt"): (None, "srt"), ("1", "talk.ko.SMI"): ("ko", "smi"), ("2", "talk.mkv.srt"): ("mkv", "srt"), ("2", "talk.ko.SMI"): ("ko", "smi")}


@pytest.mark.parametrize(
    "value, ok",
    [("https://a.example/x", True), (" HTTP://a.example ", True), ("ftp://a.example", False), ("javascript:alert(1)", False), ("http:///x", False),
     ("see https://a.example", False), ("www.a.example", False), ("http://[::1", False), ("", False), (None, False)],
)
def test_urls(spark, value, ok):
    got = spark.createDataFrame([(value,)], "u string").select(urls.safe_url(F.col("u"))).first()[0]
    assert got == (value.strip() if ok else None)


def test_origin_priority(spark):
    data = [
        ('{"url": "http://x.example/media", "webpage_url": "http://x.example/page"}', None, None, "http://x.example/page", "info-json"),
        ("[1]", '{"original_url": "http://s.example/o"}', None, "http://s.example/o", "info-json"),
        ('{"url": "http://x.example"} trailing', None, {"COMMENT": "http://c.example/x"}, "http://c.example/x", "container"),
        (None, None, {"comment": "http://c.example", "PURL": "http://p.example"}, "http://p.example", "container"),
        (None, None, {"comment": "nothing here"}, None, None),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, a string, b string, tags map<string,string>, url string, url_from string")
    for r in df.select("url", "url_from", urls.origin_url(F.col("a"), F.col("b"), F.col("tags")).alias("o")).collect():
        assert tuple(r.o) == (r.url, r.url_from)


def test_notes_on_sami_files(spark):
    head = "<SAMI><BODY>"
    two = head + "<SYNC Start=1000><P Class=KRCC>a<P Class=ENCC>b<SYNC Start=30000><P Class=KRCC>c<SYNC Start=31000><P Class=KRCC>&nbsp;"
    one = head + "<SYNC Start=1000><P Class=KRCC>a<SYNC Start=2000><P Class=KRCC>&nbsp;"
    files = spark.createDataFrame([("two", two), ("one", one), ("none", "")], "file_id string, text string")
    got = {r.file_id: list(r.notes) for r in subtitles.smi_notes(files).collect()}
    assert got == {"two": ["2 language classes, KRCC taken", "1 cues without an end of their own cut to 7 s"]}

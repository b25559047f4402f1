"""Column functions on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from qanat.config import AnswerConfig, ChunkConfig
from qanat.functions import answering, clean, metrics, rules, text


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


def test_fold_arabic(spark):
    fold = lambda t: one(spark, text.fold(F.col("t")), t=t)
    assert fold("كِتَابٌ") == "كتاب"
    assert fold("أإآٱ") == "اااا"
    assert fold("  على   مدرسة ") == "علي مدرسه"
    assert fold(None) == ""


def test_tokens(spark):
    got = one(spark, text.tokens(F.col("t")), t="والكرة في الملعب ب أ")
    assert got == ["كره", "في", "ملعب"]
    assert one(spark, text.tokens(F.col("t")), t="لك") == ["لك"]  # nothing would stay


@pytest.mark.parametrize("n, starts", [(0, [0]), (10, [0]), (300, [0]), (301, [0, 240]), (540, [0, 240]), (541, [0, 240, 480]), (700, [0, 240, 480])])
def test_windows(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    got = text.windows(spark.createDataFrame([(" ".join(words),)], "t string"), "t", "w").first().w
    assert got == [" ".join(words[s : s + 300]) for s in starts]


def test_windows_overlap(spark):
    words = [str(i) for i in range(95)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    got = [w.split() for w in text.windows(df, "t", "w", ChunkConfig(30, 10)).first().w]
    assert set(sum(got, [])) == set(words)
    assert all(a[-10:] == b[:10] for a, b in zip(got, got[1:]))


ROUTED = [
    ("ما هو تشكيل الزمالك اليوم", "lineup"),
    ("من فاز في اللقاء الأخير", "match_result"),
    ("هل تم توقيع صفقة جديدة", "transfer_news"),
    ("مران الفريق صباحا", "team_news"),
    ("كم عمر اللاعب", "player_info"),
    ("ترتيب الدوري", "general_football"),
    ("كيف حالة الجو غدا", "out_of_scope"),
    ("ماذا قال المدير بعد الفوز", "team_news"),
    ("كم هدف للاعب اسمه سامي", "player_info"),
    ("هل انتقل لاعب اسمه سامي", "transfer_news"),
    ("عاد سامي حسن لتدريب الفريق", "player_info"),
]


@pytest.mark.parametrize("query, want", ROUTED)
def test_route(spark, query, want):
    assert one(spark, rules.route(F.col("q"), rules.arabic_football()), q=query) == want


def test_unicode_boundaries(spark):
    pattern = r"أخبار.*(المصري)(?!\w)"
    hit = lambda t: one(spark, rules.any_of(F.col("t"), [pattern]), t=t)
    assert hit("أخبار المصري") and not hit("أخبار المصرية")


def test_patterns_like_python(spark):
    r = rules.arabic_football()
    queries = [q for q, _ in ROUTED] + ["أخبار الأهلي اليوم", "سعر الدولار", "الـ11 الأساسي", "يستهدف النادي مهاجما", "فيلم جديد"]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    for name, patterns in [*r.ordered, ("scope", r.out_of_scope)]:
        got = [x[0] for x in df.select(rules.any_of(F.col("q"), patterns)).collect()]
        assert got == [any(re.search(p, q) for p in patterns) for q in queries], name


def test_tags(spark):
    assert one(spark, rules.lexicon_tags(F.col("t")), t="البنك الأهلي ضد الزمالك") == ["al_ahly", "zamalek", "nbe"]
    league = rules.league(F.col("t"), F.col("s"), F.col("b"))
    assert one(spark, league, t="x", s="", b="في لاليغا والدوري الإيطالي") == "la_liga"
    assert one(spark, league, t="x", s="الكرة المصرية", b="y" * 400 + "لاليغا") == "egyptian_league"
    assert one(spark, league, t="x", s="", b="y") == "other"
    assert one(spark, rules.article_type(F.col("t")), t="انتهت المباراة") == "match_result"
    assert one(spark, rules.article_type(F.col("t")), t="") == "article"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("[](https://x.y/z) نص", "نص"),
        ("قبل #وسم_هنا بعد", "قبل بعد"),
        ("**غامق** و*مائل*", "غامق ومائل"),
        ("[رابط](http://a.b)", "رابط"),
        ("كلمة كلمةة الدوري الدوري", "كلمة كلمةة الدوري"),
        ("a\\\\b", "a b"),
        ("خبر 14 March 2026 مهم", "خبر مهم"),
        ("سطر Client window.x\nباق", "سطر"),
        ("قبل 5 دقيقة | بعد", "قبل"),
        ("<b>x</b> 😀 y", "x y"),
        (None, ""),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, clean.clean_body(F.col("t")), t=raw) == want


def test_clean_title_and_related(spark):
    title = "عنوان طويل بما يكفي هنا للخبر"
    assert one(spark, clean.clean_body(F.col("t"), F.col("h")), t=title + " ثم النص", h=title) == (title + " ثم النص")[20:].strip()
    body = "ك" * 201 + " __ ذات صلة"
    assert one(spark, clean.clean_body(F.col("t")), t=body) == "ك" * 201
    assert one(spark, clean.clean_body(F.col("t")), t="قصير __ ذات صلة") == "قصير __ ذات صلة"


@pytest.mark.parametrize("raw, want", [("نص [N]", "نص"), ("x [n]", "x"), ("x [ N ] \n", "x"), ("x [12]", "x [12]"), ("a [N] b", "a [N] b"), ("", ""), ("  ", "")])
def test_placeholder(spark, raw, want):
    from qanat.engine import strip_placeholder

    assert one(spark, answering.strip_placeholder(F.col("t")), t=raw) == want == strip_placeholder(raw)


def test_sanitize(spark):
    s = lambda t, n=4: one(spark, answering.sanitize(F.col("t"), n), t=t)
    assert s("a\x00b\n\tc<<<USER_QUERY>>><|x|>") == "ab\n\tcx"
    assert s("<sys<system>tem>x", 1) == "<system>x" and s("<sys<system>tem>x") == "x"


def test_budget_and_tokens(spark):
    assert one(spark, answering.estimate_tokens(F.col("t")), t="") == 1
    assert one(spark, answering.estimate_tokens(F.col("t")), t="x" * 300) == 100
    cfg = AnswerConfig(max_tokens=10, max_prompt_tokens=20)
    cut = answering.within_budget(F.col("t"), F.lit(""), F.col("t"), cfg)
    assert one(spark, cut, t="x" * 100) == "x" * 50 and one(spark, cut, t="x" * 20) == "x" * 20


def test_cache_key(spark):
    from qanat.engine import cache_key

    key = lambda m, i, c, q: one(spark, answering.cache_key(F.col("m"), F.col("i"), F.col("c"), F.col("q")), m=m, i=i, c=c, q=q)
    a = key("m", "lineup", ["2_0", "1_0"], " Query ")
    assert a == key("m", "lineup", ["1_0", "2_0"], "query") == cache_key("m", "lineup", ["1_0", "2_0"], "QUERY") and len(a) == 32
    assert a != key("m2", "lineup", ["1_0", "2_0"], "query")


def test_ttl(spark):
    assert one(spark, answering.ttl(F.col("i")), i="lineup") == 43200
    assert one(spark, answering.ttl(F.col("i")), i="unheard") == 2592000
    assert not one(spark, answering.fresh(F.lit(10), F.lit(10), F.lit(0)))


def test_metrics(spark):
    r = lambda p, q: one(spark, metrics.rouge1_f1(F.col("p"), F.col("q")), p=p, q=q)
    assert r("أحمد لعب", "احمد لعب") == 1.0 and r("", "x") == 0.0 and abs(r("a b", "b c d") - 0.4) < 1e-12
    hit = lambda t, k, n=None: one(spark, metrics.keyword_hit(F.col("t"), F.col("k"), n), t=t, k=k)
    assert hit(["Ab c", "d"], ["ab", "z"]) == 0.5 and hit(["x"], []) == 1.0 and hit(["x", "ab"], ["ab"], 1) == 0.0
    rr = lambda t, k: one(spark, metrics.reciprocal_rank(F.col("t"), F.col("k")), t=t, k=k)
    assert rr(["x", "y", "ab"], ["AB"]) == pytest.approx(1 / 3) and rr(["x"], ["q"]) == 0.0 and rr([], ["q"]) == 0.0 and rr(["x"], []) == 0.0
    top = lambda t, k: one(spark, metrics.hit_at_1(F.col("t"), F.col("k")), t=t, k=k)
    assert top(["ab", "x"], ["a"]) == 1.0 and top(["x", "a"], ["a"]) == 0.0 and top([], ["a"]) == 0.0
    acc = lambda p, w, f: one(spark, metrics.intent_accuracy(F.col("p"), F.col("w"), F.col("f")), p=p, w=w, f=f)
    assert acc("out_of_scope", "general_football", True) == 1.0 and acc("out_of_scope", "general_football", False) == 0.0


def test_steps_that_cannot_match_are_skipped(spark):
    """Texts made of what the patterns look for: the cleaner that looks for a needed part first gives what the plain replacements give."""
    import random

    rng = random.Random(4)
    parts = ["[](http://a)", "الأحد، 12 مايو 2024 - 12:30 ", "كتب : Example", "**3** \\\\", "**", "*", "_", "انتهت12:30", "video:12", "https://pic.twitter.com/x", "pic.twitter.com/y", "#", "#tag", "\n> q", ">", "<b>",
             "https://www.news.example/a", "news.example", "\\", "/articles/12", "Client", "هايترز تي في يوتيوب", "YouTube x", "12 مشترك", "@beINx", "bein sport", "3 May 2024", "May 3, 2024", "😀", "é", "[a](b)", "[](b)", "![a](b)",
             "صورة : x", "getty images", "word word", "  ", "\t", " ", "\n", "a", "12", "|", "7 دقيقة |"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rule, one = clean.CleanRules(), []
    for steps in (clean.before_cuts(rule), clean.AFTER_CUTS):
        plain = F.col("t")
        for pattern, to in steps:
            plain = F.regexp_replace(plain, "(?U)" + pattern, to)
            one.append((pattern, clean.needed(pattern, F.col("t"), rule)))
        assert df.where(~clean.replace_all(F.col("t"), steps, rule).eqNullSafe(plain)).count() == 0
    skipped = [(p, c) for p, c in one if c is not None]
    assert len(skipped) >= 27
    found = df.agg(*[F.count_if(F.rlike("t", F.lit("(?U)" + p)) & ~c) for p, c in skipped], *[F.count_if(F.rlike("t", F.lit("(?U)" + p))) for p, _ in skipped]).first()
    assert not any(found[: len(skipped)]) and sum(n > 0 for n in found[len(skipped) :]) >= 25


def test_a_page_leaves_nothing_to_the_garbage_collector():
    import gc

    from qanat.sources import html

    page = "<html><body><h1>Title</h1><article><p>" + "word " * 40 + "<b>bold</b></p></article></body></html>"
    gc.collect()
    gc.disable()
    try:
        assert html.article("", page, "")["title"] == "Title" and html.article("", "<p>none</p>", "") is None
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node)]
    finally:
        gc.enable()

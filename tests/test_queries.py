"""Every registered query of the engine against its DuckDB SQL."""

import hashlib
import re
from html.parser import HTMLParser

import duckdb
import pytest

from qanat.functions import arabic_rules as ar
from qanat.functions import clean, rules
from qanat.plans import catalogue
from qanat.sources.tables import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(tuple, frame.values.tolist()), key=str)


md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


def plain_clean(text, title=None, r=clean.CleanRules()):
    """The cleaner with Python's own regular expressions, step after step."""
    java = lambda x: re.sub(r"\$(\d)", r"\\\1", x)
    code = lambda x: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), x)
    steps = lambda t, all_: [t := re.sub(code(a), java(b), t) for a, b in all_][-1]
    t = steps(text or "", clean.before_cuts(r))
    cut = re.split(clean.TICKER, t, maxsplit=1)
    if len(cut) > 1:
        t = cut[0].strip()
    at = t.find(clean.RELATED)
    if at > r.least_cut:
        t = t[:at].strip()
    t = steps(t, clean.AFTER_CUTS).strip()
    if title is not None and len(title) > r.title_min and t.startswith(title[: r.title_head].strip()):
        t = t[len(title[: r.title_head]) :].strip()
    return t


def clean_body_full(tables):
    return [(md5(c), i, len(c)) for i, t in tables("SELECT doc_id, text FROM documents") for c in [plain_clean(t, t[:60])]]


def clean_adjacent_dup(tables):
    return [(i, len(re.sub(r"\b(\S{4,})\s+\1\b", r"\1", t)), len(t)) for i, t in tables("SELECT doc_id, text FROM documents")]


def plain_route(text):
    q, some = text.lower(), lambda ps: any(re.search(p, q) for p in ps)
    r = rules.arabic_football()
    for name, pattern, unless in r.overrides:
        if some([pattern]) and not (unless and some([unless])):
            return name
    if some(r.out_of_scope):
        return "out_of_scope"
    return next((n for n, ps in r.ordered if some(ps)), r.default)


def plain_type(title):
    return next((n for n, words in rules.ARTICLE_TYPES if any(w in title for w in words)), "article")


def intent_route_arabic(tables):
    phrases = catalogue.ARABIC_PHRASES
    rows = [(c, n, phrases[c % len(phrases)] + t) for c, n, t in tables("SELECT conv_id, turn, text FROM conversations")]
    assert len({plain_route(t) for _, _, t in rows}) > 5 and len({plain_type(t) for _, _, t in rows}) > 3
    return [(plain_type(t), c, plain_route(t), n) for c, n, t in rows]


class Texts(HTMLParser):
    """Strings of every paragraph, with a stack of open tags: a paragraph ends an open one right
    around it, an end tag closes all that is open inside its element."""

    def __init__(self):
        super().__init__()
        self.open, self.parts, self.heading = [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article") and self.open and self.open[-1][0] == "p":
            self.open.pop()
        strings = []
        if tag == "p" and any(t == "article" for t, _ in self.open):
            self.parts.append(strings)
        if tag not in ("br", "meta", "img", "link", "input", "hr"):
            self.open.append((tag, strings))

    def handle_endtag(self, tag):
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if any(t == "h1" for t, _ in self.open):
            self.heading += data
        if data.strip() and not any(t in ("script", "style", "nav") for t, _ in self.open):
            for _, strings in self.open:
                strings.append(data.strip())


def html_article_body(tables):
    """The pages' articles have one heading, paragraphs alone, and no meta data."""
    out = []
    for i, url, html in tables("SELECT page_id, url, html FROM pages"):
        t = Texts()
        t.feed(html)
        title = t.heading.strip()
        body = " ".join(" ".join(p) for p in t.parts if len("".join(p)) > 10).strip()
        if body.startswith(title):
            body = body[len(title) :].lstrip()
        if title and len(body) >= 80:
            out.append((md5(body), len(body), 0, i, url, title))
    return out


def article_enrich(tables):
    out = []
    fold = lambda t: " ".join(re.sub("[ً-ٰٟـ]", "", t).translate(str.maketrans("أإآٱىةؤ", "اااايهو")).split())
    for i, t, source in tables("SELECT doc_id, text, source FROM documents"):
        gone = source in ("src1", "src2")
        c = None if gone else plain_clean(t, t[:60])
        fate = "section" if gone else "short" if len(c) < 80 else "kept"
        teams = dict.fromkeys(k for n, k in ar.TEAMS if n in f"{t[:60]} {c or ''}")
        out.append((i, None if gone else md5(c), fate, "other", None if gone else len(c), ",".join(teams), md5(fold(t[:60]))))
    return out


#: Rows in order of column names.
BRUTE = {f.__name__: f for f in (clean_body_full, clean_adjacent_dup, intent_route_arabic, html_article_body, article_enrich)}


#: Estimates and recall, held against exact results in tests of their own.
APPROXIMATE = {"event_cube_estimates", "clustered_recall"}


def test_every_query_has_a_reference():
    assert set(catalogue.oracle_sql()) | set(BRUTE) | APPROXIMATE == set(catalogue.queries())


def test_recall_of_the_clustered_index(spark):
    r = catalogue.queries()["clustered_recall"](spark, DIR).first()
    assert r["recall"] >= 0.9 and r["n_near"] == 10 * len([i for i in range(0, r["n_vectors"], 100)])


def test_cube_estimates(spark, duck):
    got = {(r["event_type"], r["day"], r["bucket"]): r for r in catalogue.queries()["event_cube_estimates"](spark, DIR).collect()}
    want = duck.sql("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id % 4 AS bucket, count(DISTINCT user_id), list_sort(list(value)) FROM events
        GROUP BY CUBE (event_type, strftime(ts, '%Y-%m-%d'), user_id % 4)""").fetchall()
    assert len(got) == len(want)
    for kind, day, bucket, users, values in want:
        r = got[kind, day, bucket]
        assert abs(r["n_keys"] - users) <= max(1, 0.05 * users)
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            low, high = (sum(v < r[name] for v in values) / len(values), sum(v <= r[name] for v in values) / len(values))
            assert low - 0.03 <= q <= high + 0.03


@pytest.mark.parametrize("text", ["ماذا قال مدرب الأهلي بعد الفوز", "لاعب اسمه زيزو صفقة", "تشكيل الزمالك", "نتيجة مباراة أمس", "كيف الطقس", "أخبار المران", "سعر الذهب اليوم", "إصابة لاعب", "أي شيء آخر"])
def test_arabic_routes(spark, text):
    df = spark.createDataFrame([(text,)], "q string")
    got = df.select(rules.route(df.q, rules.arabic_football()), rules.article_type(df.q)).first()
    assert tuple(got) == (plain_route(text), plain_type(text))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - APPROXIMATE))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        columns = sorted(got.columns, key=lambda c: c)
        want = BRUTE[name](lambda q: duck.sql(q).fetchall())
        assert rows(got, columns) == sorted(want, key=str)
        return
    want = duck.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_vocabulary_is_given_term_by_term(spark, duck):
    """One row for every distinct term (it was one for every document frequency)."""
    got = catalogue.queries()["term_df_idf"](spark, DIR)
    assert got.columns == ["term", "df", "idf"]
    terms = duck.sql("SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\x0B]+')) AS t FROM documents) WHERE len(t) >= 2").fetchall()[0][0]
    assert got.count() == got.select("term").distinct().count() == terms


def joined_by_shuffle(df):
    """Whether a plan without automatic broadcasts shuffles units to join them with hits."""
    return "SortMergeJoin [unit" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_guess(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_units_stay_where_they_are_for_a_batch_of_questions(spark, no_guess):
    assert not joined_by_shuffle(catalogue.queries()["hybrid_retrieve"](spark, DIR))


def test_texts_stay_where_they_are_for_an_ablation(spark, no_guess):
    assert not joined_by_shuffle(catalogue.queries()["ablation_winner"](spark, DIR))


def test_texts_stay_where_they_are_for_answers(spark, no_guess):
    from qanat.plans import answer_queries, retrieval
    from qanat.plans import stand_ins as si

    engine = answer_queries.demo_engine(spark, DIR)
    assert "Join" not in engine.chunks._jdf.queryExecution().executedPlan().toString()
    assert not joined_by_shuffle(retrieval.retrieve_each(engine.chunks, si.questions(spark, DIR), catalogue._now(), None, index=engine.index))


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())

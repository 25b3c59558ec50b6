import random

import pytest
from pyspark.sql import functions as F

from barframe.functions import extraction as X
from barframe.functions import text as T
from barframe.functions.filings import parse_action, parse_contract_symbol
from barframe.functions.numbers import blend_scores
from barframe.operators import analysis, dedup, feed, order_values


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first()["x"]


def test_normalize_url(spark):
    urls = {
        "https://www.google.com/url?rct=j&sa=t&url=https://example.com/story/abc&ct=ga": "example.com/story/abc",
        "https://Example.com/News/?utm_source=x": "example.com/news",
        "https://www.google.com/url?url=https://siteA.com/article1&ct=ga": "sitea.com/article1",
        "https://www.google.co.in/url?q=https%3A%2F%2Fa.com%2Fx%2F": "a.com/x",
        "https://user:pw@host.com:8080/P/?a#b": "host.com/p",
        "  Not a url ": "not a url",
    }
    df = spark.createDataFrame([(k,) for k in urls], "u string").select("u", T.normalize_url("u").alias("n"))
    assert {r.u: r.n for r in df.collect()} == urls


def test_hashes(spark):
    h = lambda t, u: one(spark, T.content_hash(F.lit(t), F.lit(u)), a=1)
    assert h("Title A", "https://x.com/1") == h("Title A", "https://x.com/1") != h("Title B", "https://x.com/1")

    def djb2(s):
        v = 5381
        for ch in s:
            v = ((v * 33) ^ ord(ch)) & 0xFFFFFFFF
        return format(v, "x")

    assert h("Title A", "https://x.com/1") == djb2("title a|x.com/1")
    assert one(spark, T.djb2_hex(F.lit("")), a=1) == format(5381, "x")


@pytest.mark.parametrize("a,b,same", [
    ("Reliance Industries wins 5000 crore solar order from SECI", "Reliance Industries wins 5000 crore solar order from SECI - Moneycontrol", True),
    ("Tata Motors Q3 results beat street estimates", "Infosys announces mega deal with US client", False),
    ("HAL order", "BEL order", False), ("HAL order", "HAL order", True), ("", "!!", True),
])
def test_titles_similar(spark, a, b, same):
    assert one(spark, T.titles_similar(T.normalize_text(F.lit(a)), T.normalize_text(F.lit(b))), z=1) is same


def test_strip_html(spark):
    assert one(spark, T.strip_html(F.lit("<b>A&amp;B</b>\n &lt;x&gt;&nbsp;&#39;q&#39;")), z=1) == "A&B <x> 'q'"


CASES = [
    ("SUZLON wins order worth ₹ 500 crore", "Wind energy order from NTPC for turbine supply", dict(ticker="SUZLON", order_value=500.0, order_value_unit="Cr")),
    ("RBI announces rate cut", "", dict(ticker=None, sector="Banking & Finance")),
    ("Company bags work order from state utility", "", dict(contract_type="Work Order")),
    ("Order worth Rs 50 lakh received", "", dict(order_value=50.0, order_value_unit="Lakh")),
    ("Apar Industries secures export contract", "", dict(company_name="Apar Industries")),
    ("the weather is pleasant today", "", dict(order_value=None, matched_keywords=[], sector_tags=[])),
    ("NSE: TCSEQ up", "", dict(ticker="TCS")),
    ("x 1,250.5 cr deal", "", dict(order_value=1250.5, order_value_unit="Cr")),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "i int, title string, snippet string")
    rows = {r.i: r.asDict() for r in feed.extract(df).collect()}
    for i, (_, _, want) in enumerate(CASES):
        assert {k: rows[i][k] for k in want} == want
    assert "Infrastructure" in rows[0]["sector_tags"] and "wind energy" in rows[0]["matched_keywords"]
    assert "rate cut" in rows[1]["matched_keywords"]


def score(spark, keywords, value, unit, age_hours, tags=()):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    then = F.timestamp_seconds(F.unix_seconds(now) - int(age_hours * 3600))
    v, u = F.lit(value).cast("double"), F.lit(unit).cast("string")
    return spark.range(1).select(X.impact_score(arr(keywords), arr(tags), v, u, then, now).alias("s")).first().s


def test_scores(spark):
    s = score(spark, [], None, None, 9999)
    assert (s.total_score, s.order_value_score, s.recency_score) == (2.8, 0.3, 0.2)
    s = score(spark, ["order win", "acquisition", "merger"], 12000, "Cr", 0)
    assert (s.total_score, s.order_value_score, s.keyword_score) == (8.6, 1.0, 0.9)
    assert score(spark, [], 5000, "Lakh", 9999).order_value_score == 0.5
    assert score(spark, [], 10, "Bn", 9999).order_value_score == 0.8
    assert [one(spark, blend_scores(F.lit(a), F.lit(b)), z=1) for a, b in ((5.0, 10.0), (10.0, 10.0), (0.0, 0.0))] == [8.0, 10.0, 1.0]


def test_corporate_action_subjects(spark):
    cases = [
        ("Bonus 1:1", "bonus", 0.5), ("Bonus 3:1", "bonus", 0.25), ("Bonus 1:2", "bonus", 2 / 3), ("Bonus Issue 2:5", "bonus", 5 / 7),
        ("Face Value Split (Sub-Division) - From Rs10/- Per Share To Re 1/- Per Share", "split", 0.1),
        ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 5/- Per Share", "split", 0.5),
        ("Face Value Split From Rs 2/- To Re 1/-", "split", 0.5),
        ("Consolidation of Shares From Re 1/- Per Share To Rs 10/- Per Share", "consolidation", 10.0),
        ("Interim Dividend - Rs 2 Per Share", "dividend", None), ("Interim Dividend - Re 1 Per Share", "dividend", None),
        ("Buy Back", "other", None), ("Annual General Meeting", "other", None), ("Interest Payment", "other", None),
    ]
    kind, factor = parse_action("s")
    got = spark.createDataFrame([(c[0],) for c in cases], "s string").select("s", kind.alias("k"), factor.alias("f")).collect()
    for (s, k, f), r in zip(cases, got):
        assert (r.s, r.k) == (s, k) and (r.f is None if f is None else abs(r.f - f) < 1e-9)


def test_contract_symbols(spark):
    syms = ["NIFTY2641323800PE", "NIFTY25N1125500PE", "NIFTY26JUL23900PE", "CRUDEOIL25DECFUT", "NIFTY2623123800PE"]
    rows = spark.createDataFrame([(s,) for s in syms], "s string").select(parse_contract_symbol("s").alias("p")).collect()
    weekly, nov, monthly, future, bad = [r.p for r in rows]
    assert (str(weekly.expiry), weekly.strike, weekly.option_type) == ("2026-04-13", 23800.0, "PE")
    assert str(nov.expiry) == "2025-11-11"
    assert monthly.expiry is None and (monthly.expiry_year, monthly.expiry_month) == (2026, 7)
    assert future is None and bad is None


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def sequential_dedup(items):
    """(order, normalised title, normalised url) -> kept orders, one item after the other."""
    kept, urls = [], set()
    for o, t, u in sorted(items):
        def similar(k):
            m = max(len(t), len(k))
            return m == 0 or (t == k if m < 20 else lev(t, k) / m <= 0.30)
        if u in urls or any(similar(k) for _, k in kept):
            continue
        kept.append((o, t))
        urls.add(u)
    return {o for o, _ in kept}


def test_dedup_equals_sequential(spark):
    rnd = random.Random(7)
    words = "order win solar power crore project railway metro board results merger bank rate cut wind energy".split()
    items = []
    for i in range(90):
        kind = rnd.random()
        if kind < 0.35:  # one hot family of near-copies
            title = "Reliance Industries wins crore solar order from SECI " + "x" * rnd.randint(0, 4) + str(rnd.randint(0, 9))
        elif kind < 0.5 and items:
            title = rnd.choice(items)[1]
        elif kind < 0.6:
            title = rnd.choice(["HAL order", "BEL order", "", "abcdefghijklmnop", "abcdefghijklmnopqrstuv"])
        else:
            title = " ".join(rnd.choice(words) for _ in range(rnd.randint(4, 9)))
        items.append((i, title, f"https://a.com/{rnd.randint(0, 70)}"))
    df = spark.createDataFrame(items, "n long, title string, link string")
    norm = df.select("n", T.normalize_text("title").alias("t"), T.normalize_url("link").alias("u")).collect()
    want = sequential_dedup([(r.n, r.t, r.u) for r in norm])
    got = {r.n for r in dedup.deduplicate(df, order="n").collect()}
    assert got == want
    polls = [sequential_dedup([(r.n, r.t, r.u) for r in norm if r.n % 3 == p]) for p in range(3)]
    got = {r.n for r in dedup.deduplicate(df.withColumn("poll", F.col("n") % 3), order="n", batch=["poll"]).collect()}
    assert got == set().union(*polls)


def test_dedup_reference_cases(spark):
    items = [
        (1, "Reliance Industries wins 5000 crore solar order from SECI", "https://a.com/x"),
        (2, "Completely different headline about the same link", "https://a.com/x"),
        (3, "Reliance Industries wins 5000 crore solar order from SECI - Moneycontrol", "https://b.com/y"),
        (4, "Tata Motors Q3 results beat street estimates", "https://a.com/1"),
    ]
    df = spark.createDataFrame(items, "n long, title string, link string")
    assert {r.n for r in dedup.deduplicate(df, order="n").collect()} == {1, 4}
    two = df.withColumn("poll", F.col("n") % 2)
    assert {r.n for r in dedup.deduplicate(two, order="n", batch=["poll"]).collect()} == {1, 2, 4}


def test_prompt(spark):
    df = spark.createDataFrame([("Big order win", "Details here", "SUZLON", None, 500.0, "Cr", None, None), ("Title", "Snippet") + (None,) * 6],
                               "title string, snippet string, ticker string, company_name string, order_value double, order_value_unit string, sector string, contract_type string")
    a, b = [r.prompt for r in analysis.with_prompt(df).collect()]
    for part in ("NEWS TITLE: Big order win", "NEWS SNIPPET: Details here", "Detected Ticker: SUZLON", "Order Value: ₹500 Cr"):
        assert part in a
    assert "Pre-extracted context" not in b


def test_responses(spark):
    good = '{"ai_score": 8, "summary": "Large order", "sentiment": "Bullish", "confidence": "High", "counterparty": "NTPC"}'
    rows = [good, "```json\n" + good + "\n```", good.replace("8", "15").replace("Bullish", "positive").replace("High", "HIGH"),
            "not json at all", '{"summary": "no score"}', '{"ai_score": "8", "summary": "s", "sentiment": "x"}', "{broken"]
    out = [r.a for r in spark.createDataFrame([(r,) for r in rows], "t string").select(analysis.parse_response(F.col("t")).alias("a")).collect()]
    assert (out[0].ai_score, out[0].sentiment, out[0].counterparty, out[0].price_prediction) == (8.0, "Bullish", "NTPC", "N/A")
    assert out[1].ai_score == 8.0
    assert (out[2].ai_score, out[2].sentiment, out[2].confidence) == (10.0, "Bullish", "High")
    assert out[3:] == [None] * 4


def test_order_values(spark):
    texts = {
        "a": "The company received a purchase order with order value of Rs. 125.50 crore from NTPC.",
        "b": "Built-up area of 2.3 million sq ft. Contract value Rs 40 crore. Penalty of Rs 2 crore may apply.",
        "c": "Contract valued at US$ 1.90 mn for supply.",
        "d": "Total Value in crores 17.89 for the work order",
        "e": "29 lakh people benefit",
        "f": "Revenue of Rs 900 crore in the previous year",
        "g": None,
        "h": "Order value Rs 10 crore. Contract value Rs 11 crore.",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r.k: (r.value_cr, r.confidence, r.n_candidates) for r in order_values.order_values(df, "k", "text").collect()}
    assert got["a"] == (125.5, "high", 1)
    assert got["b"][0] == 40.0 and got["b"][2] == 2
    assert got["c"] == (15.77, "high", 1)
    assert got["d"] == (17.89, "high", 1)
    assert got["e"] == (None, "none", 0)
    assert got["f"][:2] == (900.0, "low")
    assert got["g"] == (None, "none", 0)
    assert got["h"] == (10.0, "low", 2)

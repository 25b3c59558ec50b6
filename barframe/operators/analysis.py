"""Model prompts as a column, and model responses to typed rows (no call is made here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.numbers import literal_lookup
from barframe.operators.sessions import bind

c = F.col

# The prompt wording and the response contract.
PROMPT_HEAD = (
    "You are an expert Indian stock market analyst specializing in identifying share-price-moving "
    "events. Analyze this news alert and provide a structured trading assessment.\n\nNEWS TITLE: "
)
PROMPT_TAIL = """

Respond ONLY with a valid JSON object (no markdown, no explanation) with these exact fields:
{
  "ai_score": <number 1-10, where 10 = extremely market-moving like major acquisition/order win, 1 = routine/no impact>,
  "summary": "<2-3 sentence trader's take: what happened, why it matters for the stock, what to watch next>",
  "sentiment": "<exactly one of: Bullish, Bearish, Neutral>",
  "confidence": "<exactly one of: High, Medium, Low>",
  "price_prediction": "<predicted price action e.g. 'Up 3-5% short term' or 'Neutral - no material impact'>",
  "counterparty": "<who gave the order/contract, or null if N/A>",
  "order_type": "<New Order, Repeat Order, Follow-on, or null if not an order>",
  "revenue_impact": "<estimated impact on company revenue e.g. '~8% of annual revenue', or null if unknown>",
  "key_insight": "<single most important takeaway for a trader>",
  "risk_factors": "<potential risks or reasons this might not move the stock, or null>"
}

Scoring guide:
- 9-10: Major M&A, large order win (>500 Cr), regulatory approval, block/bulk deal
- 7-8: Significant order win, quarterly results beat, dividend, JV with major company
- 5-6: Moderate order, routine contract, management change
- 3-4: Minor news, routine filing, small order
- 1-2: No market impact, general industry news"""
SENTIMENTS = {"bullish": "Bullish", "bearish": "Bearish", "neutral": "Neutral", "positive": "Bullish", "negative": "Bearish"}
CONFIDENCES = {"high": "High", "medium": "Medium", "low": "Low"}
TEXT_LIMITS = {"summary": 500, "counterparty": 100, "order_type": 50, "revenue_impact": 100, "key_insight": 200, "risk_factors": 200}

RESPONSE_SCHEMA = (
    "ai_score double, summary string, sentiment string, confidence string, price_prediction string, "
    "counterparty string, order_type string, revenue_impact string, key_insight string, risk_factors string, "
    "_bad string"
)


def number_text(value: Column) -> Column:
    """Whole numbers without a trailing '.0'."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def prompt(title, snippet, ticker, company, value, unit, sector, kind) -> Column:
    line = lambda label, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(label), x))
    amount = F.when(
        (value != 0) & unit.isNotNull(), F.concat(F.lit("₹"), number_text(value), F.lit(" "), unit)
    )
    context = F.concat_ws(
        "\n", line("Detected Ticker: ", ticker), line("Company: ", company), line("Order Value: ", amount),
        line("Sector: ", sector), line("Contract Type: ", kind),
    )
    block = F.when(context != "", F.concat(F.lit("\n\nPre-extracted context:\n"), context)).otherwise("")
    return F.concat(F.lit(PROMPT_HEAD), title, F.lit("\nNEWS SNIPPET: "), snippet, block, F.lit(PROMPT_TAIL))


def with_prompt(events: DataFrame) -> DataFrame:
    return events.withColumn("prompt", prompt(
        c("title"), c("snippet"), c("ticker"), c("company_name"), c("order_value"), c("order_value_unit"), c("sector"), c("contract_type"),
    ))


def parse_response(text: Column) -> Column:
    """Typed struct from a response, or NULL when it is not usable.

    The outermost braces are taken, so code fences around them do not matter.
    """
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    data = F.from_json(body, RESPONSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    filled = lambda f: data[f].isNotNull() & (data[f] != "")
    ok = (body != "") & data["_bad"].isNull() & data["ai_score"].isNotNull() & filled("summary") & filled("sentiment")
    clip = lambda f: F.substring(F.nullif(data[f], F.lit("")), 1, TEXT_LIMITS[f]).alias(f)
    out = F.struct(
        F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.floor(data["ai_score"] + 0.5).cast("double"))).alias("ai_score"),
        clip("summary"),
        F.coalesce(literal_lookup(F.lower(data["sentiment"]), SENTIMENTS), F.lit("Neutral")).alias("sentiment"),
        F.coalesce(literal_lookup(F.lower(data["confidence"]), CONFIDENCES), F.lit("Medium")).alias("confidence"),
        F.substring(F.coalesce(F.nullif(data["price_prediction"], F.lit("")), F.lit("N/A")), 1, 100).alias("price_prediction"),
        clip("counterparty"), clip("order_type"), clip("revenue_impact"), clip("key_insight"), clip("risk_factors"),
    )
    return F.when(ok, out)


def with_analysis(responses: DataFrame, text_col: str, analyzed_at) -> DataFrame:
    parsed = bind(responses, ai_analysis=parse_response(c(text_col)))
    return parsed.withColumn("analyzed_at", F.when(c("ai_analysis").isNotNull(), F.lit(analyzed_at).cast("timestamp")))

"""Financial keyword lists, by category, in matching order.

Matching is by substring on lower-cased text, so a short entry also hits inside longer
words; order and repeats across categories are part of the result.
"""

# Keyword lists that decide tags, sectors and scores.
ORDER_AND_CONTRACT = [
    "order win", "order received", "order book", "new order", "repeat order", "order inflow",
    "order bagged", "secured order", "contract awarded", "contract win", "contract secured",
    "work order", "purchase order", "supply order", "turnkey order", "EPC order",
    "AMC contract", "rate contract",
]
REGULATORY = [
    "letter of intent", "LoI", "LOI received", "PAL", "product approval", "ANDA approval",
    "USFDA approval", "DCGI approval", "CE marking", "BIS certification", "ISO certification",
    "regulatory approval", "patent granted", "patent filed", "license received", "FPO", "IPO",
    "OFS", "rights issue",
]
CORPORATE_ACTIONS = [
    "acquisition", "merger", "amalgamation", "demerger", "buyback", "share buyback", "delisting",
    "bonus issue", "stock split", "dividend declared", "interim dividend", "final dividend",
    "special dividend", "rights issue", "preferential allotment", "QIP",
    "qualified institutional placement", "warrant conversion", "ESOP", "JV", "joint venture",
    "strategic partnership", "stake sale", "stake acquisition", "open offer", "takeover",
    "scheme of arrangement", "subsidiary", "wholly owned subsidiary", "divestment",
    "disinvestment",
]
RESULTS = [
    "quarterly results", "Q1 results", "Q2 results", "Q3 results", "Q4 results",
    "annual results", "revenue growth", "profit growth", "EBITDA", "PAT", "net profit",
    "operating profit", "revenue", "turnover", "topline", "bottomline", "EPS",
    "earnings per share", "margin expansion", "margin contraction", "guidance", "outlook",
    "forward guidance", "management commentary", "analyst meet", "investor presentation",
    "con call", "conference call", "board meeting", "AGM", "EGM",
]
SENTIMENT = [
    "block deal", "bulk deal", "insider trading", "promoter buying", "promoter selling",
    "promoter pledge", "pledge reduction", "FII buying", "DII buying", "short covering",
    "open interest", "delivery percentage", "volume spike", "upper circuit", "lower circuit",
    "breakout", "multibagger", "52 week high", "52 week low", "all time high",
    "market cap milestone", "blue chip", "penny stock", "momentum", "bull run", "bear trap",
    "dead cat bounce",
]
DEFENSE = [
    "defense order", "defence order", "military contract", "MoD", "Ministry of Defence", "BEL",
    "HAL", "DRDO", "Make in India defense", "Atmanirbhar Bharat", "naval order", "ammunition",
    "missile", "radar", "electronic warfare", "L1 bidder", "RFP", "RFQ", "ToT",
    "transfer of technology",
]
TELECOM = [
    "spectrum allocation", "5G rollout", "5G order", "fiber optic", "FTTH", "BharatNet",
    "tower company", "network expansion", "subscriber addition", "ARPU", "data consumption",
    "telecom infra", "optical fiber", "OFC",
]
INFRASTRUCTURE = [
    "highway project", "NHAI", "road construction", "smart city", "metro project",
    "railway order", "solar project", "wind energy", "renewable energy", "power plant",
    "transmission line", "water treatment", "real estate", "housing project", "RERA",
    "cement dispatch", "steel production",
]
PHARMA = [
    "ANDA filing", "USFDA", "FDA inspection", "clinical trial", "drug launch", "API",
    "formulation", "CRAMS", "CDMO", "biosimilar", "generic launch", "hospital chain",
    "diagnostic", "medical device",
]
TECHNOLOGY = [
    "deal win", "total contract value", "TCV", "digital transformation", "cloud migration",
    "AI contract", "cybersecurity", "SaaS", "platform deal", "client addition", "large deal",
    "mega deal", "attrition rate", "bench strength", "offshoring",
]
BANKING = [
    "NPA", "GNPA", "NNPA", "NIM", "net interest margin", "credit growth", "deposit growth",
    "CASA ratio", "provision coverage", "capital adequacy", "RBI", "rate cut",
    "monetary policy", "lending rate", "AUM", "assets under management", "NAV", "mutual fund",
    "insurance premium", "GWP",
]

CATEGORIES = {
    "Order & Contract": ORDER_AND_CONTRACT,
    "Regulatory & Approvals": REGULATORY,
    "Corporate Actions": CORPORATE_ACTIONS,
    "Financial Results": RESULTS,
    "Market Sentiment": SENTIMENT,
    "Defense": DEFENSE,
    "Telecom": TELECOM,
    "Infrastructure": INFRASTRUCTURE,
    "Pharma & Healthcare": PHARMA,
    "IT & Technology": TECHNOLOGY,
    "Banking & Finance": BANKING,
}

# Categories that count as a sector, in tie-breaking order.
SECTORS = (
    "Defense", "Telecom", "IT & Technology", "Pharma & Healthcare", "Banking & Finance",
    "Infrastructure",
)

# Words that look like tickers and are not.
NOT_TICKERS = (
    "BSE", "NSE", "SEBI", "RBI", "IPO", "OFS", "QIP", "AGM", "EGM", "CEO", "CFO", "CTO", "CMD",
    "FPO", "NPA", "ROE", "PAT", "EPS", "THE", "AND", "FOR", "LTD", "PVT", "INC", "CORP", "HAS",
    "WAS", "NEW", "OLD", "ALL", "NOT", "BUT", "HAD", "HIS", "HER", "ITS", "API", "SaaS", "RSS",
    "URL", "PDF",
)

# Keywords that raise the impact score.
HIGH_IMPACT = (
    "order win", "contract awarded", "acquisition", "merger", "buyback", "demerger",
    "delisting", "open offer", "takeover", "usfda approval", "block deal", "bulk deal",
    "promoter buying", "quarterly results", "dividend",
)
SECTOR_BOOST = (
    "defense", "defence", "military", "telecom", "5g", "semiconductor", "ev",
    "electric vehicle", "ai", "artificial intelligence", "green energy", "renewable",
    "hydrogen",
)

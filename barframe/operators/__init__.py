"""DataFrame operators.

Windows are keyed by ticker, contract or index. Their inputs are keyed tables - one row per
(ticker, date) and so on, which the scans and the bar aggregation enforce - so a window
partition is never larger than the number of sessions of one instrument, however many raw
rows stand behind it. Whatever is *not* bounded that way (filings, fills, trades, returns
of a report cell) is aggregated first or joined by key, never collected per group.
"""

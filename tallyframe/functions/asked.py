"""What a question in words asks for: filters, metrics, contexts. Query-side, hence plain Python."""

from __future__ import annotations

import re

#: Words of a question and the section that they point to.
SECTION_HINTS = {"risk": "Risk Factors", "md&a": "Management's Discussion and Analysis", "discussion": "Management's Discussion and Analysis", "financial statement": "Financial Statements", "balance sheet": "Financial Statements", "business": "Business"}
ANNUAL_WORDS = ("annual", "year-over-year", "yearly", "full year")
SECTION_WORDS = ("growth", "driver", "performance", "revenue", "analysis", "cause", "factor", "strategy", "trend")
DETAIL_WORDS = ("growth", "driver", "performance", "analysis", "cause", "factor", "strategy", "trend", "insight")
ANALYSIS_SECTIONS = ["Management's Discussion and Analysis of Financial Condition and Results of Operations", "Financial Statements and Supplementary Data"]
#: What metrics are called.
METRICS = {
    "revenue": "total_revenue", "sales": "total_revenue", "turnover": "total_revenue", "cogs": "cost_of_revenue", "cost of goods sold": "cost_of_revenue", "gross profit": "gross_profit", "r&d": "research_and_development", "sg&a": "sales_general_and_admin",
    "operating income": "operating_income", "ebit": "operating_income", "net income": "net_income", "profit": "net_income", "earnings": "net_income", "eps": "earnings_per_share_diluted", "cash": "cash_and_cash_equivalents", "receivables": "accounts_receivable", "inventory": "inventory",
    "assets": "total_assets", "liabilities": "total_liabilities", "equity": "total_stockholders_equity", "debt": "long_term_debt", "operating cash flow": "net_cash_from_operating_activities", "capex": "capital_expenditures", "dividends": "dividends_paid", "buybacks": "share_repurchases",
}
#: Contexts of a question and their words.
CONTEXTS = {
    "performance": ["revenue", "earnings", "margin", "growth", "decline"],
    "forward_looking": ["outlook", "guidance", "forecast", "estimates"],
    "capital_allocation": ["repurchase", "buyback", "dividend", "capex"],
    "operations": ["supply chain", "inventory", "demand", "pricing"],
    "market": ["competition", "market share", "expansion"],
    "financial_health": ["cash flow", "EBITDA", "leverage", "working capital"],
}


def filters_of(question: str, given: dict | None = None) -> dict:
    """Filters that a question names and that aren't given: years, quarters, sections; a yearly report where it asks for years and no quarter.

    Quarters and years are kept as pairs where both are named. Questions on growth or analysis that name no section look at the
    discussion and the statements, and at small chunks."""
    out, low = dict(given or {}), question.lower()
    years = sorted(set(re.findall(r"\b(20[12]\d)\b", low)))
    quarters = sorted(set(re.findall(r"\bq([1-4])\b", low)) | {str(k) for k, w in enumerate(("first", "second", "third", "fourth"), 1) if re.search(rf"\b{w} quarter\b", low)})
    if years and "fiscal_year" not in out:
        out["fiscal_year"] = years if len(years) > 1 else years[0]
    if quarters and "fiscal_quarter" not in out:
        out["fiscal_quarter"] = quarters if len(quarters) > 1 else quarters[0]
    if years and quarters:
        out["periods"] = [(y, q) for y in years for q in quarters]
    if "form_type" not in out and "fiscal_quarter" not in out and (len(years) > 1 or any(w in low for w in ANNUAL_WORDS)):
        out["form_type"] = "10-K"
    if "section_name" not in out:
        named = list(dict.fromkeys(s for w, s in SECTION_HINTS.items() if w in low))
        if not named and any(w in low for w in SECTION_WORDS):
            named = list(ANALYSIS_SECTIONS)
        if named:
            out["section_name"] = named if len(named) > 1 else named[0]
    if "granularity" not in out and any(w in low for w in DETAIL_WORDS):
        out["granularity"] = "micro"
    return last_quarter_is_the_year(single(out))


#: Words by which a question on calls means a kind of speaker or a part of the call; the first kind that is met decides.
ROLES = {"ceo": ["ceo", "chief executive"], "cfo": ["cfo", "chief financial"], "management": ["management", "executives", "leadership"], "analyst": ["analyst", "analysts", "analyst questions"]}
PARTS = {"remarks": ["outlook", "guidance", "forecast", "future"], "questions": ["question", "q&a", "analyst question"]}


def call_filters(question: str, names: dict[str, list[str]] | None = None) -> dict:
    """Filters that a question on calls names: the first quarter, a role (a kind of ROLES, or by the names of a company's people, given by role), a part of the call."""
    low, out = question.lower(), {}
    if quarters := filters_of(question).get("fiscal_quarter") or re.findall(r"\bq4\b", low):
        out["quarter"] = f"Q{sorted(quarters)[0].removeprefix('q')}"
    elif "fourth quarter" in low:
        out["quarter"] = "Q4"
    for kind, table, more in (("role", ROLES, names or {}), ("part", PARTS, {})):
        found = next((k for k, words in table.items() if any(w in low for w in [*words, *(n.lower() for n in more.get(k, []))])), None)
        if found:
            out[kind] = found
    return out


def single(filters: dict) -> dict:
    """Lists of one value as the value."""
    return {k: v[0] if isinstance(v, list) and len(v) == 1 and k != "periods" else v for k, v in filters.items()}


def last_quarter_is_the_year(filters: dict) -> dict:
    """The fourth quarter has no report of its own: it is in the yearly one."""
    if str(filters.get("fiscal_quarter", "")).upper().removeprefix("Q") != "4":
        return filters
    return {**{k: v for k, v in filters.items() if k != "fiscal_quarter"}, "form_type": "10-K"}


def valid(ticker: str, question: str, period: str = "latest") -> list[str]:
    """What is wrong with a search, if anything."""
    found = [] if re.fullmatch(r"[A-Za-z]{1,5}", ticker.strip()) else ["ticker: 1 to 5 letters"]
    found += [] if 0 < len(question.strip()) <= 1000 else ["question: 1 to 1000 characters"]
    return found + ([] if re.fullmatch(r"latest|latest_10[kq]|last_\d+_reports", period) else [f"no such period: {period}"])


def metric(name: str, columns: list[str]) -> str | None:
    """The column that a metric's name means: itself, one it is called by, or none."""
    plain = re.sub(r"[\s_]+", " ", name.strip().lower())
    if (own := plain.replace(" ", "_")) in columns:
        return own
    return METRICS[plain] if METRICS.get(plain) in columns else None


def contexts(question: str, synonyms: dict[str, list[str]], most: int = 3) -> dict[str, list[str]]:
    """Contexts that a question touches, by a term or one of its synonyms, and the first synonyms of each such term."""
    low, out = question.lower(), {}
    for context, terms in CONTEXTS.items():
        for term in terms:
            if any(w.lower() in low for w in [term, *synonyms.get(term, [])]) and term in synonyms:
                out.setdefault(context, []).extend(synonyms[term][:most])
    return out

"""What terms of finance are called besides; for the expansion of queries."""

from __future__ import annotations

#: Terms and what else they are called, in order of preference.
SYNONYMS = {
    "forward-looking": ["outlook", "forecast", "guidance", "projection", "estimate", "expected", "anticipate", "predict", "future", "roadmap", "vision", "planning"],
    "outlook": ["guidance", "forecast", "projection", "forward-looking", "estimate", "expected", "anticipate", "future outlook", "going forward"],
    "guidance": ["outlook", "forecast", "projection", "forward-looking", "estimate", "expected", "target", "goal", "roadmap"],
    "forecast": ["outlook", "guidance", "projection", "estimate", "expected", "anticipated", "predicted", "forecasted"],
    "estimates": ["guidance", "outlook", "forecast", "projection", "expected", "anticipated", "target", "consensus"],
    "revenue": ["sales", "income", "top line", "net sales", "total revenue", "gross sales", "receipts"],
    "earnings": ["profit", "net income", "bottom line", "earnings per share", "EPS", "profitability", "net profit"],
    "margin": ["gross margin", "operating margin", "profit margin", "EBITDA margin", "net margin", "margins", "profitability"],
    "growth": ["expansion", "increase", "improvement", "uptick", "acceleration", "momentum", "gains", "rising"],
    "decline": ["decrease", "drop", "fall", "contraction", "deceleration", "slowdown", "weakness", "deterioration"],
    "repurchase": ["buyback", "buy back", "share repurchase", "stock buyback", "share purchase", "repo", "capital return"],
    "buyback": ["repurchase", "buy back", "share repurchase", "stock buyback", "share purchase", "repo", "capital return"],
    "dividend": ["payout", "distribution", "dividend payment", "cash dividend", "shareholder return", "yield"],
    "capex": ["capital expenditure", "capital spending", "investments", "infrastructure spending", "facility investments", "equipment purchases"],
    "cash flow": ["operating cash flow", "free cash flow", "FCF", "cash generation", "cash from operations", "liquidity"],
    "supply chain": ["supply", "logistics", "manufacturing", "production", "sourcing", "procurement", "vendor", "supplier"],
    "inventory": ["stock", "stockpile", "goods", "merchandise", "finished goods", "raw materials", "components"],
    "demand": ["customer demand", "market demand", "consumption", "appetite", "interest", "purchasing", "adoption"],
    "pricing": ["price", "pricing strategy", "cost", "pricing power", "price realization", "pricing environment"],
    "competition": ["competitive", "competitor", "rival", "market share", "competitive landscape", "competitive pressure"],
    "market share": ["share", "market position", "competitive position", "penetration", "footprint"],
    "expansion": ["growth", "scaling", "rollout", "launch", "enter", "penetrate", "extend"],
    "acquisition": ["M&A", "merger", "purchase", "deal", "transaction", "strategic investment", "takeover"],
    "innovation": ["R&D", "research", "development", "technology", "breakthrough", "advancement", "cutting-edge"],
    "AI": ["artificial intelligence", "machine learning", "ML", "intelligent", "smart", "automation", "cognitive"],
    "digital": ["digitization", "digital transformation", "online", "electronic", "virtual", "cloud"],
    "platform": ["ecosystem", "infrastructure", "framework", "system", "architecture", "solution"],
    "cost": ["expense", "spending", "expenditure", "investment", "outlay", "cost structure", "operating expense"],
    "efficiency": ["optimization", "productivity", "streamlining", "rationalization", "cost savings", "operational efficiency"],
    "restructuring": ["reorganization", "cost reduction", "optimization", "rightsizing", "transformation"],
    "international": ["global", "overseas", "foreign", "worldwide", "abroad", "cross-border", "multinational"],
    "domestic": ["US", "United States", "home market", "local", "national", "stateside"],
    "emerging markets": ["developing markets", "growth markets", "international expansion", "new markets"],
    "segment": ["division", "business unit", "category", "vertical", "line of business", "product line"],
    "EBITDA": ["earnings before interest tax depreciation amortization", "operating earnings", "core earnings"],
    "ROI": ["return on investment", "returns", "profitability", "investment returns"],
    "leverage": ["debt", "borrowing", "financial leverage", "debt ratio", "gearing"],
    "working capital": ["current assets", "liquidity", "cash conversion", "operating capital"],
    "strong": ["robust", "solid", "healthy", "impressive", "excellent", "outstanding", "exceptional"],
    "weak": ["soft", "challenging", "difficult", "poor", "disappointing", "concerning", "pressured"],
    "momentum": ["trend", "trajectory", "direction", "progress", "acceleration", "pace", "speed"],
    "headwinds": ["challenges", "obstacles", "pressures", "difficulties", "constraints", "barriers"],
    "tailwinds": ["opportunities", "benefits", "support", "favorable conditions", "positive drivers"],
    "quarterly": ["Q1", "Q2", "Q3", "Q4", "quarter", "three months", "90 days"],
    "annual": ["yearly", "year-over-year", "YoY", "full year", "FY", "12 months"],
    "near-term": ["short-term", "immediate", "next quarter", "coming months", "upcoming"],
    "long-term": ["strategic", "multi-year", "future", "long-range", "sustained", "ongoing"],
}
#: Phrases and the term that they stand for.
PHRASES = {r"\bforward[- ]looking\b": "forward-looking", r"\bshare repurchase\b": "repurchase", r"\bbuy[- ]?back\b": "buyback", r"\bcash flow\b": "cash flow", r"\bmarket share\b": "market share", r"\bsupply chain\b": "supply chain", r"\bcapital expenditure\b": "capex", r"\boperating margin\b": "margin", r"\bnet income\b": "earnings"}
#: Words of a question that call for a report's narrative, and the words that bring it up.
NARRATIVE_CUES = ["revenue", "growth", "performance", "sales", "income"]
NARRATIVE = "management discussion analysis results operations growth drivers performance factors"

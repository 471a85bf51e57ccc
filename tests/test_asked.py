"""Questions in words."""

from tallyframe.functions import asked
from tallyframe.operators import search


def test_filters():
    assert asked.filters_of("How did revenue change in Q2 2023?")["fiscal_quarter"] == "2"
    assert asked.filters_of("trend of margins, 2022 and 2023") == {"fiscal_year": ["2022", "2023"], "form_type": "10-K", "section_name": asked.ANALYSIS_SECTIONS, "granularity": "micro"}
    assert asked.filters_of("risk in the first quarter and Q3 of 2021 and 2022")["periods"] == [("2021", "1"), ("2021", "3"), ("2022", "1"), ("2022", "3")]
    assert asked.filters_of("fourth quarter of 2024") == {"fiscal_year": "2024", "periods": [("2024", "4")], "form_type": "10-K"}
    assert asked.filters_of("anything", {"fiscal_year": ["2020"]}) == {"fiscal_year": "2020"}


def test_validation():
    assert asked.valid("AAPL", "what", "last_3_reports") == [] and len(asked.valid("TOOLONG1", "", "yesterday")) == 3


def test_metrics():
    columns = ["total_revenue", "net_income", "gross_profit"]
    assert [asked.metric(n, columns) for n in ("Revenue", "net income", "gross_profit", "EPS", "rubbish")] == ["total_revenue", "net_income", "gross_profit", None, None]


def test_contexts():
    first = lambda *terms: [s for t in terms for s in search.SYNONYMS[t][:3]]
    assert asked.contexts("outlook for sales", search.SYNONYMS) == {"performance": first("revenue"), "forward_looking": first("outlook", "guidance", "forecast", "estimates")}
    assert asked.contexts("hello", search.SYNONYMS) == {}

"""Hand-computed fixtures of the rules, and the decisions on the quirks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import asked, fiscal, formula, period, text as tx
from tallyframe.functions.catalog import RATIOS, TAGS, VIRTUAL
from tallyframe.operators import alignment as al, chunks, facts, fundamentals as fu, news, prices, relational as rel, search, summaries as su, transcripts, usage

HEAD = "cik long, ticker string, period_end_date date, fiscal_year int, period_type string, period_length_months int"
D = dt.date.fromisoformat


def statements(spark, rows, measures="total_revenue long"):
    return spark.createDataFrame([(1, "A", D(d), y, t, m, *v) for d, y, t, m, *v in rows], f"{HEAD}, {measures}")


ALL = ", ".join(f"{n} long" for n in [*fu.REQUIRED["income"], "weighted_average_shares_basic"])


def full(spark, rows):
    """All five fields that completeness is judged by have the value given; shares are the second value."""
    return statements(spark, [(d, y, t, m, v, v, v, v, v, s) for d, y, t, m, v, s in rows], ALL)


# trailing twelve months -------------------------------------------------------------------------------------------
def test_ltm_standard_and_shares(spark):
    out = fu.ltm(full(spark, [("2023-12-31", 2023, "FY", 12, 400, 1000), ("2024-03-31", 2024, "Q1", 3, 120, 980), ("2023-03-31", 2023, "Q1", 3, 90, 1010)]))
    row = out.filter("fiscal_year = 2024").first()
    assert (row.total_revenue, row.calculation_method, row.weighted_average_shares_basic) == (430, "standard", 980)


def test_ltm_without_the_year_before(spark):
    row = fu.ltm(full(spark, [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-03-31", 2024, "Q1", 3, 120, 1)])).first()
    assert (row.total_revenue, row.calculation_method) == (520, "standard_fy_only")


def test_ltm_null_part(spark):
    df = full(spark, [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-03-31", 2024, "Q1", 3, 120, 1), ("2023-03-31", 2023, "Q1", 3, 90, 1)])
    df = df.withColumn("total_revenue", F.when(F.col("period_end_date") != "2023-03-31", F.col("total_revenue")))
    assert fu.ltm(df).filter("fiscal_year = 2024").first().total_revenue is None


def test_ltm_by_quarters(spark):
    rows = [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-03-31", 2024, "Q1", 3, 110, 1), ("2024-06-30", 2024, "Q2", 3, 120, 1), ("2023-03-31", 2023, "Q1", 3, 90, 1), ("2023-06-30", 2023, "Q2", 3, 95, 1)]
    row = fu.ltm(full(spark, rows)).filter("period_end_date = '2024-06-30'").first()
    assert (row.total_revenue, row.calculation_method) == (445, "quarterly_sum")


def test_ltm_by_few_quarters(spark):
    rows = [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-03-31", 2024, "Q1", 3, 110, 1), ("2024-06-30", 2024, "Q2", 3, 120, 1), ("2024-09-30", 2024, "Q3", 3, 130, 1)]
    df = full(spark, rows).withColumn("gross_profit", F.when(F.col("period_type").isin("FY", "Q3"), F.col("gross_profit")))
    assert fu.ltm(df).filter("period_type = 'Q3'").first().gross_profit == 530


def test_ltm_prefers_cumulated_periods_and_skips_year_ends(spark):
    rows = [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-06-30", 2024, "Q2", 6, 230, 1), ("2024-06-30", 2024, "Q2", 3, 120, 1), ("2023-06-30", 2023, "Q2", 6, 185, 1), ("2023-12-31", 2023, "Q4", 3, 100, 1)]
    out = fu.ltm(full(spark, rows)).collect()
    assert [(str(r.period_end_date), r.total_revenue, r.calculation_method) for r in out if r.fiscal_year == 2024] == [("2024-06-30", 445, "standard")]
    assert all(str(r.period_end_date) != "2023-12-31" for r in out)


def test_ltm_months_do_not_wrap(spark):
    """December and January are eleven months apart here, as in the original rule."""
    rows = [("2022-12-31", 2022, "FY", 12, 400, 1), ("2023-12-30", 2023, "Q1", 3, 120, 1), ("2022-01-02", 2022, "Q1", 3, 90, 1)]
    assert fu.ltm(full(spark, rows)).filter("fiscal_year = 2023").first().calculation_method == "standard_fy_only"


def test_ltm_at_a_year_end_is_the_year(spark):
    rows = full(spark, [("2023-12-31", 2023, "FY", 12, 400, 1), ("2024-03-31", 2024, "Q1", 3, 120, 1)])
    best = fu.best_method(fu.ltm(rows).unionByName(fu.year_rows(rows)))
    assert best.filter("period_end_date = '2023-12-31'").first().total_revenue == 400


@pytest.mark.parametrize(("gp", "want"), [(100, 130), (125, 125), (None, 130)])
def test_repair(spark, gp, want):
    df = statements(spark, [("2024-03-31", 2024, "Q1", 3, 430, 300, gp)], "total_revenue long, cost_of_revenue long, gross_profit long")
    for n in ("total_operating_expenses", "operating_income", "other_income", "interest_income", "interest_expense", "income_tax_expense"):
        df = df.withColumn(n, F.lit(None).cast("long"))
    assert fu.repaired(df).first().gross_profit == want


def test_free_cash_flow_is_less_spending(spark):
    df = statements(spark, [("2024-03-31", 2024, "Q1", 3, 100, 30, 0, 0)], "net_cash_from_operating_activities long, capital_expenditures long, net_cash_from_investing_activities long, net_cash_from_financing_activities long")
    assert fu.repaired(df).first().free_cash_flow == 70


# growth, joins ----------------------------------------------------------------------------------------------------
def test_growth_of_a_loss(spark):
    df = statements(spark, [("2024-03-31", 2024, "Q1", 3, 25), ("2023-04-01", 2023, "Q1", 3, -50)])
    assert fu.growth(df, ["total_revenue"]).first().growth == -1.5


def test_growth_takes_the_nearest_to_a_year(spark):
    day = D("2024-12-30")
    df = statements(spark, [(str(day), 2024, "FY", 12, 10), *((str(day - dt.timedelta(days=n)), 2023, "FY", 12, n) for n in (329, 330, 364, 366, 451))])
    row = fu.growth(df, ["total_revenue"]).filter("period_end_date = '2024-12-30'").first()
    assert (day - row.prior_date).days == 364


def nearest(spark, *gaps):
    at = D("2024-06-30")
    left = spark.createDataFrame([(1, at)], "cik long, at date")
    right = spark.createDataFrame([(1, at + dt.timedelta(days=g), g) for g in gaps], "cik long, day date, gap int")
    return fu.nearest(left, right, "at", "day", 90).first().gap


def test_nearest(spark):
    assert nearest(spark, -89, 90, -91) == -89
    assert nearest(spark, -30, 30) == 30
    assert nearest(spark, 91, -91) is None
    assert nearest(spark, 0, 1) == 0


def test_nearest_makes_no_pairs(spark):
    dates = lambda n, step: [D("2020-01-01") + dt.timedelta(days=step * i) for i in range(n)]
    left = spark.createDataFrame([(1, d) for d in dates(40, 30)], "cik long, at date")
    right = spark.createDataFrame([(1, d, i) for i, d in enumerate(dates(40, 31))], "cik long, day date, i int")
    out = fu.nearest(left, right, "at", "day", 90)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {d: max((-abs((e - d).days), e) for e in dates(40, 31))[1] for d in dates(40, 30)}
    assert {r["at"]: r.day for r in out.collect()} == want


def test_statements_of_one_scan(spark, sf_dir):
    """Views over the sums of sales that are written once don't read the sales again."""
    from tallyframe.plans import views

    base = views.based(spark, sf_dir)
    for name in ("income", "cash_flow", "balance"):
        assert "l_suppkey" not in views.shared(spark, sf_dir, name, given=base)._jdf.queryExecution().optimizedPlan().toString()


def test_forward_and_fuzzy(spark):
    left = spark.createDataFrame([(1, D("2024-05-10"))], "cik long, a date")
    right = spark.createDataFrame([(1, D(d)) for d in ("2024-05-05", "2024-05-15", "2024-05-16")], "cik long, b date")
    assert str(rel.next_after(left, right, ["cik"], "a", "b").first().b) == "2024-05-15"
    assert str(rel.fuzzy_dates(left, right, ["cik"], "a", "b").first().b) == "2024-05-05"


# formulas ---------------------------------------------------------------------------------------------------------
def value(spark, text, virtual=(), **fields):
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} double" for k in fields))
    return df.select(formula.Formula(text).column(df.columns, virtual).alias("v")).first().v


def test_formulas(spark):
    assert value(spark, "a / b", a=None, b=10.0) == 0.0  # a plain field that is null counts as 0
    assert value(spark, "a / b", ("a",), a=None, b=10.0) is None  # a virtual one doesn't
    assert value(spark, "a / b", a=1.0, b=0.0) is None
    assert value(spark, "a / missing", a=1.0) is None
    assert value(spark, "COALESCE(a, 7) + b", a=0.0, b=1.0) == 8.0
    assert value(spark, "COALESCE(missing, 7) + b", b=1.0) == 8.0
    assert value(spark, "-(a + 2) * 3", a=1.0) == -9.0
    for bad in ("__import__('os')", "a ** b", "f(a)", "a.b", "COALESCE(a, b + c)", "a; b"):
        with pytest.raises((ValueError, SyntaxError)):
            formula.Formula(bad)


def resolved(spark, **fields):
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} double" for k in fields))
    return formula.with_virtual_fields(df, VIRTUAL).first()


def test_virtual_fields(spark):
    row = resolved(spark, cost_of_revenue=None, total_revenue=430.0, gross_profit=130.0, operating_income=50.0, depreciation=4.0, amortization=3.0)
    assert (row.cogs, row.gp, row.total_op_expense, row.d_and_a, row.ebitda, row.ebit) == (300.0, 130.0, 380.0, 7.0, 57.0, 50.0)
    assert row.net_interest_expense == 0.0 and row.working_capital is None


def test_virtual_fields_of_users_may_come_in_any_order(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    assert formula.with_virtual_fields(df, {"late": ["early + 1"], "early": ["x * 10"]}).first().late == 21.0


def test_coverage_without_interest_is_null(spark):
    df = statements(spark, [("2024-12-31", 2024, "FY", 12, 100, 40)], "total_revenue long, operating_income long")
    assert fu.ratios(df, [r for r in RATIOS if r[0] == "EBIT_Interest_Coverage"], VIRTUAL).count() == 0
    assert fu.ratios(df, [r for r in RATIOS if r[0] == "EBIT_Margin"], VIRTUAL).first().ratio_value == 0.4


def test_ratio_inputs(spark):
    df = statements(spark, [("2024-12-31", 2024, "FY", 12, 5, 20)], "net_income long, total_stockholders_equity long")
    row = fu.ratios(df, RATIOS, VIRTUAL).filter("ratio_name = 'ROE'").first()
    assert row.ratio_value == 0.25 and row.calculation_inputs == '{"net_income":5.0,"total_stockholders_equity":20.0}'


# imputation -------------------------------------------------------------------------------------------------------
def test_imputation(spark):
    names = [n for n in "total_revenue cost_of_revenue gross_profit sales_and_marketing general_and_administrative total_operating_expenses operating_income income_before_taxes income_tax_expense net_income".split()]
    make = lambda **kw: fu.impute_income(statements(spark, [("2024-12-31", 2024, "FY", 12, *(kw.get(n) for n in names))], ", ".join(f"{n} long" for n in names))).first()
    assert make(total_revenue=100, gross_profit=0).cost_of_revenue is None  # 0 counts as missing in a guard
    assert make(total_revenue=100, gross_profit=40).cost_of_revenue == 60
    assert make(sales_and_marketing=0, general_and_administrative=5).sales_general_and_admin == 5  # here it doesn't
    row = make(total_revenue=100, cost_of_revenue=60, total_operating_expenses=10, net_income=20, income_tax_expense=5)
    assert (row.gross_profit, row.operating_income, row.income_before_taxes) == (40, 30, 25)


def test_ebitda(spark):
    income = statements(spark, [("2024-12-31", 2024, "FY", 12, 20)], "operating_income long")
    cash = lambda *v: statements(spark, [("2024-12-31", 2024, "FY", 12, *v)], "depreciation_and_amortization long, depreciation long, amortization long")
    assert fu.with_ebitda(income, cash(None, 7, 3)).first().ebitda == 30
    assert fu.with_ebitda(income, cash(8, 7, 3)).first().ebitda == 28
    assert fu.with_ebitda(income, cash(None, None, None)).first().ebitda is None


# periods ----------------------------------------------------------------------------------------------------------
def test_buckets(spark):
    days = {91: 3, 150: 3, 151: 6, 181: 6, 240: 6, 241: 9, 273: 9, 330: 9, 331: 12, 364: 12}
    df = spark.createDataFrame([(d,) for d in days], "d int").select("d", facts.months_of(F.col("d")).alias("m"))
    assert {r.d: r.m for r in df.collect()} == days


def test_period_language():
    assert period.parse("Q3-2024") == period.Period("quarter", 2024, 3) and period.parse(" fy2024 ") == period.Period("year", 2024)
    assert period.parse("Last 8 Quarters").n == 8 and period.parse("LTM").kind == "ltm"
    for bad in ("", "Q5-2024", "FY1999", "FY2031", "last 41 quarters", "last 0 quarters", "last 11 financial years", "2024"):
        with pytest.raises(ValueError):
            period.parse(bad)
    assert [period.canonical(t) for t in ("3 years", "8q", "2Y", "5", "FY2024", "rubbish", "30", "current", "past 6 quarters")] == ["last 12 quarters", "last 8 quarters", "last 8 quarters", "last 20 quarters", "fy2024", "last 12 quarters", "last 30 quarters", "latest", "last 6 quarters"]
    assert [period.report_period(t) for t in ("last 3 years", "last 2", "5 reports", "latest_10k", "last_4_reports", "soon")] == ["last_3_reports", "last_2_reports", "last_5_reports", "latest_10k", "last_4_reports", "latest"]


def test_tags_are_found_in_any_case(spark):
    df = spark.createDataFrame([("REVENUES",), ("grossprofit",), ("Nothing",)], "tag string")
    assert {(r.tag, r["column"]) for r in facts.mapped(df).collect()} == {("REVENUES", "total_revenue"), ("grossprofit", "gross_profit")}
    assert TAGS["ProceedsFromIssuanceOfLongTermDebt"] == "debt_issued" and TAGS["PaymentsToAcquireInvestments"] == "investments_purchased"


def test_fiscal_calendar(spark):
    df = spark.createDataFrame([(D("2024-10-31"),), (D("2024-09-30"),)], "d date")
    assert [r.y for r in df.select(fiscal.year_of(F.col("d"), F.lit("0930")).alias("y")).collect()] == [2025, 2024]
    assert [r.q for r in df.select(fiscal.quarter_of(F.col("d"), 9).alias("q")).collect()] == [1, 4]
    assert fiscal.quarter_starts(9) == [10, 1, 4, 7]
    y, q = fiscal.previous(F.lit(2024), F.lit(1))
    assert tuple(spark.range(1).select(y, q).first()) == (2023, 4)  # a step back over the new year is one quarter
    assert str(spark.range(1).select(fiscal.filing_date_of(F.lit("x/0000320193-24-000123.txt"))).first()[0]) == "2024-01-01"


# statistics, merges -----------------------------------------------------------------------------------------------
def test_upper_median(spark):
    assert spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v int").agg(rel.upper_median("v")).first()[0] == 3


def test_merges(spark):
    old, new = (spark.createDataFrame([r], "k int, a int, b int") for r in ((1, 1, 2), (1, None, 5)))
    assert tuple(rel.upsert_known(old, new, ["k"]).first()) == (1, 1, 5)
    assert tuple(rel.upsert(old, new, ["k"]).first()) == (1, None, 5)
    once = rel.upsert(old, new, ["k"])
    assert once.exceptAll(rel.upsert(once, new, ["k"])).count() == 0


def test_clusters(spark):
    rows = [("r", t, D(d), 1.0) for t, d in (("A", "2024-09-30"), ("A", "2024-06-30"), ("B", "2024-06-30"))]
    out = al.cluster_quarters(spark.createDataFrame(rows, "ratio_name string, ticker string, period_end_date date, ratio_value double")).collect()
    assert sorted((r.period_number, r.ticker, str(r.period_end_date)) for r in out) == [(1, "A", "2024-09-30"), (2, "A", "2024-06-30"), (2, "B", "2024-06-30")]
    years = [("r", t, D(d), 1.0) for t, d in (("A", "2024-09-30"), ("A", "2023-09-30"), ("B", "2024-12-31"), ("B", "2023-12-31"), ("C", "2022-01-31"))]
    got = al.align_years(spark.createDataFrame(years, "ratio_name string, ticker string, period_end_date date, ratio_value double")).collect()
    assert sorted((r.period_number, r.ticker) for r in got) == [(1, "A"), (1, "B"), (2, "A"), (2, "B")]


def greedy(rows, days, years):
    """Rounds by hand: (ticker, date, period_number) of rows (ticker, date)."""
    left = {}
    for t, d in sorted(rows, key=lambda x: x[1], reverse=True):
        left.setdefault(t, []).append(d)
    out, number = [], 0
    while any(left.values()):
        number += 1
        heads = sorted(((q[0], t) for t, q in left.items() if q), key=lambda x: (-x[0].toordinal(), x[1]))
        taken = []
        for d, t in heads:
            near = heads[0][0] if not years or not taken else sum(x.toordinal() for x, _ in taken) / len(taken)
            if abs((near if isinstance(near, float) else near.toordinal()) - d.toordinal()) <= days:
                taken.append((d, t))
        if years and len(taken) < 2:
            break
        for d, t in taken:
            left[t].pop(0)
            out.append((t, d, number))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_alignment_by_hand(spark, seed):
    """Companies with odd, close and equal dates, several groups; what the rounds by hand give."""
    r = random.Random(seed)
    rows = [(g, f"T{k}", D("2024-01-01") - dt.timedelta(days=r.randrange(1500) if k % 3 else 91 * j + r.randrange(20))) for g in "xyz" for k in range(r.randrange(2, 8)) for j in range(r.randrange(12))] + [("w", "T", None), ("v", "T", D("2020-01-01"))]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "ratio_name string, ticker string, period_end_date date, ratio_value double")
    for years, days, run in ((False, 45, al.cluster_quarters), (True, 180, al.align_years)):
        got = run(df, days).collect()
        for g in "vwxyz":
            assert sorted((x.ticker, x.period_end_date, x.period_number) for x in got if x.ratio_name == g) == greedy([x[1:] for x in rows if x[0] == g and x[2]], days, years)
    assert al.cluster_quarters(df.limit(0)).count() == 0


def test_clusters_lose_no_period(spark):
    """60 quarters and 15 years of two companies; a number is a request of the last n."""
    schema = "ratio_name string, ticker string, period_end_date date, ratio_value double"
    quarters = spark.createDataFrame([("r", t, D("2024-12-31") - dt.timedelta(days=91 * k + 10 * (t == "B")), float(k)) for t in "AB" for k in range(60)], schema)
    out = al.cluster_quarters(quarters).collect()
    assert sorted((r.ticker, r.ratio_value, r.period_number) for r in out) == [(t, float(k), k + 1) for t in "AB" for k in range(60)]
    assert al.cluster_quarters(quarters, most=4).count() == 8
    years = spark.createDataFrame([("r", t, D("2024-12-31") - dt.timedelta(days=365 * k), float(k)) for t in "AB" for k in range(15)], schema)
    assert sorted((r.ticker, r.ratio_value, r.period_number) for r in al.align_years(years).collect()) == [(t, float(k), k + 1) for t in "AB" for k in range(15)]
    assert al.align_years(years, most=3).count() == 6


# prices -----------------------------------------------------------------------------------------------------------
def test_gaps_end_at_weekends(spark):
    days = [d for d in (D("2024-01-01") + dt.timedelta(days=n) for n in range(12)) if d.weekday() < 5 and str(d) not in ("2024-01-04", "2024-01-05", "2024-01-08")]
    out = prices.missing_ranges(spark.createDataFrame([("A", d) for d in days], "ticker string, date date"), "2024-01-01", "2024-01-12").collect()
    assert sorted((str(r.start_date), str(r.end_date), r.days) for r in out) == [("2024-01-04", "2024-01-05", 2), ("2024-01-08", "2024-01-08", 1)]


def test_trend_and_risk(spark):
    lit = [F.lit(float(x)) for x in (100, 104, 104, 99, 101)]
    assert spark.range(1).select(prices.trend_of(F.lit(9), *lit)).first()[0] == "sideways"
    assert spark.range(1).select(prices.trend_of(F.lit(4), *lit)).first()[0] == "insufficient_data"
    risk = lambda v, w: spark.range(1).select(prices.risk_of(F.lit(v), F.lit(w))).first()[0]
    assert (risk(1.0, -6.0), risk(1.0, -11.0), risk(3.0, -6.0), risk(1.0, -1.0)) == ("medium", "high", "medium", "low")


def test_metrics(spark):
    close = [100.0, 110.0, 99.0, 108.9, 120.0, 121.0]
    df = spark.createDataFrame([("A", D("2024-01-01") + dt.timedelta(days=n), v, 10) for n, v in enumerate(close)], "ticker string, date date, close_price double, volume long")
    import statistics

    returns = [(b - a) / a * 100 for a, b in zip(close, close[1:], strict=False)]
    row = prices.metrics(df).first()
    assert row.total_return == 21.0 and row.trend == "upward" and row.volatility == pytest.approx(statistics.stdev(returns), abs=1e-4)


# text -------------------------------------------------------------------------------------------------------------
def test_keyword_score(spark):
    df = spark.createDataFrame([("cash flow and cash",)], "t string")
    assert df.select(tx.keyword_score(F.col("t"), "cash flow")).first()[0] == 6


def test_chunk_starts(spark):
    long, short = "x" * 100 + "y" * 1000, "x" * 100 + "z"
    assert tx.distinct_chunks([long, short]) == [] and tx.distinct_chunks([short, long]) == [short]
    df = spark.createDataFrame([("g", 0, long), ("g", 1, short)], "g string, seq int, text string")
    assert chunks.one_of_each_start(df, ["g"], "seq", "text").count() == 0
    once = tx.distinct_chunks([short, "another chunk of text"])
    assert tx.distinct_chunks(once) == once


def test_sentence_chunks():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    out = tx.sentence_chunks(text)
    assert len(out) > 2 and all(len(c) <= 800 for c in out) and all(out[k + 1].split(" ", 1)[0] in out[k] for k in range(len(out) - 1))
    assert tx.sentence_chunks(None) == [] and tx.sentence_chunks("Short.") == []
    assert tx.micro_chunks("Small. Text.") == [] and len(tx.micro_chunks(text)) > 5
    paragraphs = "\n\n".join(["word " * 50, "word " * 100, "A sentence of words. " * 100])
    assert sum(len(c.replace("\n", " ").split()) for c in tx.paragraph_chunks(paragraphs)) == len(paragraphs.split())
    assert tx.without_overlap("a" * 40 + "b" * 60, "b" * 60 + "c") == "c"


def test_chunks_by_their_rules():
    """Each rule of the chunkers, on texts of many lengths."""
    import random

    r = random.Random(3)
    for _ in range(60):
        parts = [" ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(1, 60))).capitalize() + r.choice(".!?") for _ in range(r.randrange(1, 40))]
        size = r.choice([200, 400, 800])
        out = tx.packed(parts, size)
        assert " ".join(out) == " ".join(parts) and all(len(c) <= size or c in parts for c in out)
        ends = [c.rsplit(" ", 0) for c in out]
        assert all(len(a[0]) + 1 + len(next(p for p in parts if b[0].startswith(p))) > size for a, b in zip(ends, ends[1:], strict=False))  # no chunk has room for what follows
        over = tx.sentence_chunks(" ".join(parts), size, 50)
        kept = [p for p in tx.sentences(" ".join(parts)) if len(p) > 10]
        assert all(len(c) <= size or any(p in c and len(p) + 52 > size for p in kept) for c in over) and all(any(p in c for c in over) for p in kept)
        assert all(b.startswith((a[-50:].strip().partition(" ")[2] or a[-50:].strip())[:5]) for a, b in zip(over, over[1:], strict=False))
        text = "\n\n".join(" ".join(parts[k : k + r.randrange(1, 4)]) for k in range(0, len(parts), 3))
        whole = tx.paragraph_chunks(text)
        paragraphs = text.split("\n\n")
        assert "".join("".join(whole).split()) == "".join(text.split())
        assert all(len(c) <= 1200 or any(len(p) > 1200 for p in paragraphs) for c in whole)
        small = tx.micro_chunks(text.replace("\n\n", " "))
        assert not small or all(b.startswith(a[-60:]) for a, b in zip(small, small[1:], strict=False))


def test_chunks_of_calls():
    said = [("Jane Doe", "Good morning all. " + "We did well this quarter. " * 40), ("Operator", "Next question."), ("Max Li", "How is demand? " * 5), ("Jane Doe", "Fine.")]
    text = "\n".join(f"{who}: {what}" for who, what in said)
    assert [(w, " ".join(t.split())) for w, t in tx.turns(text)] == [(w, " ".join(t.split())) for w, t in said]
    whole = tx.turn_chunks(text)
    assert len(whole) == 2 and whole[0].startswith("Jane Doe: Good") and whole[1].startswith("Operator: Next question. Max Li: How") and whole[1].endswith("Jane Doe: Fine.")
    remarks = tx.remark_chunks(text)
    assert all(len(c) <= 800 for c in remarks) and [c.split(":")[0] for c in remarks] == ["Jane Doe", "Jane Doe", "Operator", "Max Li", "Jane Doe"]
    assert " ".join(c.partition(": ")[2] for c in remarks).split() == " ".join(t for _, t in said).split()
    calls = tx.call_chunks(text, 300, 100)
    assert all(len(c) <= 300 for c in calls) and calls[0].startswith("Jane Doe: Good morning all.") and any(c.startswith("Max Li:") or "Max Li: How" in c for c in calls)
    assert tx.turns(None) == tx.turn_chunks("") == tx.remark_chunks("nobody speaks") == [] and tx.call_chunks("No speaker here at all. But a sentence.") == ["No speaker here at all. But a sentence."]


def test_formats(spark):
    rows = [(1.5e12,), (-2.25e9,), (999.5,), (1234.0,), (None,), (7.04e6,)]
    assert [r[0] for r in spark.createDataFrame(rows, "v double").select(tx.money(F.col("v"))).collect()] == ["$1.5T", "-$2.3B", "$999.50", "$1.2K", "N/A", "$7.0M"]
    assert spark.createDataFrame([(0.1234, None)], "a double, b double").select(tx.percent(F.col("a")), tx.percent(F.col("b"))).first()[:] == ("12.3%", "N/A")
    name, period_ = tx.ratio_key(F.col("k"))
    assert [tuple(r) for r in spark.createDataFrame([("ROE_Q4-2024",), ("Net_Margin_FY2023",), ("Cash_Ratio",)], "k string").select(name, period_).collect()] == [("ROE", "Q4-2024"), ("Net_Margin", "FY2023"), ("Cash_Ratio", None)]
    texts = [("for the Nine  Months Ended, and six months ended",), ("six months ended",), ("three months ended",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(tx.quarter_spoken(F.col("t"))).collect()] == [3, 2, 1]


def test_sections():
    allowed = ["Management's Discussion and Analysis of Financial Condition and Results of Operations", "Risk Factors", "Financial Statements and Supplementary Data"]
    assert tx.nearest_section("Item 7. Management’s Discussion", allowed) == allowed[0]  # spelled out, with an apostrophe
    assert tx.nearest_section("MD&A", allowed) == allowed[0]
    assert tx.nearest_section("risk factor", allowed) == allowed[1]
    assert tx.nearest_section("Financial Statements", allowed) == allowed[2] and tx.nearest_section("", allowed) is None
    assert tx.nearest_section("Liquidity", allowed) is None and tx.nearest_section(None, allowed) is None and tx.nearest_section("Risk", []) is None


def test_filters_of_questions_on_calls():
    assert asked.call_filters("What did the CEO say in Q3 about guidance?") == {"quarter": "Q3", "role": "ceo", "part": "remarks"}
    assert asked.call_filters("fourth quarter: what did analysts ask in the Q&A") == {"quarter": "Q4", "role": "analyst", "part": "questions"}
    assert asked.call_filters("What does Jane Doe expect?", {"cfo": ["Jane Doe"]}) == {"role": "cfo"} and asked.call_filters("") == {}


def test_ratios_in_words(spark):
    assert su.SAYS["ROE"] == "Earning power: net income over total stockholders equity." and len(su.SAYS) == len(RATIOS)
    assert su.SAYS["Revenue_Growth_YoY"] == "Change over a year: yoy growth of total revenue."
    df = spark.createDataFrame([("ROE", "net_income / total_stockholders_equity"), ("x", "COALESCE(ebitda, 0) - 2 * odd")], "ratio_name string, formula string")
    got = sorted((r.ratio_name, r.field, r.read_from) for r in su.guidance(df).collect())
    assert got == [("ROE", "net_income", "income_statement"), ("ROE", "total_stockholders_equity", "balance_sheet"), ("x", "ebitda", "virtual"), ("x", "odd", "unknown")]
    out = dict(chunks.item_sections("x " * 80 + "Item 1. Business we do things Item 1A. Risk Factors many risks", {"business": r"item 1\. ", "risk": r"item 1a\. "}))
    assert out["business"].startswith("Item 1. Business") and "many risks" in out["risk"] and out["unclassified"].startswith("x x")


def test_html():
    page = "<html><head><title>t</title></head><body><script>x</script><p>Some plain text here.</p><p>***** !!!!! -----</p><table><tr><td>a</td><td>1</td></tr></table>"
    assert chunks.html_lines(page) == ["Some plain text here.", "a", "1"] or "Some plain text here." in chunks.html_lines(page)


def test_pages_that_break_off():
    assert chunks.html_lines("<p>One of many</p><p>Salt &amp") == ["One of many", "Salt &"]
    assert chunks.html_lines("<p>Salt &am") == ["Salt &am"] and chunks.html_lines("<p>Words <b")[0].startswith("Words")
    assert chunks.html_lines(None) == chunks.html_lines("") == []


def test_speaker_chunks_keep_every_piece(spark):
    df = spark.createDataFrame([(1, 0, "A", " ".join(map(str, range(1200))))], "conv_id int, seq int, speaker string, content string")
    assert " ".join(r.text for r in transcripts.speaker_chunks(df).orderBy("piece").collect()) == " ".join(map(str, range(1200)))


def test_questions(spark):
    df = spark.createDataFrame([("What is new",), ("It is fine.",), ("Is it?",), ("thanks, one question on cost",)], "t string")
    assert [r[0] for r in df.select(tx.question(F.col("t"))).collect()] == [True, False, True, True]


# search -----------------------------------------------------------------------------------------------------------
def test_bm25_by_hand(spark):
    import math

    docs = {1: "cash flow cash", 2: "flow of risk", 3: "risk risk risk risk", 4: "", 5: "cost of goods"}
    df = spark.createDataFrame(list(docs.items()), "id long, content string")
    got = {r.id: r.score for r in search.bm25(df, "cash of cash").collect()}
    words = {i: t.split() for i, t in docs.items() if t}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df_ = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df_.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * average for w, v in idf.items()}
    want = {i: sum(idf[q] * x.count(q) * 2.5 / (x.count(q) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for q in "cash of cash".split()) for i, x in words.items()}
    assert got == {i: pytest.approx(v, abs=1e-5) for i, v in want.items() if v > 0}


def test_hybrid_of_one_result(spark):
    one = spark.createDataFrame([(1, 5.0)], "id long, score double")
    assert search.hybrid(one, one, 5).first().score == 0.0
    two = spark.createDataFrame([(1, 5.0), (2, 3.0)], "id long, score double")
    assert all(0 <= r.score <= 1 for r in search.hybrid(two, one, 5).collect())


def test_quota_and_report_order(spark):
    rows = spark.createDataFrame([(i, g, float(i)) for i, g in enumerate("aaabbbccc")], "id long, g string, score double")
    assert sorted(r["count"] for r in search.balanced(rows, "g", 5, ["a", "b", "c"]).groupBy("g").count().collect()) == [1, 2, 2]
    reports = spark.createDataFrame([("10-K", "2024", "FY"), ("10-Q", "2024", "3"), ("10-Q", "2025", "1")], "form_type string, fiscal_year string, fiscal_quarter string").withColumn("t", F.lit("A"))
    assert [r.report for r in search.last_reports(reports, 3, ["t"]).orderBy(F.desc("report")).collect()] == [20251, 20245, 20243]


def test_quarter_filter_with_or_without_q(spark):
    df = spark.createDataFrame([("3",), ("1",)], "fiscal_quarter string")
    assert df.filter(search.where({"fiscal_quarter": "Q3"}, df.columns)).count() == 1
    assert df.filter(search.where({"fiscal_quarter": ["q3", "1"]}, df.columns)).count() == 2


def test_expansion(spark):
    rows = spark.createDataFrame([("share repurchase plan",), ("zzz",), ("revenue growth margin demand",), ("AI and free cash flow",), (None,)], "q string")
    out = {r.q: r for r in rows.select("q", search.expanded(F.col("q")).alias("e"), search.expansion(F.col("q"), 2, None).alias("x"), search.with_narrative(F.col("q")).alias("n")).collect()}
    assert out["zzz"].e == "zzz" == out["zzz"].n and out[None].e is None
    assert out["share repurchase plan"].x == ["buy back", "buyback", "market position"]
    assert out["AI and free cash flow"].x == ["artificial intelligence", "free cash flow", "machine learning", "operating cash flow"]
    assert len(out["revenue growth margin demand"].e.split(" ")) <= 4 + 6 * 3 and out["revenue growth margin demand"].n.endswith("performance factors")
    found = {(r.query, r.word, r.term) for r in search.suggestions(rows.withColumnRenamed("q", "query")).collect()}
    assert ("revenue growth margin demand", "margin", "margin") in found and ("revenue growth margin demand", "growth", "expansion") in found and not any(q == "zzz" for q, _, _ in found)


def test_periods_are_pairs(spark):
    from tallyframe.functions import asked

    df = spark.createDataFrame([(str(y), f"{p}{q}") for y in (2021, 2022) for q in (1, 2, 3) for p in ("", "Q")], "fiscal_year string, fiscal_quarter string")
    assert df.filter(search.where(search.periods_of(["Q1 2021", "2 2022"]), df.columns)).distinct().count() == 4
    assert df.filter(search.where(search.periods_of(["Q1", "3"]), df.columns)).distinct().count() == 4  # in a column without Q
    found = asked.filters_of("risk in the first quarter and Q3 of 2021")
    assert {(r.fiscal_year, r.fiscal_quarter) for r in df.filter(search.where({k: v for k, v in found.items() if k != "section_name"}, df.columns)).collect()} == {("2021", "1"), ("2021", "Q1"), ("2021", "3"), ("2021", "Q3")}


# news, usage ------------------------------------------------------------------------------------------------------
def test_sentiment(spark):
    rows = [("c", s) for s in ["positive"] * 4 + ["negative"] + ["neutral"] * 5]
    assert news.sentiment(spark.createDataFrame(rows, "company string, sentiment string"), ["company"]).first().sentiment == "neutral"
    assert news.sentiment(spark.createDataFrame([*rows, ("c", "positive")], "company string, sentiment string"), ["company"]).first().sentiment == "positive"


def test_cost(spark):
    df = spark.createDataFrame([("r", "m", 1_000_000, 500_000), ("r", "x", 5, 5)], "run_id string, model_id string, input_tokens long, output_tokens long")
    assert usage.rollup(df, {"m": (3.0, 15.0)}, "run_id").first().cost == 10.5


def test_trend_is_by_date(spark):
    rows = [(1, D(d), v) for d, v in (("2022-12-31", 100.0), ("2025-03-31", 120.0), ("2024-12-31", 90.0))]
    assert usage.trend(spark.createDataFrame(rows, "cik long, d date, v double"), ["cik"], "d", "v").first().trend == "improving"


def test_numbers_in_cells(spark):
    df = spark.createDataFrame([("$1,234.5",), ("n/a",), (None,), ("-7%",)], "t string")
    assert [r[0] for r in df.select(tx.number_in(F.col("t"))).collect()] == [1234.5, None, None, -7.0]


def test_cleaned_calls(spark):
    df = spark.createDataFrame([("Hello  [AUDIO CUT] there.Next (laughs) one :  yes ..... well ---- \u201cfine\u201d",)], "t string")
    assert df.select(transcripts.cleaned(F.col("t"))).first()[0] == "Hello  there. Next  one: yes ... well -- \"fine\""


def test_parsed_speakers(spark):
    df = spark.createDataFrame([(1, "Noise first\nJane Doe: Good morning.\nAnd more.\n\nOperator: Next."), (2, "")], "call int, text string")
    rows = transcripts.parsed(df, "call", "text").orderBy("seq").collect()
    assert [(r.speaker, r.content) for r in rows] == [("Unknown", "Noise first"), ("Jane Doe", "Good morning."), ("Jane Doe", "And more."), ("Operator", "Next.")]

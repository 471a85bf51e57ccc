"""Catalogs: tags, virtual fields, ratios."""

from __future__ import annotations

#: The column that each tag is filed for. Tags that are filed for columns that no table has go to the columns that hold the same.
TAGS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "total_revenue",
    "SalesRevenueNet": "total_revenue",
    "Revenues": "total_revenue",
    "CostOfGoodsAndServicesSold": "cost_of_revenue",
    "CostOfRevenue": "cost_of_revenue",
    "GrossProfit": "gross_profit",
    "ResearchAndDevelopmentExpense": "research_and_development",
    "SellingGeneralAndAdministrativeExpense": "sales_general_and_admin",
    "SellingAndMarketingExpense": "sales_and_marketing",
    "GeneralAndAdministrativeExpense": "general_and_administrative",
    "OperatingExpenses": "total_operating_expenses",
    "OperatingIncomeLoss": "operating_income",
    "InvestmentIncomeInterestAndDividend": "interest_income",
    "InvestmentIncomeNet": "interest_income",
    "InterestExpense": "interest_expense",
    "NonoperatingIncomeExpense": "other_income",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest": "income_before_taxes",
    "IncomeTaxExpenseBenefit": "income_tax_expense",
    "NetIncomeLoss": "net_income",
    "NetIncomeLossAvailableToCommonStockholdersBasic": "net_income",
    "EarningsPerShareBasic": "earnings_per_share_basic",
    "EarningsPerShareDiluted": "earnings_per_share_diluted",
    "WeightedAverageNumberOfSharesOutstandingBasic": "weighted_average_shares_basic",
    "WeightedAverageNumberOfDilutedSharesOutstanding": "weighted_average_shares_diluted",
    "CashAndCashEquivalentsAtCarryingValue": "cash_and_cash_equivalents",
    "MarketableSecuritiesCurrent": "short_term_investments",
    "CashCashEquivalentsAndShortTermInvestments": "cash_and_short_term_investments",
    "AccountsReceivableNetCurrent": "accounts_receivable",
    "AccountsAndOtherReceivablesNetCurrent": "accounts_receivable",
    "ReceivablesNetCurrent": "accounts_receivable",
    "InventoryNet": "inventory",
    "AssetsCurrent": "total_current_assets",
    "PropertyPlantAndEquipmentNet": "property_plant_equipment",
    "Goodwill": "goodwill",
    "IntangibleAssetsNetExcludingGoodwill": "intangible_assets",
    "OtherAssetsNoncurrent": "other_assets",
    "AssetsNoncurrent": "total_non_current_assets",
    "Assets": "total_assets",
    "AccountsPayableCurrent": "accounts_payable",
    "AccruedLiabilitiesCurrent": "accrued_liabilities",
    "CommercialPaper": "commercial_paper",
    "OtherShortTermBorrowings": "other_short_term_borrowings",
    "LongTermDebtCurrent": "current_portion_long_term_debt",
    "LongTermDebtAndCapitalLeaseObligationsCurrent": "current_portion_long_term_debt",
    "FinanceLeaseLiabilityCurrent": "finance_lease_liability_current",
    "OperatingLeaseLiabilityCurrent": "operating_lease_liability_current",
    "LiabilitiesCurrent": "total_current_liabilities",
    "LongTermDebtNoncurrent": "non_current_long_term_debt",
    "LongTermDebtAndCapitalLeaseObligations": "non_current_long_term_debt",
    "DebtInstrumentCarryingAmount": "long_term_debt",
    "LongTermDebt": "long_term_debt",
    "FinanceLeaseLiabilityNonCurrent": "finance_lease_liability_noncurrent",
    "OperatingLeaseLiabilityNoncurrent": "operating_lease_liability_noncurrent",
    "OtherLiabilitiesNoncurrent": "other_long_term_liabilities",
    "LiabilitiesNonCurrent": "total_non_current_liabilities",
    "Liabilities": "total_liabilities",
    "CommonStockValue": "common_stock",
    "RetainedEarningsAccumulatedDeficit": "retained_earnings",
    "AccumulatedOtherComprehensiveIncomeLossNetOfTax": "accumulated_oci",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "total_stockholders_equity",
    "StockholdersEquity": "total_stockholders_equity",
    "LiabilitiesAndStockholdersEquity": "total_liabilities_and_equity",
    "DepreciationDepletionAndAmortization": "depreciation_and_amortization",
    "DepreciationAndAmortization": "depreciation_and_amortization",
    "DepreciationAmortizationAndAccretionNet": "depreciation_and_amortization",
    "Depreciation": "depreciation",
    "AmortizationOfIntangibleAssets": "amortization",
    "ShareBasedCompensation": "stock_based_compensation",
    "IncreaseDecreaseInAccountsReceivable": "changes_in_accounts_receivable",
    "IncreaseDecreaseInAccountsAndOtherReceivables": "changes_in_accounts_receivable",
    "IncreaseDecreaseInOtherReceivables": "changes_in_other_receivable",
    "IncreaseDecreaseInInventories": "changes_in_inventory",
    "IncreaseDecreaseInAccountsPayable": "changes_in_accounts_payable",
    "IncreaseDecreaseInAccountsPayableAndAccruedLiabilities": "changes_in_accounts_payable",
    "IncreaseDecreaseInOtherOperatingAssets": "changes_in_other_operating_assets",
    "IncreaseDecreaseInOtherOperatingLiabilities": "changes_in_other_operating_liabilities",
    "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations": "net_cash_from_operating_activities",
    "NetCashProvidedByUsedInOperatingActivities": "net_cash_from_operating_activities",
    "PaymentsToAcquirePropertyPlantAndEquipment": "capital_expenditures",
    "PaymentsToAcquireIntangibleAssets": "purchases_of_intangible_assets",
    "PaymentsToAcquireInvestments": "investments_purchased",
    "ProceedsFromSaleMaturityAndCollectionsOfInvestments": "investments_sold",
    "PaymentsToAcquireBusinessesNetOfCashAcquired": "acquisitions",
    "ProceedsFromDivestitureOfBusinesses": "divestitures",
    "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations": "net_cash_from_investing_activities",
    "NetCashProvidedByUsedInInvestingActivities": "net_cash_from_investing_activities",
    "ProceedsFromIssuanceOfLongTermDebt": "debt_issued",
    "RepaymentsOfLongTermDebt": "debt_repaid",
    "RepaymentsOfOtherShortTermDebt": "debt_repaid",
    "ProceedsFromRepaymentsOfCommercialPaper": "debt_repaid",
    "PaymentsOfDividendsCommonStock": "dividends_paid",
    "PaymentsOfDividends": "dividends_paid",
    "PaymentsForRepurchaseOfCommonStock": "share_repurchases",
    "ProceedsFromIssuanceOfCommonStock": "proceeds_from_stock_issuance",
    "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations": "net_cash_from_financing_activities",
    "NetCashProvidedByUsedInFinancingActivities": "net_cash_from_financing_activities",
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect": "net_change_in_cash",
}

#: Columns computed from tags where no tag is filed for them, (operation, tags), in order of preference.
COMPUTED = {
    "property_plant_equipment": [
        ("subtract", ["PropertyPlantAndEquipmentGross", "AccumulatedDepreciationDepletionAndAmortizationPropertyPlantAndEquipment"]),
        ("subtract", ["PropertyPlantAndEquipmentGross", "AccumulatedDepreciation"]),
        ("subtract", ["PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization", "OperatingLeaseRightOfUseAsset"]),
    ],
    "gross_profit": [("subtract", ["Revenues", "CostOfRevenue"]), ("subtract", ["RevenueFromContractWithCustomerExcludingAssessedTax", "CostOfGoodsAndServicesSold"])],
    "total_operating_expenses": [("add", ["ResearchAndDevelopmentExpense", "SellingGeneralAndAdministrativeExpense"])],
    "long_term_investments": [("add", ["MarketableSecuritiesNoncurrent", "EquityMethodInvestments", "OtherLongTermInvestments"])],
    "depreciation_and_amortization": [("add", ["Depreciation", "AmortizationOfIntangibleAssets"]), ("add", ["Depreciation"])],
    "operating_income": [
        ("subtract", ["GrossProfit", "OperatingExpenses"]),
        ("subtract", ["Revenues", "CostOfRevenue", "OperatingExpenses"]),
        ("subtract", ["Revenues", "CostOfGoodsAndServicesSold", "OperatingExpenses"]),
    ],
    "net_income": [("subtract", ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeTaxExpenseBenefit"])],
    "cash_and_short_term_investments": [("add", ["CashAndCashEquivalentsAtCarryingValue", "MarketableSecuritiesCurrent"])],
    "long_term_debt": [("add", ["LongTermDebtAndCapitalLeaseObligations", "LongTermDebtAndCapitalLeaseObligationsCurrent"])],
}

UNITS = ["USD", "shares", "pure", "USD/shares"]
TAX_RATE = 0.26

#: Virtual fields, formulas in order of preference.
VIRTUAL = {
    "cogs": ["cost_of_revenue", "total_revenue - gross_profit"],
    "gp": ["gross_profit", "total_revenue - cogs"],
    "sga_expense": ["sales_general_and_admin", "sales_and_marketing + COALESCE(general_and_administrative, 0)", "sales_and_marketing", "general_and_administrative"],
    "total_op_expense": ["total_operating_expenses + cogs", "total_revenue - operating_income", "cost_of_revenue + COALESCE(sga_expense, 0) + COALESCE(research_and_development, 0)"],
    "net_interest_expense": ["COALESCE(interest_expense, 0) - COALESCE(interest_income, 0)"],
    "d&a": ["depreciation_and_amortization", "COALESCE(depreciation, 0) + COALESCE(amortization, 0)"],
    "ebitda": ["total_revenue - total_op_expense + d&a", "total_revenue - total_op_expense"],
    "ebit": ["total_revenue - total_op_expense"],
    "pbt": ["total_revenue - total_op_expense + COALESCE(other_income, 0) + COALESCE(interest_income, 0) - COALESCE(interest_expense, 0)"],
    "cash_and_st_investments": ["cash_and_cash_equivalents + COALESCE(short_term_investments, 0)", "cash_and_short_term_investments"],
    "cash_and_st_investments_and_lt_investments": ["cash_and_cash_equivalents + COALESCE(short_term_investments, 0) + COALESCE(long_term_investments, 0)"],
    "non_current_assets": ["total_non_current_assets", "total_assets - COALESCE(total_current_assets, 0)"],
    "total_long_term_debt": [
        "long_term_debt + COALESCE(finance_lease_liability_noncurrent, 0)",
        "COALESCE(non_current_long_term_debt, 0) + COALESCE(current_portion_long_term_debt, 0) + COALESCE(finance_lease_liability_noncurrent, 0)",
    ],
    "total_debt": ["total_long_term_debt + COALESCE(commercial_paper, 0) + COALESCE(other_short_term_borrowings, 0) + COALESCE(finance_lease_liability_current, 0) + COALESCE(finance_lease_liability_noncurrent, 0)"],
    "total_debt_incl_oper_lease": ["total_debt + COALESCE(operating_lease_liability_current, 0) + COALESCE(operating_lease_liability_noncurrent, 0)"],
    "working_capital": ["total_current_assets - total_current_liabilities"],
    "net_working_capital": ["working_capital - cash_and_st_investments"],
    "free_cash_flow": ["net_cash_from_operating_activities - capital_expenditures"],
    "net_acquisitions": ["COALESCE(acquisitions, 0) - COALESCE(divestitures, 0)"],
    "net_repurchases": ["COALESCE(share_repurchases, 0) - COALESCE(proceeds_from_stock_issuance, 0)"],
    "interest_bearing_debt": ["total_debt_incl_oper_lease"],
    "invested_capital": ["total_stockholders_equity + total_debt"],
    "net_invested_capital": ["total_stockholders_equity + total_debt - cash_and_st_investments"],
    "book_value": ["total_stockholders_equity"],
    "tangible_book_value": ["total_stockholders_equity - COALESCE(goodwill, 0) - COALESCE(intangible_assets, 0)"],
}

#: Ratio, category, formula.
RATIOS = [
    ("ROE", "profitability", "net_income / total_stockholders_equity"),
    ("ROA", "profitability", f"(ebit * (1 - {TAX_RATE})) / total_assets"),
    ("ROIC", "profitability", f"(ebit * (1 - {TAX_RATE})) / invested_capital"),
    ("Net_ROIC", "profitability", f"(ebit * (1 - {TAX_RATE})) / net_invested_capital"),
    ("Net_Margin", "profitability", "net_income / total_revenue"),
    ("EBIT_Margin", "profitability", "ebit / total_revenue"),
    ("EBITDA_Margin", "profitability", "ebitda / total_revenue"),
    ("Gross_Margin", "profitability", "gp / total_revenue"),
    ("SGA_Margin", "profitability", "sga_expense / total_revenue"),
    ("NOPAT_Margin", "profitability", f"(ebit * (1 - {TAX_RATE})) / total_revenue"),
    ("Current_Ratio", "liquidity", "total_current_assets / total_current_liabilities"),
    ("Quick_Ratio", "liquidity", "(cash_and_st_investments + accounts_receivable) / total_current_liabilities"),
    ("Cash_Ratio", "liquidity", "(cash_and_st_investments) / total_current_liabilities"),
    ("Cash_OpEx_Ratio", "liquidity", "(cash_and_st_investments) / total_op_expense"),
    ("Cash_EBITDA_Ratio", "liquidity", "(cash_and_st_investments) / ebitda"),
    ("Cash_Sales_Ratio", "liquidity", "(cash_and_st_investments) / total_revenue"),
    ("Debt_to_EBITDA", "leverage", "total_debt / ebitda"),
    ("Net_Debt_to_EBITDA", "leverage", "(total_debt - cash_and_st_investments) / ebitda"),
    ("Debt_to_Equity", "leverage", "total_debt / total_stockholders_equity"),
    ("Debt_to_Assets", "leverage", "total_debt / total_assets"),
    ("Equity_Ratio", "leverage", "total_stockholders_equity / total_assets"),
    ("EBIT_Interest_Coverage", "leverage", "ebit / net_interest_expense"),
    ("EBITDA_Interest_Coverage", "leverage", "ebitda / net_interest_expense"),
    ("Asset_Turnover", "efficiency", "total_revenue / total_assets"),
    ("Invested_Capital_Turnover", "efficiency", "total_revenue / invested_capital"),
    ("Fixed_Asset_Turnover", "efficiency", "total_revenue / property_plant_equipment"),
    ("Inventory_Turnover", "efficiency", "cogs / inventory"),
    ("Receivables_Turnover", "efficiency", "total_revenue / accounts_receivable"),
    ("Operating_Cash_Margin", "cash_flow", "net_cash_from_operating_activities / total_revenue"),
    ("Free_Cash_Flow_Margin", "cash_flow", "free_cash_flow / total_revenue"),
    ("Cash_Return_on_Assets", "cash_flow", "net_cash_from_operating_activities / total_assets"),
    ("Revenue_Growth_YoY", "growth", "YOY_GROWTH(total_revenue)"),
    ("EBITDA_Growth_YoY", "growth", "YOY_GROWTH(ebitda)"),
]

#: Other names by which ratios are asked for, by category.
ASKED_RATIOS = {
    "liquidity": "current_ratio quick_ratio cash_ratio working_capital_ratio".split(),
    "leverage": "debt_to_equity debt_to_assets interest_coverage_ratio debt_service_coverage equity_ratio financial_leverage".split(),
    "efficiency": "working_capital_turnover asset_turnover receivables_turnover inventory_turnover days_sales_outstanding days_inventory_outstanding days_payable_outstanding cash_conversion_cycle".split(),
    "profitability": "gross_margin operating_margin ebitda_margin net_margin return_on_equity return_on_assets return_on_invested_capital".split(),
    "growth": "revenue_growth earnings_growth asset_growth".split(),
    "valuation": "price_to_earnings price_to_book ev_to_ebitda price_to_sales peg_ratio ev_to_sales price_to_free_cash_flow".split(),
}
#: Parts of an unknown ratio's name that tell its category, the first list with a match deciding; else it is the last.
CATEGORY_WORDS = {
    "liquidity": "liquid current quick".split(),
    "leverage": "debt leverage coverage".split(),
    "efficiency": "turnover days efficiency".split(),
    "profitability": "margin return profit".split(),
    "growth": ["growth"],
    "valuation": "price ev valuation".split(),
}
OTHER_CATEGORY = "profitability"

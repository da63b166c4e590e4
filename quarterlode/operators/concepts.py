"""Statement concepts by field, in order of preference, and what belongs to them."""

# Fixed values. Priority of a fact's namespace.
NAMESPACES = {"us-gaap": 20, "ifrs-full": 18}

# Fixed values. Forms whose facts count.
FORMS = ("10-Q", "10-K", "20-F", "6-K", "8-K")

# Fixed values. Concept names of each statement field, the preferred one first.
CONCEPTS = {
    "revenue": (
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "RevenueFromContractsWithCustomers",
        "RevenuesNetOfInterestExpense",
        "NetRevenues",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
        "SalesRevenueServicesNet",
        "Revenues",
        "Revenue",
        "OperatingRevenue",
        "OperatingRevenueNet",
        "TotalRevenue",
        "NetSales",
        "InterestRevenueExpenseNet",
    ),
    "cost_of_revenue": ("CostOfRevenue", "CostOfSales", "CostOfGoodsSold", "CostOfGoodsAndServicesSold", "CostOfServices"),
    "gross_profit": ("GrossProfit",),
    "sgna": ("SellingGeneralAndAdministrativeExpense",),
    "sales_and_marketing": ("SellingAndMarketingExpense", "SalesAndMarketingExpense", "MarketingExpense"),
    "general_and_administrative": ("GeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpenseOtherThanAmortizationOfAcquiredIntangibleAssets"),
    "rnd": ("ResearchAndDevelopmentExpense",),
    "operating_expenses": ("OperatingExpenses", "OperatingExpenseExcludingCostOfSales", "NoninterestExpense", "CostsAndExpenses"),
    "operating_income": ("OperatingIncomeLoss", "ProfitLossFromOperatingActivities", "OperatingProfit"),
    "pretax_income": (
        "IncomeBeforeTaxExpenseBenefit",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "PretaxIncome",
        "ProfitLossBeforeTax",
    ),
    "tax": ("IncomeTaxExpenseBenefit", "IncomeTaxExpenseContinuingOperations", "IncomeTaxes", "CurrentTaxExpenseIncomeAndAdjustmentsForCurrentTaxOfPriorPeriods"),
    "net_income": ("NetIncomeLoss", "ProfitLoss", "ProfitLossAttributableToOwnersOfParent"),
}

CURRENCY_FIELDS = ("revenue", "net_income", "pretax_income", "operating_income")
STATEMENT_FIELDS = ("revenue", "cost_of_revenue", "gross_profit", "sgna", "rnd", "other_opex", "operating_expenses", "operating_income", "non_operating", "pretax_income", "tax", "net_income")

# Fixed values. Expense categories: number, id, kind, exact concept names, patterns of concept names.
BREAKDOWN_RULES = (
    (1, "costProducts", "cost", ("CostOfGoodsSold", "CostOfProductRevenue", "CostOfProductSales", "CostOfProductsSold"), (r"costof(products?|goods)(sold|sales|revenue)?", r"product(s)?(revenue)?cost")),
    (2, "costServices", "cost", ("CostOfServiceRevenue", "CostOfServiceSales", "CostOfServices", "CostOfServicesSold"), (r"costofservice(s)?(sold|sales|revenue)?", r"service(s)?(revenue)?cost")),
    (3, "trafficAcquisitionCost", "cost", ("TrafficAcquisitionCosts",), (r"traffic.*acquisition.*cost", r"\btac\b")),
    (4, "fulfillment", "opex", ("FulfillmentExpense",), (r"fulfillment.*expense",)),
    (5, "technologyAndContent", "opex", (), (r"technology.*content.*expense", r"content.*technology.*expense")),
    (6, "salesAndMarketing", "opex", ("SalesAndMarketingExpense", "SellingAndMarketingExpense"), (r"salesandmarketingexpense", r"sellingandmarketingexpense")),
    (7, "marketingAdvertising", "opex", ("AdvertisingExpense", "MarketingAndAdvertisingExpense", "MarketingExpense"), (r"marketing.*advertising.*expense", r"advertising.*expense", r"marketing.*expense")),
    (8, "generalAndAdministrative", "opex", ("GeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpenseOtherThanAmortizationOfAcquiredIntangibleAssets"), (r"generalandadministrativeexpense", r"administrative.*expense")),
    (9, "rnd", "opex", ("ResearchAndDevelopmentExpense",), (r"researchanddevelopmentexpense", r"research.*development.*expense")),
    (10, "restructuring", "opex", (), (r"restructuring.*(charge|expense|cost)",)),
    (11, "impairment", "opex", (), (r"impairment.*(charge|expense|loss)",)),
)

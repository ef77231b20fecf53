"""Schemas of the JSON text columns.

Leaves are text: a quoted number ("12.5") read as double would become NULL, so numbers are cast after parsing.
Parsing once into a struct replaces dozens of path extractions on the same text.
"""

# --- Fixed values: field names of the JSON documents as the producing services write them. ----------------------
_STEP_UP_AMOUNTS = "additionalCommissions: STRUCT<stepUpCommission: STRING, stepUpGKCommission: STRING>"
_STEP_UP_RATES = "additionalCommissionRates: STRUCT<stepUpCommissionRate: STRING, stepUpGKCommissionRate: STRING>"

_QUOTE = (
    "STRUCT<priceInMinorUnit: STRING, priceExcludeTaxInMinorUnit: STRING, inclTaxInMin: STRING,"
    " mexCommission: STRING, gkCommission: STRING, reducedPriceInMinorUnit: STRING, promoAmountInMinorUnit: STRING,"
    f" {_STEP_UP_AMOUNTS}>"
)
_MERCHANT_INFO = (
    "STRUCT<commission: STRING, gkCommissionRate: STRING, taxRate: STRING, specialMerchantType: STRING,"
    f" merchantClusterID: STRING, qsrCode: STRING, {_STEP_UP_RATES}>"
)
SUB_MERCHANT = f"STRUCT<merchantID: STRING, subFoodQuoteInMin: {_QUOTE}, merchantInfoObj: {_MERCHANT_INFO}>"


def order_document(with_sub_merchants: bool) -> str:
    """Order snapshot document. Sub-merchants are the bulk of the text: leave them to the parser's skip when unused."""
    subs = f", subMerchants: ARRAY<{SUB_MERCHANT}>" if with_sub_merchants else ""
    return (
        "newTaxFlow STRING, deliveryOption STRING, currency STRUCT<exponent: STRING>,"
        " cartWithQuote STRUCT<"
        "discounts: ARRAY<STRUCT<mexFundedAmountInMin: STRING, mexFundedAmountExcludeTaxInMin: STRING>>,"
        " promoCodes: ARRAY<STRUCT<promoCode: STRING, promoAmountInMin: STRING>>,"
        f" foodQuoteInMin: {_QUOTE},"
        " totalQuoteInMin: STRUCT<mexCommission: STRING, gkCommission: STRING>,"
        f" merchantCartWithQuoteList: ARRAY<STRUCT<merchantInfoObj: {_MERCHANT_INFO}{subs}>>"
        ">"
    )


ORDER_DOCUMENT = order_document(with_sub_merchants=True)
ORDER_DOCUMENT_WHOLE = order_document(with_sub_merchants=False)
EARLY_ORDER_DOCUMENT = (
    "newTaxFlow STRING, cartWithQuote STRUCT<foodQuoteInMin: STRUCT<priceInMinorUnit: STRING, inclTaxInMin: STRING>,"
    " totalQuoteInMin: STRUCT<mexCommission: STRING>>"
)
ORDER_METADATA = "partnerOrderSubmitTime STRING, qsrCode STRING, FPTAcceptedBy STRING, payMerchant STRING"
CASHIER_DRIVER_METADATA = "daxDeliveryFee STRING, promotion STRING"
CASHIER_MERCHANT_METADATA = (
    "netEarning STRING, orderValue STRING, taxes STRING, exDeliveryFee STRING, mexFundCampaign STRING,"
    " mexFundPromo STRING, GKCommission STRING, mexCommission STRING, mexStepUpGKCommission STRING,"
    " mexStepUpCommission STRING, deliveryCharge STRING"
)
CASE_TICKET_STATE = "stateData STRUCT<Issue: STRING>"
CASE_POLICY_STATE = (
    "stateData STRUCT<RefundEntities: ARRAY<STRUCT<name: STRING, ID: STRING, quantity: STRING, menuType: STRING,"
    " singleReducedPrice: STRING>>>"
)
REFUND_ITEMS = (
    "ARRAY<STRUCT<ItemName: STRING, ItemID: STRING, ItemPriceInMinorUnits: STRING, ItemQuantity: STRING,"
    " TotalItemPriceInMinorUnits: STRING, TotalRefundPriceInMinorUnits: STRING,"
    " RefundSubItems: ARRAY<STRUCT<itemName: STRING, itemID: STRING, itemPriceInMinorUnits: STRING,"
    " itemQuantity: STRING, totalItemPriceInMinorUnits: STRING, totalRefundPriceInMinorUnits: STRING>>>>"
)
# ---------------------------------------------------------------------------------------------------------------

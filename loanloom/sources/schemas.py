"""Declared schemas and file names of the source tables.

Code columns are strings, money is double, days are integers; nothing is
inferred from the files.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}


def _struct(text: str) -> T.StructType:
    """``name:type`` pairs; types are l(ong), i(nt), d(ouble), s(tring)."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (pair.split(":") for pair in text.split())])


_APPLICATION = (
    "SK_ID_CURR:l NAME_CONTRACT_TYPE:s DAYS_BIRTH:d DAYS_EMPLOYED:d AMT_INCOME_TOTAL:d AMT_CREDIT:d AMT_ANNUITY:d "
    "AMT_GOODS_PRICE:d CNT_FAM_MEMBERS:d CNT_CHILDREN:d NAME_INCOME_TYPE:s NAME_EDUCATION_TYPE:s OCCUPATION_TYPE:s "
    "NAME_HOUSING_TYPE:s EXT_SOURCE_1:d EXT_SOURCE_2:d EXT_SOURCE_3:d AMT_REQ_CREDIT_BUREAU_HOUR:d "
    "AMT_REQ_CREDIT_BUREAU_DAY:d AMT_REQ_CREDIT_BUREAU_WEEK:d AMT_REQ_CREDIT_BUREAU_MON:d AMT_REQ_CREDIT_BUREAU_QRT:d "
    "AMT_REQ_CREDIT_BUREAU_YEAR:d"
)
_KEYS = "SK_ID_CURR:l SK_ID_PREV:l NUM_INSTALMENT_NUMBER:i NUM_INSTALMENT_VERSION:i"
_SNAPSHOT = "SK_ID_CURR:l SK_ID_PREV:l MONTHS_BALANCE:i DAYS_AVAILABLE:i SK_DPD:i SK_DPD_DEF:i NAME_CONTRACT_STATUS:s"

SCHEMAS = {
    "application_train": _struct(_APPLICATION + " TARGET:i"),
    "application_test": _struct(_APPLICATION),
    "bureau": _struct(
        "SK_ID_CURR:l SK_ID_BUREAU:l DAYS_CREDIT:i DAYS_AVAILABLE:i DAYS_CREDIT_UPDATE:i CREDIT_ACTIVE:s CREDIT_CURRENCY:s "
        "CREDIT_DAY_OVERDUE:i AMT_CREDIT_SUM:d AMT_CREDIT_SUM_DEBT:d AMT_CREDIT_SUM_OVERDUE:d"
    ),
    "bureau_balance": _struct("SK_ID_BUREAU:l MONTHS_BALANCE:i DAYS_AVAILABLE:i STATUS:s"),
    "previous_application": _struct(
        "SK_ID_CURR:l SK_ID_PREV:l DAYS_DECISION:i DAYS_AVAILABLE:i NAME_CONTRACT_STATUS:s AMT_APPLICATION:d AMT_CREDIT:d"
    ),
    "installments_payments": _struct(
        _KEYS + " PAYMENT_ID:s DAYS_ENTRY_PAYMENT:i AMT_PAYMENT:d DAYS_AVAILABLE:i DAYS_INSTALMENT:i AMT_INSTALMENT:d"
    ),
    "installment_schedule": _struct(_KEYS + " DAYS_INSTALMENT:i AMT_INSTALMENT:d DAYS_AVAILABLE:i"),
    "pos_cash_balance": _struct(_SNAPSHOT),
    "credit_card_balance": _struct(
        _SNAPSHOT + " AMT_BALANCE:d AMT_CREDIT_LIMIT_ACTUAL:d AMT_DRAWINGS_ATM_CURRENT:d AMT_DRAWINGS_CURRENT:d"
    ),
}

# File names under which a source may be delivered.
ALIASES = {
    "application_train": ["application_train"],
    "application_test": ["application_test"],
    "bureau": ["bureau"],
    "bureau_balance": ["bureau_balance"],
    "previous_application": ["previous_application"],
    "installments_payments": ["installments_payments", "instalments_payments"],
    "installment_schedule": ["installment_schedule"],
    "pos_cash_balance": ["POS_CASH_balance"],
    "credit_card_balance": ["credit_card_balance"],
}

# Columns without which a source cannot feed the long contract.
REQUIRED = {
    "bureau": ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "DAYS_AVAILABLE", "CREDIT_ACTIVE", "CREDIT_DAY_OVERDUE",
               "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE", "DAYS_AVAILABLE", "STATUS"],
    "previous_application": ["SK_ID_CURR", "SK_ID_PREV", "DAYS_DECISION", "DAYS_AVAILABLE", "NAME_CONTRACT_STATUS"],
    "installments_payments": ["SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "PAYMENT_ID",
                              "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", "DAYS_AVAILABLE"],
    "pos_cash_balance": ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "DAYS_AVAILABLE", "SK_DPD", "NAME_CONTRACT_STATUS"],
    "credit_card_balance": ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "DAYS_AVAILABLE", "SK_DPD", "NAME_CONTRACT_STATUS",
                            "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"],
    "installment_schedule": ["SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT",
                             "AMT_INSTALMENT", "DAYS_AVAILABLE"],
}

# Event day of each history source, for future-row counts.
EVENT_DAY = {
    "bureau": "DAYS_CREDIT", "bureau_balance": "MONTHS_BALANCE", "previous_application": "DAYS_DECISION",
    "installments_payments": "DAYS_ENTRY_PAYMENT", "pos_cash_balance": "MONTHS_BALANCE", "credit_card_balance": "MONTHS_BALANCE",
}

"""The feature names of the long contract, per source."""

GROUPS = {
    "bureau": [
        "bureau_account_count", "bureau_active_count", "bureau_closed_count", "bureau_overdue_count",
        "bureau_total_credit", "bureau_total_debt", "bureau_total_overdue", "bureau_max_dpd",
        "bureau_oldest_account_age_days", "bureau_newest_account_age_days",
    ],
    "bureau_balance": [
        "bureau_observed_status_months", "bureau_delinquent_months", "bureau_severe_months",
        "bureau_late_month_ratio",
    ],
    "previous_application": [
        "previous_application_count", "previous_approved_count", "previous_refused_count",
        "previous_refusal_rate", "previous_applications_365d", "days_since_previous_application",
    ],
    "installments_payments": [
        "installment_due_count", "installment_fully_paid_count", "installment_late_count",
        "installment_unpaid_overdue_count", "installment_late_rate", "installment_mean_signed_delay",
        "installment_mean_overdue_days", "installment_max_overdue_days", "installment_mean_paid_ratio",
    ],
    "pos_cash_balance": [
        "pos_loan_count", "pos_active_loan_count", "pos_observed_months", "pos_max_dpd", "pos_mean_dpd",
        "pos_late_month_ratio",
    ],
    "credit_card_balance": [
        "card_account_count", "card_current_balance", "card_current_limit", "card_current_utilization",
        "card_historical_mean_utilization", "card_historical_max_utilization", "card_max_dpd",
        "card_late_month_ratio",
    ],
}
HISTORY = [name for names in GROUPS.values() for name in names]

# Sums that become zero (not null) when a confirmed-empty source has no row for an applicant.
ZERO_SUMS = (
    "bureau_total_credit", "bureau_total_debt", "bureau_total_overdue", "card_current_balance",
    "card_current_limit",
)
COUNT_SUFFIXES = ("_count", "_months", "_365d")


def zero_when_absent(name: str) -> bool:
    return name.endswith(COUNT_SUFFIXES) or name in ZERO_SUMS

"""Application snapshot: canonical projection, row contract and derived features."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.nullsafe import is_finite, is_infinite, malformed, ratio
from loanloom.operators.contracts import Rule, first_reason, require_columns

ID = "SK_ID_CURR"
LABEL = "TARGET"
PRODUCT = "Cash loans"
TENURE_UNKNOWN = 365243
DAYS_PER_YEAR = 365.25

# The canonical feature names of the short contract.
BASE_NUMERIC = [
    "age_years", "years_employed", "annual_income", "requested_amount",
    "quoted_monthly_payment", "household_size", "dependent_children",
]
CATEGORICAL = ["employment_type", "education_level", "occupation", "housing_status"]
DERIVED = [
    "employment_tenure_missing", "proposed_payment_income_ratio", "principal_income_ratio",
    "income_per_household_member", "employed_age_ratio", "payment_principal_ratio",
]
LITE = BASE_NUMERIC + CATEGORICAL + DERIVED
OPTIONAL_CATEGORIES = ("occupation", "housing_status")

# Raw source text to canonical category.
VOCABULARY = {
    "employment_type": {
        "Working": "WORKING",
        "Commercial associate": "COMMERCIAL_ASSOCIATE",
        "State servant": "STATE_SERVANT",
        "Pensioner": "PENSIONER",
        "Unemployed": "UNEMPLOYED",
        "Student": "STUDENT",
        "Businessman": "BUSINESSMAN",
        "Maternity leave": "MATERNITY_LEAVE",
    },
    "education_level": {
        "Lower secondary": "LOWER_SECONDARY",
        "Secondary / secondary special": "SECONDARY",
        "Incomplete higher": "INCOMPLETE_HIGHER",
        "Higher education": "HIGHER",
        "Academic degree": "ACADEMIC_DEGREE",
    },
    "occupation": {
        "Laborers": "LABORER",
        "Core staff": "CORE_STAFF",
        "Accountants": "ACCOUNTANT",
        "Managers": "MANAGER",
        "Drivers": "DRIVER",
        "Sales staff": "SALES",
        "Cleaning staff": "CLEANING",
        "Cooking staff": "COOKING",
        "Private service staff": "PRIVATE_SERVICE",
        "Medicine staff": "MEDICAL",
        "Security staff": "SECURITY",
        "High skill tech staff": "HIGH_TECH",
        "Waiters/barmen staff": "WAITING_BAR",
        "Low-skill Laborers": "LOW_SKILL_LABOR",
        "Realty agents": "REALTY_AGENT",
        "Secretaries": "SECRETARY",
        "IT staff": "IT",
        "HR staff": "HR",
    },
    "housing_status": {
        "House / apartment": "OWN_OR_APARTMENT",
        "With parents": "WITH_PARENTS",
        "Rented apartment": "RENTED",
        "Municipal apartment": "MUNICIPAL",
        "Office apartment": "OFFICE",
        "Co-op apartment": "COOPERATIVE",
    },
}

# Source columns of the application table.
SOURCE_COLUMNS = {
    "age_years": "DAYS_BIRTH",
    "years_employed": "DAYS_EMPLOYED",
    "annual_income": "AMT_INCOME_TOTAL",
    "requested_amount": "AMT_CREDIT",
    "quoted_monthly_payment": "AMT_ANNUITY",
    "household_size": "CNT_FAM_MEMBERS",
    "dependent_children": "CNT_CHILDREN",
    "employment_type": "NAME_INCOME_TYPE",
    "education_level": "NAME_EDUCATION_TYPE",
    "occupation": "OCCUPATION_TYPE",
    "housing_status": "NAME_HOUSING_TYPE",
}
INQUIRY_WINDOWS = [f"AMT_REQ_CREDIT_BUREAU_{w}" for w in ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR")]
EXTERNAL_SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXTERNAL_FEATURES = [*EXTERNAL_SCORES, *[f"{s.lower()}_missing" for s in EXTERNAL_SCORES]]


def categories(feature: str) -> list[str]:
    """Closed list of canonical values of a categorical feature."""
    extra = ["OTHER"] + (["MISSING"] if feature in OPTIONAL_CATEGORIES else [])
    return sorted(set(VOCABULARY[feature].values()) | set(extra))


def canonical_category(raw: Column, mapping: dict[str, str], null_as: str | None = None) -> Column:
    """Literal map lookup: unmapped text is OTHER, null keeps its own meaning."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in mapping.items())
    looked_up = F.coalesce(F.element_at(F.expr(f"map({pairs})"), raw), F.lit("OTHER"))
    return F.when(raw.isNotNull(), looked_up).otherwise(F.lit(null_as).cast("string"))


def canonical_columns(raw: DataFrame) -> dict[str, Column]:
    """Raw application columns to canonical ones; unreadable tenure becomes -1 so it is rejected."""
    present = set(raw.columns)
    out: dict[str, Column] = {}
    for feature in BASE_NUMERIC:
        out[feature] = F.col(SOURCE_COLUMNS[feature]).try_cast("double")
    out["age_years"] = -out["age_years"] / DAYS_PER_YEAR
    tenure = F.col(SOURCE_COLUMNS["years_employed"])
    known_tenure = F.nullif(tenure.try_cast("double"), F.lit(float(TENURE_UNKNOWN)))
    out["years_employed"] = F.when(malformed(tenure), F.lit(-1.0)).otherwise(-known_tenure / DAYS_PER_YEAR)
    for feature in CATEGORICAL:
        source = SOURCE_COLUMNS[feature]
        value = F.col(source) if source in present else F.lit(None).cast("string")
        null_as = "MISSING" if feature in OPTIONAL_CATEGORIES else None
        out[feature] = canonical_category(value, VOCABULARY[feature], null_as)
    return out


def derived_columns() -> dict[str, Column]:
    c = F.col
    return {
        "employment_tenure_missing": c("years_employed").isNull().cast("int"),
        "proposed_payment_income_ratio": ratio(c("quoted_monthly_payment"), c("annual_income") / 12),
        "principal_income_ratio": ratio(c("requested_amount"), c("annual_income")),
        "income_per_household_member": ratio(c("annual_income"), c("household_size")),
        "employed_age_ratio": ratio(c("years_employed"), c("age_years")),
        "payment_principal_ratio": ratio(c("quoted_monthly_payment"), c("requested_amount")),
    }


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_columns())


def lite_rules(*, mapped: bool = False) -> list[Rule]:
    """Rules on canonical columns in the order in which a row is rejected.

    ``mapped`` says that categories come from the vocabulary mapping, where only
    a null of a required category can still be wrong.
    """
    c = F.col
    rules = []
    for name in BASE_NUMERIC:
        bad = is_infinite(c(name)) if name == "years_employed" else ~is_finite(c(name))
        rules.append(Rule(f"Non-finite or missing: {name}", bad))
    rules.append(Rule("age_years must be >=18", c("age_years") < 18))
    rules.append(
        Rule(
            "Employment tenure must be between zero and age, or null",
            (c("years_employed") < 0) | (c("years_employed") > c("age_years")),
        )
    )
    for name in ("annual_income", "requested_amount", "quoted_monthly_payment"):
        rules.append(Rule(f"{name} must be positive", c(name) <= 0))
    for name, minimum in (("household_size", 1), ("dependent_children", 0)):
        rules.append(Rule(f"{name} must be an integer >= {minimum}", (c(name) < minimum) | (c(name) % 1 != 0)))
    rules.append(
        Rule("dependent_children exceeds household_size-1", c("dependent_children") > c("household_size") - 1)
    )
    for name in CATEGORICAL:
        if mapped and name in OPTIONAL_CATEGORIES:
            continue
        known = c(name).isNotNull() if mapped else F.coalesce(c(name).isin(categories(name)), F.lit(False))
        rules.append(Rule(f"Unsupported category in {name}; use canonical vocabulary", ~known))
    overflow = F.lit(False)
    for value in derived_columns().values():
        overflow = overflow | is_infinite(value)
    rules.append(Rule("Derived ratio overflow", overflow))
    return rules


def adapt_applications(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every input row with canonical features and a ``reason`` (null when eligible).

    One projection: no shuffle, and the first failing rule is known per row
    without re-checking batches.  ``keep`` names columns of ``raw`` to pass through.
    """
    needed = [v for k, v in SOURCE_COLUMNS.items() if k not in OPTIONAL_CATEGORIES]
    require_columns(raw, [ID, "NAME_CONTRACT_TYPE", *needed], "application")
    passthrough = [n for n in (LABEL, "IS_TRAIN") if n in raw.columns] + list(keep)
    unreadable = F.coalesce(
        *[
            F.when(malformed(F.col(SOURCE_COLUMNS[f])), F.lit(f"Invalid numeric field: {f}"))
            for f in BASE_NUMERIC
            if f not in ("age_years", "years_employed")
        ]
    )
    canonical = raw.select(
        ID,
        *passthrough,
        F.coalesce(F.col("NAME_CONTRACT_TYPE") == PRODUCT, F.lit(False)).alias("_eligible"),
        unreadable.alias("_unreadable"),
        *[v.alias(k) for k, v in canonical_columns(raw).items()],
    )
    reason = (
        F.when(~F.col("_eligible"), F.lit("unsupported_product"))
        .when(F.col("_unreadable").isNotNull(), F.col("_unreadable"))
        .otherwise(first_reason(lite_rules(mapped=True)))
    )
    return add_derived(canonical.withColumn("reason", reason)).drop("_eligible", "_unreadable")


def eligible_features(raw: DataFrame) -> DataFrame:
    adapted = adapt_applications(raw).where(F.col("reason").isNull())
    keep = [c for c in (ID, LABEL, "IS_TRAIN") if c in adapted.columns]
    return adapted.select(*keep, *LITE)


def exclusions(raw: DataFrame) -> DataFrame:
    return adapt_applications(raw).where(F.col("reason").isNotNull()).select(F.col(ID).alias("id"), "reason")


def exclusion_counts(raw: DataFrame) -> DataFrame:
    return exclusions(raw).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def derived_mismatch(df: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> Column:
    """Reason naming the first derived feature that disagrees with its definition."""
    rules = []
    for name, expected in derived_columns().items():
        stored = F.col(name).cast("double")
        target = expected.cast("double")
        both_null = stored.isNull() & target.isNull()
        close = F.coalesce(F.abs(stored - target) <= atol + rtol * F.abs(target), F.lit(False))
        rules.append(Rule(f"Derived feature mismatch: {name}", ~(both_null | close)))
    return first_reason(rules)


def history_rules(names: list[str]) -> list[Rule]:
    """Value rules of the long contract, generated from the feature names."""
    rules = []
    for name in names:
        value = F.col(name).cast("double")
        rules.append(Rule(f"Non-finite history: {name}", is_infinite(value) | F.isnan(value)))
        if name not in ("installment_mean_signed_delay", "card_current_balance"):
            rules.append(Rule(f"Negative history: {name}", value < 0))
        if name.endswith(("_count", "_months", "_365d")):
            rules.append(Rule(f"Invalid history count: {name}", value.isNull() | (value % 1 != 0)))
        if name.endswith(("_rate", "_ratio")):
            rules.append(Rule(f"Invalid history fraction: {name}", value > 1))
    return rules


def snapshot_extra_columns() -> list[Column]:
    """External scores, inquiry windows and goods ratio of the application snapshot."""
    scores = [F.col(s).try_cast("double") for s in EXTERNAL_SCORES]
    inquiries = [F.col(w).try_cast("double") for w in INQUIRY_WINDOWS]
    all_missing = F.lit(True)
    for value in inquiries:
        all_missing = all_missing & value.isNull()
    return [
        *[s.alias(n) for s, n in zip(scores, EXTERNAL_SCORES)],
        *[s.isNull().cast("int").alias(f"{n.lower()}_missing") for s, n in zip(scores, EXTERNAL_SCORES)],
        all_missing.cast("int").alias("credit_bureau_inquiry_history_missing"),
        F.col("AMT_REQ_CREDIT_BUREAU_MON").try_cast("double").alias("credit_bureau_inquiries_1m"),
        F.col("AMT_REQ_CREDIT_BUREAU_QRT").try_cast("double").alias("credit_bureau_inquiries_3m"),
        F.col("AMT_REQ_CREDIT_BUREAU_YEAR").try_cast("double").alias("credit_bureau_inquiries_12m"),
        ratio(F.col("AMT_CREDIT").try_cast("double"), F.col("AMT_GOODS_PRICE").try_cast("double")).alias("loan_to_goods_price_ratio"),
    ]


def snapshot_extras(raw: DataFrame) -> DataFrame:
    return raw.select(ID, *snapshot_extra_columns())


def snapshot_rules() -> list[Rule]:
    rules = []
    numeric = EXTERNAL_SCORES + INQUIRY_WINDOWS + ["AMT_GOODS_PRICE", "AMT_CREDIT"]
    for name in numeric:
        rules.append(Rule(f"Unparseable number: {name}", malformed(F.col(name))))
    for name in EXTERNAL_SCORES:
        rules.append(Rule(f"External score outside [0,1]: {name}", ~F.col(name).try_cast("double").between(0, 1)))
    for name in INQUIRY_WINDOWS:
        rules.append(Rule(f"Negative inquiry count: {name}", F.col(name).try_cast("double") < 0))
    goods = F.col("AMT_GOODS_PRICE").try_cast("double")
    rules.append(Rule("Goods price must be observed and positive", goods.isNull() | (goods <= 0)))
    rules.append(Rule("Requested credit must be observed", F.col("AMT_CREDIT").try_cast("double").isNull()))
    return rules


def mixed_missingness(raw: DataFrame) -> DataFrame:
    """Rows in which some, but not all, inquiry windows are unknown."""
    nulls = sum((F.col(w).isNull().cast("int") for w in INQUIRY_WINDOWS), F.lit(0))
    mixed = (nulls > 0) & (nulls < len(INQUIRY_WINDOWS))
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(nulls == len(INQUIRY_WINDOWS)).alias("all_missing_rows"),
        F.count_if(mixed).alias("mixed_missing_rows"),
    )


def narrower_contract(features: list[str], dropped: set[str]) -> list[str]:
    """Contract without the named features; the order of the rest is kept."""
    unknown = dropped - set(features)
    if unknown:
        raise ContractError(f"Cannot drop unknown features: {sorted(unknown)}")
    return [f for f in features if f not in dropped]


def research_dataset(raw: DataFrame, dropped: Collection[str] = EXTERNAL_FEATURES) -> DataFrame:
    """Eligible rows with the short contract and the snapshot extras, without the features in ``dropped``.

    One projection of ``raw``; the label is kept where there is one.
    """
    rows = adapt_applications(raw.withColumn("_extras", F.struct(*snapshot_extra_columns())), ["_extras"])
    rows = rows.where(F.col("reason").isNull()).select("*", "_extras.*")
    extras = rows.schema["_extras"].dataType.names
    known = [c for c in (ID, LABEL) if c in rows.columns]
    return rows.select(*known, *narrower_contract([*LITE, *extras], set(dropped)))


def label_rules(label: str = LABEL) -> list[Rule]:
    known = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return [Rule("TARGET must be binary and nonmissing", ~known)]


def union_snapshots(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labeled and unlabeled applications in one table with a source tag."""
    return train.withColumn("IS_TRAIN", F.lit(1)).unionByName(
        test.withColumn("IS_TRAIN", F.lit(0)), allowMissingColumns=True
    )


def overlap(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Ids present on both sides; must be empty for train and test."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def quote_reasons(requests: DataFrame, quotes: DataFrame, *, on: str, currency: str, product: str) -> DataFrame:
    """Pair each request with its trusted quote and name the first disagreement.

    ``requests`` carries application_id, application_version, as_of,
    product_code, currency, quote_id and the two amounts; ``quotes`` the same
    identifiers and amounts plus expires_at.  Timestamps are ISO text.
    """
    meta = ["application_id", "application_version", "as_of", "product_code", "currency", "quote_id"]
    same = ["application_id", "application_version", "quote_id", "currency"]
    amounts = ["requested_amount", "quoted_monthly_payment"]
    right = quotes.select(on, F.lit(True).alias("_quoted"), *[F.col(k).alias(f"q_{k}") for k in same + amounts],
                          F.col("expires_at").alias("q_expires_at"))
    joined = requests.join(right, on, "left")
    uuid = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
    zoned = r"(Z|[+-]\d{2}:?\d{2})$"
    utc = r"(Z|[+-]00:?00)$"
    asof_text, expiry_text = F.col("as_of").cast("string"), F.col("q_expires_at").cast("string")
    asof, expiry = F.try_to_timestamp(asof_text), F.try_to_timestamp(expiry_text)
    missing = F.lit(False)
    for m in meta:
        missing = missing | F.col(m).isNull()
    identity = (
        ~F.col("application_id").cast("string").rlike(uuid) | ~F.col("quote_id").cast("string").rlike(uuid)
        | asof.isNull() | F.col("_quoted").isNull() | expiry.isNull()
    )
    rules = [
        Rule("Missing request metadata", missing),
        Rule("Invalid request identity, timestamp or quote", identity),
        Rule("as_of must be timezone-aware UTC", ~asof_text.rlike(utc) | ~expiry_text.rlike(zoned)),
        Rule("application_version must be a positive integer", F.col("application_version") < 1),
        Rule("Unsupported product/currency", (F.col("product_code") != product) | (F.col("currency") != currency)),
        Rule("Expired quote at decision time", expiry <= asof),
    ]
    for k in same:
        equal = F.col(k).cast("string").eqNullSafe(F.col(f"q_{k}").cast("string"))
        rules.append(Rule(f"Quote mismatch: {k}", ~equal))
    for k in amounts:
        equal = F.col(k).cast("decimal(20,4)") == F.col(f"q_{k}").cast("decimal(20,4)")
        rules.append(Rule(f"Quote mismatch: {k}", ~F.coalesce(equal, F.lit(False))))
    return joined.select(on, first_reason(rules).alias("reason"))

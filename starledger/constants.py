"""Fixed values.

The reports must give the same answers as the reference, so these values
equal the reference's: output labels, the fiscal calendar shift, the
lifetime-value horizon, the segmentation percentiles and the default
parameters of the parameterised reports.
"""

# --- fixed values (must equal the reference's) -------------------------------
FISCAL_YEAR_SHIFT_MONTHS = 4  # fiscal year = year(date + 4 months): September to August
MISSING_LABEL = "N/A"
BADGE_GOLD = "Gold"
BADGE_SILVER = "Silver"
DEFAULT_MARKET = "India"
DEFAULT_BADGE_THRESHOLD = 5_000_000
SEGMENT_HIGH = "High Value"
SEGMENT_MEDIUM = "Medium Value"
SEGMENT_LOW = "Low Value"
OTHER_MARKETS = "Other Markets"
HIGH_VALUE_REVENUE = 100_000_000
MEDIUM_VALUE_REVENUE = 50_000_000
CLV_YEARS = 3
DAYS_PER_YEAR = 365
SEGMENT_PERCENTILES = (0.8, 0.5)
AT_RISK_MONTHS = 6
CHURN_LOOKBACK_MONTHS = 12
LOG_RETENTION_DAYS = 5
FULL_ACCURACY_PCT = 100

"""Run parameters and the fixed domain constants of the analysis.

``ExperimentConfig`` replaces the notebook widgets of the original workflow:
experiment identity, analysis window, platform, significance level, filters
and winsorization switch.  Everything downstream takes a config object, so a
run is fully described by one immutable value.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original workflow's constants for the
# results to agree; they are listed here plainly, in natural order.
# ---------------------------------------------------------------------------

# E-commerce registers.
ECOMM_REGISTERS = (99, 104, 173, 174, 999)

# In-store registers: 1-20, 49-54, 93-98, 116-125, 151-154, 175-182, 195-198.
STORE_REGISTERS = (
    tuple(range(1, 21)) + tuple(range(49, 55)) + tuple(range(93, 99))
    + tuple(range(116, 126)) + tuple(range(151, 155)) + tuple(range(175, 183))
    + tuple(range(195, 199))
)

# Fuel registers: 44-46, 59-78.
FUEL_REGISTERS = (44, 45, 46) + tuple(range(59, 79))

# Register allow-list used for the SNAP exposure filter (it omits 104).
SNAP_FILTER_REGISTERS = tuple(r for r in ECOMM_REGISTERS + STORE_REGISTERS if r != 104)

# Transaction line filters.
REV_DTL_SUBTYPES = (0, 6, 7)

# Category exclusions (category builder) and the AGP builder's department rule.
CATEGORY_EXCLUDED_DEPARTMENTS = ("339", "347")
CATEGORY_EXCLUDED_GROUPS = ("0", "2", "98", "99")
AGP_EXCLUDED_DEPARTMENTS = ("339",)
AGP_MAX_GROUP_EXCLUSIVE = 99

# Click-hit rules.
EXCLUDED_HIT_SOURCES = (5, 7, 8, 9)
EVENT_CART_ADD = "12"
EVENT_COUPON_CLIP = "20305"
EVENT_SEARCH = "200"

# Offer re-classification subtypes (clips use the combined label, redemptions
# list the two words separately).
CLIP_PZN_SUBTYPES = ("MEAT SEAFOOD", "PRODUCE", "DAIRY", "FROZEN")
REDEMPTION_PZN_SUBTYPES = ("MEAT", "SEAFOOD", "PRODUCE", "DAIRY", "FROZEN")
OFFER_TYPES = ("PD", "GR", "MF", "SPD", "PZN", "SC")

# Fuel: own stations are partner 9999, partner 3001 multiplier 0.0395, others 0.035,
# division 15 excluded; fuel points convert to dollars at 0.01.
OWN_FUEL_PARTNER = 9999
PARTNER_MULTIPLIER_SPECIAL = (3001, 0.0395)
PARTNER_MULTIPLIER_DEFAULT = 0.035
FUEL_EXCLUDED_DIVISION = 15
FUEL_POINTS_TO_DOLLARS = 0.01
SCD_OPEN_END = "9999-12-31"

# Bonus points: dollars per point and the base offers that are not bonus.
BONUS_POINTS_TO_DOLLARS = 0.015
BASE_POINT_OFFERS = (44646442, 64035934, 90120515)

# Primary-platform cut-offs, look-backs.
PLATFORM_UMA_BELOW = 0.3
PLATFORM_WEB_ABOVE = 0.7
REWARDS_LOOKBACK_DAYS = 84
SEGMENT_LOOKBACK_WEEKS = 12

# Winsor level and SRM cut-off.
WINSOR_QUANTILE = 0.99
SRM_ALPHA = 0.01

# Basket health grades.
BASKET_GRADES = ("A - PERFECT", "B - GREAT", "C - ACCEPTABLE", "D - NEEDS_IMPROVEMENT", "E - POOR")

# Profile placeholder tokens meaning "missing".
EMAIL_PLACEHOLDERS = ("L/km",)
PHONE_PLACEHOLDERS = ("O/zG",)
FIRST_NAME_PLACEHOLDERS = (
    "i/ss", "5mPP5n BVAcZ63Un", "o1iORzK", "o8B Gyfvt0uf", "4k5j", "IWlXYgMw", "kAeT", "Ht5k", "4xVEbcd", "KyF",
)
LAST_NAME_PLACEHOLDERS = ("i/ss", "Z5kY4REK", "8m2ZAuy", "IWlXYgMw", "kAeT", "5mPP5n BVAcZ63Un", "o9O")
BIRTH_DATE_PLACEHOLDERS = ("i/ss",)

# Segment labels.
FACTS_LATEST_LABELS = {(1, 2): "Elite and Best", (3, 4): "Good", (5, 6): "Occasional"}
FACTS_MODE_LABELS = {(1, 2): "1.Elite and Best", (3, 4): "2.Good", (5, 6): "3.Occasional"}
FACTS_MODE_DETAIL_LABELS = {(1,): "1.Elite", (2,): "2.Best", (3, 4): "3.Good", (5, 6): "4.Occasional"}
MYNEEDS_LABELS = {
    1: "1.Easy Shoppers", 2: "2.Easy Eaters", 3: "3.Healthy Foodies",
    4: "4.Scratch Foodies", 5: "5.Chasing Price", 6: "6.One-Stop Low Price",
}
BNC_SEGMENT = "BNC TO ECOMM"

# Variant labels; A is the control.
VARIANT_LETTERS = "ABCDEFGHI"
CONTROL_VARIANT = "VARIANT A"

PLATFORMS = ("Adobe", "Decision Engine", "Push", "Email", "Household IDs")
EXPOSURE_FILTERS = ("None", "BNC", "SNAP", "Page or OS platform", "Custom")


def variant_label(letter: str) -> str:
    return f"VARIANT {letter}"


@dataclass(frozen=True)
class ExperimentConfig:
    """Parameters of one experiment analysis run.

    Dates are ISO strings.  ``start``/``end`` bound the analysis stage
    inclusively (the original analysis notebook compares ``<= end``); the
    builders use the half-open window ``[start, end + 1 day)``.
    """

    experiment_id: str
    start: str
    end: str
    platform: str = "Household IDs"
    alpha: float = 0.1
    winsorize: bool = True
    winsor_quantile: float = WINSOR_QUANTILE
    # percentile_approx accuracy; rank error is at most n / accuracy.
    percentile_accuracy: int = 100_000
    # Thresholds by counting refinement instead of the sketch: exact at any n, for a few more passes over the units.
    exact_percentile: bool = False
    page_filter: tuple[str, ...] = ()
    os_platforms: tuple[str, ...] = ()
    excluded_banners: tuple[str, ...] = ()
    exposure_filter: str = "None"
    two_controls: bool = False
    control: str = CONTROL_VARIANT
    # Time zones of event and visit time stamps.
    event_zone: str = "UTC"
    visit_zone: str = "UTC"

    def __post_init__(self) -> None:
        if self.platform not in PLATFORMS:
            raise ValueError(f"unknown platform {self.platform!r}; expected one of {PLATFORMS}")
        if self.exposure_filter not in EXPOSURE_FILTERS:
            raise ValueError(f"unknown exposure filter {self.exposure_filter!r}")
        s, e = _dt.date.fromisoformat(self.start), _dt.date.fromisoformat(self.end)
        if e < s:
            raise ValueError("end date precedes start date")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must be in (0, 1)")

    @property
    def unit_col(self) -> str:
        """Unit of analysis: the web visitor for the click-stream platform, else the household."""
        return "ADOBE_VISITOR_ID" if self.platform == "Adobe" else "HOUSEHOLD_ID"

    @property
    def end_exclusive(self) -> str:
        return (_dt.date.fromisoformat(self.end) + _dt.timedelta(days=1)).isoformat()

    @property
    def ci_level(self) -> float:
        return 1.0 - self.alpha

    def clamp_end(self, today: _dt.date) -> "ExperimentConfig":
        """End-date clamp: an end on or after ``today`` becomes yesterday."""
        e = _dt.date.fromisoformat(self.end)
        if e >= today:
            from dataclasses import replace

            return replace(self, end=(today - _dt.timedelta(days=1)).isoformat())
        return self


@dataclass(frozen=True)
class RefreshWindow:
    """Window of a metric refresh (builders).  ``start`` inclusive, ``end`` exclusive."""

    start: str
    end: str
    selection: str = "SAFE"
    experiment_id: str = ""

    @staticmethod
    def resolve(selection: str = "SAFE", start: str = "", end: str = "", experiment_id: str = "",
                today: _dt.date | None = None, zone: str = "UTC") -> "RefreshWindow":
        """Validate refresh inputs and fill default windows (365 days Power, 90 otherwise) up to today in ``zone``."""
        if selection not in ("SAFE", "Power", "Attributes"):
            raise ValueError(f"unknown metric selection {selection!r}")
        if experiment_id and (not start or not end):
            raise ValueError("a custom experiment id needs both start and end dates")
        if selection == "Attributes" and experiment_id:
            raise ValueError("attribute runs take no experiment id")
        if bool(start) != bool(end):
            raise ValueError("give both start and end dates, or neither")
        if start and end and not experiment_id:
            raise ValueError("dates given without an experiment id")
        if not start:
            today = today or _dt.datetime.now(ZoneInfo(zone)).date()
            days = 365 if selection == "Power" else 90
            start, end = (today - _dt.timedelta(days=days)).isoformat(), today.isoformat()
        return RefreshWindow(start=start, end=end, selection=selection, experiment_id=experiment_id)

    def table_name(self, kind: str, database: str) -> str:
        """Output routing: the name under which the analysis looks for the table."""
        from expkit.sources.sinks import metric_table

        return metric_table(kind, database, self.experiment_id)


# Configuration used by the driver-checked queries and the bench: the test
# tables hold orders from 1995 to 2001; 1997 is a full year inside that span.
DEMO_CONFIG = ExperimentConfig(
    experiment_id="DE-42", start="1997-01-01", end="1997-12-31", platform="Household IDs", alpha=0.1,
    event_zone="America/Boise", visit_zone="America/Denver",
)
DEMO_WEB_CONFIG = ExperimentConfig(
    experiment_id="777", start="1997-01-01", end="1997-12-31", platform="Adobe", alpha=0.1,
)

"""Level orders, rule tables and labels that results depend on."""

from __future__ import annotations

# Attribute levels in order; the first level is the regression base.
SURVEY_LEVELS: dict[str, list[str]] = {
    "format": ["Instant", "Capsule", "Ground", "Whole bean"],
    "strength": ["Mild", "Medium", "Dark"],
    "origin": ["House blend", "100% Arabica blend", "Single-origin"],
    "sustainability": ["No", "Yes"],
}

# Price points counted in the full factorial design.
SURVEY_PRICE_LEVELS = 4

# Numeric product attributes that enter the position map.
PRODUCT_ATTRIBUTES = [
    "num_servings",
    "price",
    "price_100g",
    "strength_level",
    "is_decaf",
    "sustainability_claim",
    "convenience",
    "authenticity",
    "premium",
    "perceived_sustainability",
    "taste_quality",
]

# Name pattern -> brand, tried in this order.
BRAND_RULES = [
    ("Costa", "Costa"),
    ("illy", "illy"),
    ("KENCO", "KENCO"),
    ("Lavazza", "Lavazza"),
    ("Nescafe", "Nescafe"),
    ("Starbucks", "Starbucks"),
    ("Taylors", "Taylors"),
    ("TescoFinest", "TescoFinest"),
]

# The box on the position map that counts as the target zone.
TARGET_ZONE = {"PC1": (0.25, 1.25), "PC2": (-0.35, 1.10)}

# Demographics shared by customers and prospects.
DEMOGRAPHICS = ["Married", "HouseholdSize", "Income", "Age", "Work", "Education"]

# Variables of the cluster model.
CLUSTER_VARIABLES = [
    "Recency",
    "Frequency",
    "LogMonetary",
    "LogAvgBasketValue",
    "LogTotalQuantity",
    "CategoryDiversity",
    "ProductDiversity",
    "FocusBuyer",
    "LogFocusSpend",
    "LogFocusQuantity",
    "FocusShare",
    "Income",
    "Age",
    "HouseholdSize",
]

# Variables tested for separation between clusters.
ANOVA_VARIABLES = [
    "Recency",
    "Frequency",
    "Monetary",
    "AvgBasketValue",
    "CategoryDiversity",
    "ProductDiversity",
    "FocusSpend",
    "FocusQuantity",
    "FocusShare",
    "Income",
    "Age",
    "HouseholdSize",
]

# Predictors of log spend in the influence check.
INFLUENCE_PREDICTORS = [
    "Frequency",
    "Recency",
    "CategoryDiversity",
    "ProductDiversity",
    "FocusSpend",
    "Income",
    "Age",
    "HouseholdSize",
]


def cluster_labels(focus: str = "focus") -> dict[str, str]:
    """Role -> label. The loyal role is the primary target, the committed one the secondary."""
    return {
        "loyal": f"High-value {focus} loyalists",
        "committed": f"Committed {focus} buyers",
        "inactive": "Low-value inactive customers",
        "general": "General grocery shoppers",
    }

"""Fixed values the oracle compares with: label texts, keywords and Tier B constants.

Stated here a second time on purpose: the oracle imports nothing from the library, so a
wrong text there shows as a mismatch.
"""

# Label texts by column, in evaluation order, default last.
LABELS = {
    "competitive_position": (
        "🏆 Dominant Market Position",
        "💰 Strong Price Advantage",
        "⚖️ Competitive Parity",
        "🔴 Price Disadvantage",
        "📊 Neutral Position",
    ),
    "promotional_environment": (
        "⚠️ Competitor Promotional Pressure",
        "🎯 Competitor Promo Activity",
        "📊 Standard Competitive Environment",
    ),
    "value_proposition": (
        "💎 Premium Value Proposition",
        "⭐ Quality Advantage",
        "✅ Quality Parity",
        "📈 Quality Improvement Opportunity",
    ),
    "brand_position_strength": (
        "🏆 Premium Brand Leader",
        "💎 Premium Positioning",
        "📊 Mid-tier Positioning",
        "📈 Market Position Development",
    ),
    "campaign_performance_tier": (
        "🏆 Excellent Campaign ROI",
        "✅ Good Campaign Performance",
        "📊 Average Campaign Performance",
        "📉 Poor Campaign Performance",
    ),
    "discount_efficiency": (
        "💰 High Discount High Return",
        "🔴 High Discount Low Return",
        "💎 Efficient Campaign",
        "📊 Standard Campaign",
    ),
    "retention_performance": (
        "🔁 Excellent Customer Retention",
        "✅ Good Customer Retention",
        "📊 Standard Customer Retention",
        "📈 Low Customer Retention",
    ),
    "acquisition_effectiveness": (
        "🎯 Efficient Customer Acquisition",
        "📈 Good Customer Acquisition",
        "📊 Standard Acquisition",
        "📉 Low Acquisition Campaign",
    ),
    "sensitivity_classification": (
        "🔴 Highly Price Sensitive",
        "⚠️ Moderately Price Sensitive",
        "💎 Low Price Sensitivity",
    ),
    "pricing_strategy": (
        "📈 Strong Price Increase Opportunity",
        "💰 Price Increase Opportunity",
        "🎯 Strategic Price Decrease",
        "📉 Price Reduction Recommended",
        "⚖️ Maintain Current Pricing",
    ),
    "revenue_opportunity_level": (
        "🚀 High Revenue Impact Potential",
        "📈 Significant Revenue Impact",
        "📊 Moderate Revenue Impact",
        "📉 Minimal Revenue Impact",
    ),
    "price_optimization_status": (
        "💰 Under-priced Product",
        "💸 Over-priced Product",
        "✅ Optimally Priced",
    ),
    "campaign_priority_tier": (
        "🚀 High Impact Low Cost",
        "⭐ High Impact Campaign",
        "📈 Good Impact Campaign",
        "📊 Moderate Impact Campaign",
        "📉 Low Impact Campaign",
    ),
    "competitive_intensity": (
        "⚔️ Competitive Battleground",
        "⚠️ High Competitive Response Expected",
        "📊 Moderate Competition",
        "✅ Low Competitive Pressure",
    ),
    "discount_strategy": (
        "💸 Deep Discount Strategy",
        "💰 High Value Discount",
        "📊 Standard Discount",
        "💎 Premium Pricing Strategy",
    ),
    "budget_scale": (
        "💰 Major Campaign Investment",
        "💸 Significant Campaign Budget",
        "💵 Standard Campaign Budget",
        "💳 Limited Budget Campaign",
    ),
    "duration_strategy": (
        "📅 Extended Campaign Period",
        "🗓️ Standard Campaign Period",
        "⚡ Short Campaign Period",
        "🚀 Flash Campaign",
    ),
}

# Intents in evaluation order with their keywords.
KEYWORDS = {
    "competitor_tracking": (
        "competitor", "rakip", "competition", "price", "fiyat", "pricing", "market", "pazar", "positioning", "konum", "comparison", "karşılaştırma", "advantage", "avantaj",
    ),
    "campaign_performance": (
        "campaign", "kampanya", "promotion", "roi", "kar", "return", "marketing", "pazarlama", "discount", "indirim", "performance", "başarı", "effectiveness", "etkinlik",
    ),
    "price_elasticity": (
        "elasticity", "elastikiyet", "optimization", "optimal", "optimum", "demand", "talep", "sensitivity", "hassasiyet", "revenue", "gelir", "margin", "kar",
    ),
    "promotional_calendar": (
        "calendar", "takvim", "schedule", "planning", "planlama", "future", "gelecek", "budget", "bütçe", "timeline", "zaman", "seasonal", "mevsimsel",
    ),
}
DEFAULT_INTENT = "competitor_tracking"

# Accepted report names.
ALIASES = {
    "competitor_tracking": "competitor_tracking",
    "competitor_analysis": "competitor_tracking",
    "campaign_performance": "campaign_performance",
    "campaign_analysis": "campaign_performance",
    "price_elasticity": "price_elasticity",
    "price_optimization": "price_elasticity",
    "promotional_calendar": "promotional_calendar",
    "promotional_planning": "promotional_calendar",
}

# Tier B constants (definitions of our own).
LATE_DAYS = 30
COST_SHARE = 0.6
GRID = (0.8, 0.05, 9)  # first factor, step, count
SCORE_WEIGHTS = {"volume": 0.4, "return_rate": 0.3, "price_level": 0.3}
FREIGHT = (0.02, 0.15)  # of the list value, a unit
# priority, rule, price from, price below, size from, size to, change in percent
PRICE_RULES = (
    (1, "clearance_small", 0.0, 1000.0, 1, 5, -15.0),
    (2, "premium_large", 1800.0, 1000000000000.0, 40, 50, 8.0),
    (3, "budget_band", 0.0, 1000.0, 1, 50, -5.0),
    (4, "mid_band", 1000.0, 1500.0, 1, 50, 2.0),
    (5, "upper_band", 1500.0, 1000000000000.0, 1, 50, 4.0),
)

# Market rules: name, priority, change in percent, gap from and to, demand from and to (None: open).
MARKET_RULES = (("raise", 0, 5.0, None, 0.0, 150.0, None), ("match", 10, -8.0, 5.0, None, None, None), ("clear", 20, -12.0, None, None, None, 60.0))

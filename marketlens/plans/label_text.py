"""Label texts of the four reports.

Fixed values: these strings must equal the reference's labels byte for byte
(emoji included; some symbols are followed by the emoji variation selector U+FE0F).
Listed per column, branches in evaluation order, default last.
"""

# ---- fixed values: competitor tracking ---------------------------------------
DOMINANT = "🏆 Dominant Market Position"
STRONG_ADVANTAGE = "💰 Strong Price Advantage"
PARITY = "⚖️ Competitive Parity"
DISADVANTAGE = "🔴 Price Disadvantage"
NEUTRAL = "📊 Neutral Position"

PROMO_PRESSURE = "⚠️ Competitor Promotional Pressure"
PROMO_ACTIVITY = "🎯 Competitor Promo Activity"
STANDARD_ENVIRONMENT = "📊 Standard Competitive Environment"

PREMIUM_VALUE = "💎 Premium Value Proposition"
QUALITY_ADVANTAGE = "⭐ Quality Advantage"
QUALITY_PARITY = "✅ Quality Parity"
QUALITY_OPPORTUNITY = "📈 Quality Improvement Opportunity"

BRAND_LEADER = "🏆 Premium Brand Leader"
PREMIUM_POSITIONING = "💎 Premium Positioning"
MIDTIER_POSITIONING = "📊 Mid-tier Positioning"
POSITION_DEVELOPMENT = "📈 Market Position Development"

# ---- fixed values: campaign performance --------------------------------------
ROI_EXCELLENT = "🏆 Excellent Campaign ROI"
ROI_GOOD = "✅ Good Campaign Performance"
ROI_AVERAGE = "📊 Average Campaign Performance"
ROI_POOR = "📉 Poor Campaign Performance"

HIGH_DISCOUNT_HIGH_RETURN = "💰 High Discount High Return"
HIGH_DISCOUNT_LOW_RETURN = "🔴 High Discount Low Return"
EFFICIENT_CAMPAIGN = "💎 Efficient Campaign"
STANDARD_CAMPAIGN = "📊 Standard Campaign"

RETENTION_EXCELLENT = "🔁 Excellent Customer Retention"
RETENTION_GOOD = "✅ Good Customer Retention"
RETENTION_STANDARD = "📊 Standard Customer Retention"
RETENTION_LOW = "📈 Low Customer Retention"

ACQUISITION_EFFICIENT = "🎯 Efficient Customer Acquisition"
ACQUISITION_GOOD = "📈 Good Customer Acquisition"
ACQUISITION_STANDARD = "📊 Standard Acquisition"
ACQUISITION_LOW = "📉 Low Acquisition Campaign"

# ---- fixed values: price elasticity ------------------------------------------
SENSITIVITY_HIGH = "🔴 Highly Price Sensitive"
SENSITIVITY_MODERATE = "⚠️ Moderately Price Sensitive"
SENSITIVITY_LOW = "💎 Low Price Sensitivity"

STRONG_INCREASE = "📈 Strong Price Increase Opportunity"
INCREASE = "💰 Price Increase Opportunity"
STRATEGIC_DECREASE = "🎯 Strategic Price Decrease"
DECREASE = "📉 Price Reduction Recommended"
MAINTAIN = "⚖️ Maintain Current Pricing"

IMPACT_HIGH = "🚀 High Revenue Impact Potential"
IMPACT_SIGNIFICANT = "📈 Significant Revenue Impact"
IMPACT_MODERATE = "📊 Moderate Revenue Impact"
IMPACT_MINIMAL = "📉 Minimal Revenue Impact"

UNDER_PRICED = "💰 Under-priced Product"
OVER_PRICED = "💸 Over-priced Product"
OPTIMALLY_PRICED = "✅ Optimally Priced"

# ---- fixed values: promotional calendar --------------------------------------
HIGH_IMPACT_LOW_COST = "🚀 High Impact Low Cost"
HIGH_IMPACT = "⭐ High Impact Campaign"
GOOD_IMPACT = "📈 Good Impact Campaign"
MODERATE_IMPACT = "📊 Moderate Impact Campaign"
LOW_IMPACT = "📉 Low Impact Campaign"

BATTLEGROUND = "⚔️ Competitive Battleground"
HIGH_RESPONSE = "⚠️ High Competitive Response Expected"
MODERATE_COMPETITION = "📊 Moderate Competition"
LOW_PRESSURE = "✅ Low Competitive Pressure"

DEEP_DISCOUNT = "💸 Deep Discount Strategy"
HIGH_VALUE_DISCOUNT = "💰 High Value Discount"
STANDARD_DISCOUNT = "📊 Standard Discount"
PREMIUM_PRICING = "💎 Premium Pricing Strategy"

BUDGET_MAJOR = "💰 Major Campaign Investment"
BUDGET_SIGNIFICANT = "💸 Significant Campaign Budget"
BUDGET_STANDARD = "💵 Standard Campaign Budget"
BUDGET_LIMITED = "💳 Limited Budget Campaign"

DURATION_EXTENDED = "📅 Extended Campaign Period"
DURATION_STANDARD = "🗓️ Standard Campaign Period"
DURATION_SHORT = "⚡ Short Campaign Period"
DURATION_FLASH = "🚀 Flash Campaign"

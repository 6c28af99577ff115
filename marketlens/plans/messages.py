"""Message text of insights, keyed by rule code.

Each template is a Java format string over (metric, detail); it is applied with
``format_string`` on the executors, so no row leaves Spark.  English is the
default; ``"tr"`` gives the reference's Turkish texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (code) -> (English, Turkish).  %1$.0f = metric as a count, %1$.1f = metric with one
# decimal, %2$s = detail.  The Turkish column holds fixed values (reference texts).
TEMPLATES: dict[str, tuple[str, str]] = {
    "strong_price_advantage": ("💰 Strong price advantage in %1$.0f rows",
                               "💰 %1$.0f kategoride güçlü fiyat avantajımız var"),
    "price_disadvantage": ("🔴 Price disadvantage in %1$.0f rows",
                           "🔴 %1$.0f kategoride fiyat dezavantajımız bulunuyor"),
    "review_price_disadvantage": ("Revise the strategy in categories with a price disadvantage",
                                  "Fiyat dezavantajı olan kategorilerde strateji revizyonu yapın"),
    "premium_value_proposition": ("💎 Premium value proposition in %1$.0f rows",
                                  "💎 %1$.0f kategoride premium değer önerisi sunuyoruz"),
    "competitor_promo_pressure": ("⚠️ Competitor promotional pressure in %1$.0f rows",
                                  "⚠️ %1$.0f kategoride rakip promosyon baskısı var"),
    "respond_to_competitor_promos": ("Prepare fast responses to competitor promotions",
                                     "Rakip promosyonlarına karşı hızlı response stratejileri geliştirin"),
    "avg_gap_advantage": ("📊 On average %3$.1f%% below competitors",
                          "📊 Ortalama fiyat avantajımız: %%%3$.1f rakiplerden düşük"),
    "avg_gap_disadvantage": ("📊 On average %1$.1f%% above competitors",
                             "📊 Ortalama fiyat dezavantajımız: %%%1$.1f rakiplerden yüksek"),
    "avg_gap_parity": ("⚖️ Average price parity with competitors: %1$.1f%%",
                       "⚖️ Rakiplerle ortalama fiyat paritesi: %%%1$.1f"),
    "top_campaign": ("🏆 Best campaign: %2$s (ROI %1$.1f%%)",
                     "🏆 En başarılı kampanya: %2$s (ROI: %%%1$.1f)"),
    "poor_campaigns": ("📉 %1$.0f campaigns perform poorly",
                       "📉 %1$.0f kampanya düşük performans gösteriyor"),
    "optimize_low_roi_types": ("Analyse and optimise low-ROI campaign types",
                               "Düşük ROI'li kampanya tiplerini analiz edin ve optimize edin"),
    "efficient_acquisition": ("🎯 %1$.0f campaigns acquire customers efficiently",
                              "🎯 %1$.0f kampanya verimli müşteri kazanımı sağlıyor"),
    "excellent_retention": ("🔁 %1$.0f campaigns show excellent retention",
                            "🔁 %1$.0f kampanya mükemmel müşteri tutma oranı gösteriyor"),
    "overall_roi": ("📊 Overall campaign ROI: %1$.1f%%", "📊 Toplam kampanya ROI: %%%1$.1f"),
    "strong_increase_opportunity": ("📈 Strong price increase opportunity in %1$.0f rows",
                                    "📈 %1$.0f kategoride güçlü fiyat artırım fırsatı"),
    "pilot_price_increases": ("Evaluate price increases with pilot tests",
                              "Fiyat artırım fırsatlarını değerlendirin ve pilot testler yapın"),
    "under_priced": ("💰 %1$.0f products priced below their optimum",
                     "💰 %1$.0f ürün kategori optimal fiyatın altında"),
    "optimize_under_priced": ("Optimise prices of under-priced categories",
                              "Under-priced kategorilerde fiyat optimizasyonu yapın"),
    "high_revenue_impact": ("🚀 %1$.0f rows carry high revenue impact potential",
                            "🚀 %1$.0f kategori yüksek gelir etkisi potansiyeli taşıyor"),
    "ab_test_high_impact": ("Start A/B tests where the revenue impact is high",
                            "Yüksek etki potansiyelli kategorilerde A/B testleri başlatın"),
    "low_price_sensitivity": ("💎 %1$.0f rows show low price sensitivity (premium opportunity)",
                              "💎 %1$.0f kategori düşük fiyat hassasiyeti gösteriyor (premium fırsat)"),
    "premium_pricing": ("Consider premium pricing where sensitivity is low",
                        "Düşük hassasiyetli kategorilerde premium pricing stratejileri değerlendirin"),
    "high_impact_low_cost": ("🚀 %1$.0f campaigns are high impact at low cost",
                             "🚀 %1$.0f kampanya yüksek etki düşük maliyet kategorisinde"),
    "execute_high_impact_low_cost": ("Run the high impact, low cost campaigns first",
                                     "High impact low cost kampanyaları öncelikle execute edin"),
    "high_impact_total": ("⭐ %1$.0f high impact campaigns planned",
                          "⭐ Toplam %1$.0f yüksek etkili kampanya planlandı"),
    "competitive_battleground": ("⚔️ %1$.0f campaigns face heavy competition",
                                 "⚔️ %1$.0f kampanya yoğun rekabetli ortamda"),
    "differentiate_battlegrounds": ("Develop differentiation for heavily contested campaigns",
                                    "Yoğun rekabetli kampanyalar için diferansiyasyon stratejileri geliştirin"),
    "total_budget": ("💰 Total planned budget: $%1$,.0f", "💰 Toplam planlanan kampanya bütçesi: $%1$,.0f"),
    "major_investments": ("💰 %1$.0f major investment campaigns planned",
                          "💰 %1$.0f major investment kampanyası planlandı"),
    "flash_campaigns": ("🚀 %1$.0f flash campaigns planned", "🚀 %1$.0f flash kampanya planlandı"),
    "extended_campaigns": ("📅 %1$.0f extended campaigns planned", "📅 %1$.0f uzun dönemli kampanya planlandı"),
    "no_data": ("No pricing data matches the criteria",
                "Belirtilen kriterlere uygun pricing verisi bulunamadı"),
    "widen_criteria": ("Widen the date range or the criteria", "Tarih aralığını veya kriterleri genişletin"),
}
LANGUAGES = ("en", "tr")


def messages(insights: DataFrame, language: str = "en") -> DataFrame:
    """Add a ``message`` column rendered from the templates (argument 3 = |metric|)."""
    i = LANGUAGES.index(language)
    code, metric = F.col("code"), F.col("metric")
    args = (metric, F.coalesce(F.col("detail"), F.lit("")), F.abs(metric))
    text = None
    for c, t in TEMPLATES.items():
        text = (F.when if text is None else text.when)(code == c, F.format_string(t[i], *args))
    return insights.withColumn("message", text.otherwise(F.col("code")))

"""JSON payloads of analyses: price points, dates, fundamental blocks, completeness; and labels of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.text import price_point

# Names of price points, where they may lie, and which fields a report must have.
POINTS = ("ideal_buy", "secondary_buy", "stop_loss", "take_profit")
PLACES = ("$.sniper_points", "$.battle_plan.sniper_points", "$.dashboard.battle_plan.sniper_points")
SCORE_BANDS = {"buy": (60, 79), "hold": (40, 59), "sell": (0, 39)}
ESTIMATE_BANDS = {"buy": (65, 79), "hold": (45, 59), "sell": (20, 39)}


def _filled(c: Column) -> Column:
    """c where it is an object that isn't empty."""
    return F.when(F.ltrim(c).startswith("{") & (F.coalesce(F.size(F.json_object_keys(c)), F.lit(0)) > 0), c)


def price_points(dashboard: Column) -> Column:
    """A struct of the four prices: from the payload itself if it has ideal_buy, else from the first place that isn't empty."""
    direct = F.when(F.array_contains(F.json_object_keys(dashboard), POINTS[0]), dashboard)
    found = F.coalesce(direct, *(_filled(F.get_json_object(dashboard, p)) for p in PLACES))
    return F.struct(*(price_point(F.get_json_object(found, f"$.{p}")).alias(p) for p in POINTS))


def analysis_day(snapshot: Column, created: Column) -> Column:
    """The day that the payload names, else that of creation."""
    text = F.substring(F.get_json_object(snapshot, "$.enhanced_context.date"), 1, 10)
    named = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d"))))
    return F.coalesce(named, F.to_date(created))


def fundamental_context(snapshot: Column, fallback: Column) -> Column:
    """The context's own block, else the stored one; JSON objects only."""
    an_object = lambda c: F.when(F.ltrim(c).startswith("{") & F.json_object_keys(c).isNotNull(), c)
    return F.coalesce(an_object(F.get_json_object(snapshot, "$.enhanced_context.fundamental_context")), an_object(fallback))


def fundamental_details(context: Column) -> Column:
    return F.struct(*(_filled(F.get_json_object(context, f"$.earnings.data.{k}")).alias(to) for k, to in (("financial_report", "financial_report"), ("dividend", "dividend_metrics"))))


def missing_fields(score: Column, advice: Column, summary: Column, decision: Column, dashboard: Column) -> Column:
    """Names of the mandatory fields that a report lacks, in their order."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    alerts = F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(dashboard, "$.intelligence")), "risk_alerts"), F.lit(False))
    checks = {
        "sentiment_score": score.isNull(),
        "operation_advice": blank(advice),
        "analysis_summary": blank(summary),
        "dashboard.core_conclusion.one_sentence": blank(F.get_json_object(dashboard, "$.core_conclusion.one_sentence")),
        "dashboard.intelligence.risk_alerts": ~alerts,
        "dashboard.battle_plan.sniper_points.stop_loss": F.coalesce(decision.isin("buy", "hold"), F.lit(False)) & blank(F.get_json_object(dashboard, "$.battle_plan.sniper_points.stop_loss")),
    }
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())


def chip_status(profit: Column, concentration90: Column, avg_cost: Column, price: Column) -> Column:
    """Three phrases: who is in profit, how concentrated chips are, how the price stands to their cost."""
    who = (
        F.when(profit >= 0.9, "获利盘极高(获利盘>90%)").when(profit >= 0.7, "获利盘较高(获利盘70-90%)").when(profit >= 0.5, "获利盘中等(获利盘50-70%)")
        .when(profit >= 0.3, "套牢盘中等(套牢盘50-70%)").when(profit >= 0.1, "套牢盘较高(套牢盘70-90%)").otherwise("套牢盘极高(套牢盘>90%)")
    )
    c = concentration90
    dense = F.when(c < 0.08, "筹码高度集中").when(c < 0.15, "筹码较集中").when(c < 0.25, "筹码分散度中等").otherwise("筹码较分散")
    gap = (price - avg_cost) * 100 / avg_cost
    says = lambda words: F.format_string(words + "%.1f%%", F.abs(gap))
    stands = F.when((price > 0) & (avg_cost > 0), F.when(gap > 20, says("现价高于平均成本")).when(gap > 5, says("现价略高于成本")).when(gap > -5, "现价接近平均成本").otherwise(says("现价低于平均成本")))
    return F.concat_ws("，", who, dense, stands)


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.75, "高").when(x >= 0.45, "中").otherwise("低")


def _band(signal: Column, bands: dict[str, tuple[int, int]], other: tuple[int, int], k: int) -> Column:
    out = F.lit(other[k])
    for name, band in bands.items():
        out = F.when(signal == name, band[k]).otherwise(out)
    return out


def clamped_score(score: Column, signal: Column) -> Column:
    """The score within the band of a signal that was overridden."""
    return F.greatest(_band(signal, SCORE_BANDS, (0, 100), 0), F.least(_band(signal, SCORE_BANDS, (0, 100), 1), score))


def estimated_score(signal: Column, confidence: Column) -> Column:
    low, high = (_band(signal, ESTIMATE_BANDS, (45, 59), k) for k in (0, 1))
    return F.bround(low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).cast("int")


def downgraded(signal: Column, steps: int = 1) -> Column:
    order = ("buy", "hold", "sell")
    out = signal
    for k, name in enumerate(order):
        out = F.when(signal == name, order[min(len(order) - 1, k + max(0, steps))]).otherwise(out)
    return out


def amplitude_pct(high: Column, low: Column, before: Column) -> Column:
    return F.try_divide((high - low) * 100, before)


def _scaled(x: Column, unit: str) -> Column:
    return F.when(x.isNull(), "N/A").when(x >= 1e8, F.format_string(f"%.2f 亿{unit}", x / 1e8)).when(x >= 1e4, F.format_string(f"%.2f 万{unit}", x / 1e4)).otherwise(F.format_string(f"%.0f {unit}", x))


def shares_text(x: Column) -> Column:
    return _scaled(x, "股")


def money_text(x: Column) -> Column:
    return _scaled(x, "元")


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.2f%%", x))


def whole(text: Column) -> Column:
    """An integer, cut towards zero; null for blanks, dashes and what is no number."""
    t = F.trim(text)
    return F.when(t.isin("", "-", "--"), None).otherwise(t.try_cast("double").try_cast("long"))
